"""Sources and sinks: folder scans, decoding, sheets and price lists, validation, idempotent ingest, upserts and deletes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal_url, strip

EXTENSIONS = ("pdf", "docx", "txt", "xlsx", "xls", "md")
MOST_BYTES, LEAST_CHARS = 50 * 1024 * 1024, 50
# Names of price-list columns by field, and labels of the text made of them.
PRICE_FIELDS = {
    "name": ["product", "product name", "название", "product_name", "наименование", "товар", "услуга"],
    "description": ["component", "описание", "description", "детали"],
    "price": ["price", "цена", "стоимость", "руб", "рублей", "rub", "cost"],
    "category": ["category", "категория", "тип", "вид"],
    "sector": ["sector", "сектор", "отрасль"],
    "code": ["code", "артикул", "sku", "код", "article", "article number"],
    "model": ["model", "модель"],
    "licence_object": ["licenceobject", "licence_object", "объект лицензии"],
}
PRICE_LABELS = {"name": "Продукт/услуга", "code": "Код продукта", "sector": "Сектор", "category": "Категория", "model": "Модель", "description": "Компонент", "licence_object": "Объект лицензии", "price": "Цена"}


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set, a local session makes one for itself; on a cluster that is an error, as each machine would write to its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-loom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so its lineage ends there."""
    path = f"{scratch(df.sparkSession)}/loom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = True) -> DataFrame:
    """(path, filename, extension, size, relative_path, content) of the files with one of the extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    root = folder.rstrip("/")
    out = files.select("path", name.alias("filename"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("extension"), F.col("length").alias("size"), F.regexp_replace(F.substring_index("path", root + "/", -1), "^/+", "").alias("relative_path"), "content")
    return out.where(F.col("extension").isin(*extensions))


def decode(content: Column) -> Column:
    """UTF-8 text without the bytes that are none."""
    return F.translate(F.make_valid_utf8(content.cast("string")), "�", "")


def _cp1251() -> tuple[str, str]:
    pairs = [(chr(b), bytes([b]).decode("cp1251", "ignore")) for b in range(0x80, 0x100)]
    return "".join(a for a, _ in pairs if _), "".join(b for _, b in pairs if b)


def decode_any(content: Column, second: str = "cp1251") -> Column:
    """UTF-8 if it is valid, else cp1251 (as a map over Latin-1) or Latin-1."""
    latin = F.decode(content, "ISO-8859-1")
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.translate(latin, *_cp1251()) if second == "cp1251" else latin)


def sheet_rows(df: DataFrame, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """(row, text): non-empty cells of each row joined, with the sheet's name and the row's number from 1."""
    cells = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns]
    text = F.concat_ws(" | ", *cells)
    return df.select((F.col(order) + 1).alias("row"), F.concat(F.lit(f"[{sheet}] "), (F.col(order) + 1).cast("string"), F.lit(": "), text).alias("text")).where(text != "")


def price_products(df: DataFrame, fields: dict[str, list[str]] | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """Products of a price list with arbitrary column names: each field takes the first filled column whose name has one of its words; the text labels what there is and appends unused columns."""
    fields, labels = fields or PRICE_FIELDS, labels or PRICE_LABELS
    filled = lambda c: F.when(~F.lower(strip(F.col(c).cast("string"))).isin("", "nan", "none"), strip(F.col(c).cast("string")))
    fits = lambda c, words: any(w in c.lower().strip() for w in words)
    nothing = F.lit(None).cast("string")
    value = {f: F.coalesce(*([filled(c) for c in df.columns if fits(c, words)] or [nothing])) for f, words in fields.items()}
    value["name"] = F.coalesce(value["name"], *(F.when(F.length(filled(c)) > 3, filled(c)) for c in df.columns))
    unused = [c for c in df.columns if not fits(c, [w for words in fields.values() for w in words])]
    text = F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), value[f]) for f, label in labels.items()), *(F.concat(F.lit(f"{c}: "), filled(c)) for c in unused))
    return df.select(*(value[f].alias(f) for f in fields), text.alias("text")).where("name is not null")


def validate(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, most: int = MOST_BYTES, least: int = LEAST_CHARS) -> DataFrame:
    """files(extension, size, text) with reject_reason, null for those that pass."""
    reason = F.when(~F.col("extension").isin(*extensions), "extension").when(F.col("size") > most, "size").when(F.coalesce(F.length(strip(F.col("text"))), F.lit(0)) < least, "text")
    return files.withColumn("reject_reason", reason)


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose project and name are not known yet."""
    return files.join(known.select("project_id", "filename").distinct(), ["project_id", "filename"], "left_anti")


def outcomes(files: DataFrame) -> DataFrame:
    """Processed, skipped, failed and all files of each project (outcome column)."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return files.groupBy("project_id").agg(count("processed"), count("skipped"), count("error"), F.count("*").alias("total"))


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """chunks with a stable id by source, index and text."""
    return chunks.withColumn("chunk_id", F.md5(F.concat_ws("_", "source", F.col("chunk_index").cast("string"), F.md5("text"))))


def upsert(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New rows, and those of the existing ones that they don't replace."""
    return new.unionByName(existing.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def replace_source(existing: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """New rows, and existing ones of sources that have none new."""
    return existing.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def delete(tables: dict[str, DataFrame], tombstones: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of deleted keys."""
    gone = tombstones.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def to_index(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that have no vector."""
    return chunks.join(vectors.select("chunk_id").distinct(), "chunk_id", "left_anti")


def to_chunk(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with content that have no chunk."""
    return documents.where(F.length(strip(F.col("content"))) > 0).join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def distinct_sources(chunks: DataFrame) -> DataFrame:
    return chunks.select("source").distinct().orderBy("source")


def allowed(rows: DataFrame, prefixes: DataFrame, url: str = "source") -> DataFrame:
    """Rows whose normalised URL begins with a listed prefix, up to a path boundary: each row is looked up by its own prefixes."""
    own = normal_url(F.col(url))
    parts = F.split(F.regexp_replace(own, r"[?#].*$", ""), "/")
    keys = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    listed = prefixes.select(normal_url(F.col("prefix")).alias("key")).distinct()
    each = rows.select(F.col(url).alias("__u"), F.explode(keys).alias("key")).join(listed, "key", "left_semi").select("__u").distinct()
    return rows.join(each, F.col(url) == F.col("__u"), "left_semi")
