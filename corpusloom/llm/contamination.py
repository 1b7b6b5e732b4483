"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark (13 words, or a shorter item as a whole) form a hash set that is broadcast while its
measured rows and bytes are within BROADCAST_ROWS and BROADCAST_BYTES, and is shuffled beyond them. A window of L words covers one whole block of
(L + 1) // 2 words wherever it lies in a document cut into such blocks, so documents are first screened by the
hashes of their blocks, a few rows a document. Only documents that pass have all their windows compared, as
strings, with the set; where their keys are few enough to be broadcast, no text is moved.

A null or empty text has no words and is clean. Items that are null or have no word are ignored, items of equal
text count each by its id, repeated rows are judged each for itself, an empty benchmark leaves all clean, an empty
table gives an empty result, and extra columns are ignored. A text of any length is compared whole, in time that
grows in proportion to its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: What is broadcast has this many rows and bytes of text at most.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text):
    """Words of a text, A-Z folded."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the text and a hash that tells rows of one id apart."""
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_key"))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row_key"] == b["row_key"])


def _sized(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id string, size, words) for each distinct window of each item."""
    items = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item_id"), words(benchmark[text_col]).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    windows = items.select("item_id", size.alias("size"), F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {window} + 1, 1)), i -> slice(w, i, {window}))")).alias("words"))
    return windows.distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with n_words; hits as doc_id, row_key, start, size, phrase; items of each phrase as phrase, item_id). Words count from 0."""
    wins = cut(benchmark_windows(benchmark, window, item_col, text_col).select("item_id", "size", "words", F.concat_ws(" ", "words").alias("phrase")), "bench")
    phrases = wins.select("size", "phrase").distinct()
    measured = phrases.groupBy("size").agg(F.count("*").alias("n"), F.sum(F.octet_length("phrase")).alias("bytes")).collect()  # one row per size, 13 at most
    sizes, weight = {r["size"]: r["n"] for r in measured}, sum(r["bytes"] for r in measured)
    blocks = sorted({(s + 1) // 2 for s in sizes})
    hashes = [F.expr(f"transform(sequence(1, n_words - n_words % {b}, {b}), i -> xxhash64({b}, slice(w, i, {b})))") for b in blocks]
    empty = F.expr("cast(array() as array<bigint>)")
    screened = _keyed(docs, id_col, text_col).withColumn("w", words(F.col("text"))).withColumn("n_words", F.size("w").cast("long"))
    screened = screened.select("doc_id", "row_key", "n_words", *(F.when(F.col("n_words") >= b, h).otherwise(empty).alias(f"b{b}") for b, h in zip(blocks, hashes, strict=True)))
    base = cut(screened.withColumn("blocks", F.concat(empty, *(F.col(f"b{b}") for b in blocks))).select("doc_id", "row_key", "n_words", "blocks"), "words")
    anchors = None
    for b in blocks:
        of = [s for s in sizes if (s + 1) // 2 == b]
        part = wins.where(F.col("size").isin(of)).select(F.explode(F.expr(f"transform(sequence(1, size - {b} + 1), i -> xxhash64({b}, slice(words, i, {b})))")).alias("h"))
        anchors = part if anchors is None else anchors.union(part)
    n = sum(sizes.values())
    if anchors is None:
        anchors = base.sparkSession.createDataFrame([], "h bigint")
    found = base.select("doc_id", "row_key", F.explode("blocks").alias("h")).join(_sized(anchors.distinct(), n * 7), "h", "left_semi").select("doc_id", "row_key").distinct()
    found = cut(found, "found")
    texts = _keyed(docs, id_col, text_col)
    # Rows that agree in id and text give the same hits, which are counted once by their start.
    close = texts.join(_sized(found, found.count()), _same(texts, found), "left_semi").select("doc_id", "row_key", words(F.col("text")).alias("w"))
    by_size = None
    for s in sorted(sizes):
        part = close.where(F.size("w") >= s).select("doc_id", "row_key", F.lit(s).alias("size"), F.posexplode(F.expr(f"transform(sequence(1, size(w) - {s} + 1), i -> concat_ws(' ', slice(w, i, {s})))")).alias("start", "phrase"))
        by_size = part if by_size is None else by_size.union(part)
    if by_size is None:
        by_size = close.select("doc_id", "row_key", F.lit(0).alias("size"), F.lit(0).alias("start"), F.lit("").alias("phrase")).limit(0)
    hits = cut(by_size.join(_sized(phrases, n, weight), ["size", "phrase"], "left_semi").select("doc_id", "row_key", "start", "size", "phrase"), "hits")
    return base, hits, wins.select("phrase", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated, spans (first word, word after the last) for each row."""
    base, hits, items = find_hits(docs, benchmark, window, id_col, text_col, item_col)
    ends = hits.groupBy("doc_id", "row_key", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    # Occurrences overlap; those that overlap or touch form one span, which begins where none before reaches.
    own = Window.partitionBy("doc_id", "row_key").orderBy("start")
    first = F.coalesce(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)) < F.col("start"), F.lit(True))
    islands = ends.withColumn("first", first).withColumn("k", F.sum(F.col("first").cast("int")).over(own)).groupBy("doc_id", "row_key", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = islands.groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")).withColumnsRenamed({"doc_id": "d", "row_key": "r"})
    named = hits.select("doc_id", "row_key", "phrase").distinct().join(items, "phrase").groupBy("doc_id", "row_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    named = named.select(F.col("doc_id").alias("d2"), F.col("row_key").alias("r2"), "items")
    out = base.join(spans, base["doc_id"].eqNullSafe(spans["d"]) & (base["row_key"] == spans["r"]), "left").join(named, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("row_key") == F.col("r2")), "left")
    n_hit = F.coalesce(F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)"), F.lit(0).cast("long"))
    out = out.select("doc_id", "row_key", "n_words", n_hit.alias("n_hit"), F.coalesce(F.col("items"), F.expr("cast(array() as array<string>)")).alias("items"), F.coalesce(F.col("spans"), F.expr("cast(array() as array<struct<start:int, end:int>>)")).alias("spans"))
    return out.select(
        "doc_id", "row_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"), "spans",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit words cut out of every text; columns stay."""
    found = contamination(docs, benchmark, window, id_col, text_col, item_col)
    found = found.where("contaminated" if remove == "documents" else "n_hit > 0").select(F.col("doc_id").alias("__d"), F.col("row_key").alias("__r"), F.col("spans").alias("__s"))
    same = docs[id_col].eqNullSafe(F.col("__d")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__r"))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    between, own = F.split(F.col(text_col), ANY_CASE, -1), F.regexp_extract_all(F.col(text_col), F.lit(ANY_CASE), F.lit(0))
    left = F.zip_with(between, own, lambda b, w: F.struct(b.alias("b"), w.alias("w")))
    shown = F.array_join(F.transform(left, lambda x, i: F.concat(x["b"], F.when(F.exists("__s", lambda s: (i >= s["start"]) & (i < s["end"])), "").otherwise(F.coalesce(x["w"], F.lit(""))))), "")
    out = docs.join(found.dropDuplicates(["__d", "__r"]), same, "left")
    return out.withColumn(text_col, F.when(F.col("__s").isNull(), F.col(text_col)).otherwise(shown)).select(*docs.columns)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (
  select distinct item_id, least(len(w), 13) as size, array_to_string(w[i:i + 12], ' ') as phrase
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
s as (select distinct size from p),
o as (
  select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as phrase
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, s where len(w) >= size)),
h as (select o.doc_id, o.i, o.size, p.item_id from o join p using (size, phrase)),
n as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + size)) as k from (select distinct doc_id, i, size from h)) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join n using (doc_id) left join t using (doc_id)
"""
