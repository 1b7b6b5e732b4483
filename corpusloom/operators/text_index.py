"""A stored BM25 index that is kept up to date: segments of postings by term hash, deltas and tombstones.

    postings/seg=S/part=P   project_id, term, chunk_id, tf, dl    P: hash of the term
    forward/seg=S           project_id, chunk_id, dl, terms       what a chunk put into the postings
    terms/seg=S/part=P      project_id, term, df                  what the segment adds to (or takes from) each df
    tombs/seg=S             chunk_id                              chunks of earlier segments that are gone from S on
    collections/version=V   project_id, n, total, mean            chunks, tokens and mean idf of each project
    manifest/version=V      seg, tombs                            the segments of a version

Adding or deleting chunks writes one segment: df, n and the average length are sums over segments, and what replaced or
deleted chunks had added is taken back from their forward rows, so no text is read again. A version counts once its
manifest is written; a change that fails before leaves the one before it. merge() joins all segments to one.
A search reads the parts of its terms only. Postings are dealt by ranges
of part, project, term and chunk, so neither a large project nor a word that all chunks have meets in one task. Ids are unique within one call; chunks without tokens count in n.

Block-max search cuts the chunks of a project into zones. For each term and zone a block holds the postings and, apart
from them, the most a posting of it can score. A query's best zones are scored first; the k-th score found is the bar
that the bounds of all other zones must reach to be read at all.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut
from .retrieve import EPSILON, as_bm25, asked_terms, counted, impact, top

PARTS = 64
#: Chunks of a zone, about.
ZONE = 16


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def term_part(parts: int):
    return F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")


class TextIndex:
    """An index in a folder. add, delete and merge make versions; of_terms and all_ read one."""

    def __init__(self, spark: SparkSession, folder: str, chunk_kind: str = "bigint", project_kind: str = "string", parts: int = PARTS):
        self.spark, self.folder, self.parts = spark, folder, parts
        p, c = f"project_id {project_kind}", f"chunk_id {chunk_kind}"
        self.schemas = {
            "postings": f"{p}, term string, {c}, tf bigint, dl int, seg int, part int",
            "forward": f"{p}, {c}, dl int, terms array<struct<term: string, tf: bigint>>, seg int",
            "terms": f"{p}, term string, df bigint, seg int, part int",
            "tombs": f"{c}, seg int",
            "collections": f"{p}, n bigint, total bigint, mean double, version int",
        }
        self.version, self.segments, self.tombs = 0, [], 0
        self._open()

    def _open(self) -> None:
        """The latest whole version of the folder, if it has any."""
        try:
            rows = self.spark.read.schema("seg int, tombs bigint, version int").parquet(f"{self.folder}/manifest").collect()  # a row a segment of each version
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        if rows:
            self.version = max(r["version"] for r in rows)
            now = sorted((r for r in rows if r["version"] == self.version), key=lambda r: r["seg"])
            self.segments, self.tombs = [r["seg"] for r in now if r["seg"] >= 0], sum(r["tombs"] for r in now)

    def _read(self, what: str, segments: list[int] | None = None) -> DataFrame:
        segments = self.segments if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], self.schemas[what])
        return self.spark.read.schema(self.schemas[what]).option("basePath", f"{self.folder}/{what}").parquet(*(f"{self.folder}/{what}/seg={s}" for s in segments))

    def _live(self, df: DataFrame) -> DataFrame:
        """Rows of segments without those of chunks that a later segment has replaced or deleted."""
        if not self.tombs:
            return df
        gone = self._read("tombs").groupBy("chunk_id").agg(F.max("seg").alias("from"))
        return df.join(gone, (df["chunk_id"] == gone["chunk_id"]) & (df["seg"] < gone["from"]), "left_anti")

    def collections(self) -> DataFrame:
        """(project_id, n, avgdl, mean)."""
        if not self.version:
            return self.spark.createDataFrame([], self.schemas["collections"]).select("project_id", "n", F.lit(0.0).alias("avgdl"), "mean")
        own = self.spark.read.schema(self.schemas["collections"]).option("basePath", f"{self.folder}/collections").parquet(f"{self.folder}/collections/version={self.version}")
        return own.where("n > 0").select("project_id", "n", (F.col("total") / F.col("n")).alias("avgdl"), "mean")

    def _commit(self, forward: DataFrame, gone: DataFrame | None = None) -> None:
        """A segment of new forward rows (without seg) and of the old ones that they replace or, if given, those of deleted chunks."""
        seg = self.version + 1

        def put(df: DataFrame, what: str, *by: str) -> None:
            df.write.mode("overwrite").parquet(f"{self.folder}/{what}/seg={seg}", partitionBy=list(by) or None)

        put(forward, "forward")
        forward = self._read("forward", [seg]).drop("seg")
        gone = forward if gone is None else gone
        old = cut(self._live(self._read("forward")).join(gone.select("chunk_id").distinct(), "chunk_id", "left_semi").drop("seg"), "index-gone")
        put(old.select("chunk_id"), "tombs")
        each = forward.select("project_id", "chunk_id", "dl", F.inline("terms")).withColumn("part", term_part(self.parts))
        put(each.select("project_id", "term", "chunk_id", "tf", "dl", "part").repartitionByRange("part", "project_id", "term", "chunk_id").sortWithinPartitions("part", "project_id", "term"), "postings", "part")
        sign = each.select("project_id", "term", F.lit(1).cast("long").alias("d")).unionByName(old.select("project_id", F.inline("terms")).select("project_id", "term", F.lit(-1).cast("long").alias("d")))
        df = sign.groupBy("project_id", "term").agg(F.sum("d").alias("df")).where("df <> 0").withColumn("part", term_part(self.parts))
        put(df.repartitionByRange("part", "project_id", "term").sortWithinPartitions("part", "project_id", "term"), "terms", "part")
        segments, tombs = [*self.segments, seg], self.tombs + old.count()
        of = lambda d, s: d.groupBy("project_id").agg((s * F.count("*")).alias("n"), (s * F.sum(F.col("dl").cast("long"))).alias("total"))
        before = [self.spark.read.schema(self.schemas["collections"]).option("basePath", f"{self.folder}/collections").parquet(f"{self.folder}/collections/version={self.version}").select("project_id", "n", "total")] if self.version else []
        sums = of(forward, 1).unionByName(of(old, -1))
        for b in before:
            sums = sums.unionByName(b)
        self._publish(seg, segments, tombs, sums.groupBy("project_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0"))

    def _publish(self, version: int, segments: list[int], tombs: int, sums: DataFrame) -> None:
        """The mean idf follows from how many terms have each df; then the version counts."""
        spread = self._read("terms", segments).groupBy("project_id", "term").agg(F.sum("df").alias("df")).where("df > 0").groupBy("project_id", "df").agg(F.count("*").alias("terms"))
        idf = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        mean = spread.join(sums, "project_id").groupBy("project_id").agg((F.sum(idf * F.col("terms")) / F.sum("terms")).alias("mean"))
        sums.join(mean, "project_id", "left").select("project_id", "n", "total", "mean").write.mode("overwrite").parquet(f"{self.folder}/collections/version={version}")
        rows = [(s, tombs if s == segments[-1] else 0) for s in segments] or [(-1, 0)]
        self.spark.createDataFrame(rows, "seg int, tombs bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        self.version, self.segments, self.tombs = version, segments, tombs

    def add(self, chunks: DataFrame) -> TextIndex:
        """Adds chunks (project_id, chunk_id, text); those whose id is known are replaced."""
        self._commit(counted(chunks))
        return self

    def delete(self, ids: DataFrame) -> TextIndex:
        """Deletes chunks by chunk_id; unknown ids change nothing."""
        self._commit(self.spark.createDataFrame([], self.schemas["forward"]).drop("seg"), ids)
        return self

    def merge(self) -> TextIndex:
        """One segment instead of all, without what is gone."""
        seg = self.version + 1
        self._live(self._read("forward")).drop("seg").write.mode("overwrite").parquet(f"{self.folder}/forward/seg={seg}")
        self._live(self._read("postings")).drop("seg").repartitionByRange("part", "project_id", "term", "chunk_id").sortWithinPartitions("part", "project_id", "term").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/postings/seg={seg}")
        self._read("terms").groupBy("project_id", "term", "part").agg(F.sum("df").alias("df")).where("df <> 0").repartitionByRange("part", "project_id", "term").sortWithinPartitions("part", "project_id", "term").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/terms/seg={seg}")
        self.spark.createDataFrame([], self.schemas["tombs"]).drop("seg").write.mode("overwrite").parquet(f"{self.folder}/tombs/seg={seg}")
        sums = self.spark.read.schema(self.schemas["collections"]).option("basePath", f"{self.folder}/collections").parquet(f"{self.folder}/collections/version={self.version}").select("project_id", "n", "total") if self.version else self.spark.createDataFrame([], "project_id string, n bigint, total bigint")
        self._publish(seg, [seg], 0, sums)
        return self

    def all_(self, parts: list[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(postings, terms, collections) as of `retrieve.bm25_index`, of some parts or all."""
        postings, terms, collections = self._read("postings"), self._read("terms"), self.collections()
        if parts is not None:
            postings, terms = (d.where(F.col("part").isin(parts)) for d in (postings, terms))
        sums = terms.groupBy("project_id", "term").agg(F.sum("df").alias("df")).where("df > 0").join(collections, "project_id")
        idf = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        terms = sums.select("project_id", "term", "df", F.when(idf < 0, EPSILON * F.col("mean")).otherwise(idf).alias("idf"))
        return self._live(postings).drop("seg", "part"), terms, collections.drop("mean")

    def of_terms(self, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The index as far as it bears on the terms asked for: other parts aren't read."""
        parts = [r[0] for r in asked.select(term_part(self.parts).alias("part")).distinct().collect()]  # PARTS at most
        return self.all_(parts)


def build(chunks: DataFrame, folder: str, parts: int = PARTS) -> TextIndex:
    """A new index of chunks."""
    return TextIndex(chunks.sparkSession, folder, _kind(chunks, "chunk_id"), _kind(chunks, "project_id"), parts).add(chunks.select("project_id", "chunk_id", "text"))


def store_blocks(index: TextIndex, folder: str | None = None, zone: int = ZONE) -> DataFrame:
    """(part, project_id, term, zone, n, most_tf, least_dl, rows) of an index, written by part; bounds are columns apart from the postings."""
    postings, _, collections = index.all_()
    zones = collections.select("project_id", F.ceil(F.col("n") / zone).alias("zones"))
    placed = postings.join(cut(zones, "zones"), "project_id").withColumn("zone", F.pmod(F.xxhash64("chunk_id"), F.col("zones")).cast("int")).withColumn("part", term_part(index.parts))
    # The ranges that blocks are written by are those that they are made in, so postings move once.
    own = ["part", "project_id", "term", "zone"]
    blocks = placed.repartitionByRange(*own).sortWithinPartitions(*own).groupBy(*own).agg(F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.collect_list(F.struct("chunk_id", "tf", "dl")).alias("rows"))
    folder = folder or f"{index.folder}/blocks-{uuid.uuid4().hex}"
    blocks = blocks.select("project_id", "term", "zone", "n", "most_tf", "least_dl", "rows", "part")
    blocks.sortWithinPartitions(*own).write.partitionBy("part").parquet(folder)
    return index.spark.read.schema(blocks.schema).parquet(folder)


def block_max(queries: DataFrame, index: TextIndex, blocks: DataFrame, k: int, first: int = 2) -> tuple[DataFrame, DataFrame]:
    """(top k as of `retrieve.bm25`, work): the same rows, from the zones alone that can hold one of them.

    work has query_id, postings (those of its terms) and scored. first x k zones are scored to set the bar.
    """
    asked = asked_terms(queries)
    parts = [r[0] for r in asked.select(term_part(index.parts).alias("part")).distinct().collect()]
    _, terms, collections = index.all_(parts)
    weighted = asked.join(terms, ["project_id", "term"]).join(collections, "project_id")
    weighted = cut(weighted.select("query_id", "project_id", "term", (F.col("times") * F.col("idf")).alias("weight"), "avgdl"), "block-terms")
    blocks = blocks.where(F.col("part").isin(parts))
    bound = F.greatest(F.lit(0.0), F.col("weight") * impact(F.col("most_tf"), F.col("least_dl"), F.col("avgdl")))
    metas = blocks.select("project_id", "term", "zone", "n", "most_tf", "least_dl").join(weighted, ["project_id", "term"])
    zones = cut(metas.groupBy("query_id", "zone").agg(F.sum(bound).alias("bound"), F.sum("n").alias("n")).where("bound > 0"), "block-bounds")

    def scored(some: DataFrame) -> DataFrame:
        # A chunk has one zone, so its sum is made where the zones of a query meet.
        held = blocks.select("project_id", "term", "zone", "rows").join(weighted, ["project_id", "term"]).select("query_id", "zone", "weight", "avgdl", "rows")
        rows = held.join(some.select("query_id", "zone"), ["query_id", "zone"], "left_semi").select("query_id", "zone", "weight", "avgdl", F.inline("rows"))
        return rows.groupBy("query_id", "zone", "chunk_id").agg(F.round(F.sum(F.col("weight") * impact(F.col("tf"), F.col("dl"), F.col("avgdl"))), 6).alias("raw")).drop("zone")

    lead = cut(top(zones, first * k, by="bound", key="zone").drop("rank"), "block-lead")
    begun = cut(scored(lead), "block-first")
    bar = top(begun.where("raw > 0"), k, by="raw").groupBy("query_id").agg(F.count("*").alias("c"), F.min("raw").alias("bar")).where(F.col("c") >= k).select("query_id", "bar")
    # Sums are rounded to six places, so a bound may lie that much below a score.
    rest = zones.join(lead.select("query_id", "zone"), ["query_id", "zone"], "left_anti").join(bar, "query_id", "left").where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - 1e-5)).drop("bar")
    rest = cut(rest, "block-rest")
    out = as_bm25(begun.unionByName(scored(rest)), k)
    n = lambda d, name: d.groupBy("query_id").agg(F.sum("n").alias(name))
    work = n(zones, "postings").join(n(lead.select("query_id", "n").unionByName(rest.select("query_id", "n")), "scored"), "query_id")
    return out, work
