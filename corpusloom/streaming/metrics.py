"""Continuous measures over events: the same transformation runs on a batch and on a stream with a watermark."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.embed import with_cache

LATE = "10 minutes"

#: Rows of a client that go together in the batch rate limit, about.
ISLANDS = 10_000


def windowed(events: DataFrame, width: str = "5 minutes", *by) -> DataFrame:
    """Events grouped by time window (and columns); a stream gets its watermark here."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("ts", LATE)
    return events.groupBy(F.window("ts", width), *by)


def _bounds(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("window.start")).drop("window")


def error_rate(events: DataFrame, width: str = "5 minutes", limit: float = 0.1, *by, bounds: bool = True) -> DataFrame:
    """Events, errors, their rate and whether it is over the limit, by window and columns (status column); bounds: with the start of the window instead of the window itself."""
    errors = F.count_if(F.col("status") == "error")
    rate = F.round(errors / F.count("*"), 6)
    return (_bounds if bounds else lambda x: x)(windowed(events, width, *by).agg(F.count("*").alias("n"), errors.alias("errors"), rate.alias("rate"), (rate > limit).alias("alert")))


def quantile(events: DataFrame, p: float, limit: float, over: bool = True, width: str = "5 minutes", *by) -> DataFrame:
    """A quantile of value by window and whether it is over (or under) a limit: exact on a batch, approximate on a stream."""
    q = F.percentile_approx("value", p, 10_000) if events.isStreaming else F.percentile("value", p)
    return _bounds(windowed(events, width, *by).agg(F.round(q, 6).alias("q"), F.count("*").alias("n"))).withColumn("alert", F.col("q") > limit if over else F.col("q") < limit)


def hit_ratio(events: DataFrame, least: float = 0.3, width: str = "5 minutes") -> DataFrame:
    """Hits over hits and misses by window (status hit or miss); null without either."""
    hits, all_ = F.count_if(F.col("status") == "hit"), F.count_if(F.col("status").isin("hit", "miss"))
    return _bounds(windowed(events, width).agg(hits.alias("hits"), all_.alias("lookups"), F.round(hits / F.nullif(all_, F.lit(0)), 6).alias("ratio"))).withColumn("alert", F.coalesce(F.col("ratio") < least, F.lit(False)))


def totals(events: DataFrame, width: str, *labels: str) -> DataFrame:
    """Sum of value and count by window and labels."""
    return _bounds(windowed(events, width, *labels).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n")))


def firing(alerts: DataFrame, width_seconds: int, hold: int) -> DataFrame:
    """alerts(start, alert) with run (how many windows in a row are in alert) and firing (hold windows or more)."""
    bad = alerts.where("alert").select("start")
    # Windows in a row have the same difference of time and number, dealt by day so that no task orders all of them: a run is joined over midnight below.
    at = F.floor(F.col("start").cast("timestamp").cast("double") / width_seconds).cast("long")
    w = Window.partitionBy("day").orderBy("at")
    runs = bad.withColumn("at", at).withColumn("day", F.to_date("start")).withColumn("g", F.col("at") - F.row_number().over(w))
    runs = runs.groupBy("day", "g").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    island = Window.orderBy("lo")  # one row for each island of a day: as few as alerts, not events
    joined = runs.withColumn("new", F.coalesce((F.col("lo") != F.lag("hi").over(island) + 1).cast("int"), F.lit(1))).withColumn("i", F.sum("new").over(island))
    whole = joined.withColumn("first", F.min("lo").over(Window.partitionBy("i")))
    each = whole.select("first", F.explode(F.sequence("lo", "hi")).alias("at"))
    run = (F.col("at") - F.col("first") + 1).alias("run")
    return alerts.withColumn("at", at).join(each.select("at", run), "at", "left").select("start", "alert", F.coalesce("run", F.lit(0)).alias("run"), F.coalesce(F.col("run") >= hold, F.lit(False)).alias("firing"))


def _accepts(ts: list[float], limit: int, seconds: float) -> list[bool]:
    kept: list[float] = []
    out = []
    for t in ts:
        while kept and kept[0] <= t - seconds:
            kept.pop(0)
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def islands(requests: DataFrame, seconds: float, rows: int = ISLANDS) -> DataFrame:
    """requests with island: runs of a client's requests that a gap longer than the span parts, numbered by the first of each so that short ones go together up to about rows.

    Nothing accepted before such a gap still counts after it. A client without gaps is one run.
    """
    w = Window.partitionBy("client_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("id"))
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    out = requests.withColumn("at", F.row_number().over(w)).withColumn("gap", gap)
    first = F.max(F.when((F.col("at") == 1) | (F.col("gap") > seconds * 1e6), F.col("at"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("island", F.floor(first / rows)).drop("at", "gap")


def rate_limit(requests: DataFrame, limit: int = 30, seconds: float = 60.0) -> DataFrame:
    """requests(client_id, ts, id) with accepted: a client has at most limit accepted ones in any sliding span; only these count.

    Runs are sorted by Spark, which spills, and read in slices that hand their accepted times (limit at most) to the
    next, so no run is held as a whole, however long a client goes without a gap. Requests without a time aren't accepted.
    """
    kind = {n: requests.schema[n].dataType.simpleString() for n in ("client_id", "id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, deque()
        for b in batches:
            ok = []
            for own, t in zip(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True), b.column(1).to_pylist(), strict=True):
                if own != key:
                    key, kept = own, deque()
                if t is None:
                    ok.append(False)
                    continue
                while kept and kept[0] <= t - seconds:
                    kept.popleft()
                ok.append(len(kept) < limit)
                if ok[-1]:
                    kept.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ok, pa.bool_())], ["client_id", "id", "accepted"])

    own = islands(requests.select("client_id", F.col("ts").cast("timestamp").alias("ts"), "id"), seconds)
    own = own.select("client_id", F.col("ts").cast("double").alias("t"), "id", "island").repartition("client_id", "island")
    return own.sortWithinPartitions("client_id", "island", F.asc_nulls_last("t"), F.asc_nulls_last("id")).mapInArrow(run, f"client_id {kind['client_id']}, id {kind['id']}, accepted boolean")


class RateLimiter(StatefulProcessor):
    """The stream's rate limit: a client's accepted times are its state."""

    def __init__(self, limit: int = 30, seconds: float = 60.0):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "ts double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "id"])
        before = [t for (t,) in self.kept.get()] if self.kept.exists() else []
        times = pdf["ts"].tolist()
        ok = _accepts(before + times, self.limit, self.seconds)[len(before) :]
        left = before + [t for t, a in zip(times, ok, strict=True) if a]
        self.kept.put([(t,) for t in left if t > left[-1] - self.seconds] if left else [])
        yield pd.DataFrame({"client_id": [key[0]] * len(pdf), "id": pdf["id"].tolist(), "accepted": ok})

    def close(self) -> None:
        pass


def rate_limit_stream(requests: DataFrame, limit: int = 30, seconds: float = 60.0) -> DataFrame:
    own = requests.select("client_id", F.col("ts").cast("timestamp").cast("double").alias("ts"), "id")
    return own.groupBy("client_id").transformWithStateInPandas(RateLimiter(limit, seconds), "client_id long, id long, accepted boolean", "Append", "None")


def rolling_history(messages: DataFrame, n: int) -> DataFrame:
    """messages(user_id, turn, content) with the last n contents up to each, oldest first."""
    w = Window.partitionBy("user_id").orderBy("turn").rowsBetween(-(n - 1), 0)
    return messages.withColumn("history", F.collect_list("content").over(w))


class Store:
    """What a stream has ingested: chunks, their vectors and the embedding cache, each in a folder for every batch, and a manifest of the batches that count.

    A batch writes its folders anew whenever it runs, and counts once its line of the manifest is there; readers see no
    other batch. So a batch that was stopped midway is repeated without a trace, and one that had counted is skipped.
    A document that comes again, in a later batch, replaces its chunks.
    """

    PARTS = ("documents", "chunks", "vectors", "cache")

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def batches(self) -> DataFrame:
        """(batch, documents, chunks, vectors, embedded) of the batches that count."""
        schema = "documents long, chunks long, vectors long, embedded long, batch long"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, part: str, schema: str) -> DataFrame:
        """Rows of all batches that count, with their batch."""
        done = [r[0] for r in self.batches().select("batch").collect()]  # a number a batch
        if not done:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        return self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.folder}/{part}").parquet(*(f"{self.folder}/{part}/batch={n}" for n in done))

    def current(self, part: str, schema: str, doc_schema: str = "doc_id long") -> DataFrame:
        """Rows of the latest batch of each document."""
        doc = doc_schema.split()[0]
        latest = self.read("documents", doc_schema).groupBy(doc).agg(F.max("batch").alias("batch"))
        return self.read(part, schema).join(latest, [doc, "batch"], "left_semi").drop("batch")

    def put(self, part: str, n: int, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{part}/batch={n}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def ingest(stream: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, doc: str = "doc_id"):
    """Starts a query that turns each batch of documents into chunks (chunk(batch): doc, chunk_id, text and more), embeds texts that no batch has embedded before (embed(id, text): id, embedding), and counts the batch."""

    def write(batch: DataFrame, n: int) -> None:
        store = Store(batch.sparkSession, folder)
        if store.batches().where(F.col("batch") == n).count():
            return
        docs = store.put("documents", n, batch.select(doc).distinct())
        chunks = store.put("chunks", n, chunk(batch))
        known = store.read("cache", "key string, embedding array<float>").drop("batch")
        found, fresh = with_cache(chunks, known, embed, "chunk_id", "text")
        fresh = store.put("cache", n, fresh.select("key", "embedding"))
        # Found again over what was just written, so nothing is embedded twice.
        found, _ = with_cache(chunks, known.unionByName(fresh), embed, "chunk_id", "text")
        vectors = store.put("vectors", n, found.where("embedding is not null").select(F.col("id").alias("chunk_id"), "embedding").join(chunks.select("chunk_id", doc), "chunk_id"))
        counts = [docs.count(), chunks.count(), vectors.count(), fresh.count()]
        before_commit(n)
        row = batch.sparkSession.createDataFrame([tuple(counts)], "documents long, chunks long, vectors long, embedded long")
        row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def before_commit(n: int) -> None:
    """Called when a batch has been written but does not count yet (tests stop it here)."""


def merge_updates(totals: DataFrame, folder: str, checkpoint: str):
    """Starts a query in update mode: each batch writes the totals that it changed. latest() has the current ones."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, folder: str, schema, *keys: str) -> DataFrame:
    """The last written row of each key of merge_updates."""
    rows = spark.read.schema(schema.add("batch", "long")).parquet(folder)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return best.select(*keys, *(F.col(f"v.{c}").alias(c) for c in values))


def sketches(events: DataFrame, width: str = "5 minutes", *by, k: int = 800) -> DataFrame:
    """A KLL sketch of value by window: bounded state for a stream, and a table that rolled() merges to wider windows."""
    return _bounds(windowed(events, width, *by).agg(F.kll_sketch_agg_double(F.col("value").cast("double"), k).alias("sketch"), F.count("value").alias("n")))


def rolled(rows: DataFrame, width: str, *by, k: int = 800) -> DataFrame:
    """Sketches of narrow windows merged to wider ones."""
    return _bounds(rows.groupBy(F.window("start", width), *by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.sum("n").alias("n")))


def sketched(rows: DataFrame, p: float, limit: float, over: bool = True) -> DataFrame:
    """The quantile of each sketch and whether it is over (or under) a limit; its rank is off by less than 1 % for k = 800."""
    out = rows.withColumn("q", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))).drop("sketch")
    return out.withColumn("alert", F.col("q") > limit if over else F.col("q") < limit)
