"""Batch twins of the continuous measures over events (event_type as status, value as measure), and streams that must give the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunk as c
from ..operators import embed as e
from ..sources.tables import scratch
from ..streaming import metrics as m
from ..streaming import stateful as st
from .chunk_queries import FORCED
from .registry import query
from .text_queries import tok

START = "time_bucket(interval {w}, ts) as start"


def events(tables):
    status = F.when(F.col("event_type") == "view", "hit").when(F.col("event_type") == "click", "miss").otherwise(F.col("event_type"))
    return tables("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("client_id"), status.alias("status"), "value", F.col("event_id").alias("id"))


def _plain(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def _start(w: str) -> str:
    return f"strftime(time_bucket(interval '{w}', ts), '%Y-%m-%d %H:%M:%S') as start"


@query("w1_error_rate", f"select {_start('5 minutes')}, count(*) as n, count(*) filter (event_type = 'error') as errors, round(count(*) filter (event_type = 'error') / count(*), 6) as rate, round(count(*) filter (event_type = 'error') / count(*), 6) > 0.1 as alert from events group by 1")
def _(tables):
    return _plain(m.error_rate(events(tables)))


@query("w2_latency_p95", f"select {_start('1 hour')}, event_type as status, round(quantile_cont(value, 0.95), 6) as q, count(*) as n, round(quantile_cont(value, 0.95), 6) > 100 as alert from (select ts, value, case event_type when 'view' then 'hit' when 'click' then 'miss' else event_type end as event_type from events) group by 1, 2")
def _(tables):
    return _plain(m.quantile(events(tables), 0.95, 100.0, True, "1 hour", "status"))


@query("w3_median_relevance", f"select {_start('1 hour')}, round(quantile_cont(value, 0.5), 6) as q, count(*) as n, round(quantile_cont(value, 0.5), 6) < 20 as alert from events group by 1")
def _(tables):
    return _plain(m.quantile(events(tables), 0.5, 20.0, False, "1 hour"))


@query("w4_hit_ratio", f"select start, h as hits, a as lookups, round(h / nullif(a, 0), 6) as ratio, coalesce(round(h / nullif(a, 0), 6) < 0.3, false) as alert from (select {_start('5 minutes')}, count(*) filter (event_type = 'view') as h, count(*) filter (event_type in ('view', 'click')) as a from events group by 1)")
def _(tables):
    return _plain(m.hit_ratio(events(tables)))


@query("w5_firing", f"""
with a as (select time_bucket(interval '30 minutes', ts) as s, round(count(*) filter (event_type = 'error') / count(*), 6) > 0.1 as alert from events group by 1),
b as (select s, epoch(s)::bigint // 1800 - row_number() over (order by s) as g from a where alert),
r as (select s, row_number() over (partition by g order by s) as run from b)
select strftime(a.s, '%Y-%m-%d %H:%M:%S') as start, alert, coalesce(run, 0) as run, coalesce(run >= 3, false) as firing from a left join r using (s)""")
def _(tables):
    return _plain(m.firing(m.error_rate(events(tables), "30 minutes").select("start", "alert"), 1800, 3))


@query("w6_rate_limit")
def _(tables):
    return m.rate_limit(events(tables), 3, 3600.0)


@query("w7_totals", f"select {_start('1 hour')}, event_type as status, round(sum(value), 4) as total, count(*) as n from (select ts, value, case event_type when 'view' then 'hit' when 'click' then 'miss' else event_type end as event_type from events) group by 1, 2")
def _(tables):
    return _plain(m.totals(events(tables), "1 hour", "status"))


@query("w7_totals_stream", f"select {_start('1 day')}, event_type as status, round(sum(value), 4) as total, count(*) as n from (select ts, value, case event_type when 'view' then 'hit' when 'click' then 'miss' else event_type end as event_type from events) group by 1, 2")
def _(tables):
    """Events as a stream of files, to the end, into a table."""
    spark = tables("events").sparkSession
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    tables("events").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(tables("events").schema).parquet(f"{folder}/in")
    out = m.totals(events(lambda _: stream), "1 day", "status")
    name = f"totals_{uuid.uuid4().hex}"

    def write(batch, n):
        batch.write.mode("overwrite").parquet(f"{folder}/{name}")

    # Complete mode: each batch has all totals so far, and the last stays.
    out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return _plain(spark.read.schema(out.schema).parquet(f"{folder}/{name}"))


CUT = 1000


@query("w8_ingest", f"""with p as (select doc_id, source, generate_subscripts(p, 1) as i, unnest(p) as text from (select doc_id, source, {FORCED.format(n=CUT)} as p from documents))
select source, count(distinct doc_id) as documents, count(*) as chunks, count(distinct doc_id || '/' || i) as ids, count(*) filter (len({tok('text')}) > 0) as vectors, count(distinct text) filter (len({tok('text')}) > 0) > 0 as cached from p group by source""")
def _(tables):
    """A stream of documents to chunks, cached embeddings and a manifest, started twice: the second start finds nothing new."""
    d = tables("documents")
    spark, folder = d.sparkSession, f"{scratch(d.sparkSession)}/ingest-{uuid.uuid4().hex}"
    d.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    def chunked(batch):
        parts = c.exploded(batch.withColumn("repo", F.col("source")), "doc_id", c.force_split(F.col("text"), CUT), "repo")
        return parts.select("doc_id", "repo", F.concat_ws("/", "doc_id", "chunk_index").alias("chunk_id"), "text")

    for _ in range(2):
        m.ingest(stream, chunked, lambda t: e.hashed(t, "id", "text"), f"{folder}/store", f"{folder}/state").awaitTermination()
    store = m.Store(spark, f"{folder}/store")
    chunks = store.current("chunks", "doc_id long, repo string, chunk_id string, text string")
    vectors = store.current("vectors", "chunk_id string, embedding array<float>, doc_id long").select("chunk_id", F.lit(1).alias("v"))
    cached = store.read("cache", "key string, embedding array<float>").select("key").distinct()
    own = chunks.join(vectors, "chunk_id", "left").join(cached.withColumn("hit", F.lit(1)), F.sha2("text", 256) == F.col("key"), "left")
    return own.groupBy(F.col("repo").alias("source")).agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.count_distinct("chunk_id").alias("ids"), F.count("v").alias("vectors"), (F.count("hit") > 0).alias("cached"))


def replayed(df, order, folder: str, slices: int = 4):
    """Rows written to a folder in slices by an order, one after the other, as a source would deliver them."""
    bounds = df.select(order.cast("double").alias("o")).approxQuantile("o", [k / slices for k in range(1, slices)], 0.01)
    o = order.cast("double")
    for k in range(slices):
        part = df if not bounds else df.where((o >= bounds[k - 1] if k else F.lit(True)) & (o < bounds[k] if k < len(bounds) else F.lit(True)))
        part.write.mode("append").parquet(folder)


FLIPS = f"""with a as (select user_id % 4 as series, time_bucket(interval '2 hours', ts) as s, round(count(*) filter (event_type = 'error') / count(*), 6) > 0.25 as alert from events where user_id is not null group by all),
b as (select series, epoch(s)::bigint // 7200 as w, epoch(s)::bigint // 7200 - row_number() over (partition by series order by s) as g from a where alert),
r as (select series, min(w) as lo, max(w) as hi from b group by series, g having max(w) - min(w) + 1 >= 2)
select series::varchar as series, state, strftime(to_timestamp(k * 7200) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as changed_at from (select series, 'firing' as state, lo + 2 as k from r union all select series, 'resolved', hi + 1 from r)"""


def serial(tables):
    return events(tables).where("client_id is not null").withColumn("series", (F.col("client_id") % 4).cast("string"))


@query("w5_alert_changes", FLIPS)
def _(tables):
    out = st.alert_changes(m.error_rate(serial(tables), "2 hours", 0.25, "series"), 7200, 2)
    return out.withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss"))


@query("w5_alert_stream", FLIPS)
def _(tables):
    """The same from a stream whose events come up to eight minutes late; a last event of no series moves the watermark past all windows."""
    own = serial(tables).select("ts", "status", "series")
    spark, folder = tables("events").sparkSession, f"{scratch(tables('events').sparkSession)}/alerts-{uuid.uuid4().hex}"
    replayed(own, F.unix_seconds("ts") + F.pmod(F.xxhash64("ts", "status"), F.lit(480)), f"{folder}/in")
    own.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 30 days")).alias("ts"), F.lit("none").alias("status"), F.lit("").alias("series")).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with st.rocksdb(spark):
        out = st.alert_stream(m.error_rate(stream, "2 hours", 0.25, "series", bounds=False), 7200, 2)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(st.CHANGES).parquet(f"{folder}/out").withColumn("changed_at", F.date_format("changed_at", "yyyy-MM-dd HH:mm:ss"))


@query("w7_totals_update", f"select {_start('1 day')}, event_type as status, round(sum(value), 4) as total, count(*) as n from (select ts, value, case event_type when 'view' then 'hit' when 'click' then 'miss' else event_type end as event_type from events) group by 1, 2")
def _(tables):
    """Events as a stream in update mode: a batch writes the totals that it changed, and the last of each key count."""
    spark, folder = tables("events").sparkSession, f"{scratch(tables('events').sparkSession)}/updates-{uuid.uuid4().hex}"
    replayed(tables("events"), F.unix_seconds(F.col("ts").cast("timestamp")), f"{folder}/in")
    stream = spark.readStream.schema(tables("events").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = m.totals(events(lambda _: stream), "1 day", "status")
    m.merge_updates(out, f"{folder}/out", f"{folder}/state").awaitTermination()
    return _plain(m.latest(spark, f"{folder}/out", out.schema, "start", "status"))


@query("w2_sketch", f"select {_start('1 hour')}, event_type as status, count(*) as n, true as near from (select ts, value, case event_type when 'view' then 'hit' when 'click' then 'miss' else event_type end as event_type from events) group by 1, 2")
def _(tables):
    """The 95th percentile of hours from sketches of five minutes, held to the exact ranks: near if it is off by a hundredth of them, or one value, at most."""
    own = events(tables)
    out = m.sketched(m.rolled(m.sketches(own, "5 minutes", "status"), "1 hour", "status"), 0.95, 100.0)
    each = own.select(F.date_trunc("hour", "ts").alias("start"), "status", "value").join(out, ["start", "status"])
    below, upto = F.count_if(F.col("value") < F.col("q")), F.count_if(F.col("value") <= F.col("q"))
    slack = F.greatest(F.lit(1.0), 0.01 * F.count("*"))
    return _plain(each.groupBy("start", "status").agg(F.count("*").alias("n"), ((below <= 0.95 * F.count("*") + slack) & (upto >= 0.95 * F.count("*") - slack)).alias("near")))


HISTORY = "select conv_id as user_id, turn, md5(array_to_string(list(text) over (partition by conv_id order by turn rows between 3 preceding and current row), '|')) as digest from conversations"


@query("w9_history_stream", HISTORY)
def _(tables):
    """The histories from a stream: a turn a minute, up to five minutes out of order."""
    own = tables("conversations").select(F.col("conv_id").alias("user_id"), F.timestamp_seconds(F.lit(1_700_000_040) + F.col("turn") * 60).alias("ts"), "turn", F.col("text").alias("content"))
    spark, folder = own.sparkSession, f"{scratch(own.sparkSession)}/history-{uuid.uuid4().hex}"
    replayed(own, F.col("turn") + F.pmod(F.xxhash64("user_id", "turn"), F.lit(5)), f"{folder}/in")
    own.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("content")).where("ts is not null").write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with st.rocksdb(spark):
        st.history_stream(stream, 4).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("user_id long, turn long, history array<string>").parquet(f"{folder}/out")
    return out.select("user_id", "turn", F.md5(F.array_join("history", "|")).alias("digest"))


@query("w9_rolling_history", "select conv_id as user_id, turn, md5(array_to_string(list(text) over (partition by conv_id order by turn rows between 3 preceding and current row), '|')) as digest from conversations")
def _(tables):
    h = m.rolling_history(tables("conversations").select(F.col("conv_id").alias("user_id"), "turn", F.col("text").alias("content")), 4)
    return h.select("user_id", "turn", F.md5(F.array_join("history", "|")).alias("digest"))
