"""Streams against their batch twins on replays with late events, and ingestion that is stopped midway."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embed
from corpusloom.streaming import metrics, stateful

BASE = dt.datetime(2024, 1, 1)


def replay(df, folder, slices, order):
    """Writes df in slices by a column that says when rows arrive."""
    rows = sorted(df, key=order)
    size = -(-len(rows) // slices)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def run(spark, frames, schema, folder, make, mode="append"):
    """Rows of a stream that gets the frames one after the other."""
    for f in frames:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with stateful.rocksdb(spark):
        out = make(stream)
        out.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def test_alert_stream_equals_its_batch_twin(spark, tmp_path):
    """Late events within the delay count, those beyond it don't; silent series are resolved by their timers."""
    r, schema = random.Random(4), "series string, ts timestamp, status string"
    rows = []
    for s in ("a", "b", "c"):
        bad = False
        for w in range(120):
            bad = bad != (r.random() < 0.2)
            if r.random() < 0.9:  # else the window is silent
                rows += [(s, BASE + dt.timedelta(seconds=300 * w + r.randint(0, 299)), "error" if bad and r.random() < 0.8 else "ok") for _ in range(3)]
    arrival = {id(x): x[1] + dt.timedelta(seconds=r.randint(0, 500)) for x in rows}
    frames = replay(rows, tmp_path, 7, lambda x: arrival[id(x)])
    too_late = ("a", BASE + dt.timedelta(seconds=10), "error")
    frames[5] = frames[5] + [too_late] * 50
    frames.append([("", BASE + dt.timedelta(days=30), "ok")])
    got = run(spark, frames, schema, str(tmp_path), lambda s: stateful.alert_stream(metrics.error_rate(s, "5 minutes", 0.3, "series", bounds=False), 300, 3))
    want = stateful.alert_changes(metrics.error_rate(spark.createDataFrame(rows, schema), "5 minutes", 0.3, "series"), 300, 3)
    shown = sorted(map(tuple, want.collect()))
    assert len(shown) > 10 and sorted(map(tuple, got.collect())) == shown


def test_alert_changes_match_a_plain_loop(spark):
    r = random.Random(9)
    rows = [(s, BASE + dt.timedelta(minutes=5 * w), r.random() < 0.7) for s in "xy" for w in range(700) if r.random() < 0.95]
    got = sorted(map(tuple, stateful.alert_changes(spark.createDataFrame(rows, "series string, start timestamp, alert boolean"), 300, 4).collect()))
    want = []
    for s in "xy":
        bad, w = {t for k, t, a in rows if k == s and a}, 0
        while w < 701:
            n = 0
            while BASE + dt.timedelta(minutes=5 * (w + n)) in bad:
                n += 1
            if n >= 4:
                want += [(s, "firing", BASE + dt.timedelta(minutes=5 * (w + 4))), (s, "resolved", BASE + dt.timedelta(minutes=5 * (w + n)))]
            w += n + 1
    assert got == sorted(want)


def test_history_stream_equals_its_batch_twin(spark, tmp_path):
    r, schema = random.Random(5), "user_id long, ts timestamp, turn long, content string"
    rows = [(u, BASE + dt.timedelta(minutes=t), t, r.choice([f"m{t}", f"n{t}", None])) for u in range(6) for t in range(60) if r.random() < 0.8]
    arrival = {id(x): x[1] + dt.timedelta(seconds=r.randint(0, 540)) for x in rows}
    frames = replay(rows, tmp_path, 8, lambda x: arrival[id(x)])
    frames[6] = frames[6] + [(0, BASE, 0, "too late"), (None, BASE + dt.timedelta(minutes=59), 9, "nobody"), (1, None, 9, "no time")]
    frames.append([(-1, BASE + dt.timedelta(days=2), 0, "end")])
    got = run(spark, frames, schema, str(tmp_path), lambda s: stateful.history_stream(s, 3))
    want = metrics.rolling_history(spark.createDataFrame(rows, schema), 3).select("user_id", "turn", "history")
    key = lambda d: sorted((x.user_id, x.turn, tuple(x.history)) for x in d.collect())
    assert key(got) == key(want)


def chunked(batch):
    return batch.select("doc_id", F.posexplode(F.split("text", "/")).alias("n", "text")).select("doc_id", F.concat_ws("-", "doc_id", "n").alias("chunk_id"), "text")


@pytest.mark.parametrize("stop_at", [0, 1])
def test_ingest_stopped_before_it_counts(spark, tmp_path, monkeypatch, stop_at):
    """Killed between write and commit, run again: chunks and vectors are unique and complete, and each text is embedded once."""
    docs = [(i, f"one {i}/two/three {i % 3}") for i in range(12)]
    folder = str(tmp_path)
    for k in range(3):
        spark.createDataFrame(docs[4 * k : 4 * k + 4], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    asked = []

    def embed_all(t):
        asked.append(sorted(r.text for r in t.collect()))
        return embed.hashed(t, "id", "text")

    start = lambda: metrics.ingest(stream, chunked, embed_all, f"{folder}/store", f"{folder}/state")
    with monkeypatch.context() as m:

        def stop(n):
            if n == stop_at:
                raise RuntimeError("killed")

        m.setattr(metrics, "before_commit", stop)
        with pytest.raises(Exception, match="killed"):
            start().awaitTermination()
    store = metrics.Store(spark, f"{folder}/store")
    assert store.batches().count() == stop_at
    assert store.current("chunks", "doc_id long, chunk_id string, text string").count() == 12 * stop_at
    start().awaitTermination()
    start().awaitTermination()
    chunks = store.current("chunks", "doc_id long, chunk_id string, text string")
    vectors = store.current("vectors", "chunk_id string, embedding array<float>, doc_id long")
    want = sorted(f"{i}-{n}" for i in range(12) for n in range(3))
    assert sorted(r.chunk_id for r in chunks.collect()) == want == sorted(r.chunk_id for r in vectors.collect())
    keys = [r.key for r in store.read("cache", "key string, embedding array<float>").collect()]
    assert len(keys) == len(set(keys)) == 12 + 1 + 3
    assert sum(r.embedded for r in store.batches().collect()) == 16
    spark.createDataFrame([(3, "two"), (40, "new")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    start().awaitTermination()
    now = {r.chunk_id for r in store.current("chunks", "doc_id long, chunk_id string, text string").collect()}
    assert now == (set(want) - {"3-0", "3-1", "3-2"}) | {"3-0", "40-0"}
    assert ["new"] in asked[-2:]


def test_update_mode_keeps_late_totals_and_drops_later_ones(spark, tmp_path):
    schema = "ts timestamp, status string, value double"
    at = lambda m: BASE + dt.timedelta(minutes=m)
    frames = [[(at(1), "x", 1.0), (at(14), "x", 2.0)], [(at(6), "x", 10.0), (at(40), "x", 4.0)], [(at(41), "x", 5.0)], [(at(2), "x", 100.0)]]
    for f in frames:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = metrics.totals(stream, "5 minutes", "status")
    metrics.merge_updates(out, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r.start, r.total, r.n) for r in metrics.latest(spark, f"{tmp_path}/out", out.schema, "start", "status").collect()}
    # The event of minute 6 is late but within ten minutes of the watermark's event; that of minute 2 comes when the watermark has been at 30 for a batch.
    assert got == {(at(0), 1.0, 1), (at(5), 10.0, 1), (at(10), 2.0, 1), (at(40), 9.0, 2)}


def test_merged_sketches_stay_within_their_bound(spark):
    r = random.Random(1)
    rows = [(BASE + dt.timedelta(seconds=i), r.choice([r.gauss(0, 1), r.expovariate(0.1), 3.0])) for i in range(20_000)]
    df = spark.createDataFrame(rows, "ts timestamp, value double")
    for p in (0.05, 0.5, 0.95, 0.99):
        for row in metrics.sketched(metrics.rolled(metrics.sketches(df, "5 minutes"), "1 hour"), p, 0.0).collect():
            own = sorted(v for t, v in rows if row.start <= t < row.start + dt.timedelta(hours=1))
            below, upto = sum(v < row.q for v in own), sum(v <= row.q for v in own)
            assert row.n == len(own) and below <= (p + 0.01) * len(own) and upto >= (p - 0.01) * len(own)
