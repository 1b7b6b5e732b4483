"""Properties of operators that SQL can't express, and cases that the tables lack."""

import datetime as dt
import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as t
import pytest
from conftest import DATA
from corpusloom.operators import analytics, chunk, evaluate, retrieve
from corpusloom.plans import QUERIES
from corpusloom.sources import tables
from corpusloom.streaming import metrics

words = st.text(alphabet="ab. !\n", max_size=400)


@settings(max_examples=200, deadline=None)
@given(words, st.integers(5, 60), st.integers(0, 30))
def test_windows_cover_and_end(text, size, overlap):
    spans = chunk.window_spans(text, size, overlap)
    assert all(0 < b - a <= max(size, len(text) if len(text) <= size else size) for a, b in spans)
    assert [a for a, _ in spans] == sorted({a for a, _ in spans})
    if text.strip():
        covered = set().union(*(range(a, b) for a, b in spans))
        assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


@settings(max_examples=200, deadline=None)
@given(words, st.integers(5, 60), st.integers(0, 20))
def test_recursive_parts_fit(text, size, overlap):
    parts = chunk.recursive_parts(text, size, min(overlap, size - 1))
    assert all(0 < len(p) <= size and p in text for p in parts)


def test_pages_join_short_ones(spark):
    text = "[Page 1]\n" + "x" * 120 + "\n[Page 2]\nshort\n[Page 3]\n" + "y" * 150
    df = spark.createDataFrame([(1, text), (2, "no marker"), (3, None)], "id int, text string")
    out = {r.id: r.p for r in df.select("id", chunk.pages(F.col("text")).alias("p")).collect()}
    assert len(out[1]) == 2 and out[1][0].endswith("[Page 2]\nshort") and not out[2]


def test_elements_and_sections(spark):
    body = "слово " * 30
    text = f"# Title\n{body}\n1. Глава\n{body}\nCAPS LINE\n{body}"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert len(df.select(chunk.elements(F.col("text"))).first()[0]) == 3
    s = chunk.sections(spark.createDataFrame([(1, f"ГЛАВА 1\n{body}\n# Two\n{body}"), (2, "plain")], "id int, text string"), "id", "text").orderBy("id", "section_index").collect()
    assert [(r.title, r.start_line) for r in s] == [("ГЛАВА 1", 0), ("# Two", 2), ("Введение", 0)]


def test_question_answer_patterns(spark):
    rows = [("Q: a? A: b",), ("Вопрос: что\nОтвет: то",), ("В: x О: y",), ("nothing",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(t.question_answer(F.col("x"))).collect()]
    assert [tuple(g) if g else None for g in got] == [("a?", "b"), ("что", "то"), ("x", "y"), None, None]


def test_default_word_lists(spark):
    rows = [("Привет",), ("Объясни и сравни подходы подробно",), ("Что это?",), ("Сколько стоит тариф",)]
    got = spark.createDataFrame(rows, "x string").select(t.is_small_talk(F.col("x")), t.complexity(F.col("x")), t.has_any(F.lower("x"), t.PRICING)).collect()
    assert [r[0] for r in got] == [True, False, False, False]
    assert [r[1] for r in got][1:3] == ["complex", "simple"]
    assert [r[2] for r in got] == [False, False, False, True]


def test_markdown_look_behind(spark):
    got = spark.createDataFrame([("# H\n**b** and _i_ `c` [t](u)\n- one\n1. two\n---",)], "x string").select(t.strip_markdown(F.col("x"))).first()[0]
    assert got == "H\nb and i c t\n• one\ntwo"


def test_price_list_synonyms(spark):
    df = spark.createDataFrame([("  ", "Лампа", "10", "x"), ("A1", None, "nan", "y"), (None, None, None, "z")], "`Артикул` string, `Наименование товара` string, `Цена, руб` string, note string")
    got = tables.price_products(df).orderBy("text").collect()
    assert [(r.name, r.price, r.code) for r in got] == [("Лампа", "10", None)]
    assert got[0].text == "Продукт/услуга: Лампа\nЦена: 10\nnote: x"


def test_decode_second_encoding(spark):
    df = spark.createDataFrame([("Привет".encode("cp1251"),), ("ok é".encode(),)], "x binary")
    assert [r[0] for r in df.select(tables.decode_any(F.col("x"))).collect()] == ["Привет", "ok é"]


def test_costs_are_null_without_a_price(spark):
    u = spark.createDataFrame([("a", 10, 20), ("b", 1, 1), ("c", 5, 5)], "model_id string, input_tokens int, output_tokens int")
    p = spark.createDataFrame([("a", 3.0, 6.0), ("b", 0.0, 1.0)], "model_id string, input_price double, output_price double").select("model_id", F.col("input_price").cast("decimal(20,10)").alias("input_price"), F.col("output_price").cast("decimal(20,10)").alias("output_price"))
    got = {r.model_id: r.cost for r in analytics.usage_cost(u, p).collect()}
    assert float(got["a"]) == 0.00015 and got["b"] is None and got["c"] is None


def test_groundedness_without_context(spark):
    df = spark.createDataFrame([(1, "the sky is blue today", "", ["blue"]), (2, "the sky is blue today", "", ["red"]), (3, "", "", ["x"])], "query_id int, answer string, context string, key_facts array<string>")
    got = {r.query_id: (r.groundedness, r.unfounded) for r in evaluate.groundedness(df).collect()}
    assert got[1] == (0.4, []) and got[2] == (0.0, [evaluate.NO_CONTEXT]) and got[3] == (0.0, [])


def test_rate_limit_matches_a_plain_loop(spark):
    r = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 3, base + dt.timedelta(seconds=r.randint(0, 600)), i) for i in range(400)]
    got = {x.id: x.accepted for x in metrics.rate_limit(spark.createDataFrame(rows, "client_id long, ts timestamp, id long"), 5, 60.0).collect()}
    for c in range(3):
        kept = []
        for _, ts, i in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2])):
            kept = [k for k in kept if (ts - k).total_seconds() < 60]
            assert got[i] == (len(kept) < 5)
            if got[i]:
                kept.append(ts)


def test_rate_limit_stream_matches_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i % 2, base + dt.timedelta(seconds=3 * i), i) for i in range(120)], "client_id long, ts timestamp, id long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = metrics.rate_limit_stream(stream, 4, 60.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    order = lambda d: sorted((r.client_id, r.id, r.accepted) for r in d.collect())
    assert order(spark.read.parquet(str(tmp_path / "out"))) == order(metrics.rate_limit(df, 4, 60.0))


def test_alert_holds_over_midnight(spark):
    start = dt.datetime(2024, 1, 1, 23, 40)
    rows = [(start + dt.timedelta(minutes=5 * i), i != 6) for i in range(10)]
    got = metrics.firing(spark.createDataFrame(rows, "start timestamp, alert boolean"), 300, 5).orderBy("start").collect()
    assert [r.run for r in got] == [1, 2, 3, 4, 5, 6, 0, 1, 2, 3] and [r.firing for r in got].count(True) == 2


def test_rate_limit_parts_a_client_at_gaps(spark):
    r, t, times = random.Random(3), 1_700_000_000_000_000, []
    for _ in range(600):
        t += r.choice([1, 2, 5, 20, 59, 60, 61, 200]) * 1_000_000
        times.append(t)
    df = spark.createDataFrame([(7, x, i) for i, x in enumerate(times)], "client_id long, us long, id long").selectExpr("client_id", "timestamp_micros(us) as ts", "id")
    want = metrics._accepts([x / 1e6 for x in times], 2, 60.0)
    runs = metrics.islands(df, 60.0, 50).groupBy("island").count().collect()
    assert len(runs) > 5 and max(x["count"] for x in runs) < 120
    whole = metrics.islands
    metrics.islands = lambda d, s: whole(d, s, 50)
    try:
        got = {x.id: x.accepted for x in metrics.rate_limit(df, 2, 60.0).collect()}
    finally:
        metrics.islands = whole
    assert [got[i] for i in range(600)] == want


@pytest.mark.parametrize("name,other", [("c1_windows_sql", "c1_windows"), ("c2_recursive_sql", "c2_recursive"), ("c1_windows_pieces", "c1_windows")])
def test_other_forms_give_the_rows_of_the_operators(spark, name, other):
    rows = lambda n: sorted(map(str, QUERIES[n](spark, DATA.replace("0.001", "0.01")).collect()))
    assert rows(name) == rows(other) != []


def test_packed_sentences_match_a_plain_loop_and_take_linear_time(spark):
    r = random.Random(8)
    texts = [". ".join("w" * r.choice([3, 30, 90, 250]) + str(i) for i in range(n)) + "." for n in (0, 1, 7, 40, 3000)] + ["", "word " * 900, None]

    def plain(sentences):
        out, cur, n = [], [], 0

        def flush():
            if cur and len(" ".join(cur)) >= 100:
                out.append(" ".join(cur))

        for s in sentences:
            if n + len(s) <= 2000:
                cur, n = [*cur, s], n + len(s)
                continue
            flush()
            if len(s) > 2000:
                out.extend(p for p in (s[i : i + 2000].strip() for i in range(0, len(s), 2000)) if p)
                cur, n = [], 0
            else:
                cur, n = [s], len(s)
        flush()
        return out

    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for x in chunk.packed_sentences(rows, "id", "text").collect():
        got.setdefault(x.id, {})[x.chunk_index] = x.text
    for x in rows.select("id", t.sentences(F.col("text")).alias("s")).collect():
        assert got.get(x.id, {}) == dict(enumerate(plain(x.s or [])))

    def seconds(n):
        text = ". ".join(f"sentence number {i} of a long text that goes on {'x' * 90}" for i in range(n))
        began = time.time()
        assert len(chunk.sentence_parts(text)) > n / 40
        return time.time() - began

    once, twice = min(seconds(50_000) for _ in range(3)), min(seconds(100_000) for _ in range(3))
    assert twice < 2.3 * once + 0.2


def test_names_with_one_prefix_dont_meet_every_question(spark):
    """Files that share a prefix are told apart by their rarest gram; the work doubles with the input."""

    def run(n):
        needles = spark.range(n).select(F.format_string("report_2024_%05d.pdf", "id").alias("needle"))
        texts = spark.range(n).select(F.format_string("what does report_2024_%05d.pdf say about it, item %d?", "id", "id").alias("text"))
        began = time.time()
        found = retrieve.within(needles, texts).collect()
        assert len(found) == n and all(x.needle in x.text for x in found)
        return time.time() - began

    run(500)
    assert run(16_000) < 60
    r = random.Random(2)
    word = lambda k: "".join(r.choice("abc") for _ in range(k))
    needles, texts = {word(r.randint(1, 7)) for _ in range(80)} | {""}, {word(r.randint(0, 40)) for _ in range(60)}
    got = {(x.needle, x.text) for x in retrieve.within(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string")).collect()}
    assert got == {(a, b) for a in needles for b in texts if a and a in b}


def test_rate_limit_without_times(spark):
    rows = [(1, None, 1), (1, dt.datetime(2024, 1, 1), 2), (1, dt.datetime(2024, 1, 1), 3), (None, dt.datetime(2024, 1, 1), 4)]
    got = {r.id: r.accepted for r in metrics.rate_limit(spark.createDataFrame(rows, "client_id long, ts timestamp, id long"), 1, 60.0).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True}


def test_giant_texts_are_windowed_in_pieces(spark, monkeypatch):
    """The same rows as windows(), whatever the pieces; texts whose windows never meet end up whole."""
    r = random.Random(11)
    prose = lambda n: "".join(r.choice(["word ", "other words. ", "more!\n", "a", "  ", "\n\n"]) for _ in range(n))
    rows = [(0, prose(6000)), (1, "x" * 30_000), (2, " " * 9000 + prose(2000) + "\n" * 5000), (3, prose(20)), (4, None), (5, ""), (6, "y" * 4999 + ". " + prose(3000))]
    df = spark.createDataFrame(rows, "id long, text string")
    shown = lambda d: sorted(map(tuple, d.select("id", "chunk_index", "start", "end", "text").collect()))
    for size, overlap, piece in ((300, 60, 2000), (100, 99, 5000), (1000, 200, 1500)):
        assert shown(chunk.windows_of_giants(df, "id", "text", size, overlap, piece)) == shown(chunk.windows(df, "id", "text", size, overlap))
    monkeypatch.setattr(chunk, "ROUNDS", 1)
    assert shown(chunk.windows_of_giants(df, "id", "text", 300, 61, 2000)) == shown(chunk.windows(df, "id", "text", 300, 61))
