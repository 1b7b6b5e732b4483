"""Faults that larger tables have shown."""

import hashlib

import numpy as np
import pytest
from conftest import DATA

from corpusloom.operators import embed, retrieve
from corpusloom.plans import QUERIES, retrieval_queries


def cancelling() -> str:
    """Two words in the same bucket with opposite signs."""
    seen = {}
    for i in range(10_000):
        w = f"w{i}"
        h = hashlib.md5(w.encode()).hexdigest()
        bucket, sign = int(h[:8], 16) % embed.DIM, int(h[8], 16) % 2
        if (bucket, 1 - sign) in seen:
            return f"{seen[bucket, 1 - sign]} {w}"
        seen[bucket, sign] = w
    raise AssertionError


def test_text_whose_words_cancel_out_is_embedded(spark):
    """w8_ingest counts a vector for each text with words; exact search compares one without direction with nothing."""
    rows = [(1, "p", cancelling()), (2, "p", ""), (3, "p", None), (4, "p", "some words")]
    d = retrieve.embedded(spark.createDataFrame(rows, "chunk_id long, project_id string, text string"), "chunk_id", "text", "embedding")
    got = {r.chunk_id: r.embedding for r in d.collect()}
    assert set(got) == {1, 4} and not any(got[1]) and abs(sum(x * x for x in got[4]) - 1) < 1e-6
    q = d.select(d.chunk_id.alias("query_id"), "project_id", d.embedding.alias("q"))
    assert [(r.query_id, r.chunk_id) for r in retrieve.dense(q, d, 5, -1.0).collect()] == [(4, 4)]


@pytest.mark.parametrize("others", [False, True])
def test_dense_is_exact_with_ties_and_blocks(spark, monkeypatch, others):
    """Blocks of any size give the rows of brute force, also where many vectors tie at the last place."""
    monkeypatch.setattr(retrieve, "BLOCK_ROWS", 7)
    monkeypatch.setattr(retrieve, "QUERY_ROWS", 3)
    monkeypatch.setattr(retrieve, "PART_ROWS", 20)
    r = np.random.default_rng(1)
    x = r.normal(size=(120, 8)).astype(np.float32)
    x[40:80] = x[3]  # copies
    x[9] = 0
    rows = [(i, "ab"[i % 3 == 0], v.tolist()) for i, v in enumerate(x)] + [(500, None, x[0].tolist()), (501, "a", None)]
    v = spark.createDataFrame(rows, "chunk_id long, project_id string, embedding array<float>")
    q = v.where("chunk_id % 5 = 0 or chunk_id = 9").select(v.chunk_id.alias("query_id"), "project_id", v.embedding.alias("q"))
    want = set()
    for i, p, a in rows:
        if p is None or a is None or not any(a) or i % 5:
            continue
        scored = []
        for j, o, b in rows:
            if o == p and b is not None and any(b) and not (others and i == j):
                s = round(float(np.dot(np.float64(a), np.float64(b)) / np.sqrt(np.dot(np.float64(a), np.float64(a)) * np.dot(np.float64(b), np.float64(b)))), 6)
                scored.append((-s, j))
        want |= {(i, j, n) for n, (s, j) in enumerate(sorted(x for x in scored if -x[0] >= 0.1)[:4], 1)}
    assert {(x.query_id, x.chunk_id, x.rank) for x in retrieve.dense(q, v, 4, 0.1, others=others).collect()} == want


def test_variants_of_a_project_are_searched_once(spark, monkeypatch):
    """r9_variants: each asking vector is searched once, not once for every question of its project."""
    seen = []
    inner = retrieve.search_variants

    def counted(variants, *rest):
        seen.append(variants.count())
        return inner(variants, *rest)

    monkeypatch.setattr(retrieve, "search_variants", counted)
    assert QUERIES["r9_variants"](spark, DATA).count() > 0
    asking = retrieval_queries.vector_queries(lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")).count()
    assert seen == [asking]


def test_tokens_are_counted_without_a_shuffle(spark):
    rows = [(1, "p", "a b a _c"), (2, "p", ""), (3, "q", None), (4, None, "B b"), (5, "p", "x " * 5000)]
    out = retrieve.counted(spark.createDataFrame(rows, "chunk_id long, project_id string, text string"))
    assert "Exchange" not in out._jdf.queryExecution().toString()
    got = {r.chunk_id: (r.project_id, r.dl, {t.term: t.tf for t in r.terms}) for r in out.collect()}
    assert got[1] == ("p", 4, {"a": 2, "b": 1, "_c": 1}) and got[2] == ("p", 0, {}) and got[3][2] == {} and got[4] == (None, 2, {"b": 2}) and got[5] == ("p", 5000, {"x": 5000})


@pytest.mark.parametrize("rows", [[10] * 1000, [3_000_000, 10, 10], [10] * 50 + [400_000] * 20])
def test_python_holds_few_texts_at_once(rows):
    """c1_windows_pieces: what Python makes of a batch is held for a slice of it."""
    import pyarrow as pa

    from corpusloom.operators import chunk

    b = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(["x" * n for n in rows])], ["id", "text"])
    parts = list(chunk._slices([b]))
    assert sum(p.num_rows for p in parts) == len(rows) and [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(rows)))
    assert all(p.num_rows == 1 or p.nbytes <= 2 * chunk.HELD for p in parts)


def test_history_sets_one_timer_a_batch():
    """w9_history_stream: one timer stands for all waiting messages of a user, and releases all that the watermark has passed."""
    import pandas as pd

    from corpusloom.streaming.stateful import History

    class Listed:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)
        clear = lambda self: self.rows.clear()

        def put(self, rows):
            self.rows = list(rows)

        def appendList(self, rows):
            self.rows += rows

    class Handle:
        def __init__(self):
            self.timers, self.states = [], {}

        def getListState(self, name, schema):
            return self.states.setdefault(name, Listed())

        def registerTimer(self, at):
            self.timers.append(at)

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    h, processor = Handle(), History(2)
    processor.init(h)
    batch = pd.DataFrame({"at": [30, 10, 20, 50], "turn": [3, 1, 2, 5], "content": ["c", "a", "b", "e"]})
    assert all(x.empty for x in processor.handleInputRows((7,), iter([batch]), At(0)))
    assert h.timers == [10]
    (out,) = processor.handleExpiredTimer((7,), At(40), At(10))
    assert out.values.tolist() == [[7, 1, ["a"]], [7, 2, ["a", "b"]], [7, 3, ["b", "c"]]] and h.timers == [10, 50]
    (out,) = processor.handleExpiredTimer((7,), At(60), At(50))
    assert out.values.tolist() == [[7, 5, ["c", "e"]]] and not h.states["waiting"].rows


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """op7: no row is left out for its length or its place in an order, and parts that train apart learn together."""
    import random

    from corpusloom.llm import toxicity

    monkeypatch.setattr(toxicity, "PART", 150)
    monkeypatch.setattr(toxicity, "STEPS", 200)
    r, vocabulary, rows = random.Random(4), [f"word{i}" for i in range(300)], []
    for i in range(900):
        w = [r.choice(vocabulary) for _ in range(3500 if i % 9 == 0 else 60)]
        if i % 3 == 0:
            for at in r.sample(range(len(w)), max(3, len(w) // 20)):
                w[at] = "vilething" if i % 9 == 0 else "nastyname"
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = toxicity.labelled(df.drop("toxic"), df.select("doc_id", "toxic"))
    assert learned.count() == df.where(~toxicity.held_out("doc_id")).count() and learned.select("part").distinct().count() > 2
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    got = toxicity.predict(df, model).join(df.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert any(x.doc_id % 9 == 0 for x in got) and sum(x.predicted == x.toxic for x in got) / len(got) > 0.95
    assert toxicity.fit(df.where("length(text) > 20000"), df.select("doc_id", (df.doc_id % 2).cast("int").alias("toxic"))) is not None


def test_toxicity_moves_the_rows_it_learns_from_once(spark, monkeypatch):
    """op7: texts without a label stay where they are, one of equal texts with equal labels is moved, and a bitmap that tells nothing changes no row."""
    import random

    from corpusloom.llm import common, toxicity

    def shuffled() -> int:
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    r = random.Random(6)
    texts = [" ".join(f"{r.getrandbits(40):x}" for _ in range(200)) for _ in range(2500)]
    rows = [(i, texts[i % 7 if i < 300 else i]) for i in range(2500)] + [(i, texts[i]) for i in range(300, 400)] + [(i, texts[i + 1]) for i in range(400, 450)] + [(9000, None), (9001, ""), (None, "no id")]
    labels = [(i, int(i % 8 == 0)) for i in (*range(450), *range(9000, 9100))] + [(i, 1) for i in range(40)] + [(41, None), (None, 1)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = {i for (i,) in df.where(~toxicity.held_out("doc_id")).where("doc_id is not null").select("doc_id").collect()}
    y = {i: max(v for j, v in labels if j == i and v is not None) for i in {j for j, v in labels if v is not None} & kept}
    want = []
    for t, v in {(t, y[i]) for i, t in rows if t is not None and i in y}:
        raw = np.frombuffer(t.encode(), np.uint8)
        want.append((v, toxicity.slots(common.word_hashes(raw, np.array([0, len(raw)]), toxicity._LOOKUP)[1]).astype(np.uint16).tobytes()))
    monkeypatch.setattr(toxicity, "PART", 60)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        start = shuffled()
        got = toxicity.labelled(df, marks)
        assert shuffled() - start < 0.3 * sum(len(t or "") for _, t in rows)
        assert sorted((x.y, bytes(x.slots)) for x in got.collect()) == sorted(want)
        monkeypatch.setattr(toxicity, "_bitmap", lambda keys, n: np.full(4096, 255, np.uint8))
        assert sorted(map(tuple, toxicity.labelled(df, marks).collect())) == sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_toxicity_parts_are_even(spark, monkeypatch):
    """op7: a division that drops the low bits of hashes had put all rows in one of four parts."""
    from corpusloom.llm import toxicity

    monkeypatch.setattr(toxicity, "PART", 150)
    df = spark.range(850).selectExpr("id as doc_id", "concat('word', id) as text", "cast(id % 2 as int) as toxic")
    got = [r["count"] for r in toxicity.labelled(df, df.select("doc_id", "toxic")).groupBy("part").count().collect()]
    assert len(got) == 4 and min(got) > 100


def test_words_are_those_of_the_pattern(spark):
    """F8, F15: texts are split in numpy as Spark's own pattern splits them, whatever their characters."""
    from pyspark.sql import functions as F

    from corpusloom.functions.text import tokens

    odd = ["", None, " ", "_a b_", "ÉCOLE d'été — Straße", "ΑΣ Σ", "İstanbul ı", "日本語 テキスト。漢字", "𝒳𝒴 𐐀x 😀a😀", "½ x² ⅷ ٣٤ áb", "x\x00y\x85z\xa0w​v", "Ab" * 3000, "€\U0010fffdA"]
    df = spark.createDataFrame([(i, "p", x) for i, x in enumerate(odd)], "chunk_id long, project_id string, text string").coalesce(1)
    want = {}
    for r in df.select("chunk_id", F.explode(tokens(F.col("text"))).alias("w")).collect():
        own = want.setdefault(r.chunk_id, {})
        own[r.w] = own.get(r.w, 0) + 1
    got = {r.chunk_id: (r.dl, {t.term: t.tf for t in r.terms}) for r in retrieve.counted(df).collect()}
    assert {i: x for i, (_, x) in got.items() if x} == want and {i: n for i, (n, _) in got.items()} == {i: None if x is None else sum(want.get(i, {}).values()) for i, x in enumerate(odd)}
    assert {r.id for r in embed.hashed(df, "chunk_id", "text").collect()} == set(want)


def test_whole_documents_are_embedded_without_a_shuffle(spark):
    """F8, r18_whole_document: no text or token moves between tasks."""
    out = retrieve.embedded(spark.createDataFrame([(1, "p", "a b")], "chunk_id long, project_id string, text string"), "chunk_id", "text", "embedding")
    assert "Exchange" not in out._jdf.queryExecution().toString()


def test_citations_sort_no_postings(spark, monkeypatch):
    """F15, t10_citations: a search for a table of questions makes no index by term of its own."""
    from corpusloom.operators import text_index

    def build(*_):
        raise AssertionError("postings of all documents are sorted")

    monkeypatch.setattr(text_index, "build", build)
    monkeypatch.setattr(retrieval_queries, "_KEPT", {})
    assert QUERIES["t10_citations"](spark, DATA).count() > 0


def test_keyword_search_keeps_the_best_of_each_slice(spark, monkeypatch):
    """F14, r20_overlap_fallback: few rows leave a slice of texts, ties, named files, odd characters and other projects included, and the top k are those of brute force."""
    import random
    import re

    monkeypatch.setattr(retrieve, "HELD", 1 << 8)
    r = random.Random(3)
    stems = ["straße", "école", "houses", "blue", "bluebird", "日本語の本", "😀x😀y", "_under", "what", "abcd"]
    say = lambda n: " ".join(r.choice(["", "un"]) + r.choice(stems) + r.choice(["", "s", ",", ". "]) for _ in range(n))
    texts = [(f"c{i}", r.choice("pq"), f"File{i % 3}.txt", r.choice([None, "", say(3), say(20).upper(), say(60)])) for i in range(400)]
    asked = [(i, r.choice("pqz"), say(4) + r.choice(["", " in file1.TXT"])) for i in range(30)]
    q, c = spark.createDataFrame(asked, "query_id long, project_id string, question string"), spark.createDataFrame(texts, "chunk_id string, project_id string, source string, text string")
    out = retrieve.file_fallback(q, c.repartition(3), 4)
    want = set()
    for i, p, question in asked:
        words = {w for w in re.findall(r"\w+", question.lower()) if len(w) > 3}
        rows = [(-(0.9 if f.lower() in question.lower() else min(0.8, round(0.5 + 0.1 * sum(w in (t or "").lower() for w in words), 6))), k) for k, o, f, t in texts if o == p]
        want |= {(i, k, -s, n) for n, (s, k) in enumerate(sorted(rows)[:4], 1)}
    assert {(x.query_id, x.chunk_id, x.score, x.rank) for x in out.collect()} == want
    found = retrieve.keyword_top(q, c.coalesce(1), 4, lambda n, of: n / of)
    assert "Exchange" not in found._jdf.queryExecution().toString()
