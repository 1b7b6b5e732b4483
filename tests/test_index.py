"""Kept indexes: a BM25 index under changes equals one built anew, block-max gives the rows of the full search, and the dense index finds what exact search finds."""

import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from corpusloom.operators import dense_index, retrieve, text_index
from corpusloom.plans import QUERIES

CHUNKS, ASKED = "chunk_id long, project_id string, text string", "query_id long, project_id string, question string"


def texts(seed, ids, projects=("p", "q")):
    r = random.Random(seed)
    return [(i, projects[i % len(projects)], " ".join(f"w{min(int(r.paretovariate(0.6)), 60)}" for _ in range(r.choice([0, 1, 5, 12, 40])))) for i in ids]


def facts(index):
    postings, terms, collections = index
    return (
        sorted(map(tuple, postings.select("project_id", "term", "chunk_id", "tf", "dl").collect())),
        sorted((r.project_id, r.term, r.df, round(r.idf, 9)) for r in terms.select("project_id", "term", "df", "idf").collect()),
        sorted((r.project_id, r.n, round(r.avgdl, 9)) for r in collections.collect()),
    )


def test_changed_index_equals_a_new_one(spark, tmp_path):
    now = {c[0]: c for c in texts(1, range(40))}
    ix = text_index.build(spark.createDataFrame(list(now.values()), CHUNKS), str(tmp_path / "i"), 4)
    r = random.Random(2)
    for step in range(4):
        if step == 2:
            ix.merge()
        elif step == 1:
            gone = r.sample(sorted(now), 12) + [999]
            ix.delete(spark.createDataFrame([(i,) for i in gone], "chunk_id long"))
            for i in gone:
                now.pop(i, None)
        else:
            new = texts(10 + step, r.sample(range(70), 20))
            ix.add(spark.createDataFrame(new, CHUNKS))
            now |= {c[0]: c for c in new}
    again = text_index.TextIndex(spark, str(tmp_path / "i"), parts=4)
    assert (again.version, again.segments) == (ix.version, ix.segments)
    want = retrieve.bm25_index(spark.createDataFrame(list(now.values()), CHUNKS))
    assert facts(again.all_()) == facts(want)
    q = spark.createDataFrame([(1, "p", "w3 w5 w5"), (2, "q", "w1 unknown"), (3, "none", "w1")], ASKED)
    rows = lambda index: sorted(map(tuple, retrieve.bm25(q, index, 5).collect()))
    assert rows(again) == rows(want)


def test_a_change_that_fails_leaves_the_version_before(spark, tmp_path, monkeypatch):
    ix = text_index.build(spark.createDataFrame(texts(1, range(9)), CHUNKS), str(tmp_path / "i"), 4)
    before = facts(ix.all_())

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(text_index.TextIndex, "_publish", stop)
        with pytest.raises(RuntimeError):
            ix.add(spark.createDataFrame(texts(2, range(5, 20)), CHUNKS))
    again = text_index.TextIndex(spark, str(tmp_path / "i"), parts=4)
    assert facts(again.all_()) == before
    again.add(spark.createDataFrame(texts(3, range(5, 20)), CHUNKS))
    assert facts(again.all_()) == facts(retrieve.bm25_index(spark.createDataFrame(texts(1, range(5)) + texts(3, range(5, 20)), CHUNKS)))


def test_searches_read_the_parts_of_their_terms(spark, tmp_path):
    ix = text_index.build(spark.createDataFrame(texts(1, range(60)), CHUNKS), str(tmp_path / "i"), 16)
    asked = retrieve.asked_terms(spark.createDataFrame([(1, "p", "w3")], ASKED))
    postings, terms, _ = ix.of_terms(asked)
    for df in (postings, terms):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "part" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {r[0] for r in postings.select(text_index.term_part(16)).distinct().collect()} == {r[0] for r in asked.select(text_index.term_part(16)).collect()}


def test_empty_index(spark, tmp_path):
    ix = text_index.build(spark.createDataFrame([], CHUNKS), str(tmp_path / "i"), 4)
    q = spark.createDataFrame([(1, "p", "w3")], ASKED)
    assert retrieve.bm25(q, ix, 5).count() == 0 and retrieve.bm25(q, text_index.TextIndex(spark, str(tmp_path / "none")), 5).count() == 0
    assert facts(ix.add(spark.createDataFrame(texts(1, range(5)), CHUNKS)).merge().all_()) == facts(retrieve.bm25_index(spark.createDataFrame(texts(1, range(5)), CHUNKS)))


@pytest.mark.parametrize("zone", [1, 4])
def test_block_max_gives_the_rows_of_the_full_search(spark, tmp_path, zone):
    r = random.Random(7)
    c = spark.createDataFrame(texts(5, range(300)), CHUNKS)
    q = spark.createDataFrame([(i, "pq"[i % 2], " ".join(f"w{min(int(r.paretovariate(0.6)), 70)}" for _ in range(r.randint(0, 12)))) for i in range(30)], ASKED)
    ix = text_index.build(c, str(tmp_path / "i"), 4)
    out, work = text_index.block_max(q, ix, text_index.store_blocks(ix, zone=zone), 4)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, retrieve.bm25(q, ix, 4).collect()))
    work = work.collect()
    assert all(0 < w.scored <= w.postings for w in work) and sum(w.scored for w in work) < sum(w.postings for w in work)


def test_dense_index_recall_on_the_given_vectors(spark):
    rows = QUERIES["r1_index_recall"](spark, DATA.replace("0.001", "0.01")).collect()
    assert len(rows) == 25 and sum(r.found for r in rows) >= 0.9 * sum(r.expected for r in rows)


def test_dense_index_prunes_what_lies_in_clusters(spark):
    g = np.random.default_rng(3)
    centres = g.normal(size=(30, 16))
    rows = [(i, "ab"[i % 2], (centres[i % 30] + 0.05 * g.normal(size=16)).tolist()) for i in range(3000)] + [(5000 + i, "a", [1.0] * 16) for i in range(700)] + [(9000, "a", None), (9001, "b", [0.0] * 16)]
    v = spark.createDataFrame(rows, "chunk_id long, project_id string, embedding array<double>")
    index = dense_index.build(v)
    assert index.probes <= len(index.centroids) / 3
    q = dense_index.usable(v, "embedding").where("chunk_id % 60 = 0").select(F.col("chunk_id").alias("query_id"), "project_id", F.col("embedding").alias("q"))
    exact = retrieve.dense(q, dense_index.usable(v, "embedding"), 10, 0.2)
    got = dense_index.recall(dense_index.search(q, v, index, 10, 0.2), exact).collect()
    assert len(got) == q.count() and sum(r.found for r in got) >= 0.9 * sum(r.expected for r in got)
    shown = lambda d: sorted(map(tuple, d.select("query_id", "chunk_id", "score", "rank").collect()))
    assert shown(dense_index.search(q, v, index, 3, 0.2, probes=len(index.centroids))) == shown(retrieve.dense(q, dense_index.usable(v, "embedding"), 3, 0.2))


def test_dense_index_of_nothing(spark):
    v = spark.createDataFrame([], "chunk_id long, project_id string, embedding array<double>")
    q = spark.createDataFrame([(1, "a", [1.0, 0.0])], "query_id long, project_id string, q array<double>")
    assert dense_index.search(q, v, dense_index.build(v), 3).count() == 0
