"""The pipeline against expectations that owe nothing to its stages, and on odd tables."""

import hashlib
import re

import pytest
from conftest import DATA
from corpusloom.llm import pii
from corpusloom.llm.registry import ORACLE
from test_llm import brute_groups, tik
from test_pii import brute, brute_rounds

import corpus_pipeline


def contaminated(text, windows):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit = {k for n in {len(x) for x in windows} for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in windows for k in range(j, j + n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def benchmark_windows(items):
    out = set()
    for t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out |= {tuple(w[i : i + 13]) for i in range(max(len(w) - 12, 1))} if w else set()
    return out


def redacted(texts):
    """Texts with base kinds and the identifiers that brute-force rounds over these texts believe in."""
    ids = {v for v, x in brute_rounds(texts.values()).items() if x >= pii.BELIEVED}
    out = {}
    for i, t in texts.items():
        more = [(m.start(), 4, "id", m.end(), m[0]) for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z_-]*[0-9][A-Za-z0-9_-]*", t) if m[0] in ids]
        parts, at = [], 0
        for a, _, kind, b, _ in sorted(brute(t) + more):
            if a >= at:
                parts += [t[at:a], f"[{kind}]"]
            at = max(at, b)
        out[i] = "".join(parts) + t[at:]
    return out


def test_pipeline_matches_brute_force(spark, duck):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kept = {i for (i,) in duck.execute(f"select doc_id from ({ORACLE['op2_quality']}) where kept").fetchall()}
    kept = {i for i, (_, c) in brute_groups({i: t for i, t in texts.items() if i in kept}).items() if c == i}
    windows = benchmark_windows(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect())
    kept = {i for i in kept if not contaminated(texts[i], windows)}
    clean, own = redacted({i: texts[i] for i in kept}), tik()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert set(got) == kept
    for i, t in clean.items():
        ids = own.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids, and columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    a, b = "one two three four five six seven eight nine ten eleven twelve", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, a), (1, b), (2, b), (3, a), (3, a), (4, None), (5, ""), (6, " \n"), (7, long), (8, "x" * 50_000), (9, "write to me@mail.example.com or +49 30 1234567 if you like what you read here"), (None, a), (None, "no id but ten words or more are in this text here")]
    where = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None, 1, "v", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, value string, spans int")
    docs.write.parquet(f"{where}/documents.parquet")
    docs.limit(0).write.parquet(f"{where}/none/documents.parquet")
    for at in (where, f"{where}/none"):
        spark.createDataFrame([(1, 1, 0), (None, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, "theta iota kappa lambda"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return where


def test_odd_rows(spark, folder):
    """Of A and B under one id each text stays once; nulls, blanks and texts of few words fail the base rules; contaminated ones go; rows without an id stay."""
    got = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    own = tik()
    a = "one two three four five six seven eight nine ten eleven twelve"
    clean = "write to [email] or [phone] if you like what you read here"
    long = " ".join(f"w{i}" for i in range(30_000))
    count = lambda t: len(own.encode_ordinary(t))
    assert {k: sorted(v) for k, v in got.items()} == {1: [count(a)], 7: [count(long)], 9: [count(clean)], None: sorted([count(a), count("no id but ten words or more are in this text here")])}


def test_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_each_stage_returns_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
