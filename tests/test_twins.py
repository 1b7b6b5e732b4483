"""Operators that SQL doesn't express against plain loops over the same texts, and literal cases of formulas and formats."""

import re

import pytest
from conftest import DATA
from corpusloom.functions import text as t
from corpusloom.operators import chunk, context, retrieve, text_index
from corpusloom.plans import QUERIES
from pyspark.sql import functions as F

MARKS = (". ", ".\n", "! ", "!\n", "? ", "?\n", "\n\n", "\n")


def windows(text, size=1000, overlap=200):
    """(start, end): each window ends behind the last mark of the first kind found beyond the overlap."""
    out, at = [], 0
    if len(text) <= size:
        return [(0, len(text))] if text.strip() else []
    while True:
        end = min(at + size, len(text))
        if end < len(text):
            for mark in MARKS:
                places = [i for i in range(at + overlap, end - len(mark) + 1) if text.startswith(mark, i)]
                if places:
                    end = places[-1] + len(mark)
                    break
        if text[at:end].strip():
            out.append((at, end))
        if end == len(text):
            return out
        at = end - overlap


def merged(parts, least=100):
    out = []
    for p in parts:
        if len(p) >= least:
            out.append(p)
        elif out and p:
            out[-1] += "\n\n" + p
    return out


def force(text, size=2000):
    return [x for i in range(0, len(text), size) if (x := text[i : i + size].strip())]


def marked(text):
    lines = []
    for line in text.split("\n"):
        s = line.strip()
        lines.append(f"## {s}" if s and len(s) < 80 and (s.upper() == s and s.lower() != s or s.endswith(":")) else s)
    return "\n".join(lines)


def split(text, seps, most=2000):
    if not seps:
        return [text] if len(text) <= most else force(text, most)
    pieces = [p for x in text.split(seps[0]) if (p := x.strip())]
    if text.count(seps[0]) and pieces:
        return [q for p in pieces for q in ([p] if len(p) <= most else split(p, seps[1:], most))]
    return split(text, seps[1:], most)


SEPS = ["\n\n\n", "\n\n", "\n---\n", "\n# ", "\n## ", "\n### ", "\n", ". "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    long = "word " * 1500
    rows += [(9001, None), (9002, ""), (9003, " \n "), (9004, "a" * 4500), (9005, "# A\n" + long + "\n## B\nshort\n\n\n" + "x. " * 900), (9006, "\n---\n".join(["one " * 60, "two", "three " * 600])), (9007, "CAPS LINE\n" + "Sentence one. " * 40)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def by_id(df, *cols):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]])
    return out


@pytest.mark.parametrize("size,overlap", [(1000, 200), (1000, 500), (300, 0)])
def test_windows(docs, texts, size, overlap):
    got = by_id(chunk.windows(docs, "doc_id", "text", size, overlap), "start", "end", "text")
    for i, x in texts.items():
        assert got.get(i, []) == [(a, b, x[a:b]) for a, b in windows(x, size, overlap)]


def test_recursive_splits(docs, texts):
    got = by_id(chunk.recursive(docs, "doc_id", "text"), "text")
    for i, x in texts.items():
        parts = got.get(i, [])
        assert all(p in x and len(p) <= 1000 for p in parts)
        if len(set(x)) < 20:
            continue  # a part of one letter may lie anywhere
        at = 0
        for p in parts:  # each begins where the one before ends, white space apart, or up to the overlap earlier
            next_ = at + len(x[at:]) - len(x[at:].lstrip())
            found = next((i for i in range(next_, max(-1, at - 201), -1) if x.startswith(p, i)), None)
            assert found is not None
            at = max(at, found + len(p))
        assert not x[at:].strip()


def test_markdown_chunks(docs, texts):
    got = by_id(chunk.exploded(docs, "doc_id", chunk.markdown(F.col("text"))), "text")
    for i, x in texts.items():
        marks = marked(x)
        assert got.get(i, []) == merged([p for q in split(marks, SEPS) if (p := q.strip())]), i


def test_parents_and_children(docs, texts):
    rows = chunk.parent_child(docs, "doc_id", "text").collect()
    got = {r.chunk_id: (r.type, r.parent_id, r.chunk_index, r.text) for r in rows}
    want = {}
    for i, x in texts.items():
        for n, (a, b) in enumerate(windows(x, 2000, 500)):
            want[f"{i}_parent_{n}"] = ("parent", None, n, x[a:b])
            for m, (c, d) in enumerate(windows(x[a:b], 500, 100)):
                want[f"{i}_parent_{n}_child_{m}"] = ("child", f"{i}_parent_{n}", m, x[a:b][c:d])
    assert got == want and len(rows) == len(want)


def cascade(docs, text):
    """(strategy, chunks) of one text by the strategies one after the other, each from its own twin."""
    sentences = [s for p in re.split(r"[.!?]+\s+", text) if (s := p.strip())]
    packed, now = [], []
    for s in sentences:
        if sum(map(len, now)) + len(s) <= 2000:
            now.append(s)
            continue
        packed += [" ".join(now)] if len(" ".join(now)) >= 100 else []
        packed, now = (packed + force(s), []) if len(s) > 2000 else (packed, [s])
    packed += [" ".join(now)] if len(" ".join(now)) >= 100 else []
    heads, cur = [], []
    for line in (x.strip() for x in text.split("\n")):
        if cur and line and heading(line):
            heads, cur = heads + ["\n".join(cur).strip()], []
        cur.append(line)
    heads = merged([h for h in [*heads, "\n".join(cur).strip()] if h])
    fits = heads and 100 <= sum(map(len, heads)) / len(heads) <= 2000
    long = merged([p for q in split(marked(text), SEPS) if (p := q.strip())]) if len(text) > 2000 else []
    for name, parts in (("element", heads if fits else []), ("recursive", long), ("sentence", packed), ("window", [text[a:b] for a, b in windows(text)])):
        if parts:
            return [(name, p) for p in parts]
    return []


def heading(line):
    patterns = [r"#{1,6}\s+.+$", r"[А-ЯЁ][А-ЯЁ\s]{2,50}$", r"\d+\.\s+[А-ЯЁ]", r"[А-ЯЁ][а-яё\s]{5,100}:$"]
    return any(re.match(p, line) for p in patterns) or len(line) < 80 and line.upper() == line and line.lower() != line and len(re.split(r"\s+", line)) < 10


def test_cascade(docs, texts):
    got = by_id(chunk.cascade(docs, "doc_id", "text"), "strategy", "text")
    for i, x in texts.items():
        assert got.get(i, []) == cascade(docs, x), i


def test_hierarchical(docs, texts):
    got = {(r.doc_id, r.section_index, r.chunk_index_in_section): (r.title, r.strategy, r.text) for r in chunk.hierarchical(docs, "doc_id", "text").collect()}
    want = {}
    for i, x in texts.items():
        parts, title = [], "Введение"
        for line in x.split("\n"):
            s = line.strip()
            if re.match(r"(?i)(?:(?:ГЛАВА|РАЗДЕЛ|ЧАСТЬ)\s+\d+[.\s]*(.+)?|(?:\d+\.?\s+)?[A-ZА-ЯЁ][A-ZА-ЯЁ\s]{5,50}|#{1,2}\s+.+)$", s):
                parts.append((s, line + "\n"))
            elif parts:
                parts[-1] = (parts[-1][0], parts[-1][1] + line + "\n")
            else:
                parts.append((title, line + "\n"))
        parts = [p for p in parts if p[1].strip()] or [("Основной текст", x)]
        for n, (head, body) in enumerate(parts):
            for m, (name, c) in enumerate(cascade(docs, body)):
                want[i, n, m] = (head, name, c)
    assert got == want


def test_overlap_fallback(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    langs = ["en", "fr", "de", "es"]
    got = {}
    for r in QUERIES["r20_overlap_fallback"](spark, DATA).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.chunk_id, r.score)
    parts = {}
    for i, d in docs.items():
        if len(d.text or "") > 50:
            for n, (a, b) in enumerate(windows(d.text, 1000, 500)):
                parts.setdefault(d.lang, []).append((f"{i}_{n}", f"src{i % 7}", d.text[a:b].lower()))
    for q in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        text = q.text + (f" in SRC{q.item_id % 2}?" if q.item_id % 3 == 0 else "")
        words = {w for w in re.findall(r"\w+", text.lower()) if len(w) > 3}
        rows = [(-(0.9 if source in text.lower() else min(0.8, round(0.5 + 0.1 * sum(w in low for w in words), 6))), c) for c, source, low in parts.get(langs[q.item_id % 4], [])]
        want = {n: (c, -s) for n, (s, c) in enumerate(sorted(rows)[:5], 1)}
        assert got.get(q.item_id, {}) == want


def test_cascade_of_techniques(spark):
    """Later techniques run for queries that are short of hits only; the first that finds a text wins; short texts are left out."""
    texts = spark.createDataFrame([(i, f"text number {i} is long enough" if i < 8 else "short") for i in range(10)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    asked = []

    def stage(name, hits):
        def run(left):
            asked.append((name, sorted(r.query_id for r in left.collect())))
            return left.join(spark.createDataFrame([(q, c, s, name) for q, c, s in hits], "query_id long, chunk_id long, score double, method string"), "query_id")

        return run

    stages = [stage("a", [(1, 0, 0.9), (1, 1, 0.8), (2, 0, 0.5), (2, 9, 0.9)]), stage("b", [(2, 0, 0.99), (2, 3, 0.4), (3, 4, 0.3)]), stage("c", [(3, 4, 0.9), (3, 5, 0.2)])]
    got = {(r.query_id, r.chunk_id): (r.method, r.score) for r in retrieve.cascade(queries, stages, texts, 2).collect()}
    assert asked == [("a", [1, 2, 3]), ("b", [2, 3]), ("c", [3])]
    assert got == {(1, 0): ("a", 0.9), (1, 1): ("a", 0.8), (2, 0): ("a", 0.5), (2, 3): ("b", 0.4), (3, 4): ("b", 0.3), (3, 5): ("c", 0.2)}


def test_adaptive_parameters(spark):
    words = " ".join(f"w{i}" for i in range(16))
    q = spark.createDataFrame([(1, "Что это?"), (2, "Объясни подробно как работает система и сравни с другими"), (3, words), (4, "Просто несколько слов о системе"), (5, "Что это?"), (6, words)], "query_id long, question string")
    quality = spark.createDataFrame([(3, 0.4), (4, 0.9), (5, 0.9), (6, 0.5)], "query_id long, quality double")
    got = {r.query_id: (r.complexity, r.k) for r in retrieve.adaptive_k(q, quality, 5).collect()}
    assert got == {1: ("simple", 3), 2: ("complex", 10), 3: ("complex", 13), 4: ("medium", 3), 5: ("simple", 3), 6: ("complex", 10)}
    found = spark.createDataFrame([(1, 4, "simple"), (2, 5, "medium"), (3, 11, "medium"), (4, 10, "complex"), (5, 0, "complex"), (6, None, "simple")], "query_id long, hits long, complexity string")
    assert {r.query_id: r.threshold for r in retrieve.adaptive_threshold(found).collect()} == {1: 0.4, 2: 0.5, 3: 0.6, 4: 0.45, 5: 0.35, 6: 0.4}
    scores = spark.createDataFrame([(1, 0.8), (1, 0.7), (1, 0.6), (2, 0.5), (2, 0.3), (3, 0.1)], "query_id long, score double")
    assert {r.query_id: r.quality for r in retrieve.quality(scores).collect()} == {1: 0.9, 2: 0.5, 3: 0.1}


def test_rerank_formula(spark):
    q = spark.createDataFrame([(1, "Where is THIS Blue house, tell about house")], "query_id long, question string")
    texts = spark.createDataFrame([(1, "the blue house, " + "x" * 200), (2, "house"), (3, "")], "chunk_id long, text string")
    hits = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.9)], "query_id long, chunk_id long, score double")
    got = {r.chunk_id: r.score for r in retrieve.rerank(hits, q, texts, 5, t.RERANK_STOP_WORDS).collect()}
    # Keywords: where blue house tell about; words: where this blue "house," tell about house.
    assert got == {1: round(0.2 + 0.4 * 2 / 5 + 0.2 * 0.3 + 0.1, 6), 2: round(0.2 + 0.4 / 5 + 0.2 * 0.1 - 0.2, 6)}


def test_expansion(spark):
    q = spark.createDataFrame([(1, "p", "What is the Price of big Blue houses here"), (2, "p", "is it"), (3, "p", "one two six ten")], "query_id long, project_id string, question string")
    got = {}
    for r in retrieve.expand(q, t.STOP_WORDS).orderBy("query_id", "n").collect():
        got.setdefault(r.query_id, []).append(r.variant)
    assert got == {1: ["What is the Price of big Blue houses here", "what price blue houses here", "what price big blue houses here", "what is the price of"], 2: ["is it"], 3: ["one two six ten"]}


def test_stored_and_preview_fallbacks_fill_up(spark):
    q = spark.createDataFrame([(1, "p", "blue houses in A.TXT"), (2, "p", "nothing"), (3, "q", "blue")], "query_id long, project_id string, question string")
    c = spark.createDataFrame([(i, "p", f"{n}.txt", x) for i, (n, x) in enumerate([("b", "no hit here"), ("c", "blueish"), ("a", "blue houses"), ("d", "")])], "chunk_id long, project_id string, source string, text string")
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in retrieve.stored_fallback(q, c, 3).collect()}
    assert got == {(1, 1): (2, 0.7), (1, 2): (1, 0.6), (1, 3): (0, 0.5), (2, 1): (0, 0.5), (2, 2): (1, 0.5), (2, 3): (2, 0.5)}
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in retrieve.file_fallback(q, c, 2, 0.7, 0.4, 0.0).collect()}
    assert got == {(1, 1): (2, 0.7), (1, 2): (0, 0.4), (2, 1): (0, 0.4), (2, 2): (1, 0.4)}


def test_stored_index_gives_the_same_hits(spark, tmp_path):
    c = spark.createDataFrame([(i, "p", " ".join(f"w{(i * j) % 17}" for j in range(1, 12))) for i in range(40)], "chunk_id long, project_id string, text string")
    q = spark.createDataFrame([(1, "p", "w3 w5 w5"), (2, "p", "w1 unknown")], "query_id long, project_id string, question string")
    index = retrieve.bm25_index(c)
    stored = text_index.build(c, str(tmp_path / "i"), 4)
    rows = lambda ix: sorted(map(tuple, retrieve.bm25(q, ix, 5).collect()))
    assert rows(stored) == rows(text_index.TextIndex(spark, str(tmp_path / "i"), parts=4)) == rows(index)


def test_formats(spark):
    hits = spark.createDataFrame([(1, 10, "a.txt", 0, "first text", 0.875, 1), (1, 11, None, 4, "second", 0.5, 2), (1, 12, "", 0, "", 0.4, 3)], "query_id long, chunk_id long, source string, chunk_index int, text string, score double, rank int")
    assert context.pack_until_full(hits, 200).first().context == "[a.txt, часть 1]\nfirst text\n\n---\n[Документ, часть 5]\nsecond\n"
    assert context.pack_until_full(hits, 16, with_header=False).first().context == "[Источник: a.txt]\nfirst text\n\n---\n\n[Источник: неизвестно]\nsecond"
    assert context.pack_skipping(hits, 9).first().context == "second" and context.pack_skipping(hits, 16).first().context == "first text\n\n---\n\nsecond"
    assert context.fragments(hits.where("rank < 3")).first().context.split("\n\n")[1] == "Фрагмент 2 (источник: Документ 2, релевантность: 0.50):\nsecond"
    cited = hits.withColumn("document_id", F.when(F.col("rank") == 1, "0123456789")).withColumn("text", F.when(F.col("rank") == 1, F.concat(F.repeat(F.lit("x"), 99), F.lit(" y"))).otherwise(F.col("text")))
    assert context.citations(cited).first().citations.split("\n")[:2] == [f'1. Документ 01234567, чанк 1: "{"x" * 99}..."', '2. Чанк 2, чанк 5: "second"']
    files = spark.createDataFrame([("p", "My_report.pdf", "pdf", "2024-05-06"), ("p", "a.txt", "txt", "2024-01-01")], "project_id string, filename string, file_type string, created string").withColumn("created", F.to_date("created"))
    assert context.catalogue(files).first().catalogue == "Доступные документы в проекте:\n1. Файл: My_report.pdf (тип: PDF)\n   Ключевые слова: report\n   Загружен: 2024-05-06\n2. Файл: a.txt (тип: TXT)\n   Загружен: 2024-01-01"


def test_answers_and_caps(spark):
    df = spark.createDataFrame([("One. Two is long", "c" * 12), ("no stop here at all", ""), ("A. B", None)], "x string, c string")
    got = [r[0] for r in df.select(t.truncate_answer(F.col("x"), 20, F.col("c"), 8)).collect()]
    # The first is cut behind "One", then its citations overflow, and the second cut finds no other full stop than that of the dots.
    assert got[2] == "A. B" and got[1] == "no stop here..." and got[0].endswith("...") and len(got[0]) <= 23
    assert spark.createDataFrame([("abcdef",)], "x string").select(t.cap(F.col("x"), 3)).first()[0] == "abc\n\n[... документ обрезан, всего 6 символов ...]"
