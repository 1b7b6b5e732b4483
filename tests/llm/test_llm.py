"""Training-data operators: brute-force twins on small fixtures, round trips, held-out accuracy, and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from corpusloom.llm import bpe, contamination, htmlmain, langid, licenses, neardup, pii, quality, token_files, toxicity
from corpusloom.llm.registry import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, value int"
ODD = [None, "", " \n\t ", "a", "é😀 ñ", "x" * 50_000, "word " * 30_000, "Same text here again and once more. " * 3]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None, None, "k", i) for i, t in enumerate(ODD)]
    rows += [rows[7], (20, ODD[7], None, None, None, None, None), (None, "no id, four words", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def tik():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def ids_of(texts):
    enc, dec = bpe.codec(bpe.tokenizer_path("byte_bpe_50k.tiktoken"), bpe.default_pattern())
    out = []
    for lo, hi, _, _, ids, to in bpe.encoded_blocks(pa.array(texts, pa.string()), enc, 3000):
        out += [ids[to[i] : to[i + 1]] for i in range(hi - lo)]
    return out, dec


def test_bpe_ids_are_those_of_the_rank_library():
    r, own = random.Random(5), tik()
    parts = [" ", "  ", "\n", "\t", " \n", "a", "the", "ing", "ñ", "é", "ß", "😀", "中", "1", "!", "---", "'s", "<|endoftext|>", "\x1c", "\x85", "\xa0", " ", "“", "«", "%%%", "."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(4000)] + [None, ""] + [c * n for c in "a- \n" for n in (1, 2, 3, 50)]
    got, dec = ids_of(texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == own.encode_ordinary(t or "")
        assert dec.decode(ids).tobytes().decode() == (t or "")


def test_bpe_offsets_and_split_characters(spark):
    text = "é😀 中x"
    r = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    own = tik()
    raw = [own.decode_single_token_bytes(i) for i in r.ids]
    at = 0
    for b, s, e in zip(raw, r.starts, r.ends, strict=True):
        n = len(text.encode()[:at].decode("utf-8", "ignore"))
        assert s == n and len(text.encode()[: at + len(b)].decode("utf-8", "replace")) == e
        at += len(b)
    back = bpe.decode(spark.createDataFrame([(1, r.ids)], "id long, ids array<int>")).first()
    assert back.text == text and bytes(back.bytes) == text.encode()


def test_op1_digests(spark, rows):
    own = tik()
    for r in QUERIES["op1_byte_bpe"](spark, DATA).collect():
        ids = own.encode_ordinary(rows[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest())


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 3000):
        for hi in (1, 2, 300, 50_000, 2**31, 2**60, 2**63):
            v = r.integers(0, hi, n).astype(np.uint64)
            v[r.random(n) < 0.3] = 0
            if n > 5:
                v[5] = 2**64 - 1
            assert (token_files.unpack(*token_files.pack(v), n) == v).all()


def test_op9_files(spark, rows):
    own, start = tik(), 0
    got = {r.doc_id: r for r in QUERIES["op9_token_files"](spark, DATA).collect()}
    for i in sorted(rows):
        ids = np.array([*own.encode_ordinary(rows[i] or ""), 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    ours = sorted(map(str, (tuple(r) for r in df.select(*order).collect())))
    assert ours == sorted(map(str, duck.execute(f"select {', '.join(order)} from ({ORACLE[name]})").fetchall()))


def test_binomial_tail_is_exact(spark):
    for n, k, p in ((100, 0, 0.05), (5000, 40, 0.01), (200, 2, 0.01), (3, 0, 0.3)):
        got = spark.sql(f"select {quality.binomial_tail('k', 'n', p)} x from (select {k}L k, {n}L n)").first().x
        q = Fraction(p)
        want = sum(math.comb(n, j) * q**j * (1 - q) ** (n - j) for j in range(k + 1))
        assert abs(got / float(want) - 1) < 1e-9


def test_certified_cutoffs_keep_their_promise(spark):
    good = [(i, "en", 50, 100, 0 if i else 60, 0, 0) for i in range(4000)]
    counted = spark.createDataFrame(good + [(9000 + i, "fr", 50, 100, 0, 0, 0) for i in range(30)], "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    labels = counted.select("doc_id", F.lit(1).alias("quality"))
    got = {(r.stratum, r.feature): r for r in quality.certified_cutoffs(counted, labels).collect()}
    assert {s for s, _ in got} == {"en"}  # thirty labels certify nothing
    assert got["en", "symbols"].cutoff == 0.05 and got["en", "symbols"].k == 1


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_groups(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(sets)
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in order}


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, passage = {}, [r.choice(vocabulary) for _ in range(40)]
    for g in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([4, 5, 30, 150]))] + (passage if g % 3 == 0 else [])
        for _ in range(12):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts[len(texts)] = " ".join(w)
    texts |= {1000: "", 1001: "A b C", 1002: "a B c", 1003: " \n"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.classes(df).collect()}
    assert got == brute_groups(texts)


def test_hyperminhash_estimates():
    r = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.9):
        both, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (int(600 * share), int(300 * (1 - share)), int(300 * (1 - share))))
        one, two = np.concatenate((both, a)), np.concatenate((both, b))
        x, y = (neardup.registers(np.array([0, len(s)]), s) for s in (one, two))
        true = len(both) / (len(both) + len(a) + len(b))
        assert abs(neardup.estimate(x, y, np.array([len(one)]), np.array([len(two)]))[0] - true) < 0.17


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.id: r.comp for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_short_benchmark_items_and_spans(spark):
    docs = spark.createDataFrame([(1, "Say Hello-World now, hello world!"), (2, "nothing"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "hello WORLD"), ("b", "--"), ("c", None), ("d", "hello world"), ("e", "now")], "item_id string, text string")
    got = {r.doc_id: r for r in contamination.contamination(docs, bench).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].items_sha256) == (5, 3, hashlib.sha256(b"a,d,e").hexdigest())
    assert not got[2].contaminated and got[3].n_words == 0
    assert contamination.decontaminate(docs, bench, "spans").where("doc_id = 1").first().text == "Say - ,  !"
    assert [tuple(s) for s in got[1].spans] == [(1, 6)]


@pytest.mark.parametrize("limit", [0, 500_000])
def test_contamination_matches_brute_force(spark, monkeypatch, limit):
    """Random texts with planted passages, broadcast or joined."""
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", limit)
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "x1"]
    items = {f"i{i}": " ".join(r.choices(vocabulary, k=n)) for i, n in enumerate([1, 3, 12, 13, 14, 40, 40, 13])}
    items["i8"], items["i9"] = items["i3"].upper(), ""
    texts = {i: " ".join(r.choices(vocabulary, k=r.randint(0, 120))) for i in range(60)}
    for i in range(0, 60, 3):
        texts[i] += ", " + r.choice(list(items.values())) + "; " + r.choice(list(items.values()))
    texts[60] = " ".join(items["i5"].split() * 30)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {k: {tuple(w[j : j + 13]) for j in range(max(len(w) - 12, 1))} for k, t in items.items() if (w := cut(t))}
    rows = [*texts.items(), (0, texts[0])]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id string, text string")
    got = contamination.contamination(df, bench).collect()
    assert len(got) == len(rows)
    for x in got:
        w, hit, found = cut(texts[x.doc_id]), set(), set()
        for k, own in windows.items():
            for g in own:
                for j in range(len(w) - len(g) + 1):
                    if tuple(w[j : j + len(g)]) == g:
                        hit.update(range(j, j + len(g)))
                        found.add(k)
        spans = {i for s in x.spans for i in range(s.start, s.end)}
        assert (x.n_words, x.n_hit, x.items_sha256, spans) == (len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), hit)


def test_language_accuracy_on_the_held_out_fold(spark, docs):
    got = QUERIES["op6_language_id"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = got.where("lang = lang_pred").count() / got.count()
    assert right > 0.9, right
    empty = langid.predict(spark.createDataFrame([(1, None), (2, "12 !")], "doc_id long, text string"), {"en": b"the and"}).collect()
    assert [(r.lang_pred, r.score) for r in empty] == [("und", 0.0)] * 2


def test_toxicity_learns_words(spark):
    r = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(900):
        w = [r.choice(vocabulary) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["vilething", "nastyname", "rudeword"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
    got = toxicity.predict(df, model).join(df.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert sum(x.predicted == x.toxic for x in got) / len(got) > 0.97
    assert toxicity.fit(df, df.select("doc_id", F.lit(0).alias("toxic"))) is None


def test_licences_are_found_and_inherited(spark):
    rows = [("r/LICENSE", "The MIT License (MIT)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"), ("r/a/x.py", "code"), ("r/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("r/b/c/y.py", "code"), ("r/b/z.py", "# Licensed under the Apache License, Version 2.0\n" + "code\n" * 50), ("q/z.py", "no licence talk"), (None, None)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "id int, path string, text string")
    got = {r.key: (r.license, r.found, r.origin) for r in licenses.scan(df, "id", "path", "text").collect()}
    assert got[0][:2] == ("MIT", "file") and got[1] == ("MIT", "inherited", "r/LICENSE") and got[2][:2] == ("GPL-3.0", "file")
    assert got[3] == ("GPL-3.0", "inherited", "r/b/COPYING") and got[4][:2] == ("Apache-2.0", "header") and got[5][1] == got[6][1] == "none"


def test_licences_of_other_families_are_told_apart(spark):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "CC-BY-SA-3.0": "CC-BY-SA-3.0", "Licensed under CC BY 4.0": "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 2.5 License": "CC-BY-NC-SA-2.5",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0", "Licensed under the GNU General Public License v3.0": "GPL-3.0",
        "This library is licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1", "This work is licensed under the GNU Affero General Public License, version 3": "AGPL-3.0",
        "BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause", "ISC License": "ISC", "Licensed under the Apache License": "Apache-2.0",
        "Licensed under the Apache License, Version 1.1": "unknown", "Released under the House License": "unknown", "Proprietary: no licence is given": "unknown",
    }
    df = spark.createDataFrame([(i, f"r{i}/x", t + "\n" + "code\n" * 50) for i, t in enumerate(lines)], "id int, path string, text string")
    got = {r.key: (r.license, r.found) for r in licenses.scan(df, "id", "path", "text").collect()}
    assert {t: got[i] for i, t in enumerate(lines)} == {t: (x, "none" if x == "unknown" else "header") for t, x in lines.items()}


def test_wrapped_notices_and_whole_texts(spark):
    import textwrap

    t = licenses.TEMPLATES
    mit = "Copyright (c) 2021 A. Body\n\n" + "\n".join(textwrap.wrap(t["MIT"][-1], 60))
    apache = "\n".join(f"# {x}" for x in textwrap.wrap(t["Apache-2.0"][-1], 50)) + "\nimport os\n" + "code\n" * 80
    gpl = "/*\n" + "\n".join(f" * {x}" for x in textwrap.wrap(t["GPL-3.0"][2], 40)) + "\n */\n" + "code\n" * 400
    prose = "some words of prose\nThis work is licensed under a\nCreative Commons Attribution 4.0\nInternational License\nmore words follow here\n" + "and so on\n" * 50
    three, two = (f"Copyright\n\n{t[k][-1]}" for k in ("BSD-3-Clause", "BSD-2-Clause"))
    rows = {"a/LICENSE": (mit, "MIT", "file"), "b/x.py": (apache, "Apache-2.0", "header"), "c/x.c": (gpl, "GPL-3.0", "header"), "d/x.txt": (prose, "CC-BY-4.0", "header"), "e/COPYING": (three, "BSD-3-Clause", "file"), "f/COPYING": (two, "BSD-2-Clause", "file"), "g/LICENSE.txt": (t["ISC"][-1], "ISC", "file"), "h/LICENSE": ("licence " * 3000, "unknown", "file")}
    df = spark.createDataFrame([(i, p, x[0]) for i, (p, x) in enumerate(rows.items())], "id int, path string, text string")
    got = {r.path: (r.license, r.found) for r in licenses.scan(df, "id", "path", "text").collect()}
    assert got == {p: x[1:] for p, x in rows.items()}


def test_cosines_match_brute_force(spark):
    r = random.Random(4)
    words = "licensed under the apache license version 2.0 mit gnu general public gpl 3 isc software permission cc by 4.0 terms of use free and".split()
    lines = [x for own in licenses.TEMPLATES.values() for x in own if r.random() < 0.4] + [" ".join(r.choices(words, k=r.randint(2, 14))) for _ in range(150)]
    lines += r.choices(lines, k=60)

    def terms(x):
        x = re.sub(r"\bcc[ -]by((?:-[a-z]{2})*)(?:[ -]v?(?=[0-9]))?", r"cc by\1 ", x.lower())
        return [re.sub(r"^v?([0-9]{1,2}(?:\.[1-9][0-9]*)?)(?:\.0)?$", r"\1", w) for w in re.findall(r"(?:[^\W_]|[.+-])*[^\W_]", x)]

    df, total = {}, len(lines)
    for x in lines:
        for w in set(terms(x)):
            df[w] = df.get(w, 0) + 1

    def weights(x):
        own = terms(x)
        return {w: (1 + math.log(own.count(w))) * (math.log((1 + total) / (1 + df[w])) + 1 if w in df else 1.0) for w in set(own)}

    names, version = re.compile(licenses.DECIDES), re.compile(licenses.VERSION)
    family = lambda k: re.sub(r"-[0-9.]+$", "", k)
    lone = {k: [family(x) for x in licenses.TEMPLATES].count(family(k)) == 1 for k in licenses.TEMPLATES}
    want = {}
    for x in set(lines):
        a, best = weights(x), []
        for k, own in licenses.TEMPLATES.items():
            for y in own:
                b = weights(y)
                both = set(a) & set(b)
                if not both or not {w for w in b if names.match(w)} <= both:
                    continue
                if {w for w in b if version.match(w)} <= both or lone[k] and not any(version.match(w) for w in a):
                    dot = sum(a[w] * b[w] for w in both)
                    best.append((-round(dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), 6), k))
        if best:
            want[x] = min(best)
    named = {hashlib.sha256(x.encode()).hexdigest(): x for x in lines}
    got = {named[r.digest]: (-r.score, r.license) for r in licenses.scored_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert set(got) == set(want)
    assert all(abs(got[x][0] - s) < 2e-6 and (got[x][1] == k or abs(got[x][0] - s) > 0) for x, (s, k) in want.items())


def test_long_lines_and_files_are_scored_whole(spark):
    """A line of a megabyte costs what its terms do, and a licence text beyond any template's length is still found."""
    import time

    r = random.Random(6)
    noise = " ".join(f"x{r.randrange(40_000)}" for _ in range(150_000))
    mit = licenses.TEMPLATES["MIT"][-1]
    long = "\n\n".join([f"paragraph {i} of a readme that goes on" for i in range(400)] + [mit, "more words " * 2000])
    rows = [(1, "a/min.js", f"license {noise}"), (2, "a/LICENSE", long), (3, "b/x.py", f"{noise}\n\n{licenses.TEMPLATES['Apache-2.0'][0]}"), (4, "b/y.py", "no notice")]
    began = time.time()
    got = {x.key: (x.license, x.found) for x in licenses.scan(spark.createDataFrame(rows, "k long, p string, t string"), "k", "p", "t").collect()}
    assert time.time() - began < 90
    assert got[2][0] == "MIT" and got[3][0] == "Apache-2.0" and got[4] == (None, "none")


def test_inheritance_matches_brute_force(spark):
    r = random.Random(12)
    folders = ["", "a/", "a/b/", "a/b/c/", "a/d/", "e/", "e/f/"]
    rows = {}
    for n, f in enumerate(folders):
        if r.random() < 0.5:
            rows[f"{f}LICENSE"] = r.choice(["The MIT License (MIT)", "ISC License", "BSD 2-Clause License"])
        for m in range(3):
            rows[f"{f}x{n}{m}.txt"] = "plain words"
    kinds = {"The MIT License (MIT)": "MIT", "ISC License": "ISC", "BSD 2-Clause License": "BSD-2-Clause"}
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows.items())], "id int, path string, text string").repartition(3)
    got = {x.path: (x.license, x.origin) for x in licenses.scan(df, "id", "path", "text").collect()}
    for p, t in rows.items():
        at = p
        want = (kinds.get(t), p if t in kinds else None)
        while want[0] is None:
            at = at.rstrip("/")
            at = at[: at.rfind("/") + 1]
            if at + "LICENSE" in rows:
                want = (kinds[rows[at + "LICENSE"]], at + "LICENSE")
            elif not at:
                break
        assert got[p] == want


def test_unknown_notices_inherit_nothing(spark):
    code = "\n" + "code\n" * 50
    rows = [("r/LICENSE", "The MIT License (MIT)"), ("r/a.py", "# Released under the House License" + code), ("r/b.py", "# Copyright 2020 A. Body" + code), ("r/c.py", "# Use is subject to the terms found in the LICENSE file" + code), ("r/s/LICENSE", "House License, all rights reserved"), ("r/s/d.py", "code"), ("r/t/odd.txt", "A house license"), ("r/t/e.py", "code")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "id int, path string, text string")
    got = {r.path: (r.license, r.found, r.origin) for r in licenses.scan(df, "id", "path", "text").collect()}
    assert got["r/a.py"] == ("unknown", "none", "r/a.py") and got["r/s/LICENSE"] == ("unknown", "file", "r/s/LICENSE") and got["r/t/odd.txt"][:2] == ("unknown", "none")
    assert got["r/b.py"] == got["r/c.py"] == got["r/t/e.py"] == ("MIT", "inherited", "r/LICENSE") and got["r/s/d.py"] == ("unknown", "inherited", "r/s/LICENSE")


def test_small_samples_flag_few_clean_documents(spark):
    """Held-out rows of a table with three dozen toxic rows to learn from."""
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op7_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits / sum(r.predicted for r in got) > 0.5 and hits / sum(r.toxic for r in got) > 0.4


def test_network_gradients(monkeypatch):
    """A training step moves the loss down, and scores agree with a plain-loop network."""
    r = np.random.default_rng(3)
    model = toxicity.Model(3)
    model.p["e"] = r.normal(size=model.p["e"].shape).astype(np.float32)
    texts = [toxicity.slots(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 5, 40)]
    got = model.logits(np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    for s, z in zip(texts, got, strict=True):
        x, h = model.p["e"][s[:, 0]] + model.p["e"][s[:, 1]], []
        for w in toxicity.WIDTHS:
            pad = np.concatenate((x, np.zeros((w, toxicity.SIZE), np.float32)))
            values = [np.maximum(pad[i : i + w].reshape(-1) @ model.p[f"f{w}"] + model.p[f"c{w}"], 0) for i in range(len(x))]
            h += list(np.max(values, axis=0))
        assert abs(float(np.array(h) @ model.p["o"] + model.p["b"][0]) - float(z)) < 1e-3


def test_hot_language_is_sampled_evenly(spark):
    """Most rows are copies in one language; the sample stays bounded and other languages are learned."""
    words = {"en": "the and of with from this that have".split(), "fr": "le la les avec pour dans sur une".split()}
    r = random.Random(2)
    rows = [(i, "the same english text with that and this", "en") for i in range(3000)] + [(5000 + i, " ".join(r.choices(words[k], k=20)), k) for i in range(400) for k in ("en", "fr")]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6))
    assert sorted(learned) == ["en", "fr"] and set(learned["fr"].decode().split()) == set(words["fr"])


def test_language_is_the_smallest_compression(spark, docs):
    """Prediction, score and certainty are those of compressing each text with each dictionary by hand."""
    import zstandard as z

    books = langid.learn(docs)
    assert len(books) == 4
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id % 5 = 0").collect()] + [(-1, "vous avez"), (-2, "the"), (-3, None), (-4, "1234 !"), (-5, "Ä" * 3000)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), books).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score, got[i].confident) == ("und", 0.0, False)
            continue
        raw = b" " + t.lower().encode() + b" "
        level, size = (langid.FINE_LEVEL, len(raw)) if len(raw) <= langid.SHORT else (langid.LEVEL, langid.BLOCK)
        sizes = {}
        for k, d in books.items():
            c = z.ZstdCompressor(level=level, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False)
            sizes[k] = sum(len(c.compress(raw[j : j + size])) for j in range(0, len(raw), size))
        best = min(sorted(sizes), key=sizes.get)
        margin = 1 - sizes[best] / min(v for k, v in sizes.items() if k != best)
        assert got[i].lang_pred == best and abs(got[i].score - margin / (margin + langid.NARROW)) < 1e-9 and got[i].confident == (margin >= langid.NARROW)


def test_rows_without_letters_dont_crowd_out_a_language(spark):
    rows = [(i, None if i % 2 else "123", "xx") for i in range(6000)] + [(10_000 + i, f"mots rares de la langue {i}", "xx") for i in range(30)]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"mots", "rares", "langue"} <= set(learned["xx"].decode().split())


def labels_of(spark):
    return spark.createDataFrame([(3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")


RUNS = {
    "bpe": lambda s, d: bpe.round_trip(d),
    "quality": lambda s, d: quality.judge(d, labels_of(s)),
    "neardup": lambda s, d: neardup.classes(d),
    "contamination": lambda s, d: contamination.contamination(d, s.createDataFrame([(1, "same text here"), (None, None)], "item_id long, text string")),
    "html": lambda s, d: htmlmain.extract(d.withColumn("page_id", F.col("doc_id")).withColumn("url", F.lit(None).cast("string")), html_col="text"),
    "langid": lambda s, d: langid.predict(d, langid.learn(d)),
    "toxicity": lambda s, d: toxicity.predict(d, toxicity.fit(d, labels_of(s))),
    "pii": lambda s, d: pii.find(d),
    "licenses": lambda s, d: licenses.scan(d, "doc_id", "source", "text"),
}


def expected(name, r, text):
    """Whether a row of an operator is what its docstring says of an odd text."""
    t = text or ""
    if name == "bpe":
        return (r.n_tokens, r.decoded_sha256) == (len(tik().encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest())
    if name == "quality":
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {j for i, w in enumerate(seen) if seen.count(w) > 1 for j in range(i, i + 5)} if len(words) < 1000 else set(range(len(words)))
        failed = len(words) < 10 or 100 * len(twice) > 20 * len(words)
        return (r.n_words, r.word_chars, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), len(twice), failed) and not (failed and r.kept)
    if name == "contamination":
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        hit = {j for i in range(len(words) - 2) if words[i : i + 3] == ["same", "text", "here"] for j in range(i, i + 3)}
        return (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), int(bool(hit)), bool(hit) and 20 * len(hit) >= len(words))
    if name == "html":
        return (r.text, r.n_chars) == (" ".join(t.split()), len(" ".join(t.split())))
    if name == "langid":
        return (r.lang_pred == "und" and r.score == 0) if not any(map(str.isalpha, t)) else 0 <= r.score <= 1
    if name == "licenses":
        return (r.license, r.found, r.score) == (None, "none", 0.0)
    if name == "toxicity":
        return 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    if name == "pii":
        return (list(r.spans), list(r.more)) == ([], [])
    return True


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_inputs_have_their_defined_results(spark, odd, name):
    texts = {}
    for x in odd.collect():
        texts.setdefault(x.doc_id, set()).add(x.text)
    out = RUNS[name](spark, odd).collect()
    for r in out:
        own = texts[next(v for k, v in r.asDict().items() if k in ("doc_id", "page_id", "key"))]
        assert len(own) == 1 and expected(name, r, *own), (name, r)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_inputs_have_a_row_each(spark, odd, name):
    assert RUNS[name](spark, odd).count() == odd.count()
    assert RUNS[name](spark, odd.limit(0)).count() == 0


def test_token_files_of_odd_inputs(spark, odd, tmp_path):
    token_files.write(odd, str(tmp_path / "a"))
    got = token_files.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert len(got) == odd.count() and got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    token_files.write(odd.limit(0), str(tmp_path / "b"))
    assert token_files.read(spark, str(tmp_path / "b")).count() == 0


def test_near_duplicates_of_odd_inputs(spark, odd):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.classes(odd).collect()}
    assert (None, 1, None, True) in got and (0, 0, 0, True) in got and (20, 7, 7, False) in got
