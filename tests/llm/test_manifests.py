"""Conversation repair, the cuckoo-filter index and the Merkle manifest against SQL and plain loops."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from corpusloom.llm import conversations, cuckoo, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def both(spark, folder, name, rows, schema, query, sql, extra=False):
    """Rows of a query over a small table, and those of its SQL."""
    df = spark.createDataFrame(rows, schema)
    if extra:
        for c in ("id", "digest", "tree", "row", "seq", "conv", "blk", "same"):
            df = df.withColumn(c, df[df.columns[0]])
    df.repartition(3).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    out = query(spark, folder)
    cols = sorted(out.columns)
    con = duckdb.connect()
    if rows:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    else:
        types = {"long": "bigint", "string": "varchar"}
        con.execute(f"create table {name} ({', '.join(f'{c} {types[t]}' for c, t in (x.split() for x in schema.split(', ')))})")
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in out.select(*cols).collect()), key=key), sorted(con.execute(f"select {', '.join(cols)} from ({sql})").fetchall(), key=key)


def random_docs(seed, n):
    r = random.Random(seed)
    texts = ["", " ", "\n\t", None, "a b", "ab", "a  b ", "é", "é ", "long " * 3000, "x y", "xy"]
    return [(r.choice([i, i, i, 5, None]), r.choice(texts), r.choice(["en", "fr", None, "", "é"]), r.choice(["s", None]), r.choice([i, None])) for i in range(n)]


@pytest.mark.parametrize("width", [8, 4096])
def test_merkle_matches_sql(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(merkle, "WIDTH", width)
    rows = [(i, f"t{i}", "en" if i % 3 else "fr", "s", i) for i in range(150)] + [(1000, "only", None, None, None), (1001, None, "é", "s", 2)]
    ours, theirs = both(spark, str(tmp_path), "documents", rows, DOCS, merkle.op13_merkle, merkle.SQL, extra=True)
    assert len(ours) == 152 and ours == theirs
    assert 0 < sum(not r[-1] for r in ours) < 60


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)], [(7, "a", "x", "s", 1), (7, "a", "x", "s", 1), (7, "b", "x", "s", None), (None, "", "", "s", 4)]])
def test_merkle_odd_tables(spark, tmp_path, rows):
    ours, theirs = both(spark, str(tmp_path), "documents", rows, DOCS, merkle.op13_merkle, merkle.SQL)
    assert len(ours) == len(rows) and ours == theirs


def test_merkle_steps_fold_to_the_root(spark, monkeypatch):
    monkeypatch.setattr(merkle, "WIDTH", 9)
    docs = spark.createDataFrame([(i, f"t{i}", "en" if i % 5 else "fr", "s", i) for i in range(70)], DOCS)
    out = merkle.manifest(docs, arity=3, with_steps=True).collect()
    assert len(out) == 70 and len({r["root"] for r in out}) == 1
    for r in out:
        assert merkle.folds(r["leaf"], r["steps"]) == r["root"] == r["folded_root"] and r["verified"]
        assert merkle.folds("0" * 64, r["steps"]) != r["root"]
        assert hashlib.sha256("".join(s.split(":")[1] for s in r["steps"]).encode()).hexdigest() == r["proof_sha256"]


def test_cuckoo_filter_keeps_a_set():
    r = np.random.default_rng(1)
    live, f = {}, cuckoo.Cuckoo(2)
    for _ in range(30):
        new = r.integers(0, 1 << 63, (int(r.integers(1, 400)), 4)).astype(np.uint64)
        new[:, 1] &= np.uint64(0xFFFF)  # crowded buckets
        assert (f.find(new)[0] < 0).all()
        f.insert(new)
        live |= {tuple(k): True for k in new.tolist()}
        gone = [k for k in live if r.random() < 0.4]
        keys = np.array(gone, np.uint64).reshape(-1, 4)
        assert f.delete(keys).all() and not f.delete(keys).any()
        for k in gone:
            del live[k]
        assert len(f) == len(live) and {tuple(k) for k in f.live().tolist()} == set(live)
        assert (f.find(np.array(list(live), np.uint64).reshape(-1, 4))[0] >= 0).all()
    same = r.integers(0, 1 << 63, (40, 4)).astype(np.uint64)
    same[:, 2] = same[0, 2]  # one fingerprint, told apart by the stored keys
    f.insert(same)
    found, seen = f.find(same)
    assert seen.all() and len(set(found.tolist())) == 40
    assert f.marks.size >= len(f) / cuckoo.LOAD


def test_index_inserts_deletes_and_grows(spark, monkeypatch):
    monkeypatch.setattr(cuckoo, "SHARD_KEYS", 50)
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(600)]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "digest string")
    index = cuckoo.Index(spark)
    index.grow(100)
    few = index.bits
    assert index.insert(frame(digests[:100] + digests[:5])).count() == 5
    assert {r[0] for r in index.delete(frame(digests[40:60] + digests[300:310])).collect()} == set(digests[40:60])
    index.grow(500)
    assert index.bits > few
    assert {r[0] for r in index.insert(frame(digests[30:600])).collect()} == set(digests[30:40] + digests[60:100])
    assert index.size() == 600 and sorted(r[0] for r in index.digests().collect()) == sorted(digests)


@pytest.mark.parametrize("n", [0, 1, 60])
def test_exact_duplicates_odd_tables(spark, tmp_path, n):
    ours, theirs = both(spark, str(tmp_path), "documents", random_docs(3, n), DOCS, cuckoo.op12_exact_duplicates, cuckoo.SQL, extra=True)
    assert len(ours) == n and ours == theirs


def test_documents_that_came_before_are_members(spark):
    index = cuckoo.Index(spark)
    old = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    cuckoo.groups(old, index).collect()
    new = spark.createDataFrame([(3, "ab"), (4, "d"), (5, "a  b c"), (6, "c  ")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in cuckoo.groups(new, index, old).collect()}
    assert got == {3: (1, 2, False), 4: (4, 1, True), 5: (5, 1, True), 6: (6, 2, True)}
    assert index.size() == 4


TURNS = "conv_id long, turn long, role string, text string"


def random_turns(seed, n, convs):
    r = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "u"], ["Hi.", "yes", None, "", " ", "Well?", "Good! ", "a\n", "b.\n", "ok.", "And?", "c."]
    return [(r.choice([*range(convs), None]), r.choice([*range(n // max(convs, 1) + 2), None]), r.choice(roles), r.choice(texts) if r.random() < 0.3 else f"{r.random()}.") for _ in range(n)]


@pytest.mark.parametrize("n,convs", [(0, 1), (1, 1), (400, 25), (300, 1)])
def test_conversations_match_sql(spark, tmp_path, n, convs):
    ours, theirs = both(spark, str(tmp_path), "conversations", random_turns(n, n, convs), TURNS, conversations.op11_conversations, conversations.SQL, extra=True)
    assert ours == theirs


def plain(rows):
    """(cost, audit, text) by a table of all rows and states, from the last row on."""
    ends = [(0, "", ""), (6, "II", "\nuser:\nassistant:"), (3, "I", "\nassistant:"), (0, "", "")]
    names, nexts, seen, faults = {2: "user", 3: "assistant"}, (2, 2, 3, 2), set(), []
    for _, role, text in rows:
        gone = not text.strip(" \t\n\x0b\x0c\r") or (role, text) in seen
        seen.add((role, text))
        faults.append((gone, 0 if gone or text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else 3))
    after = ends
    for (_, role, text), (gone, more) in zip(rows[::-1], faults[::-1], strict=True):
        own = []
        for s in range(4):
            ways = [(4 + after[s][0], "D" + after[s][1], after[s][2])]
            if not gone:
                c, a, t = after[nexts[s]]
                ways.append((3 + more + c, "R" + a, f"\n{names[nexts[s]]}:{text}{t}"))
                k = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                if (s, k) in {(0, 1), (0, 2), (1, 2), (3, 2), (2, 3)}:
                    c, a, t = after[k]
                    ways.append((more + c, "K" + a, f"\n{role}:{text}{t}"))
            own.append(min(ways))
        after = []
        for s in range(4):
            ways, line, at, cost, letters = [own[s]], "", s, 0, ""
            for _ in range(2):
                at = nexts[at]
                line, cost, letters = f"{line}\n{names[at]}:", cost + 3, letters + "I"
                ways.append((cost + own[at][0], letters + own[at][1], line + own[at][2]))
            after.append(min(ways))
    return after[0]


@pytest.mark.parametrize("block,size", [(3, 1 << 20), (7, 40), (4096, 1 << 20)])
def test_repair_of_long_conversations(spark, block, size):
    r = random.Random(block)
    rows = [(i % 7 == 0, i, r.choice(["user", "assistant", "system"]), r.choice(["x.", "y", "", f"{i}.", f"{i}!", f"{i}"])) for i in range(1500)]
    rows = [(int(c), i, role, text) for c, i, role, text in rows]
    done = conversations.Repair(spark.createDataFrame(rows, TURNS).repartition(5), block_rows=block, block_bytes=size)
    turns = done.turns().orderBy("blk", "at").collect()
    for got in done.summaries().collect():
        own = [x[1:] for x in rows if x[0] == got["conv_id"]]
        cost, audit, text = plain(own)
        assert (got["cost"], got["audit"]) == (cost, audit)
        assert got["repaired_sha256"] == hashlib.sha256(text[1:].encode()).hexdigest()
        shown = [t for t in turns if t["conv_id"] == got["conv_id"]]
        assert "".join(t["edit"] for t in shown) == audit
        assert "\n".join(f"{t['role']}:{t['text']}" for t in shown if t["edit"] != "D") == text[1:]


def test_costs_compose_in_any_order():
    r = random.Random(0)
    for _ in range(200):
        kinds = bytes(r.randrange(12) for _ in range(r.randrange(1, 30)))
        cut = r.randrange(1, len(kinds)) if len(kinds) > 1 else None
        whole = conversations.block_table(kinds)
        if cut:
            assert conversations.composed(conversations.block_table(kinds[:cut]), conversations.block_table(kinds[cut:])) == whole
        for s in range(4):
            for to in range(4):
                if whole[s][to][0] < conversations.FAR:
                    edits, state, cost = conversations.block_edits(kinds, s, to), s, 0
                    for kind, letters in zip(kinds, edits, strict=True):
                        state, cost = next((t, cost + c) for t, (c, x) in conversations.LETTERS[kind][state].items() if x == letters)
                    assert (state, cost) == (to, whole[s][to][0])
