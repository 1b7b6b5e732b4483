"""Repair of conversations: the cheapest edits after which roles read system?, (user, assistant)*.

Rows are kept, given the role that is due, deleted, or preceded by an inserted turn without text. What was last kept is
one of four states (nothing, system, user, assistant), and each row turns a vector of four costs into the next. The
edits are found by Hirschberg's divide and conquer: costs forward to the middle and backward to it are added, the
cheapest crossing is taken (of equals the one whose audit is least), and both halves go on from there, so no table of
all rows and states is kept. Next to its cost each state has its rank: the order of the least audits that lead there.
No such audit begins another, as each ends at the same row, so ranks decide between equal costs.

Costs and ranks of rows in a row form a 4 x 4 table, and tables of neighbours are composed to one. So a conversation of
any length is dealt out: rows are sorted as a whole, cut into blocks of bounded rows and bytes, and the recursion runs
over parts, over the blocks of a part, over runs of rows and over rows. Only the hash of a repaired conversation, which
is sequential by its definition, takes the blocks of one conversation through one task, one after the other.

Null roles and texts are one space, which is no role and blank. Null turns come first; rows of one turn go by role, then
by the SHA-256 of their text, so repeated rows are next to each other. Null ids are one conversation. Empty roles can't
be kept. Texts are of any length, an empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, cut, table

#: Rows and bytes of text of a block; one longer row is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 4096, 2 << 20
#: Rows that are looked up as one.
RUN = 8
#: Costs of edits, fixed by the contract.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
FAR = 1 << 60
#: The state that an inserted or re-roled turn leads to.
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost and edits of ending a conversation in each state.
ENDS = (0, 2 * INSERT, INSERT, 0)
#: Fault of a row, beside its role's state (0: another role).
FINE, CUT_OFF, GONE = 0, 4, 8


def _keeps(state: int, role: int) -> bool:
    return role == SYSTEM and state == NOTHING or role == USER and state != USER or role == ASSISTANT and state == USER


def _edits(kind: int, state: int) -> dict[int, tuple[int, str]]:
    """state after the row -> (cost, letters), the cheapest and of equals the least. A third insertion would be back where the first began."""
    role, fault, out = kind % 4, kind - kind % 4, {}
    for n in range(3):
        own, before = INSERT * n, "I" * n
        ways = [(own + DELETE, before + "D", state)]
        if fault != GONE:
            more = TRUNCATED if fault == CUT_OFF else 0
            ways.append((own + REROLE + more, before + "R", NEXT[state]))
            if _keeps(state, role):
                ways.append((own + more, before + "K", role))
        for cost, letters, to in ways:
            out[to] = min(out.get(to, (FAR, "")), (cost, letters))
        state = NEXT[state]
    return out


def _ranked(ways: list) -> tuple:
    """Four of (cost, order) or None as (cost, rank)."""
    order = sorted((w[1], k) for k, w in enumerate(ways) if w)
    rank = {k: r for r, (_, k) in enumerate(order)}
    return tuple((ways[k][0], rank[k]) if ways[k] else (FAR, 9) for k in range(4))


LETTERS = {kind: [_edits(kind, s) for s in range(4)] for kind in range(12)}
ROW = {kind: tuple(_ranked([e.get(k) for k in range(4)]) for e in ways) for kind, ways in LETTERS.items()}


def onward(vector: tuple, step: tuple) -> tuple:
    """(cost, rank) of each state behind a table, from those before it."""
    out = []
    for to in range(4):
        ways = [(vector[s][0] + step[s][to][0], (vector[s][1], step[s][to][1])) for s in range(4) if vector[s][0] < FAR and step[s][to][0] < FAR]
        out.append(min(ways) if ways else None)
    return _ranked(out)


def composed(a: tuple, b: tuple) -> tuple:
    return tuple(onward(a[s], b) for s in range(4))


@lru_cache(50_000)
def run_table(kinds: bytes) -> tuple:
    """The table of a run of rows."""
    if len(kinds) == 1:
        return ROW[kinds[0]]
    mid = len(kinds) // 2
    return composed(run_table(kinds[:mid]), run_table(kinds[mid:]))


def crossings(tables: list[tuple], first: int, last: int) -> list[int]:
    """States behind each table on the cheapest way, of equals the least, from the first state to the last."""
    if len(tables) == 1:
        return [last]
    mid = len(tables) // 2
    ahead = tuple((0, 0) if s == first else (FAR, 9) for s in range(4))
    for t in tables[:mid]:
        ahead = onward(ahead, t)
    behind = [0 if s == last else FAR for s in range(4)]
    for t in reversed(tables[mid:]):
        behind = [min(t[s][to][0] + behind[to] for to in range(4)) for s in range(4)]
    at = min((ahead[s][0] + behind[s], ahead[s][1], s) for s in range(4) if ahead[s][0] < FAR)[2]
    return crossings(tables[:mid], first, at) + crossings(tables[mid:], at, last)


@lru_cache(50_000)
def run_edits(kinds: bytes, first: int, last: int) -> tuple[str, ...]:
    """The letters of each row of a run."""
    out, state = [], first
    for kind, to in zip(kinds, crossings([ROW[k] for k in kinds], first, last), strict=True):
        out.append(LETTERS[kind][state][to][1])
        state = to
    return tuple(out)


def _runs(kinds: bytes) -> list[bytes]:
    return [kinds[i : i + RUN] for i in range(0, len(kinds), RUN)]


def block_table(kinds: bytes) -> tuple:
    tables = [run_table(r) for r in _runs(kinds)]
    while len(tables) > 1:
        tables = [composed(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


def block_edits(kinds: bytes, first: int, last: int) -> list[str]:
    runs, out, state = _runs(kinds), [], first
    for r, to in zip(runs, crossings([run_table(r) for r in runs], first, last), strict=True):
        out += run_edits(r, state, to)
        state = to
    return out


@lru_cache(10_000)
def short_table(kinds: bytes) -> list[int]:
    """The table of a short block, as it is stored."""
    return flat(block_table(kinds))


def flat(t: tuple) -> list[int]:
    return [x for row in t for cell in row for x in cell]


def deep(f: list[int]) -> tuple:
    return tuple(tuple((f[8 * s + 2 * k], f[8 * s + 2 * k + 1]) for k in range(4)) for s in range(4))


#: Counts of a stretch of rows: faults, role pairs out of order, distinct turns, the roles and turns at its ends.
FACTS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_role", "last_role", "first_turn", "last_turn")
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def facts_of(roles: list[int], turns: list, blank: int, duplicate: int, truncated: int) -> list:
    pairs = sum(p not in LEGAL for p in zip(roles, roles[1:], strict=False))
    known = [t for t in turns if t is not None]
    return [blank, duplicate, truncated, pairs, len(set(known)), roles[0], roles[-1], known[0] if known else None, known[-1] if known else None]


def facts_with(a: list, b: list) -> list:
    """Facts of two stretches in a row."""
    out = [x + y for x, y in zip(a[:5], b[:5], strict=True)] + [a[5], b[6], b[7] if a[7] is None else a[7], a[8] if b[8] is None else b[8]]
    out[3] += (a[6], b[5]) not in LEGAL
    out[4] -= a[8] is not None and a[8] == b[7]
    return out


NODE = "blk long, tbl array<long>, facts array<long>"
_NODE = pa.struct([("blk", pa.int64()), ("tbl", pa.list_(pa.int64())), ("facts", pa.list_(pa.int64()))])


def _joined(nodes: list[dict]) -> tuple[tuple, list]:
    tables, facts = [deep(x["tbl"]) for x in nodes], nodes[0]["facts"]
    for x in nodes[1:]:
        facts = facts_with(facts, x["facts"])
    while len(tables) > 1:
        tables = [composed(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0], facts


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) with planted faults, told by the CRC of "conversation:turn" modulo 20: 0 drops a row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    name = lambda c: F.coalesce(turns[c].cast("string"), space)
    rows = turns.select(turns[conv_col].alias("conv"), turns[turn_col].alias("turn"), name(role_col).alias("role"), name(text_col).alias("text"), (F.crc32(F.concat(name(conv_col), F.lit(":"), name(turn_col)).cast("binary")) % 20).alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.where("k <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), times.alias("__t")).drop("__t")


def _blocks(turns: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows (conv, turn, role, text) sorted as a whole, in blocks of one conversation each; blk is the place of a block's first row."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = turns.select("conv", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    tie = F.monotonically_increasing_id()
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    rows = rows.withColumn("__tie", tie).repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    code = F.coalesce(F.expr("map('s', 1, 'u', 2, 'a', 3)[substring(role, 1, 1)]"), F.lit(0)) + F.when(last == "", 4).when(~last.isin(".", "!", "?"), 8).otherwise(0)
    rows = rows.select("conv", F.monotonically_increasing_id().alias("seq"), "turn", code.cast("byte").alias("code"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "digest").cast("binary"), 256).alias("same"), "role", "text")
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            conv, text = b.column(0), b.column(6)
            new = np.ones(n, bool)
            if n > 1:
                a, c = conv.slice(0, n - 1), conv.slice(1)
                differ = pc.fill_null(pc.not_equal(a, c), True)
                both = pc.and_(pc.is_null(a), pc.is_null(c))
                new[1:] = np.asarray(pc.and_(differ, pc.invert(both)))
            start = np.flatnonzero(new)
            own = start[np.cumsum(new) - 1]
            size = np.concatenate(([0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0)), dtype=np.int64)))
            slot = np.stack(((np.arange(n) - own) // most_rows, (size[:-1] - size[own]) // most_bytes))
            new[1:] |= (slot[:, 1:] != slot[:, :-1]).any(axis=0)
            start = np.flatnonzero(new)
            at = pa.array(np.append(start, n).astype(np.int32))
            first = pa.array(start)
            lists = [pa.ListArray.from_arrays(at, b.column(k)) for k in range(2, 7)]
            for i in range(0, len(start), 256):  # few blocks a batch, as they may be large
                yield pa.RecordBatch.from_arrays([c.slice(i, 256) for c in (conv.take(first), b.column(1).take(first), *lists)], ["conv", "blk", "turns", "codes", "same", "roles", "texts"])

    return cut(rows.mapInArrow(run, f"conv {kind}, blk long, turns array<long>, codes array<tinyint>, same array<string>, roles array<string>, texts array<string>"), "turn-blocks")


def _nodes(blocks: DataFrame) -> DataFrame:
    """(conv, blk, kinds, tbl, facts) of each block: what its rows are, and what they do to costs."""
    rows = blocks.select("conv", "blk", F.posexplode("same").alias("at", "same"))
    seq = F.col("blk") + F.col("at")
    firsts = rows.groupBy("conv", "same").agg(F.min(seq).alias("seq"), F.min_by("blk", seq).alias("blk"))
    firsts = firsts.groupBy("blk").agg(F.collect_list((F.col("seq") - F.col("blk")).cast("int")).alias("firsts"))
    kind = dict(blocks.dtypes)["conv"]

    def run(batches):
        for b in batches:
            out = []
            for turns, codes, firsts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                code, new = np.asarray(codes, np.int64), np.zeros(len(codes), bool)
                new[firsts or []] = True
                role, blank, open_ = code % 4, code // 4 == 1, code // 4 == 2
                again, open_ = ~new & ~blank, open_ & new
                kinds = (role + np.where(blank | again, GONE, np.where(open_, CUT_OFF, FINE))).astype(np.uint8).tobytes()
                out.append((kinds, short_table(kinds) if len(kinds) <= 2 * RUN else flat(block_table(kinds)), facts_of(role.tolist(), turns, int(blank.sum()), int(again.sum()), int(open_.sum()))))
            kinds, tables, facts = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.binary()), pa.array(tables, pa.list_(pa.int64())), pa.array(facts, pa.list_(pa.int64()))], ["conv", "blk", "kinds", "tbl", "facts"])

    rows = blocks.select("conv", "blk", "turns", "codes").join(firsts, "blk", "left").select("conv", "blk", "turns", "codes", "firsts")
    return cut(rows.mapInArrow(run, f"conv {kind}, blk long, kinds binary, tbl array<long>, facts array<long>"), "turn-nodes")


def _parts(nodes: DataFrame) -> DataFrame:
    """The blocks of each conversation in one part of the sort as one node: (conv, blk of the first, tbl, facts, nodes)."""
    own = nodes.groupBy("conv", F.shiftright("blk", 33).alias("part")).agg(F.sort_array(F.collect_list(F.struct("blk", "tbl", "facts"))).alias("nodes"))
    kind = dict(nodes.dtypes)["conv"]

    def run(batches):
        for b in batches:
            lists = b.column(1).to_pylist()
            done = [_joined(x) for x in lists]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0]["blk"] for x in lists], pa.int64()), pa.array([flat(t) for t, _ in done], pa.list_(pa.int64())), pa.array([f for _, f in done], pa.list_(pa.int64())), pa.array(lists, pa.list_(_NODE))], ["conv", "blk", "tbl", "facts", "nodes"])

    return cut(own.select("conv", "nodes").mapInArrow(run, f"conv {kind}, blk long, tbl array<long>, facts array<long>, nodes array<struct<{NODE.replace('blk long', 'blk: long').replace('tbl array', 'tbl: array').replace('facts array', 'facts: array')}>>"), "turn-parts")


WAY = "blk long, first int, last int, tail int, alone boolean"
_WAY = [("blk", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("tail", pa.int32()), ("alone", pa.bool_())]


def _solved(parts: DataFrame) -> DataFrame:
    """(conv, cost, facts, ways) of each conversation: the states at both ends of each of its parts, as many as the sort had tasks at most."""
    own = parts.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("blk", "tbl", "facts", F.size("nodes").alias("n")))).alias("nodes"))
    kind = dict(parts.dtypes)["conv"]
    way = "array<struct<" + ", ".join(x.replace(" ", ": ", 1) for x in WAY.split(", ")) + ">>"

    def run(batches):
        for b in batches:
            costs, facts, ways = [], [], []
            for nodes in b.column(1).to_pylist():
                whole, fact = _joined(nodes)
                ends = whole[NOTHING]
                cost, _, last = min((ends[s][0] + ENDS[s], ends[s][1], s) for s in range(4) if ends[s][0] < FAR)
                states = [NOTHING, *crossings([deep(x["tbl"]) for x in nodes], NOTHING, last)]
                alone = len(nodes) == 1 and nodes[0]["n"] == 1
                costs.append(cost)
                facts.append(fact)
                ways.append([{"blk": x["blk"], "first": states[k], "last": states[k + 1], "tail": ENDS[last] // INSERT if k + 1 == len(nodes) else 0, "alone": alone} for k, x in enumerate(nodes)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(costs, pa.int64()), pa.array(facts, pa.list_(pa.int64())), pa.array(ways, pa.list_(pa.struct(_WAY)))], ["conv", "cost", "facts", "ways"])

    return cut(own.mapInArrow(run, f"conv {kind}, cost long, facts array<long>, ways {way}"), "turn-ways")


def _block_ways(parts: DataFrame, solved: DataFrame) -> DataFrame:
    """WAY of each block, from those of the parts."""
    asked = parts.select("blk", "nodes").join(solved.select(F.inline("ways")), "blk")

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                states = [r["first"], *crossings([deep(x["tbl"]) for x in r["nodes"]], r["first"], r["last"])]
                out += [(x["blk"], states[k], states[k + 1], r["tail"] if k + 1 == len(r["nodes"]) else 0, r["alone"]) for k, x in enumerate(r["nodes"])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(_WAY)], [c for c, _ in _WAY])

    return asked.mapInArrow(run, WAY)


def _edited(r: dict) -> list[tuple[str, str, str | None, int]]:
    """(letter, role, text, row of the block) of each edit in turn; the role and text are null for a deleted row."""
    out, state = [], r["first"]
    for i, (letters, role, text) in enumerate(zip(block_edits(r["kinds"], r["first"], r["last"]), r["roles"], r["texts"], strict=True)):
        for x in letters:
            if x == "D":
                out.append((x, None, None, i))
                continue
            state = r["kinds"][i] % 4 if x == "K" else NEXT[state]
            out.append((x, role if x == "K" else ROLES[state], "" if x == "I" else text, i))
    for _ in range(r["tail"]):
        state = NEXT[state]
        out.append(("I", ROLES[state], "", len(r["roles"])))
    return out


class Repair:
    """The repair of a table of turns: its conversations, and their turns as repaired."""

    def __init__(self, turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES):
        self.conv_col = conv_col
        own = turns.select(turns[conv_col].alias("conv"), turns[turn_col].alias("turn"), turns[role_col].alias("role"), turns[text_col].alias("text"))
        self.blocks = _blocks(own, block_rows, block_bytes)
        self.nodes = _nodes(self.blocks)
        parts = _parts(self.nodes)
        self.solved = _solved(parts)
        ways = _block_ways(parts, self.solved).join(self.nodes.select("blk", "kinds"), "blk")
        self.rows = self.blocks.select("conv", "blk", "roles", "texts").join(ways, "blk")

    def turns(self) -> DataFrame:
        """(id, at, edit, role, text): every edit in order, deleted rows without role and text."""
        kind = dict(self.rows.dtypes)["conv"]

        def run(batches):
            for b in batches:
                for k, r in enumerate(b.to_pylist()):
                    own = _edited(r)
                    yield pa.RecordBatch.from_arrays([pa.repeat(b.column(b.schema.get_field_index("conv"))[k], len(own)), pa.array([r["blk"]] * len(own), pa.int64()), pa.array(range(len(own)), pa.int64()), *(pa.array([x[c] for x in own], pa.string()) for c in range(3))], ["conv", "blk", "at", "edit", "role", "text"])

        return self.rows.mapInArrow(run, f"conv {kind}, blk long, at long, edit string, role string, text string").withColumnRenamed("conv", self.conv_col)

    def summaries(self) -> DataFrame:
        """A row for each conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        kind = dict(self.rows.dtypes)["conv"]

        def pieces(batches):
            for b in batches:
                audits, texts = [], []
                for r in b.to_pylist():
                    own = _edited(r)
                    lines = [f"{role}:{text}" for x, role, text, _ in own if x != "D"]
                    text = "\n".join(lines)
                    audits.append("".join(x for x, *_ in own))
                    texts.append(hashlib.sha256(text.encode()).hexdigest() if r["alone"] else text if lines else None)
                own = [b.column(b.schema.get_field_index(c)) for c in ("conv", "blk", "alone")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(audits, pa.string()), pa.array(texts, pa.string())], ["conv", "blk", "alone", "audit", "text"])

        def whole(batches):
            """Hashes of single blocks are done. The others come by conversation and place; a hash takes in one after the other."""
            key, audit, h, some = None, [], None, False
            names = ["conv", "audit", "repaired_sha256"]
            row = lambda: pa.RecordBatch.from_arrays([key, pa.array(["".join(audit)]), pa.array([h.hexdigest()])], names)
            for b in batches:
                done = b.filter(b.column(2))
                yield pa.RecordBatch.from_arrays([done.column(k) for k in (0, 3, 4)], names)
                b = b.filter(pc.invert(b.column(2)))
                for k, (part, text) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                    own = b.column(0).slice(k, 1)
                    if key is None or not own.equals(key):
                        if key is not None:
                            yield row()
                        key, audit, h, some = own, [], hashlib.sha256(), False
                    audit.append(part)
                    if text is not None:
                        h.update((("\n" if some else "") + text).encode())
                        some = True
            if key is not None:
                yield row()

        ends = self.rows.mapInArrow(pieces, f"conv {kind}, blk long, alone boolean, audit string, text string")
        ends = ends.repartition("conv").sortWithinPartitions("conv", "blk").mapInArrow(whole, f"conv {kind}, audit string, repaired_sha256 string")
        facts = self.solved.select(F.col("conv").alias("__conv"), "cost", *(F.col("facts")[k].alias(c) for k, c in enumerate(FACTS)))
        out = facts.join(ends, facts["__conv"].eqNullSafe(ends["conv"]))
        gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
        return out.select(F.col("conv").alias(self.conv_col), gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "conversations")
    done = Repair(damaged(source), "conv", "turn", "role", "text").summaries()
    every = source.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(done, every["conv_id"].eqNullSafe(done["conv"]), "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """Least (cost, audit) and repaired text for each state from the last row to the first."""
    due = ("", "", "user", "assistant")

    def more(cost: str, letter: str, line: str, v: str) -> str:
        return f"{{'c': {cost} + {v}.c, 'a': '{letter}' || {v}.a, 'r': {line} || {v}.r}}"

    def row(s: int) -> str:
        to = NEXT[s]
        ways = [more("4", "D", "''", f"s{s}"), f"case when not gone then {more('3 + more', 'R', f"chr(10) || '{due[to]}:' || text", f's{to}')} end"]
        for letter, k in (("s", SYSTEM), ("u", USER), ("a", ASSISTANT)):
            if _keeps(s, k):
                ways.append(f"case when not gone and left(role, 1) = '{letter}' then {more('more', 'K', "chr(10) || role || ':' || text", f's{k}')} end")
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x is not null))[1] as v{s}"

    def state(s: int) -> str:
        a, b = NEXT[s], NEXT[NEXT[s]]
        ways = [f"v{s}", more("3", "I", f"chr(10) || '{due[a]}:'", f"v{a}"), more("6", "II", f"chr(10) || '{due[a]}:' || chr(10) || '{due[b]}:'", f"v{b}")]
        return f"list_sort([{', '.join(ways)}])[1] as s{s}"

    ends = [("0", "''", "''"), ("6", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'"), ("3", "'I'", "chr(10) || 'assistant:'"), ("0", "''", "''")]
    return rf"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as k from conversations),
d as (
  select conv_id, turn, case k when 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case k when 3 then 2 else 1 end)) as copy
  from k where k <> 0),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from d),
f as (
  select *, not regexp_matches(text, '[^ 	-
]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
         regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) not in ('.', '!', '?') as open_, lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from r),
g as (select *, blank or again as gone, case when open_ then 3 else 0 end as more from f),
b(conv_id, i, s0, s1, s2, s3) as (
  select conv_id, count(*) + 1, {', '.join(f"{{'c': {c}::bigint, 'a': {a}, 'r': {r}}}" for c, a, r in ends)} from r group by conv_id
  union all
  select conv_id, i, {', '.join(map(state, range(4)))} from (
    select g.conv_id, g.i, {', '.join(map(row, range(4)))} from b join g on g.conv_id is not distinct from b.conv_id and g.i = b.i - 1)),
t as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate,
         count(*) filter (open_ and not gone) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from g group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(s0.c, 0) as cost, coalesce(s0.a, '') as audit, sha256(substr(coalesce(s0.r, ''), 2)) as repaired_sha256
from (select distinct conv_id from conversations) o left join t on t.conv_id is not distinct from o.conv_id left join b on b.conv_id is not distinct from o.conv_id and b.i = 1
"""


SQL = _sql()
