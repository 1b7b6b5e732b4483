"""Near-duplicate groups: HyperMinHash registers, banding, corrected estimates, exact verification, components.

A document's set holds the hashes of its distinct five-word shingles. Each of REGISTERS buckets keeps, of the least
hash under its own hash function, the count of leading zeros and MANTISSA bits after the first one (16 bits in
all). BAND registers together form a key; documents that share a key are candidates. At a similarity of 0.75 a
pair shares none of the 40 keys with a probability below 3e-7.

Texts of the same words form a class, and only its smallest id goes on. Within a bucket of equal keys all members
are compared with its smallest id, not with each other; where a bucket then still spans several components, those
of its members that lie in different components are compared as well, so no link that would join two groups is
left out, while a group of many copies costs a comparison a member. That second comparison is an exact prefix join,
as a bucket may hold all documents that share one passage: with shingles in the order of their frequency, two sets
that agree in three quarters share one of the first n - ceil(0.75 n) + 1, which a common passage is not among. What
a document shares with no other bounds what it can share with one, and so the sizes of sets that it can agree with;
so does a sketch of parities. Both keep apart the outlying members of a large group of near copies. Before the full sets are compared, the
estimate from all registers, corrected for registers that agree by chance, must come within MARGIN of the threshold.

Texts are of one class if a 128-bit cryptographic digest of their words agrees. Classes are numbered once, in a
written table, and all joins go by these numbers, so rows that repeat an id with different texts stay apart.

Null and empty texts have no shingles and are linked with nothing; rows without an id are linked with nothing,
have a null component and are kept; rows that repeat an id are linked only if their texts are; an empty table
gives an empty result; extra columns are ignored; a text of any length has its whole set.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, blocks, byte_table, cut, mix, span_hashes, table, text_parts, word_spans

SHINGLE, THRESHOLD = 5, 75
REGISTERS, BAND, MANTISSA = 160, 4, 10
#: Five standard errors of an estimate from 160 registers.
MARGIN = 0.17
#: Sizes of sets are dealt into classes that each reach this much further.
SIZE_STEP = 1.1
#: Bits of the parity sketch that bounds how many shingles two sets share.
PARITIES = 1024
#: Places of a prefix that are looked back at, so that a pair that shares many is told once; it changes how often a pair is told, never whether it is.
RECENT = 16
_LOOKUP = byte_table(SPACES, fold=True)
_U = np.uint64


def _functions() -> tuple[np.ndarray, np.ndarray]:
    seed = np.arange(1, REGISTERS + 1, dtype=np.uint64)
    return mix(seed * _U(0xA0761D6478BD642F)) | _U(1), mix(seed * _U(0xE7037ED1A0B428DB))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes, key 1, key 2) of the rows of a block: row i's set is hashes[starts[i]:starts[i + 1]], ascending; the keys tell sequences of words apart."""
    n = len(offsets) - 1
    is_sep, same = _LOOKUP
    folded = same[raw]
    row, begin, end = word_spans(raw, offsets, is_sep)
    h = span_hashes(folded, begin, end)
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    within = np.arange(len(row)) - first[row] if len(row) else row
    # The digest of a sequence of words is that of their lengths and of their bytes.
    size = (end - begin).astype("<u4")
    letters = folded[~is_sep[raw]].tobytes()
    to = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[first].tolist()
    keys = np.zeros((2, n), np.uint64)
    for i in np.flatnonzero(count):
        d = hashlib.blake2b(size[first[i] : first[i + 1]].tobytes(), digest_size=16)
        d.update(letters[to[i] : to[i + 1]])
        keys[:, i] = np.frombuffer(d.digest(), "<u8")
    at = np.flatnonzero(within <= (count[row] - SHINGLE)) if len(row) else np.empty(0, np.int64)
    s = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        s = s * _U(0x9FB21C651E98DF25) + h[at + j]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    owner = np.concatenate((row[at], short))
    s = np.concatenate((mix(s), mix(keys[0][short] + _U(SHINGLE))))
    order = np.argsort(s)
    order = order[np.argsort(owner[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return np.searchsorted(owner, np.arange(n + 1)), s, keys[0], keys[1]


def registers(starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS, 16 bits: exponent and mantissa of the least hash) of sets; an empty set has zeros."""
    has = np.flatnonzero(np.diff(starts))
    out = np.zeros((len(starts) - 1, REGISTERS), np.uint16)
    if not len(has):
        return out
    x, lo = mix(hashes + _U(1)), starts[:-1][has]
    for j, (a, c) in enumerate(zip(*_functions(), strict=True)):
        least = np.minimum.reduceat(x * a + c, lo)
        # A double's exponent tells the leading zeros, its first bits are the mantissa.
        out[has, j] = (least.astype(np.float64).view(np.uint64) >> _U(52 - MANTISSA)).astype(np.uint16)
    return out


def parities(starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """PARITIES bits of each set, as 64-bit words: how many of its shingles fall on a bit, modulo two."""
    rows, words = len(starts) - 1, PARITIES // 64
    place = np.repeat(np.arange(rows), np.diff(starts)) * PARITIES + (mix(hashes + _U(3)) % _U(PARITIES)).astype(np.int64)
    odd = (np.bincount(place, minlength=rows * PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(rows, PARITIES), axis=1, bitorder="little").view(np.uint64).reshape(rows, words)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register of two sets of n and m shingles without a common one agrees: over cells of each exponent, both least hashes fall in one."""
    total, s = np.zeros(len(n)), n + m
    for zeros in range(64):
        hi = 2.0**-zeros
        total += hi / 2 / (1 << MANTISSA) * (np.exp(-s * hi / 2) - np.exp(-s * hi))
    return np.minimum(n * m / s * total, 1.0)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (pairs x REGISTERS), corrected for agreement by chance."""
    c = chance(n.astype(float), m.astype(float))
    return ((a == b).mean(axis=1) - c) / (1 - c)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, n shingles, k1, k2, registers) of each row; row_key is a hash of the text."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_parts(batch.column(1))
            for lo, hi in blocks(offsets):
                part = offsets[lo : hi + 1]
                starts, s, k1, k2 = shingle_sets(raw[part[0] : part[-1]], part - part[0])
                n = np.diff(starts)
                regs = registers(starts, s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([r.tobytes() for r in regs], pa.binary())], ["id", "row_key", "n", "k1", "k2", "regs"])

    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("row_key")).mapInArrow(run, "id long, row_key long, n long, k1 long, k2 long, regs binary")


def band_rows(sketches: DataFrame) -> DataFrame:
    """(key, id, n) for each band of each sketch."""
    bands = REGISTERS // BAND
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            k = batch.num_rows
            if k:
                regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(k, bands, BAND).astype(np.uint64)
                packed = np.zeros((k, bands), np.uint64)
                for j in range(BAND):
                    packed |= regs[:, :, j] << _U(16 * j)
                keys = mix(mix(packed) + salt).view(np.int64).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.repeat(batch.column(i).to_numpy(), bands)) for i in (0, 1))], ["key", "id", "n"])

    return sketches.select("id", "n", "regs").mapInArrow(run, "key long, id long, n long")


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose estimate comes within MARGIN of the threshold."""
    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                n, m = (batch.column(i).to_numpy() for i in (4, 5))
                near = (estimate(a, b, n, m) >= THRESHOLD / 100 - MARGIN) & (100 * np.minimum(n, m) >= THRESHOLD * np.maximum(n, m))
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in (0, 1)], ["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long")


def _texts(nodes: DataFrame, docs: DataFrame, of: DataFrame, make, schema: str, id_col: str, text_col: str) -> DataFrame:
    """(node, columns of schema) for each of the nodes: make(starts, hashes) gives the columns of a block of texts. of: (node, rep, k1, k2), the class that each node stands for."""
    wanted = of.join(nodes, "node", "left_semi")
    texts = docs.select(docs[id_col].cast("long").alias("rep"), docs[text_col].cast("string").alias("text")).join(wanted.select("rep").distinct(), "rep", "left_semi")
    names = ["rep", "k1", "k2", *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        for batch in batches:
            raw, offsets = text_parts(batch.column(1))
            for lo, hi in blocks(offsets):
                part = offsets[lo : hi + 1]
                starts, s, k1, k2 = shingle_sets(raw[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), *make(starts, s)], names)

    key = ["rep", "k1", "k2"]
    return texts.mapInArrow(run, f"rep long, k1 long, k2 long, {schema}").dropDuplicates(key).join(wanted, key).select("node", *names[3:])


def verified(pairs: DataFrame, docs: DataFrame, of: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b) of nodes of which the full sets agree: 100 * common >= THRESHOLD * all."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    pack = lambda starts, s: [pa.array([s[i:j].tobytes() for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], pa.binary())]
    full = cut(_texts(nodes, docs, of, pack, "s binary", id_col, text_col), name)

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(100 * common >= THRESHOLD * (len(x) + len(y) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    one, two = full.select(F.col("node").alias("a"), F.col("s").alias("sa")), full.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def prefix_pairs(members: DataFrame, docs: DataFrame, of: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b) of members (node, n, comp) of different components that may agree in THRESHOLD per cent; none that does is left out."""

    def pack(starts, s):
        sets = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(s.view(np.int64)))
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(starts)) * (PARITIES // 64), pa.int32()), pa.array(parities(starts, s).view(np.int64).reshape(-1)))
        return [sets, bits]

    sets = cut(_texts(members.select("node"), docs, of, pack, "s array<long>, bits array<long>", id_col, text_col), "shingles")
    members = members.withColumnRenamed("node", "id")
    sets = sets.withColumnRenamed("node", "id")
    shingles = sets.select("id", F.explode("s").alias("s"))
    shared = shingles.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    # Shingles of one member come first; they take up places but join nothing.
    ordered = shingles.join(shared, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("o")).join(members, "id").join(sets.select("id", "bits"), "id")
    places = f"n - ceil({THRESHOLD} * n / 100) + 1 - (n - size(o))"
    # Of two sets x and y with m elements that any other has, at most m are common, and THRESHOLD per cent of all must be: |y| is at most "reach" of x.
    reach = f"floor(({100 + THRESHOLD} * size(o)) / {THRESHOLD}) - n"
    # Each place carries the RECENT ones before it and the number of those from it on.
    place = f"transform(slice(o, 1, cast(greatest(0, {places}) as int)), (x, i) -> struct(x.s as s, transform(slice(o, greatest(i - {RECENT}, 0) + 1, least(i, {RECENT})), y -> y.s) as before, size(o) - i as rest))"
    prefix = cut(ordered.select("id", "n", "comp", "bits", F.expr(reach).alias("reach"), F.expr(f"explode({place})").alias("x")).select("id", "n", "comp", "bits", "reach", "x.*"), "prefix")
    step = lambda v: f"cast(floor(ln({v}) / {math.log(SIZE_STEP)!r}) as int)"
    # The larger set of a pair looks into the classes of sizes that it can agree with, the smaller one lies in its own.
    one = prefix.where(f"100 * reach >= {THRESHOLD} * n").select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("reach").alias("ra"), F.col("bits").alias("xa"), F.col("before").alias("pa"), F.col("rest").alias("ea"), "s", F.expr(f"explode(sequence({step(f'{THRESHOLD} * n / 100')}, {step('least(n, reach)')}))").alias("size"))
    two = prefix.where(f"100 * reach >= {THRESHOLD} * n").select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("reach").alias("rb"), F.col("bits").alias("xb"), F.col("before").alias("pb"), F.col("rest").alias("eb"), "s", F.expr(step("n")).alias("size"))
    # Each shingle that only one of two sets has turns one parity over, so the parities that differ count no more than these shingles.
    apart = " + ".join(f"bit_count(xa[{i}] ^ xb[{i}])" for i in range(PARITIES // 64))
    # A pair is told at the first place that its sets share: none before it agrees, and no more than what follows can. Later places may repeat the pair, but the places just before them agree as a rule.
    first = f"{100 + THRESHOLD} * least(ea, eb) >= {THRESHOLD} * (na + nb) and not arrays_overlap(pa, pb)"
    pairs = one.join(two, ["s", "size"]).where(f"{100 + THRESHOLD} * ({apart}) <= {100 - THRESHOLD} * (na + nb) and ca <> cb and (na > nb or na = nb and a > b) and 100 * nb >= {THRESHOLD} * na and nb <= ra and na <= rb and {first}")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for each end of an edge (a, b); comp is the smallest id that edges reach.

    Each round lets every end follow its neighbour that comes first in the order of a hash, and contracts the
    edges; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = cut(edges.where("a <> b").distinct(), "edges")
    member = cut(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("root")), "members")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
        follow = cut(both.groupBy("a").agg(F.min(order("b")).alias("low")).select("a", F.least("low", order("a"))["id"].alias("to")), "follow")
        # One jump along what is followed halves the way to a root.
        far = follow.select(F.col("a").alias("to"), F.col("to").alias("next"))
        follow = cut(follow.join(far, "to", "left").select("a", F.coalesce("next", "to").alias("to")), "follow")
        member = cut(member.join(follow, member["root"] == follow["a"], "left").select("id", F.coalesce("to", "root").alias("root")), "members")
        ends = edges.join(follow, "a").select(F.col("to").alias("x"), "b")
        ends = ends.join(follow, ends["b"] == follow["a"]).select(F.col("x").alias("a"), F.col("to").alias("b"))
        edges = cut(ends.where("a <> b").distinct(), "edges")
    low = member.groupBy("root").agg(F.min("id").alias("comp"))
    return member.join(low, "root").select("id", "comp")


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_key, n, k1, k2, root, comp) of each row: root tells groups apart, comp is the smallest id of the group; both are null without an id or a word."""
    every = cut(sketch(docs, id_col, text_col), "sketch")
    own = every.where("n > 0 and id is not null")
    # Numbered in the file that is written, so a class has one number however often it is read.
    of = cut(own.groupBy("k1", "k2").agg(F.min("id").alias("rep")).select(F.monotonically_increasing_id().alias("node"), "rep", "k1", "k2"), "classes")
    first = every.join(of, (every["id"] == of["rep"]) & (every["k1"] == of["k1"]) & (every["k2"] == of["k2"]))
    reps = cut(first.select(of["node"].alias("id"), "n", "regs").dropDuplicates(["id"]), "reps")
    rows = band_rows(reps)
    buckets = rows.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = cut(rows.join(buckets.select("key", "hub"), "key"), "buckets")
    near = cut(likely(members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), reps), "likely")
    links = cut(verified(near, docs, of, "sets", id_col, text_col), "links")
    found = cut(components(links), "found")
    # Buckets that still hold more than one component: their members are compared across components.
    labelled = members.join(found, "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    left = cut(labelled.join(mixed, "key", "left_semi").select(F.col("id").alias("node"), "n", "comp").distinct(), "mixed")
    across = prefix_pairs(left, docs, of, id_col, text_col).join(near, ["a", "b"], "left_anti")
    more = cut(verified(cut(likely(across, reps), "likely"), docs, of, "sets", id_col, text_col), "links")
    found = cut(components(links.union(more)), "found")
    # The smallest node of a group need not hold its smallest id.
    least = found.join(of.select(F.col("node").alias("id"), "rep"), "id").groupBy("comp").agg(F.min("rep").alias("least"))
    found = found.join(least, "comp").select(F.col("id").alias("node"), F.col("comp").alias("root"), "least")
    named = of.join(found, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("root"), F.coalesce("least", "rep").alias("comp"))
    own = own.join(named, ["k1", "k2"]).select("id", "row_key", "n", "k1", "k2", "root", "comp")
    none = F.lit(None).cast("long")
    return own.union(every.where("n = 0 or id is null").select("id", "row_key", "n", "k1", "k2", none, none))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    comp = F.coalesce("comp", "id")
    return _labelled(docs, id_col, text_col).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, that of the smallest id (of rows that repeat this id, one); columns stay. Rows without an id or a word are in no group and stay, but for rows that agree in both id and text, of which one does."""
    rows = cut(_labelled(docs, "doc_id", "text"), "labelled")
    best = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "row_key")).alias("m")).select("m.*")
    kept = best.union(rows.where("root is null and id is not null").select("id", "row_key")).distinct()
    same = (docs["doc_id"].cast("long") == kept["id"]) & (F.xxhash64(docs["text"].cast("string")) == kept["row_key"])
    # Of rows with an id, the one that stays is found by number, so their texts are moved for those with repeated keys only.
    twice = cut(rows.where("id is not null").groupBy("id", "row_key").agg(F.count("*").alias("copies")).where("copies > 1").join(kept, ["id", "row_key"], "left_semi"), "twice")
    out = docs.join(kept, same, "left_semi")
    if twice.isEmpty():
        return out.union(docs.where("doc_id is null"))
    again = (docs["doc_id"].cast("long") == twice["id"]) & (F.xxhash64(docs["text"].cast("string")) == twice["row_key"])
    one = out.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(twice, again, "left_anti").union(one).union(docs.where("doc_id is null"))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
s as (
  select distinct doc_id, md5(array_to_string(w[i:i + 4], ' ')) as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (g) where a.doc_id < b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
u as (select a, b from e union select b, a from e),
r(doc_id, to_id) as (select doc_id, doc_id from documents union select r.doc_id, u.b from r join u on u.a = r.to_id)
select doc_id, coalesce(n, 0) as n_shingles, min(to_id) as component_id, doc_id = min(to_id) as kept from r left join n using (doc_id) group by doc_id, n
"""
