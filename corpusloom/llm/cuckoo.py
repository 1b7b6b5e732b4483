"""Exact de-duplication with a cuckoo-filter index.

Texts are equal if they are identical without white space; a text's digest is the SHA-256 of what is left. The index
holds the live digests in shards by their leading bits. A shard is a cuckoo filter: buckets of SLOTS fingerprints of 16
bits, each digest in one of two buckets, with the digests themselves stored beside them. A digest whose fingerprint is
found is compared with the stored ones; one that is new is inserted; a table that overflows is built anew at a larger
size from its stored digests. Digests can be deleted again, which frees their slots.

Rows send their digests to the shards, combined within each batch, so a text that fills a third of the table arrives
as one digest a batch. Digests that the filter has seen before are hits. The texts of hits, and of no others, are then
compared as whole contents within their digest (combined before the shuffle), and only equal contents form a group.
Groups with a thousandth of the rows or more are at most a thousand, so they are broadcast; no other key is as frequent.

A null text is an empty one, and empty texts are equal to each other and to white space. Of rows that agree in length
and id one stays. Null ids come last. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, scratch, table

SPACE = " \t\n\x0b\x0c\r"
SLOTS = 4
#: Share of filled slots beyond which a table grows, and rounds of moving digests about before it does.
LOAD, ROUNDS = 0.9, 200
#: Digests of a shard that a new index aims at.
SHARD_KEYS = 20_000
#: Digests beyond this number aren't broadcast (64 hex digits each).
BROADCAST_ROWS = 200_000


class Cuckoo:
    """A cuckoo filter with its keys: rows of four unsigned 64-bit words, taken to be uniform."""

    def __init__(self, buckets: int = 16):
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.marks = np.zeros((buckets, SLOTS), np.uint16)
        self.keys = np.zeros((buckets, SLOTS, 4), np.uint64)

    def __len__(self) -> int:
        return int(np.count_nonzero(self.marks))

    def _homes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0) and both buckets; either bucket follows from the other and the fingerprint."""
        mask = np.uint64(len(self.marks) - 1)
        mark = (keys[:, 2] >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = keys[:, 1] & mask
        return mark, first.astype(np.int64), (first ^ (mix(mark.astype(np.uint64)) & mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot of each key or -1, whether its fingerprint was found)."""
        mark, a, b = self._homes(keys)
        slots = np.concatenate((a[:, None] * SLOTS + np.arange(SLOTS), b[:, None] * SLOTS + np.arange(SLOTS)), axis=1)
        seen = self.marks.reshape(-1)[slots] == mark[:, None]
        out = np.full(len(keys), -1, np.int64)
        row, col = np.nonzero(seen)
        where = slots[row, col]
        same = (self.keys.reshape(-1, 4)[where] == keys[row]).all(axis=1)
        out[row[same]] = where[same]
        return out, seen.any(axis=1)

    def live(self) -> np.ndarray:
        return self.keys[self.marks != 0]

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Frees the slots of the keys that are live; whether each was."""
        at, _ = self.find(keys)
        self.marks.reshape(-1)[at[at >= 0]] = 0
        return at >= 0

    def insert(self, keys: np.ndarray) -> None:
        """Adds distinct keys that aren't live."""
        while len(keys):
            if len(self) + len(keys) <= LOAD * self.marks.size:
                keys = self._place(keys)
                if not len(keys):
                    return
            stored = self.live()
            keys = np.concatenate((stored, keys))
            buckets = 2 * len(self.marks)
            while LOAD * buckets * SLOTS < len(keys):
                buckets *= 2
            self._empty(buckets)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """Puts keys into free slots, moving others to their second bucket; returns those left without one."""
        left = keys.copy()
        _, at, _ = self._homes(left)
        for turn in range(ROUNDS):
            moved = True
            while moved and len(left):  # one key for each bucket at a time
                moved = False
                for second in (False, True):
                    if not len(left):
                        break
                    mark, a, b = self._homes(left)
                    where = np.where(at == a, b, a) if second else at
                    free = self.marks[where] == 0
                    can = np.flatnonzero(free.any(axis=1))
                    can = can[np.unique(where[can], return_index=True)[1]]
                    if len(can):
                        slot = free[can].argmax(axis=1)
                        self.marks[where[can], slot], self.keys[where[can], slot] = mark[can], left[can]
                        stay = np.ones(len(left), bool)
                        stay[can] = False
                        left, at, moved = left[stay], at[stay], True
            if not len(left):
                break
            mark, _, _ = self._homes(left)
            own = np.unique(at, return_index=True)[1]
            bucket, slot = at[own], (turn + own) % SLOTS
            out = self.keys[bucket, slot].copy()
            self.marks[bucket, slot], self.keys[bucket, slot] = mark[own], left[own]
            left[own] = out
            _, a, b = self._homes(out)
            at[own] = np.where(bucket == a, b, a)
        return left


def words_of(digests: list[str]) -> np.ndarray:
    """Digests in hex as rows of four words."""
    return np.frombuffer(bytes.fromhex("".join(digests)), ">u8").reshape(-1, 4).astype(np.uint64)


def hex_of(keys: np.ndarray) -> list[str]:
    text = keys.astype(">u8").tobytes().hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def digest(text: Column) -> Column:
    return F.sha2(normal(text).cast("binary"), 256)


STATE = "shard int, bits int, live long, marks binary, words binary"


class Index:
    """Live digests in a folder, in 2^bits shards. Each change writes a new generation beside the old one."""

    def __init__(self, spark, folder: str | None = None, bits: int = 0):
        self.spark, self.bits = spark, bits
        self.folder = folder or f"{scratch(spark)}/loom/cuckoo-{uuid.uuid4().hex}"
        self.state = spark.createDataFrame([], STATE)

    def _run(self, digests: DataFrame, deleting: bool) -> DataFrame:
        """(digest, found, n) for each distinct digest and batch it came in: whether it was live then, and its rows."""
        bits = self.bits

        def combine(batches):
            for b in batches:
                own, n = np.unique(np.asarray(b.column(0).to_pylist(), object).astype("U64"), return_counts=True)
                if len(own):
                    keys = words_of(own.tolist())
                    yield pa.RecordBatch.from_arrays([pa.array((keys[:, 0] >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(own), np.int32)), pa.array(own.tolist()), pa.array(n, pa.int64())], ["shard", "digest", "n"])

        sent = digests.select("digest").mapInArrow(combine, "shard int, digest string, n long").selectExpr("shard", "1 as kind", "null as marks", "null as words", "digest", "n")
        # A shard of an earlier generation with fewer bits is the state of all shards that it splits into.
        split = F.explode(F.expr(f"sequence(cast(shiftleft(shard, {bits} - bits) as int), cast(shiftleft(shard + 1, {bits} - bits) - 1 as int))"))
        kept = self.state.select(split.alias("shard"), F.lit(0).alias("kind"), "marks", "words", F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("n"))

        def serve(batches):
            shard, filter_ = None, Cuckoo()

            def stored():
                keys = filter_.live()
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([bits], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([filter_.marks.astype("<u2").tobytes()]), pa.array([filter_.keys.astype("<u8").tobytes()]), *(pa.array([None], t) for t in (pa.string(), pa.bool_(), pa.int64()))], names) if len(keys) else None

            names = ["shard", "bits", "live", "marks", "words", "digest", "found", "n"]
            for b in batches:
                shards, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
                edges = np.flatnonzero(np.diff(shards)) + 1
                for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(shards)], strict=True):
                    if lo == hi:
                        continue
                    if shards[lo] != shard:
                        if shard is not None and (row := stored()) is not None:
                            yield row
                        shard, filter_ = int(shards[lo]), Cuckoo()
                    while lo < hi and kinds[lo] == 0:
                        marks = np.frombuffer(b.column(2)[lo].as_py(), "<u2").reshape(-1, SLOTS)
                        keys = np.frombuffer(b.column(3)[lo].as_py(), "<u8").reshape(-1, SLOTS, 4)
                        keys = keys[marks != 0]
                        filter_.insert(keys[(keys[:, 0] >> np.uint64(64 - bits)).astype(np.int64) == shard] if bits else keys)
                        lo += 1
                    if lo == hi:
                        continue
                    texts, n = b.column(4).slice(lo, hi - lo).to_pylist(), b.column(5).slice(lo, hi - lo).to_numpy()
                    own, group = np.unique(np.asarray(texts, "U64"), return_inverse=True)
                    total, keys = np.bincount(group, n).astype(np.int64), words_of(own.tolist())
                    if deleting:
                        found = filter_.delete(keys)
                    else:
                        found = filter_.find(keys)[0] >= 0
                        filter_.insert(keys[~found])
                    k = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int32()), *(pa.nulls(k, t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary())), pa.array(own.tolist()), pa.array(found), pa.array(total)], names)
            if shard is not None and (row := stored()) is not None:
                yield row

        rows = sent.unionByName(kept).repartition("shard").sortWithinPartitions("shard", "kind")
        path = f"{self.folder}/{uuid.uuid4().hex}"
        rows.mapInArrow(serve, f"{STATE}, digest string, found boolean, n long").write.parquet(path)
        out = self.spark.read.schema(f"{STATE}, digest string, found boolean, n long").parquet(path)
        self.state = out.where("digest is null").select("shard", "bits", "live", "marks", "words")
        return out.where("digest is not null").select("digest", "found", "n")

    def grow(self, more: int) -> None:
        """More shards where the digests that are to come would fill the present ones."""
        while (self.size() + more) > SHARD_KEYS << self.bits and self.bits < 30:
            self.bits += 1

    def size(self) -> int:
        """Number of live digests."""
        return self.state.agg(F.sum("live")).first()[0] or 0

    def insert(self, digests: DataFrame) -> DataFrame:
        """Makes digests live. Returns the distinct ones that were live before or came more than once."""
        return self._run(digests, False).groupBy("digest").agg(F.max("found").alias("found"), F.sum("n").alias("n")).where("found or n > 1").select("digest")

    def delete(self, digests: DataFrame) -> DataFrame:
        """Takes digests out. Returns those that were live."""
        return self._run(digests, True).where("found").select("digest").distinct()

    def digests(self) -> DataFrame:
        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    marks = np.frombuffer(r["marks"], "<u2").reshape(-1, SLOTS)
                    yield pa.RecordBatch.from_arrays([pa.array(hex_of(np.frombuffer(r["words"], "<u8").reshape(-1, SLOTS, 4)[marks != 0]), pa.string())], ["digest"])

        return self.state.select("marks", "words").mapInArrow(run, "digest string")


def groups(docs: DataFrame, index: Index | None = None, kept: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_chars, text_sha256, keep_id, group_size, kept. Their digests become live in the index.

    kept are the documents whose digests are live in an index that was filled before; they are members of the groups.
    """

    def keyed_of(df: DataFrame) -> DataFrame:
        text = df[text_col].cast("string")
        return df.select(df[id_col].alias("id"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"), digest(text).alias("digest"))

    def contents_of(df: DataFrame) -> DataFrame:
        text = df[text_col].cast("string")
        return df.select(digest(text).alias("digest"), normal(text).alias("content"))

    keyed, contents = keyed_of(docs).withColumn("old", F.lit(False)), contents_of(docs)
    if kept is not None:
        keyed, contents = keyed.unionByName(keyed_of(kept).withColumn("old", F.lit(True))), contents.unionByName(contents_of(kept))
    keyed = cut(keyed.withColumn("row", F.monotonically_increasing_id()), "digests")
    n_rows = keyed.count()
    index = index or Index(docs.sparkSession)
    index.grow(n_rows)
    hits = cut(index.insert(keyed.where("not old")), "hits")
    few = hits.count() <= BROADCAST_ROWS
    hits = F.broadcast(hits) if few else hits
    # The contents behind a digest are compared as a whole; two of them would be a collision of SHA-256.
    same = contents.join(hits, "digest", "left_semi").groupBy("digest", "content").agg(F.count("*").alias("n"))
    same = same.groupBy("digest").agg(F.count("*").alias("contents"), F.max("n").alias("group_size"))
    same = same.select("digest", F.when(F.col("contents") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two contents have one digest"))).alias("group_size"))
    # The longest text stays, then the lowest id; of rows that agree in both one that was live, then the first as read.
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("unnamed"), "id", (~F.col("old")).alias("new"), "row")
    best = keyed.join(hits, "digest", "left_semi").groupBy("digest").agg(F.min(order).alias("best"))
    found = cut(same.join(best, "digest").select("digest", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    hot, rest = found.where(F.col("group_size") * 1000 >= n_rows), found.where(F.col("group_size") * 1000 < n_rows)
    rows = keyed.where("not old")
    out = rows.join(F.broadcast(hot), "digest").unionByName(rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rest, "digest", "left"))
    alone = F.col("group_size").isNull()
    return out.select(F.col("id").alias(id_col), "n_chars", F.col("digest").alias("text_sha256"), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"))


def op12_exact_duplicates(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size, row_number() over w = 1 as kept, sha256(t) as text_sha256
from d window w as (partition by t order by n desc, doc_id)
"""
