"""Token-id files in Simple-8b: word-aligned coding of ids, written and read back by Spark.

A 64-bit word holds a selector in its top four bits and 60 bits of payload. Selectors 1 to 14 say how many ids
of how many bits follow; selector 0 is the escape: its payload is a place in the row's list of ids that need
more than 60 bits. Ids are cut into blocks of BLOCK; each block begins a new word and its word offset is kept, so
blocks are packed side by side and all words of one selector are decoded in one step.

A file row holds whole documents (about ROW_BYTES of text, or one longer document): their ids and counts, the
words, the block offsets, the escapes, and the number of ids before it in its part. Parts follow the ascending
order of the documents. The files are Parquet with binary columns, so any store that Spark reads will do.

Null and empty texts have only the end id; repeated rows and equal ids stay, each with its own ids; null document
ids come first; an empty table gives an empty file; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, encoded_blocks
from .common import scratch, table, tokenizer_path

BLOCK = 128
ROW_BYTES = 4 << 20
#: Ids in a word and the bits of each, by selector from 1 on.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_COUNT = np.array([1] + [c for c, _ in PACKINGS], np.int64)


def _bits(v: np.ndarray) -> np.ndarray:
    """Bits that each value needs, one at least; past 2^53 it may say one too many, but never over 60 for what 60 bits hold."""
    return np.clip((v.astype(np.float64).view(np.int64) >> 52) - 1022, 1, 60).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(words, word offset of each block, escapes) of unsigned 64-bit ids, all as little-endian bytes."""
    v = np.ascontiguousarray(ids, "<u8")
    n = len(v)
    wide = v >= np.uint64(1 << 60)
    escapes = v[wide]
    v = v.copy()
    v[wide] = np.arange(len(escapes), dtype=np.uint64)
    need = _bits(v)
    need[wide] = 61
    k = -(-n // BLOCK)
    width = BLOCK + 60
    grid, bits = np.zeros((k, width), np.uint64), np.zeros((k, width), np.uint8)
    pad = np.zeros(k * BLOCK, np.uint64)
    pad[:n] = v
    grid[:, :BLOCK] = pad.reshape(k, BLOCK)
    pad8 = np.zeros(k * BLOCK, np.uint8)
    pad8[:n] = need
    bits[:, :BLOCK] = pad8.reshape(k, BLOCK)
    flat, fbits = grid.reshape(-1), bits.reshape(-1)
    length = np.minimum(BLOCK, n - np.arange(k) * BLOCK)
    at, live = np.zeros(k, np.int64), np.arange(k)
    starts, kinds, owners = [], [], []
    reach = np.arange(60)
    while len(live):
        p = live * width + at[live]
        most, who, q = fbits[p], np.arange(len(live)), p
        kind = np.where(most <= 60, len(PACKINGS), 0)
        have = 1
        for s in range(len(PACKINGS) - 1, 0, -1):
            c, b = PACKINGS[s - 1]
            for j in range(have, c):
                most = np.maximum(most, fbits[q + j])
            have, fits = c, most <= b
            most, who, q = most[fits], who[fits], q[fits]
            if not len(who):
                break
            kind[who] = s
        starts.append(p)
        kinds.append(kind)
        owners.append(live)
        at[live] += _COUNT[kind]
        live = live[at[live] < length[live]]
    start, kind, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, kinds, owners))
    order = np.argsort(owner, kind="stable")
    start, kind, owner = start[order], kind[order], owner[order]
    words = kind.astype(np.uint64) << np.uint64(60)
    for s, (c, b) in enumerate([(1, 60), *PACKINGS]):
        at_s = np.flatnonzero(kind == s)
        if len(at_s):
            got = flat[start[at_s][:, None] + reach[:c]] << (np.arange(c, dtype=np.uint64) * np.uint64(b))
            words[at_s] |= np.bitwise_or.reduce(got, axis=1)
    return words.astype("<u8").tobytes(), np.searchsorted(owner, np.arange(k)).astype("<u4").tobytes(), escapes.astype("<u8").tobytes()


def unpack(words: bytes, offsets: bytes, escapes: bytes, n: int) -> np.ndarray:
    """The n ids that pack() was given."""
    w, first, wide = np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4").astype(np.int64), np.frombuffer(escapes, "<u8")
    out = np.zeros(len(first) * BLOCK + 60, np.uint64)
    kind = (w >> np.uint64(60)).astype(np.int64)
    low = w & np.uint64((1 << 60) - 1)
    owner = np.searchsorted(first, np.arange(len(w)), "right") - 1
    before = np.concatenate(([0], np.cumsum(_COUNT[kind])))[:-1]
    local = before - before[first][owner] if len(w) else before
    for s, (c, b) in enumerate([(1, 60), *PACKINGS]):
        at_s = np.flatnonzero(kind == s)
        if len(at_s):
            got = (low[at_s][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(b))) & np.uint64((1 << b) - 1)
            place = local[at_s][:, None] + np.arange(c)
            keep = place < BLOCK
            out[(owner[at_s][:, None] * BLOCK + place)[keep]] = wide[got[keep].astype(np.int64)] if s == 0 else got[keep]
    return out[:n]


SCHEMA = "part int, before long, doc_ids array<long>, counts array<long>, n long, words binary, offsets binary, escapes binary"


def write(docs: DataFrame, folder: str, path: str | None = None, pattern: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, adds end_id to each and writes the files of all documents in ascending order of id_col."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def run(batches):
        enc, _ = codec(path, pattern)
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo, hi, _, _, ids, to in encoded_blocks(b.column(1), enc, ROW_BYTES):
                counts = np.diff(to) + 1
                v = np.insert(ids, to[1:], end_id)
                row = [part, before, b.column(0).slice(lo, hi - lo).to_pylist(), counts, len(v), *pack(v)]
                before += len(v)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "before", "doc_ids", "counts", "n", "words", "offsets", "escapes"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(run, SCHEMA).write.parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files; start counts the ids of all documents before it."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    # One row for each part: as many as the write had tasks, which bounds the broadcast.
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.expr("sum(n) over (order by part) - n").alias("base"))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = unpack(row["words"], row["offsets"], row["escapes"], row["n"]).astype("<u4")
                ends = np.cumsum(row["counts"])
                starts = ends - row["counts"]
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row["doc_ids"], starts + row["before"] + row["base"], row["counts"], crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(F.broadcast(parts), "part").select("base", "before", "doc_ids", "counts", "n", "words", "offsets", "escapes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/loom/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder)
