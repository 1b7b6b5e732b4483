"""Helpers that the training-data operators share: table access, lineage cuts, and vectorised word hashing."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised helpers look at in one go; a longer text forms a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster. Where none is set, a local session makes one for itself; on a cluster that is an error, as each machine would write to its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-loom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, so a lost executor repeats nothing before it."""
    path = f"{scratch(df.sparkSession)}/loom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list, name: str) -> DataFrame:
    """df sorted as a whole and written, with seq: ascending in the order, its high bits (from 33 on) the part of the sort and the low ones the place in it. Equal rows go to any of two parts."""
    tie = F.monotonically_increasing_id().alias("__tie")
    rows = df.select("*", tie)
    rows = rows.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    return cut(rows.withColumn("seq", F.monotonically_increasing_id()), name)


def held_out(doc_id):
    """The fold that contracts keep from learners: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of an ASCII text: it has no such function, so the bits of the polynomial are folded in byte by byte."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    return f"case when {text} is not null then xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen({text}) + 1), lambda i: ascii(({text})[i])::bigint)), lambda c, b: {bits}), 4294967295) end"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and len+1 offsets of an Arrow string column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges whose texts together stay within limit bytes (one row at least)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a span that are hashed eight at a time; longer spans go to a cryptographic hash.
LANES = 128
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def byte_table(separators: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is separator, byte that stands for it) of each byte, for word_hashes; fold: A-Z count as a-z."""
    is_sep = np.zeros(256, bool)
    is_sep[list(separators)] = True
    same = np.arange(256, dtype=np.uint8)
    if fold:
        same[65:91] = same[97:123]
    return is_sep, same


#: Space and the control characters from tab to carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row: (row, start byte, end byte). Separators are ASCII bytes, so the bytes decide as code points would."""
    if not len(raw):
        return (np.empty(0, np.int64),) * 3
    word = ~is_sep[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lookup) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word."""
    is_sep, same = lookup
    row, starts, ends = word_spans(raw, offsets, is_sep)
    return row, span_hashes(same[raw], starts, ends)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[starts[i]:ends[i]]. Each step is one-to-one in the eight bytes that it takes in, so spans of one length up to eight never collide; no sum over positions is involved that patterned texts could cancel out."""
    length = ends - starts
    h = mix(length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(0x9E3779B97F4A7C15))
    padded, eight = np.concatenate((raw, np.zeros(8, np.uint8))), np.arange(8)
    which, at, left = np.arange(len(starts)), starts, length
    short = length <= LANES
    if not short.all():
        for i in np.flatnonzero(~short):
            h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
        which, at, left = which[short], at[short], left[short]
    while len(which):
        x = padded[at[:, None] + eight].view("<u8")[:, 0] & _MASK[np.minimum(left, 8)]
        h[which] = mix(h[which] ^ x)
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    return h
