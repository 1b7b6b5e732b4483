"""Words of whole columns in numpy: the splits that `functions.text.tokens` gives, without a string object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD

#: Bytes of text that are split at once, about; a longer text is split alone.
HELD = 1 << 23
POINTS = 0x110000
_TABLES: dict = {}


def word_table(spark: SparkSession) -> np.ndarray:
    """A bit for each code point that Spark's own pattern takes for a part of a word, made once in a session."""
    key = spark.sparkContext.applicationId
    if key not in _TABLES:
        step, found = 4096, np.zeros(POINTS, bool)
        rows = [("".join(chr(c) for c in range(lo, lo + step) if not 0xD800 <= c < 0xE000),) for lo in range(0, POINTS, step)]
        for r in spark.createDataFrame(rows, "c string").select(F.array_join(F.regexp_extract_all("c", F.lit(WORD), F.lit(0)), "").alias("c")).collect():  # all code points, once
            found[[ord(c) for c in r["c"]]] = True
        _TABLES[key] = np.packbits(found)
    return _TABLES[key]


def text_slices(batches, column: int, held: int = HELD):
    """Arrow batches in slices of about held bytes of a text column: (slice, its bytes, its len+1 offsets). A null is an empty text."""
    for b in batches:
        texts = b.column(column % b.num_columns).cast(pa.large_string())
        _, offsets, data = texts.buffers()
        if not b.num_rows:
            continue
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw, lo = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), 0
        while lo < b.num_rows:
            hi = min(b.num_rows, max(lo + 1, int(np.searchsorted(at, at[lo] + held, "right")) - 1))
            yield b.slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def is_word(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 texts belongs to a word; table: what word_table gives."""
    points = np.unpackbits(table).astype(bool)
    out = points[raw & 0x7F] & (raw < 0x80)
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        size = 2 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0)
        padded = np.concatenate((raw, np.zeros(3, np.uint8)))
        point = raw[lead].astype(np.int64) & (0x7F >> size)
        for j in range(1, 4):
            more = size > j
            point[more] = (point[more] << 6) | (padded[lead[more] + j] & 0x3F)
        ok = points[np.minimum(point, POINTS - 1)]
        for j in range(4):
            at = lead[ok & (size > j)] + j
            out[at[at < len(raw)]] = True
    return out


def split(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """(number of words of each text, all words in order) of texts in lower case."""
    word = is_word(raw, table)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    n = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(offsets) - 1)
    at = np.concatenate(([0], np.cumsum(ends - starts)))
    return n, pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[word])))
