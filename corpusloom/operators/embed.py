"""Embeddings: feature hashing by default, any model by plug-in, and a cache joined by text hash."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from .words import split, text_slices, word_table

DIM = 64


def _sums(batches, dim: int, table: np.ndarray):
    """Batches of kept columns and a text in lower case, with the signed sums of each row's buckets as a matrix; rows without tokens go."""
    for b, raw, offsets in text_slices(batches, -1):
        n, found = split(raw, offsets, table)
        b, n = b.filter(pa.array(n > 0)), n[n > 0]
        if not b.num_rows:
            continue
        coded = found.dictionary_encode()
        digests = [hashlib.md5(t.encode()).hexdigest() for t in coded.dictionary.to_pylist()]
        bucket = np.array([int(h[:8], 16) % dim for h in digests])
        sign = np.array([1.0 if int(h[8], 16) % 2 == 0 else -1.0 for h in digests])
        at = coded.indices.to_numpy()
        cell = np.repeat(np.arange(len(n)), n) * dim + bucket[at]
        yield b, np.bincount(cell, sign[at], len(n) * dim).reshape(-1, dim)


def hashed(df: DataFrame, id_col: str, text_col: str, dim: int = DIM, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, embedding array<float>) of each text: signed feature hashing of its tokens, scaled to length 1. A text without tokens is absent; one whose tokens cancel out has a vector of zeros. Each row is hashed for itself, so nothing is shuffled."""
    own = df.select(F.col(id_col).alias("id"), *keep, F.lower(text_col).alias("__t"))
    names, table = ["id", *keep], word_table(df.sparkSession)

    def run(batches):
        for b, sums in _sums(batches, dim, table):
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            v = (sums / np.where(norm > 0, norm, 1)).astype(np.float32)
            offsets = pa.array(np.arange(len(v) + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.ListArray.from_arrays(offsets, pa.array(v.reshape(-1)))], [*names, "embedding"])

    return own.mapInArrow(run, StructType([*(own.schema[c] for c in names), StructField("embedding", ArrayType(FloatType()))]))


def sparse(df: DataFrame, id_col: str, text_col: str, dim: int = DIM) -> DataFrame:
    """(id, bucket, v) of hashed(); a bucket that sums to zero is absent."""
    each = hashed(df, id_col, text_col, dim).select("id", F.posexplode("embedding").alias("bucket", "v"))
    return each.where("v <> 0").select("id", F.col("bucket").cast("long").alias("bucket"), F.col("v").cast("double").alias("v"))


def by_model(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], id_col: str, text_col: str) -> DataFrame:
    """(id, embedding) from a model of one's own: load() is called once a task, what it returns once an Arrow batch."""

    def run(batches):
        embed = load()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(embed([t or "" for t in b.column(1).to_pylist()]), pa.list_(pa.float32()))], ["id", "embedding"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, embedding array<float>")


def with_cache(df: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, key, embedding, cached) of each text and the rows to add to the cache (key, embedding). embed: (id, text) -> (id, embedding); each distinct text that the cache lacks is embedded once."""
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.sha2(text_col, 256).alias("key"))
    missing = own.select("key", "text").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    fresh = embed(missing.select(F.col("key").alias("id"), "text")).withColumnRenamed("id", "key")
    both = cache.select("key", "embedding", F.lit(True).alias("cached")).unionByName(fresh.select("key", "embedding", F.lit(False).alias("cached")))
    return own.select("id", "key").join(both, "key", "left"), fresh


def live(cache: DataFrame, as_of, seconds: int, ts: str = "ts") -> DataFrame:
    """Entries of a cache that have not expired at a time."""
    return cache.where(F.col(ts).cast("timestamp") + F.expr(f"interval {seconds} seconds") > F.lit(as_of).cast("timestamp"))


def cached_answers(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """questions(query_id, project_id, question) with the latest answer to the same question, case and outer spaces aside, of the project."""
    key = F.lower(F.trim("question"))
    latest = cache.groupBy("project_id", key.alias("q")).agg(F.max_by("answer", F.struct("ts", "answer")).alias("answer"))
    return questions.withColumn("q", key).join(latest, ["project_id", "q"], "left").drop("q")


def invalidate(cache: DataFrame, projects: DataFrame) -> DataFrame:
    return cache.join(projects.select("project_id").distinct(), "project_id", "left_anti")
