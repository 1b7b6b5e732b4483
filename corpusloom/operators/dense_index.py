"""An inverted-file index for dense search: vectors in cells, in blocks that are compared with many queries at once.

Cells are the nearest of a bounded number of centroids, fitted on a bounded sample; every vector is indexed. A project's
vectors of one cell lie in blocks of about BLOCK vectors, so the number of blocks follows the size of the project and no
key is held by one task. A query visits its nearest cells; how many is set by calibrate(), which asks exact search
for the neighbours of a bounded set of vectors and takes as many cells as hold the wanted share of them. Candidates
of each block are scored as products of matrices in single precision, and those that lead are scored again exactly, as
`retrieve.dense` does. Null vectors and those of length 0 are never found; an empty index finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .retrieve import dense, dot, top
from .retrieve import directed as usable

#: Centroids at most, and vectors that they are fitted on at most.
MOST_CELLS, SAMPLE, ROUNDS = 4096, 20_000, 8
#: Vectors of a block and queries of a group, about.
BLOCK, GROUP = 512, 512
#: Vectors whose exact neighbours set the number of cells that a query visits, and the share of neighbours to find.
CALIBRATION, SHARE = 200, 0.95
#: Places that scores in single precision are told apart by, and candidates that go on for each that is wanted.
PLACES, ROOM = 5, 3


@dataclass
class DenseIndex:
    blocks: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    probes: int


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of unit vectors."""
    n = len(column)
    if not n:
        return np.zeros((0, 1), np.float32)
    m = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)
    return (m / np.sqrt((m * m).sum(axis=1, keepdims=True))).astype(np.float32)


def fit(vectors: DataFrame, n: int) -> np.ndarray:
    """Centroids of unit length: k-means by angle on at most SAMPLE vectors, those with the least hashes of their ids."""
    some = vectors.select("embedding", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    x = _matrix(some)
    k = int(min(MOST_CELLS, 4 * n**0.5, len(x)))
    centroids = x[:k].copy()
    for _ in range(ROUNDS if len(x) > k else 0):
        own = np.concatenate([(x[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centroids[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centroids


def _kinds(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def build(vectors: DataFrame, probes: int | None = None, k: int = 10) -> DenseIndex:
    """Index of vectors (chunk_id, project_id, embedding); probes as given or, for the best k of a query, as calibrated."""
    own = usable(vectors.select("chunk_id", "project_id", "embedding"), "embedding")
    n = own.count()
    centroids = fit(own, n)

    def assign(batches):
        for b in batches:
            x = _matrix(b.column(2))
            cell = (x @ centroids.T).argmax(axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array([r.tobytes() for r in x], pa.binary())], ["chunk_id", "project_id", "cell", "unit"])

    assigned = cut(own.mapInArrow(assign, f"{_kinds(own, 'chunk_id', 'project_id')}, cell int, unit binary"), "cells")
    sizes = cut(assigned.groupBy("project_id", "cell").agg(F.count("*").alias("n")), "cell-sizes")
    placed = assigned.join(sizes, ["project_id", "cell"]).withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    blocks = placed.groupBy("project_id", "cell", "block").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "unit"))).alias("rows"))
    blocks = cut(blocks.select("project_id", "cell", "block", F.col("rows.chunk_id").alias("ids"), F.col("rows.unit").alias("units")), "dense-blocks")
    index = DenseIndex(blocks, sizes, centroids, probes or len(centroids))
    if probes is None and n:
        index.probes = calibrate(index, own, k)
    return index


def nearest(index: DenseIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, project_id, cell, unit, place) of the cells nearest to each query (query_id, project_id, q)."""
    centroids, probes = index.centroids, max(1, min(probes, len(index.centroids)))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows if len(centroids) else 0, 512):
                part = b.slice(lo, 512)
                x = _matrix(part.column(2))
                cells = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                who = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                units = pa.array([r.tobytes() for r in x], pa.binary())
                place = np.tile(np.arange(cells.shape[1], dtype=np.int32), len(x))
                yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), pa.array(cells.reshape(-1)), units.take(who), pa.array(place)], ["query_id", "project_id", "cell", "unit", "place"])

    own = usable(queries.select("query_id", "project_id", "q"), "q")
    return own.mapInArrow(run, f"{_kinds(own, 'query_id', 'project_id')}, cell int, unit binary, place int")


def calibrate(index: DenseIndex, vectors: DataFrame, k: int, share: float = SHARE) -> int:
    """Cells a query must visit so that share of the exact best k of some vectors (other than themselves) lie in them."""
    asked = vectors.select("chunk_id", F.xxhash64("chunk_id", F.lit(1)).alias("h"), "project_id", "embedding").orderBy("h").limit(CALIBRATION)
    asked = cut(asked.select(F.col("chunk_id").alias("query_id"), "project_id", F.col("embedding").alias("q")), "calibration")
    true = dense(asked, vectors, k, -1.0, others=True).select("query_id", "chunk_id")
    cells = index.blocks.select("cell", F.explode("ids").alias("chunk_id"))
    places = nearest(index, asked, len(index.centroids)).select("query_id", "cell", "place")
    found = true.join(cells, "chunk_id").join(places, ["query_id", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # a row a cell at most
    total, seen = sum(r["n"] for r in found), 0
    for r in found:
        seen += r["n"]
        if seen >= share * total:
            return r["place"] + 1
    return len(index.centroids)


def search(queries: DataFrame, vectors: DataFrame, index: DenseIndex, k: int, threshold: float = 0.5, probes: int | None = None) -> DataFrame:
    """As `retrieve.dense`, over the cells that each query visits: query_id, chunk_id, score, method, rank."""
    asked = nearest(index, queries, probes or index.probes).drop("place")
    # Only cells that hold vectors of the project are visited; queries of a cell go in groups of bounded size.
    crowds = asked.groupBy("project_id", "cell").agg(F.count("*").alias("c")).join(index.sizes.select("project_id", "cell"), ["project_id", "cell"])
    asked = asked.join(crowds, ["project_id", "cell"]).withColumn("g", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("c") / GROUP)).cast("int"))
    groups = asked.groupBy("project_id", "cell", "g").agg(F.collect_list(F.struct("query_id", "unit")).alias("asked"))
    most = ROOM * k
    pairs = groups.join(index.blocks, ["project_id", "cell"]).select(F.col("asked.query_id").alias("qs"), F.col("asked.unit").alias("q"), "ids", "units")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                qs, ids = b.column(0).slice(i, 1).flatten(), b.column(2).slice(i, 1).flatten()
                q, v = (np.frombuffer(b"".join(b.column(c).slice(i, 1).flatten().to_pylist()), np.float32).reshape(len(x), -1) for c, x in ((1, qs), (3, ids)))
                near = np.round((q @ v.T).astype(np.float64), PLACES)
                first = np.argsort(-near, axis=1, kind="stable")[:, :most]  # ids ascend in a block, so ties go to the lowest
                score = np.take_along_axis(near, first, axis=1)
                row, col = np.nonzero(score >= threshold - 10**-PLACES)
                if len(row):
                    yield pa.RecordBatch.from_arrays([qs.take(pa.array(row)), ids.take(pa.array(first[row, col])), pa.array(score[row, col])], ["query_id", "chunk_id", "near"])

    kinds = f"{_kinds(asked, 'query_id')}, {_kinds(vectors, 'chunk_id')}, near double"
    near = pairs.mapInArrow(run, kinds)
    lead = top(near, most, by="near").select("query_id", "chunk_id")
    own = queries.select("query_id", "q").withColumn("qn", F.sqrt(dot(F.col("q"), F.col("q"))))
    exact = vectors.select("chunk_id", "embedding").join(lead, "chunk_id").join(own, "query_id")
    score = F.round(dot(F.col("q"), F.col("embedding")) / (F.col("qn") * F.sqrt(dot(F.col("embedding"), F.col("embedding")))), 6)
    return top(exact.select("query_id", "chunk_id", score.alias("score")).where(F.col("score") >= threshold), k).withColumn("method", F.lit("dense"))


def recall(hits: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, expected, found, recall): how many of the exact hits of each query are among others. A hit that only ties with the last exact one counts."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("expected"))
    reached = hits.join(last, "query_id").where(F.col("score") >= F.col("last")).groupBy("query_id").agg(F.count("*").alias("found"))
    out = last.join(reached, "query_id", "left").select("query_id", "expected", F.least("expected", F.coalesce("found", F.lit(0))).alias("found"))
    return out.withColumn("recall", F.round(F.col("found") / F.col("expected"), 6))
