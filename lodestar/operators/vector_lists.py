"""Approximate vector search: lists of vectors by nearest centroid, probed by list and ranked again exactly.

Centroids come from k-means over a bounded sample.  A list's rows hold 8-bit codes of its vectors with the length of what
the codes lose, so a probe reads a quarter of the bytes and knows how far each of its scores may be off: only rows that can
be among the best of what is probed are looked up and scored in full.  What a search finds is therefore exact over the lists
it probes, and exact altogether if it probes all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.vectors import cosine
from ..sources.scratch import written
from .recall import DIGITS, matrix, neighbours


@dataclass(frozen=True)
class Settings:
    """Bounds of the centroids: their number and the sample they are fitted on go to the driver and to every task."""

    #: The most lists; there are as many as the root of the number of vectors.
    max_lists: int = 4096
    #: Vectors of the sample for each list, and steps of k-means.
    sample: int = 32
    steps: int = 12
    #: Vectors that stand for queries when the number of probes is fitted, and the share of their neighbours to find.
    trials: int = 128
    target: float = 0.95
    #: Rows and queries of one product at most, about.
    rows: int = 1 << 15
    block: int = 1 << 10


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def centroids(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> np.ndarray:
    """Unit centroids by k-means on cosine, of a sample that hashes of the ids choose: the same for the same rows."""
    known = vectors.where(F.col(vector_col).isNotNull())
    lists = min(settings.max_lists, max(1, math.isqrt(known.count())))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(lists * settings.sample).select(vector_col).toArrow()
    _, points = matrix(sample.column(0))
    if not len(points):
        return np.zeros((1, 1))
    points = _unit(points)
    now = points[np.linspace(0, len(points) - 1, lists).astype(int)]
    for _ in range(settings.steps):
        nearest = np.argmax(points @ now.T, axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, nearest, points)
        empty = np.bincount(nearest, minlength=len(now)) == 0
        sums[empty] = now[empty]
        now = _unit(sums)
    return now


def lists(vectors: DataFrame, centers: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(list, id, scale, lost, codes): each vector of unit length by its nearest centroid, as codes of 8 bits.

    A vector is about scale * codes, and ``lost`` is the length of the difference.  Rows without a vector are left out; a
    vector of length 0 has no direction and is in list 0 with codes of 0.
    """
    out = T.StructType([T.StructField("list", T.IntegerType()), T.StructField(id_col, vectors.schema[id_col].dataType)])
    out = out.add("scale", T.DoubleType()).add("lost", T.DoubleType()).add("codes", T.BinaryType())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, points = matrix(batch.column(1))
            if not len(there):
                continue
            points = _unit(points)
            scale = np.abs(points).max(axis=1) / 127
            codes = np.round(np.divide(points, scale[:, None], out=np.zeros_like(points), where=scale[:, None] > 0)).astype(np.int8)
            lost = np.linalg.norm(points - codes * scale[:, None], axis=1)
            near = np.argmax(points @ centers.T, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(near), batch.column(0).take(pa.array(there)), pa.array(scale), pa.array(lost), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", id_col, "scale", "lost", "codes"])

    return vectors.select(id_col, vector_col).mapInArrow(coded, out)


def write_lists(vectors: DataFrame, centers: np.ndarray, path: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The lists as a table sorted by list, in ranges of lists and ids: a probe reads its lists' row groups alone."""
    lists(vectors, centers, id_col, vector_col).repartitionByRange("list", id_col).sortWithinPartitions("list", id_col).write.mode("overwrite").parquet(path)
    return vectors.sparkSession.read.parquet(path)


def probes(queries: DataFrame, centers: np.ndarray, count: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(list, query_id, q): for each query the lists of its nearest centroids, with the query as a unit vector."""
    out = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("query_id", queries.schema[id_col].dataType), T.StructField("q", T.ArrayType(T.DoubleType()))])
    count = min(count, len(centers))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, points = matrix(batch.column(1))
            if not len(there):
                continue
            points = _unit(points)
            near = np.argpartition(-(points @ centers.T), count - 1, axis=1)[:, :count].astype(np.int32)
            rows = np.repeat(np.arange(len(there)), count)
            flat = pa.array(points[rows].ravel())
            q = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, points.shape[1], dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), batch.column(0).take(pa.array(there[rows])), q], ["list", "query_id", "q"])

    return queries.select(id_col, vector_col).mapInArrow(probed, out)


def fitted_probes(listed: DataFrame, centers: np.ndarray, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> int:
    """The least number of lists that hold the target share of the k nearest of some of the vectors, found exactly.  Vectors
    without clusters need many lists, clustered ones few."""
    known = vectors.where(F.col(vector_col).isNotNull())
    trial = known.orderBy(F.xxhash64(F.lit(1), F.col(id_col)), id_col).limit(settings.trials)
    where = listed.select(F.col(id_col).alias("_id"), "list")
    exact = neighbours(vectors, trial, k, "cosine", id_col, vector_col).join(where, F.col(id_col) == F.col("_id")).select("query_id", "list").toArrow()
    rows = trial.select(id_col, vector_col).toArrow()  # so many trials at most
    if not len(exact):
        return 1
    _, points = matrix(rows.column(1))
    order = np.argsort(np.argsort(-(_unit(points) @ centers.T), axis=1), axis=1)
    place = {q: i for i, q in enumerate(rows.column(0).to_pylist())}
    needed = np.sort([order[place[q], c] for q, c in zip(exact["query_id"].to_pylist(), exact["list"].to_pylist())])
    return 1 + int(needed[min(len(needed) - 1, math.ceil(settings.target * len(needed)) - 1)])


def search(
    listed: DataFrame, centers: np.ndarray, vectors: DataFrame, queries: DataFrame, k: int, count: int,
    id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings(),
) -> DataFrame:
    """(query_id, id_col, score, rank): each query's k best by cosine among the rows of its ``count`` nearest lists; ties go
    to the smaller id.

    A long list is dealt to parts, and the queries of a list to blocks; each pair of them is one product in one task, which
    keeps the rows whose score may reach the k-th best there.  These are joined with their vectors and scored in full.
    """
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / settings.rows).cast("int").alias("parts"))
    asked = written(probes(queries, centers, count, id_col, vector_col), "probes")
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / settings.block).cast("int").alias("blocks"))
    both = sizes.join(blocks, "list")  # a row for each list
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    id_type = vectors.schema[id_col].dataType
    none = lambda kind: F.lit(None).cast(kind)
    left = listed.join(both, "list").select("list", deal(id_col, "parts").alias("p"), every("blocks").alias("b"), F.col(id_col).alias("id"), none(queries.schema[id_col].dataType).alias("query_id"), "scale", "lost", "codes", none("array<double>").alias("q"))
    right = asked.join(both, "list").select("list", every("parts").alias("p"), deal("query_id", "blocks").alias("b"), none(id_type).alias("id"), "query_id", none("double").alias("scale"), none("double").alias("lost"), none("binary").alias("codes"), "q")
    out = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField(id_col, id_type), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
    ids_type, asked_type = to_arrow_type(id_type), to_arrow_type(queries.schema[id_col].dataType)

    def near(table: pa.Table) -> pa.Table:
        known, asking = table.filter(table["q"].is_null()), table.filter(table["q"].is_valid())
        rows, cols = [], []
        low = high = np.zeros((0, 0))
        if len(known) and len(asking):
            _, q = matrix(asking["q"])
            codes = np.frombuffer(b"".join(known["codes"].to_pylist()), np.int8).reshape(len(known), -1)
            score = (q @ codes.T.astype(np.float64)) * known["scale"].to_numpy()[None]
            lost = known["lost"].to_numpy()[None] + 10.0**-DIGITS  # what rounding may change counts as lost
            low, high = score - lost, score + lost
            kth = -np.partition(-low, min(k, low.shape[1]) - 1, axis=1)[:, min(k, low.shape[1]) - 1] if low.shape[1] > k else np.full(len(low), -np.inf)
            rows, cols = np.nonzero(high >= kth[:, None])
        return pa.table(
            [asking["query_id"].combine_chunks().take(pa.array(rows, pa.int64())).cast(asked_type), known["id"].combine_chunks().take(pa.array(cols, pa.int64())).cast(ids_type), pa.array(low[rows, cols] if len(rows) else [], pa.float64()), pa.array(high[rows, cols] if len(rows) else [], pa.float64())],
            names=["query_id", id_col, "low", "high"],
        )

    found = written(left.unionByName(right).groupBy("list", "p", "b").applyInArrow(near, out), "candidates")
    # What may be among a query's best of all its lists: not below the k-th of the least scores.
    by_low = Window.partitionBy("query_id").orderBy(F.desc("low"))
    floor = found.withColumn("n", F.row_number().over(by_low)).where(F.col("n") <= k).groupBy("query_id").agg(F.min("low").alias("floor"), F.max("n").alias("n"))
    able = found.join(floor, "query_id").where((F.col("high") >= F.col("floor")) | (F.col("n") < k)).select("query_id", id_col)
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("_q"))
    pairs = able.join(vectors.select(id_col, F.col(vector_col).alias("_v")), id_col).join(q, "query_id")
    scored = pairs.select("query_id", id_col, F.round(cosine(F.col("_v"), F.col("_q")), DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
