"""Column functions on vectors, exact and in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def normalised(a: Column) -> Column:
    """a over its length; a zero vector stays."""
    return F.when(norm(a) == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a)))


def mean_vector(df, keys: list[str], vector_col: str, dimensions: int):
    """Mean pooling: the mean of each group's vectors, summed by place, so that groups are never gathered."""
    sums = [F.avg(F.col(vector_col)[i].cast("double")).alias(f"_{i}") for i in range(dimensions)]
    return df.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"_{i}") for i in range(dimensions)]).alias(vector_col))
