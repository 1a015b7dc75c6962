"""Embedding models as Arrow functions, and the one that needs no weights."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType


def stub_vector(text: str, dimensions: int = 64) -> np.ndarray:
    """A deterministic vector: SHA-256 of the text and a little-endian counter, bytes as shares of 255 less a half."""
    blocks = -(-dimensions // 32)
    data = b"".join(hashlib.sha256(text.encode() + i.to_bytes(8, "little")).digest() for i in range(blocks))
    return (np.frombuffer(data[:dimensions], np.uint8) / 255.0 - 0.5).astype(np.float32)


class StaticTable:
    """Mean of the tokens' rows of a table, normalised; unknown tokens are left out and no token gives a zero vector."""

    def __init__(self, table: np.ndarray, tokens: Callable[[str], list[int]], unknown: int = -1):
        self.table, self.tokens, self.unknown = table, tokens, unknown

    def __call__(self, text: str) -> np.ndarray:
        ids = [i for i in self.tokens(text) if i != self.unknown]
        if not ids:
            return np.zeros(self.table.shape[1], np.float32)
        mean = self.table[ids].mean(0)
        length = float(np.linalg.norm(mean))
        return (mean / length if length else mean).astype(np.float32)


def embed(
    df: DataFrame, text_col: str, model: Callable[[str], np.ndarray], dimensions: int, out_col: str = "embedding", failure_col: str | None = None
) -> DataFrame:
    """df with the vectors of a text column; a model that returns another size, or no finite numbers, is an error.

    With failure_col, a column of df, a text that the model fails on has no vector and the reason there.
    """
    at = df.columns.index(text_col)
    schema = type(df.schema)([*df.schema.fields]).add(out_col, ArrayType(FloatType()))
    failed_at = df.columns.index(failure_col) if failure_col else None

    def vector(text: str) -> np.ndarray:
        v = model(text)
        if len(v) != dimensions or not np.isfinite(v).all():
            raise ValueError("the model gave no vector of its dimensions")
        return v

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, columns = [], list(batch.columns)
            failures = columns[failed_at].to_pylist() if failed_at is not None else []
            for i, t in enumerate(columns[at].to_pylist()):
                try:
                    vectors.append(None if t is None else vector(t))
                except Exception as error:  # whatever a model raises
                    if failed_at is None:
                        raise
                    vectors.append(None)
                    failures[i] = f"{type(error).__name__}: {error}"[:500]
            if failed_at is not None:
                columns[failed_at] = pa.array(failures, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.list_(pa.float32()))], [*batch.schema.names, out_col])

    return df.mapInArrow(made, schema)
