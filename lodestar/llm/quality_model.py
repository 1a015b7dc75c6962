"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A document is a bag of terms: its words, their shapes (runs of upper case, lower case, digits and other signs), and the
shapes again inside repetitions.  Terms are hashed into a fixed number of bins and weighted by inverse document
frequency; the singular vectors of the labelled sample give the latent space.  The labelled vectors are broadcast, and
every document gets its exact cosine with each of them, block by block; its nearest ones vote with their similarity.

Only the fit is bounded: at most ``Settings.sample`` labelled rows of either class, those with the smallest hash of the
id, are learned from.  Scoring covers every row and whole texts.  The vote counts the two classes as equally frequent.

Defined results: a null text is an empty one and gets a score like any other; without labelled rows every score is 0.5;
labelled rows without quality, and ids with labels that
differ, are not learned from; of an id's texts that with the smallest hash is; repeated rows are each scored alike; an empty table gives an empty
result; of the input only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import crc_of_id, id_crc, named, small_batches

#: Bytes of a word's shape: A for upper case, a for lower case and beyond ASCII, 0 for digits, itself otherwise.
_SHAPE = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)


@dataclass(frozen=True)
class Settings:
    bins: int = 1024
    dimensions: int = 48
    #: Labelled rows of each class that the model learns from, at most.
    sample: int = 2048
    neighbours: int = 25
    #: The score from which a document is taken for good.
    threshold: float = 0.7
    #: Words that a worker keeps the bins of, at most; beyond it, it starts anew.
    known_words: int = 400_000


class _Bins(dict):
    """Bins of a word and of its shape, word * bins + shape, by the word's bytes."""

    def __init__(self, settings: Settings):
        super().__init__()
        self.settings = settings

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.settings.known_words:
            self.clear()
        half = self.settings.bins // 2
        shape = zlib.crc32(_RUN.sub(rb"\1", word.translate(_SHAPE))[:12]) % half
        found = (half + zlib.crc32(word.lower()) % half) * self.settings.bins + shape
        self[word] = found
        return found


def bag(text: str | None, bins: _Bins) -> np.ndarray:
    """Counts of the terms of a whole text by bin."""
    size = bins.settings.bins
    words = text.encode("utf-8").split() if text else []
    counts = np.zeros(size, np.float32)
    if not words:
        return counts
    codes = np.fromiter(map(bins.__getitem__, words), np.int64, len(words))
    counts += np.bincount(codes // size, minlength=size)
    counts += np.bincount(codes % size, minlength=size)
    # What stands again one to three words later or in a window of five that came before is a term of its own kind.
    again = sum(int((codes[k:] == codes[:-k]).sum()) for k in (1, 2, 3)) if len(codes) > 3 else 0
    if len(codes) > 5:
        windows = codes[:-4].astype(np.uint64)
        for k in range(1, 5):
            windows = windows * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - 4 + k].astype(np.uint64)
        windows.sort()
        counts[1] += 2 * int((windows[1:] == windows[:-1]).sum())
    counts[0] += 2 * again
    return counts


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors, a row for each row of counts, in the latent space; zero for no terms."""
        shares = counts / np.maximum(1.0, counts.sum(1, keepdims=True))
        at = (np.sqrt(shares) * self.weights) @ self.axes
        return (at / np.maximum(1e-9, np.linalg.norm(at, axis=1, keepdims=True))).astype(np.float32)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Vote of the nearest labelled vectors, each with its similarity, both classes counting as equally frequent."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.place(counts) @ self.vectors.T
        k = min(self.settings.neighbours, len(self.labels))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        force = np.maximum(0.0, np.take_along_axis(near, best, 1).astype(np.float64)) ** 4 + 1e-9
        good = self.labels[best] == 1
        share = max(1e-9, min(1 - 1e-9, float((self.labels == 1).mean())))
        force *= np.where(good, 0.5 / share, 0.5 / (1 - share))
        return np.clip((force * good).sum(1) / force.sum(1), 0.0, 1.0)


def fit_counts(counts: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """Model of labelled bags of terms: inverse document frequencies, singular vectors and the placed rows."""
    seen = (counts > 0).sum(0)
    weights = np.log((1.0 + len(counts)) / (1.0 + seen)).astype(np.float32) + 0.1
    model = Model(settings, weights, np.eye(settings.bins, settings.dimensions, dtype=np.float32), counts[:0], labels)
    if len(labels):
        shares = counts / np.maximum(1.0, counts.sum(1, keepdims=True))
        rows = np.sqrt(shares) * weights
        values, axes = np.linalg.eigh((rows.T @ rows).astype(np.float64))
        model.axes = axes[:, ::-1][:, : settings.dimensions].astype(np.float32)
        model.vectors = model.place(counts)
    return model


def learnable(id_col: str = "doc_id", folds: int = 4, held_out: int = 2) -> Column:
    """Whether a row may be learned from: its id's crc32 isn't in the held-out fold."""
    return id_crc(id_col) % folds != held_out


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    settings: Settings = Settings(), usable: Column | None = None,
) -> Model:
    """Model of a bounded sample of labelled rows: of each class the ``sample`` smallest by a hash of the id."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(learnable(id_col) if usable is None else usable).where(named(id_col).isNotNull() & named(label_col).isNotNull())
    label = named(label_col).cast("int")
    known = known.groupBy(named(id_col).alias("id")).agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").drop("other")
    order = F.xxhash64("id"), F.col("id")
    parts = [known.where(F.col("label") == c).orderBy(*order).limit(settings.sample) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # 2 * sample rows at most
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = _Bins(settings)
        for batch in batches:
            found = [bag(t, bins) for t in batch.column(2).to_pylist()]
            columns = [pa.array([np.flatnonzero(x) for x in found], pa.list_(pa.int32()))]
            columns += [pa.array([x[np.flatnonzero(x)] for x in found], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "label", "at", "n"])

    found = rows.mapInArrow(bags, T.StructType([*rows.schema.fields[:2], T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.FloatType()))]))
    found = found.toArrow().sort_by("id")  # 2 * sample rows at most
    counts = np.zeros((len(found), settings.bins), np.float32)
    for i, (at, n) in enumerate(zip(found["at"].to_pylist(), found["n"].to_pylist())):
        counts[i, at] = n
    return fit_counts(counts, found["label"].to_numpy().astype(np.int64), settings)


def _scorer(spark, model: Model):
    shared = spark.sparkContext.broadcast(model)

    def scores(texts: list[str | None], state: dict) -> np.ndarray:
        m = shared.value
        bins = state.setdefault("bins", _Bins(m.settings))
        counts = np.array([bag(t, bins) for t in texts], np.float32).reshape(len(texts), m.settings.bins)
        return m.scores(counts)

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row."""
    small_batches(docs.sparkSession)
    scores, threshold = _scorer(docs.sparkSession, model), model.settings.threshold
    rows = docs.select(named(id_col), named(text_col).cast("string").alias("_text"))
    names = [id_col, "held_out", "score", "predicted"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            got = scores(batch.column(1).to_pylist(), state)
            held = [crc_of_id(i) % folds == held_out for i in batch.column(0).to_pylist()]
            columns = [batch.column(0), pa.array(held, pa.bool_()), pa.array(got, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((got >= threshold).astype(np.int32))], names)

    kinds = [T.BooleanType(), T.DoubleType(), T.IntegerType()]
    return rows.mapInArrow(scored, T.StructType([rows.schema[id_col], *map(T.StructField, names[1:], kinds)]))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model takes for good, with the columns of docs, in one pass."""
    small_batches(docs.sparkSession)
    scores, threshold, at = _scorer(docs.sparkSession, model), model.settings.threshold, docs.columns.index(text_col)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist(), state) >= threshold))

    return docs.mapInArrow(good, docs.schema)
