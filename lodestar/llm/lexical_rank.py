"""Ranked lexical search of a stated set of items over all documents, by sort-based accumulation.

The documents are read once: what each has of the items' terms, and its length, is a row of a table in the shared folder,
from which Spark counts statistics.  Scores are then summed by ranges of documents: a task takes a block of its rows, puts
together one entry (item, document, impact) for each term that both have, orders the entries by a radix sort of their
packed keys, and sums runs of equal keys.  Of the sums each item keeps a heap of its best over all blocks of the task; the
tasks' heaps meet in two steps, first by parts of the tasks.  Items are taken in blocks of a bounded number of terms.

Defined results: rows of one item id, null among them, are one item with the terms of all its rows; every row of the
documents is a document, also where ids repeat or are null; equal scores go by ascending id, null last, and equal ids in any
order; an item without terms, or with none that a document has, gives no rows; an empty table gives an empty result; other
columns are not read.  Texts are read whole, and every document that has a term of an item is scored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import coded_words, cut, named, small_batches

#: Bytes that no term has become spaces, upper-case letters of ASCII lower-case ones.
SIGNS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Settings:
    best: int = 10
    #: Terms of a block of items, all items' terms counted; a single item may have more.
    block_terms: int = 1 << 16
    #: Entries that a task sorts at a time; a single document with more is taken alone.
    block_entries: int = 1 << 21
    #: Parts in which the tasks' heaps meet first.
    parts: int = 64


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets of the texts, code of every term, distinct terms by code)."""
    texts = texts.cast(pa.string())
    valid, offsets, data = texts.buffers()
    if data is not None:
        data = pa.py_buffer(SIGNS[np.frombuffer(data, np.uint8)])
    return coded_words(pa.Array.from_buffers(pa.string(), len(texts), [valid, offsets, data], offset=texts.offset))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of unsigned keys, digits of 16 bits from the lowest on; each pass is a stable radix sort."""
    order = np.argsort((keys & np.uint64(0xFFFF)).astype(np.uint16), kind="stable")
    for shift in range(16, int(keys.max(initial=0)).bit_length(), 16):
        digit = ((keys >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def summed(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, doc, sum of impacts) of entries, by item and then document."""
    if not len(items):
        return items, docs, impacts
    width = np.uint64(int(docs.max()).bit_length())
    keys = (items.astype(np.uint64) << width) | docs.astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    keys = keys[starts]
    return (keys >> width).astype(np.int64), (keys & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64), np.add.reduceat(impacts[order], starts)


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in the group) of the members of groups of these sizes."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): each item's terms, once."""
    out = T.StructType([T.StructField("item_id", items.schema[id_col].dataType), T.StructField("term", T.StringType())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, codes, words = terms_of(batch.column(1))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), words.take(pa.array(codes))], ["item_id", "term"])

    return items.select(named(id_col), named(text_col).cast("string")).mapInArrow(listed, out).distinct()


def matched_terms(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length, the places of its terms in the vocabulary, and how
    often it has each."""
    small_batches(docs.sparkSession)
    known = pa.array(vocabulary, pa.string())
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType())])
    out = out.add("terms", T.ArrayType(T.IntegerType())).add("tfs", T.ArrayType(T.LongType()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, codes, words = terms_of(batch.column(1))
            place = pc.fill_null(pc.index_in(words, known), -1).to_numpy()[codes] if len(codes) else codes
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            keys, tfs = np.unique((row * (len(known) + 1) + place)[place >= 0], return_counts=True)
            rows, terms = np.divmod(keys, len(known) + 1)
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            n = np.diff(offsets)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.select(named(id_col), named(text_col).cast("string")).mapInArrow(counted, out)


def _impacts(weights: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n: np.ndarray, count: int, length: int) -> np.ndarray:
    """What each entry of a document adds to the score of an item with the term."""
    m = 100 - 90 + (90 * n * count) // length
    return weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m))


class Heaps:
    """The best documents of each item: higher scores first, then smaller ids, a missing id last."""

    def __init__(self, items: int, best: int):
        self.best, self.heaps = best, [[] for _ in range(items)]

    def offer(self, items: np.ndarray, ids: list, scores: np.ndarray) -> None:
        for item, doc, score in zip(items.tolist(), ids, scores.tolist()):
            entry = (score, _Later(doc))
            heap = self.heaps[item]
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            elif heap[0] < entry:
                heapq.heapreplace(heap, entry)

    def least(self) -> np.ndarray:
        """The score that a document has to reach, by item."""
        return np.array([h[0][0] if len(h) == self.best else 1 for h in self.heaps], np.int64)

    def rows(self) -> Iterator[tuple[int, object, int]]:
        return ((item, entry[1].id, entry[0]) for item, heap in enumerate(self.heaps) for entry in heap)


class _Later:
    """An id whose order is turned around, so that of equal scores the smaller id is the better one."""

    __slots__ = ("id",)

    def __init__(self, doc: object):
        self.id = doc

    def __lt__(self, other: _Later) -> bool:
        return other.id is not None and (self.id is None or self.id > other.id)

    def __eq__(self, other: object) -> bool:
        return self.id == other.id


def _best_of(matched: DataFrame, item_type: T.DataType, ids: list, owners: np.ndarray, starts: np.ndarray, weights: np.ndarray, count: int, length: int, settings: Settings) -> DataFrame:
    """(item_id, doc_id, score, part) of each task's best documents of every item; items of term t are owners[starts[t] :
    starts[t + 1]], as places in ids."""
    id_type = matched.schema["doc_id"].dataType
    out = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", id_type), T.StructField("score", T.LongType()), T.StructField("part", T.IntegerType())])
    per_term = np.diff(starts)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(ids), settings.best)
        for batch in batches:
            terms, tfs = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            n = batch.column("n").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("terms").offsets.to_numpy()))
            impacts = _impacts(weights, terms, tfs, n[row], count, length)
            sizes = per_term[terms]
            # Blocks end between documents.
            done = np.cumsum(np.bincount(row, sizes, batch.num_rows).astype(np.int64))
            low = 0
            while low < batch.num_rows:
                before = done[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(done, before + settings.block_entries, "right")))
                held = slice(*np.searchsorted(row, [low, high]))
                entry, place = _spread(sizes[held])
                item, doc, score = summed(owners[starts[terms[held][entry]] + place], row[held][entry] - low, impacts[held][entry])
                if len(item):
                    good = np.flatnonzero(score >= heaps.least()[item])
                    heaps.offer(item[good], batch.column("doc_id").take(pa.array(doc[good] + low)).to_pylist(), score[good])
                low = high
        found = list(heaps.rows())
        kinds = pa.schema([("item_id", ids_type), ("doc_id", doc_type), ("score", pa.int64()), ("part", pa.int32())])
        part = TaskContext.get().partitionId() % settings.parts
        columns = [[ids[i] for i, _, _ in found], [d for _, d, _ in found], [s for _, _, s in found], [part] * len(found)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    ids_type, doc_type = to_arrow_type(item_type), to_arrow_type(id_type)
    return matched.mapInArrow(scored, out)


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents with a score above 0."""
    spark = docs.sparkSession
    wanted = cut(item_terms(items, item_id, item_text), "item_terms")
    blocks = -(-wanted.count() // settings.block_terms)
    item_type, id_type = items.schema[item_id].dataType, docs.schema[doc_id].dataType
    found = []
    for block in range(blocks):
        pairs = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        if not len(pairs):
            continue
        coded = pairs.column("term").combine_chunks().dictionary_encode()
        owner = pairs.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        matched = cut(matched_terms(docs, coded.dictionary.to_pylist(), doc_id, doc_text), "matched")
        count, length = matched.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not count:
            break
        dfs = np.zeros(len(coded.dictionary), np.int64)
        for term, df in matched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect():
            dfs[term] = df
        weights = np.floor(1000 * np.log((2 * count + 2) / (2 * dfs + 1))).astype(np.int64)
        by_term = np.argsort(coded.indices.to_numpy(), kind="stable")
        starts = np.searchsorted(coded.indices.to_numpy()[by_term], np.arange(len(dfs) + 1))
        owners = owner.indices.to_numpy().astype(np.int64)[by_term]
        found.append(_best_of(matched, item_type, owner.dictionary.to_pylist(), owners, starts, weights, count, length, settings))
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())]))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    for keys in (["item_id", "part"], ["item_id"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.best)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
