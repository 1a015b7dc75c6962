"""Near duplicates by SimHash and deletion-variant signatures.

A fingerprint has 64 bits; bit b is 1 if more than half of the text's shingle hashes have it.  Two fingerprints link at
``max_distance`` differing bits or fewer.  Cut into s = max_distance // 2 + 1 segments, one segment of a linked pair
differs by at most one bit, so each fingerprint is indexed under every segment as it is and under every variant of a
segment with one bit made a wildcard; linked pairs meet in an equality join on those signatures and are then verified.
A wildcard's signatures only meet between the fingerprints with the bit unset and those with it set, and a pair counts
only in the first segment that allows it, so that every link is found exactly once and no bucket gives all its pairs.

Only distinct fingerprints are indexed: however many copies a text has, they are one node.  Components come from
alternating large-star and small-star rounds over the links, so no group is ever gathered in one task.

Defined results: a null or empty text has fingerprint 0 and links like any other; a text of fewer words than a shingle
is one shingle; repeated rows are returned as often as they came, all with the same component; a null id is never the
smallest id, and the component of rows without any id is null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut, named, row_keys, rows_but, small_batches

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2
#: Hashes whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text, with A-Z lower-cased, as an unsigned 64-bit number."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1
        ends = (starts + sizes)[shingle - 1 :].tolist()
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _with_fingerprints(rows: DataFrame) -> DataFrame:
    """rows with fp in place of their last column, the text."""
    small_batches(rows.sparkSession)
    schema = T.StructType(rows.schema.fields[:-1]).add("fp", "long")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.columns[-1].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], schema.names)

    return rows.mapInArrow(made, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint's bits as a signed long."""
    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text"))
    return _with_fingerprints(rows)


def _segments(max_distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    n = max_distance // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _bits(value: int) -> Column:
    """64 bits as a signed long."""
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def _part(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(_bits((1 << width) - 1))


def signatures(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(key, side, fp): side 2 for a segment as it is, else the value of the bit that is a wildcard in the key."""
    fp, made = F.col("fp"), []
    for j, (low, width) in enumerate(_segments(max_distance)):
        part = _part(fp, low, width)
        if 2 * j <= max_distance:
            made.append(F.struct(F.xxhash64(F.lit(j), F.lit(-1), part).alias("key"), F.lit(2).alias("side")))
        if 2 * j + 1 <= max_distance:
            for p in range(width):
                rest = part.bitwiseAND(_bits(((1 << width) - 1) & ~(1 << p)))
                bit = F.shiftrightunsigned(part, p).bitwiseAND(F.lit(1).cast("long")).cast("int")
                made.append(F.struct(F.xxhash64(F.lit(j), F.lit(p), rest).alias("key"), bit.alias("side")))
    return nodes.select("fp", F.inline(F.array(*made)))


def links(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b), each linked pair of distinct fingerprints once.  The verification tells how many bits of a segment differ,
    and so in which single signature the pair has to be counted."""
    signed = signatures(nodes, max_distance)
    left = signed.where("side <> 1").select("key", F.col("side").alias("s"), F.col("fp").alias("a"))
    right = signed.where("side <> 0").select("key", F.col("side").alias("t"), F.col("fp").alias("b"))
    apart = F.col("a").bitwiseXOR(F.col("b"))
    here = F.when(F.col("s") == 2, 0).otherwise(1)
    first = F.lit(None).cast("int")
    for j, (low, width) in reversed(list(enumerate(_segments(max_distance)))):
        differ = F.bit_count(_part(apart, low, width))
        first = F.when(differ <= 1, F.when(differ == here, F.xxhash64(F.lit(j), *_key_tail(j, low, width, max_distance)))).otherwise(first)
    verified = (F.bit_count(apart) <= max_distance) & (first == F.col("key"))
    ordered = F.when(F.col("s") == 2, F.col("a") < F.col("b")).otherwise(F.lit(True))
    joined = left.join(right, "key").where((F.col("s") == 2) == (F.col("t") == 2)).where(ordered & verified)
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _key_tail(j: int, low: int, width: int, max_distance: int) -> list[Column]:
    """The arguments after j of the key under which a pair that first agrees in segment j is counted."""
    a, b = F.col("a"), F.col("b")
    part_a, part_b = _part(a, low, width), _part(b, low, width)
    differ = part_a.bitwiseXOR(part_b)
    place = F.when(differ == 0, F.lit(-1)).when(differ < 0, F.lit(63)).otherwise(F.bit_count(differ - 1)).cast("int")
    return [place, part_a.bitwiseAND(part_b)]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the edges (a, b).

    Alternates large-star and small-star; every round is a few aggregations and joins on the node, checkpointed.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        # Large star: every larger neighbour of u hangs on the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours hang on the smallest of these.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _components_of(marked: DataFrame, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """((fp, least, root) of every fingerprint of (id, fp), the links)."""
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("least")))
    edges = cut(links(nodes, max_distance))
    roots = components(edges)
    known = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return known.withColumn("root", F.coalesce("root", "fp")), edges


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """(id_col, fingerprint, component_id, n_links) of every row: the fingerprint in 16 hex digits, the smallest id that
    links lead to, and the number of other fingerprints that this one links to."""
    marked = cut(fingerprints(docs, id_col, text_col))
    known, edges = _components_of(marked, max_distance)
    degree = edges.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    lowest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = cut(known.join(lowest, "root").join(degree, "fp", "left").select("fp", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(placed, "fp").select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each component of docs, with the columns of docs: that with the smallest id, null ids last, of equal ids
    that with the smallest hash of the row.  Rows that repeat an id, or have none, are rows like others, and of equal rows
    one stays."""
    k1, k2 = row_keys(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    marked = cut(_with_fingerprints(rows))
    roots = _components_of(marked.select("fp", F.col("id").cast("long").alias("id")), max_distance)[0]
    equal = marked.join(roots, "fp").groupBy("root", "k1", "k2", "id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2")
    one = equal.groupBy("root").agg(F.min_by(F.struct("k1", "k2"), order).alias("r"))
    stays = (F.col("k1") == F.col("r.k1")) & (F.col("k2") == F.col("r.k2"))
    gone = equal.join(one, "root").select("k1", "k2", stays.alias("one"), "n").where("n > 1 or not one")
    return rows_but(docs, cut(gone.drop("n"), "gone"))
