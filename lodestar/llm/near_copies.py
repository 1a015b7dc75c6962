"""The near-duplicate stage: SimHash links of five-word fingerprints, and the rest up to a Jaccard similarity of 0.8.

Texts whose sets of five-word shingles, A-Z lower-cased, have a similarity of ``SIMILAR`` or more link; a group is what
links lead to.  Candidates come from two places, and every link is verified on the whole sets:

1. Deletion-variant signatures of five-word SimHash fingerprints (``simhash.links``) within ``MAX_DISTANCE`` bits.
2. Texts at 0.8 differ by up to 21 of 64 bits (9.7 on the average), which no deletion variants reach: with segments short
   enough for one bit each, nearly all texts share a key.  So a text also has BANDS keys of ROWS minima each, and texts
   that share a key are candidates.  A pair at similarity s has no common key with probability
   (1 - s ** ROWS) ** BANDS: 7e-5 at 0.8, 5e-10 at 0.9.

Only distinct texts (by a 64-bit hash of their words) are nodes.  A key may belong to very many texts, so its texts are
first compared with one of them, that which shares keys with most others, and what links is one group from there on.
Pairs of a key's texts that are in different groups still are compared by wide sketches of ``WIDE`` minima, within blocks
of about BLOCK x BLOCK texts, so that no pair is a row before its estimate is within ``SIGMAS`` standard deviations of a
link (lost with a probability of 3e-5 at exactly 0.8); what is left is verified.

Defined results: a null text is an empty one, and texts without words are copies of each other; a text of fewer words
than a shingle is one shingle; one row of a group stays, that with the smallest id, null ids last, of equal ids that with
the smallest hash; rows that repeat an id, or have none, are rows like others, and of equal rows one stays; an empty table
gives an empty result; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from ._shared import coded_words, cut, named, row_keys, rows_but, small_batches

SEED = 42
SHINGLE = 5
SIMILAR = 0.8
MAX_DISTANCE = 2
BANDS, ROWS = 24, 5
#: Minima of the wide sketch.
WIDE = 1024
SIGMAS = 4
#: Texts on each side of a block of pairs, about.
BLOCK = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.random.default_rng(SEED).integers(0, 1 << 64, (2, WIDE), np.uint64)
_A |= np.uint64(1)
#: The lowest bit of every group of four.
_LOW = np.uint64(0x1111111111111111)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def most_apart(minima: int) -> int:
    """Of so many minima the number that differ, four bits of each, from which a pair is no candidate."""
    p = (1 - SIMILAR) * 15 / 16
    return int(minima * p + SIGMAS * (minima * p * (1 - p)) ** 0.5) + 1


def shingles(texts: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(hash of its words, hashes of its shingles as they follow, the distinct ones ascending) of every text of a batch."""
    offsets, codes, distinct = coded_words(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    of_word = np.array([xxhash.xxh64_intdigest(w or "", SEED) for w in distinct.to_pylist()], np.uint64)
    words = of_word[codes] if len(codes) else np.zeros(0, np.uint64)
    whole = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        whole = whole * _ODD + words[j : j + len(whole)]
    whole, out = _mixed(whole), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        key = xxhash.xxh64_intdigest(words[a:b].tobytes(), SEED)
        if b - a < SHINGLE:
            one = np.array([key] if b > a else [], np.uint64)
            out.append((key, one, one))
        else:
            out.append((key, whole[a : b - SHINGLE + 1], np.unique(whole[a : b - SHINGLE + 1])))
    return out


def minima(sets: list[np.ndarray], first: int, last: int) -> np.ndarray:
    """The minima of sets that aren't empty under the hash functions from first to before last, a row each function."""
    line = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.array([_mixed(np.minimum.reduceat(line * _A[k] + _B[k], starts)) for k in range(first, last)])


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of sets by their first minima, a row each set."""
    keys = np.empty((found.shape[1], BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(found.shape[1], band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = _mixed(key * _ODD + found[k])
        keys[:, band] = key
    return keys


def sketches(found: np.ndarray) -> np.ndarray:
    """Four bits of every minimum, sixteen in a word, a row each set."""
    few = found & np.uint64(15)
    out = np.zeros((found.shape[1], -(-len(found) // 16)), np.uint64)
    for k, row in enumerate(few):
        out[:, k // 16] |= row << np.uint64(4 * (k % 16))
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many minima sketches differ."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & _LOW).sum(-1, dtype=np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two ascending sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows in order of their block, a block's texts before its pairs."""
    block, sets = None, {}
    for batch in batches:
        found: list[tuple[int, int]] = []
        made = [s for _, _, s in shingles(batch.column(4))]
        for g, is_pair, a, b, own in zip(*[c.to_pylist() for c in batch.columns[:4]], made):
            if g != block:
                block, sets = g, {}
            if not is_pair:
                sets[a] = own
                continue
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)) and jaccard(x, y) >= SIMILAR:
                found.append((a, b))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (g, a, b) of blocks' texts that wide sketches and sizes allow, from rows in order of their block."""
    limit, block, rows = most_apart(WIDE), None, []

    def pairs() -> Iterator[pa.RecordBatch]:
        sides, nodes, roots, sizes = (np.array(c, np.int64) for c in list(zip(*rows))[:4])
        wide = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
        keys = np.array([r[5] for r in rows], np.int64)
        left, right = (np.flatnonzero(sides <= 0), np.flatnonzero(sides != 0)) if (sides >= 0).any() else (np.arange(len(rows)),) * 2
        for i in left:
            among = right[(roots[right] != roots[i]) & (np.minimum(sizes[right], sizes[i]) >= SIMILAR * np.maximum(sizes[right], sizes[i]))]
            if (sides < 0).all():
                among = among[among > i]
            near = among[apart(wide[among], wide[i]) < limit]
            # A pair counts only under the first key that both have.
            same = keys[near] == keys[i]
            near = near[keys[i][same.argmax(1)] == rows[i][6]] if len(near) else near
            if len(near):
                a, b = np.minimum(nodes[near], nodes[i]), np.maximum(nodes[near], nodes[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), block)), pa.array(a), pa.array(b)], ["g", "a", "b"])

    for batch in batches:
        for g, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if g != block:
                if len(rows) > 1:
                    yield from pairs()
                block, rows = g, []
            rows.append(row)
    if len(rows) > 1:
        yield from pairs()


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (g, a, b) that link.  Pairs are verified in the blocks that g names, so that a text is sent once for a
    block and not for each pair."""
    pairs = cut(pairs.groupBy("a", "b").agg(F.min("g").alias("g")), "pairs")
    needed = pairs.select("g", F.explode(F.array("a", "b")).alias("node")).distinct().join(texts, "node")
    none = F.lit(None)
    rows = needed.select("g", F.lit(False).alias("is_pair"), F.col("node").alias("a"), none.cast("long").alias("b"), "text")
    rows = rows.unionByName(pairs.select("g", F.lit(True).alias("is_pair"), "a", "b", none.cast("string").alias("text")))
    return cut(rows.repartition("g").sortWithinPartitions("g", "is_pair").mapInArrow(_verified, "a long, b long"), "links")


def _near(a: str, b: str) -> Column:
    """Whether sizes and narrow sketches of two rows allow a link."""
    differ = F.lit(0)
    for k in range(-(-BANDS * ROWS // 16)):
        x = F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(int(_LOW)).cast("long")))
    sizes = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (differ < most_apart(BANDS * ROWS)) & (F.least(*sizes) >= SIMILAR * F.greatest(*sizes))


def _rooted(df: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return df.withColumn("root", F.col("node"))
    return df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidates (g, a, b): texts of one fingerprint with the smallest of them, and the smallest ones of fingerprints
    that link."""
    least = cut(nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    same = nodes.where("n > 0").select("fp", "node").join(least.withColumnRenamed("node", "first"), "fp").where("node <> first")
    linked = simhash.links(least.select("fp"), MAX_DISTANCE)
    linked = linked.join(least.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
    found = same.select(F.col("node").alias("x"), F.col("first").alias("y")).unionByName(linked.select("x", "y"))
    a, b = F.least("x", "y"), F.greatest("x", "y")
    return found.select(F.xxhash64(a, F.pmod(F.xxhash64(b), F.lit(64))).alias("g"), a.alias("a"), b.alias("b"))


def _by_centre(buckets: DataFrame, sketched: DataFrame) -> DataFrame:
    """Candidates (g, a, b): every text of a key with that text of the key that shares most keys."""
    known = buckets.select("key", "node").join(sketched.select("node", "shared"), "node")
    centre = F.max(F.struct("shared", "node")).alias("c")
    met = known.join(known.groupBy("key").agg(centre), "key").where("node <> c.node")
    met = met.select("node", F.col("c.node").alias("centre")).distinct()
    own, other = F.struct("node", "n", "sketch").alias("x"), F.struct("node", "n", "sketch").alias("c")
    met = met.join(sketched.select("node", own), "node").join(sketched.select(F.col("node").alias("centre"), other), "centre").where(_near("x", "c"))
    member = F.pmod(F.xxhash64("x.node"), F.lit(64))
    return met.select(F.xxhash64("c.node", member).alias("g"), F.least("x.node", "c.node").alias("a"), F.greatest("x.node", "c.node").alias("b"))


def _by_blocks(opened: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (g, a, b) among a key's texts in different groups, by wide sketches."""

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, _, s in shingles(batch.column(1))]
            wide = sketches(minima(sets, 0, WIDE)) if sets else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in wide], pa.binary())], ["node", "wide"])

    own = texts.join(opened.select("node").distinct(), "node", "left_semi").mapInArrow(widened, "node long, wide binary")
    parts = F.ceil(F.col("m") / BLOCK).cast("long")
    rows = opened.join(cut(own.join(nodes.select("node", "keys"), "node"), "wide"), "node").withColumn("p", F.pmod(F.xxhash64("node"), parts))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    side = F.when(F.col("p") == F.col("q"), F.lit(-1)).when(F.col("p") < F.col("q"), F.lit(0)).otherwise(F.lit(1))
    g = F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q"))
    rows = rows.select(g.alias("g"), side.cast("long").alias("side"), "node", "root", F.col("n").cast("long").alias("n"), "wide", "keys", "key")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_plausible, "g long, a long, b long")


def groups(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(node, root) of the texts that link to others; nodes are (node, n, fp, sketch, keys), and texts_of gives
    (node, text) of some of them."""
    alike = cut(_by_fingerprint(nodes), "alike")
    entries = nodes.select(F.explode("keys").alias("key"), "node")
    shared = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = cut(entries.join(shared, "key"), "buckets")
    sketched = cut(nodes.select("node", "n", "sketch").join(buckets.groupBy("node").agg(F.sum("m").alias("shared")), "node"), "sketched")
    centred = cut(_by_centre(buckets, sketched), "centred")
    needed = buckets.select("node").unionByName(alike.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    texts = cut(texts_of(needed), "texts")
    edges = _links(alike.unionByName(centred), texts)
    roots = None if edges.isEmpty() else simhash.components(edges)
    rooted = _rooted(buckets.select("key", "node"), roots)
    several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x < y")
    opened = cut(rooted.join(several.select("key", "m"), "key").join(sketched.select("node", "n"), "node"), "opened")
    if not opened.isEmpty():
        more = _links(_by_blocks(opened, nodes, texts), texts)
        if not more.isEmpty():
            roots = simhash.components(edges.unionByName(more))
    return roots


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, id, node, n, fp, sketch, keys) of every row."""
    small_batches(docs.sparkSession)
    k1, k2 = row_keys(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["k1"], rows.schema["k2"], rows.schema["id"]])
    schema = schema.add("node", "long").add("n", "integer").add("fp", "long")
    schema = schema.add("sketch", T.ArrayType(T.LongType())).add("keys", T.ArrayType(T.LongType()))
    longs = pa.list_(pa.int64())

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingles(batch.column(3))
            sets = [s for _, _, s in found if len(s)]
            least = minima(sets, 0, BANDS * ROWS) if sets else np.zeros((BANDS * ROWS, 0), np.uint64)
            each = iter(zip(sketches(least).view(np.int64), bands(least).view(np.int64)))
            made = [next(each) if len(s) else ([], []) for _, _, s in found]
            nodes = np.array([k for k, _, _ in found], np.uint64).view(np.int64)
            fps = np.array([simhash.majority(f) for _, f, _ in found], np.uint64).view(np.int64)
            columns = [pa.array(nodes), pa.array([len(s) for _, _, s in found], pa.int32()), pa.array(fps)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, *[pa.array([m[k] for m in made], longs) for k in (0, 1)]], schema.names)

    return rows.mapInArrow(marks, schema)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, that with the smallest id, with the columns of docs."""
    marks = cut(marked(docs, id_col, text_col), "marks")
    row = F.min(F.struct("k1", "k2")).alias("row")
    nodes = cut(marks.groupBy("node").agg(row, *[F.first(c).alias(c) for c in ("n", "fp", "sketch", "keys")]), "nodes")
    k1, k2 = row_keys(docs)

    def texts_of(wanted: DataFrame) -> DataFrame:
        rows = cut(nodes.join(wanted, "node", "left_semi").select("node", "row.k1", "row.k2"), "wanted")
        found = docs.select(k1.alias("k1"), k2.alias("k2"), named(text_col).cast("string").alias("text")).join(rows.hint("merge"), ["k1", "k2"])
        return found.groupBy("node").agg(F.first("text").alias("text"))

    rooted = _rooted(marks.select("k1", "k2", "id", "node"), groups(nodes, texts_of))
    order = F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2")
    equal = rooted.groupBy("root", "k1", "k2", "id").agg(F.count("*").alias("n"))
    one = equal.groupBy("root").agg(F.min_by(F.struct("k1", "k2"), order).alias("r"))
    stays = (F.col("k1") == F.col("r.k1")) & (F.col("k2") == F.col("r.k2"))
    gone = equal.join(one, "root").select("k1", "k2", stays.alias("one"), "n").where("n > 1 or not one")
    return rows_but(docs, cut(gone.drop("n"), "gone"))
