"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the ascending array of the ``k`` smallest distinct 64-bit hashes of a text's word shingles.  Sketches of parts
merge into the sketch of the whole, and two sketches estimate the resemblance and the containment of their texts; one
alone estimates its number of distinct shingles, exactly while that is below ``k``.

Expressions are bound by one-element arrays (``_let``), so that Spark evaluates each once for a row and not once for
each element.  The neighbour of every document comes from a window over buckets of the id's order: buckets are bounded
by quantiles of the id, and the first document of each is also dealt to the bucket before, so that nothing is ordered
in one task.

Defined results: a null text is an empty one; a text without words has an empty sketch, and two such are alike by 1; a
text of fewer words than a shingle is one shingle; documents follow by id with null ids last, rows that repeat an id by
text; an empty table gives an empty result; of the input only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, named

SHINGLE = 5
K = 128
#: Documents that are put in order together, about, and the most buckets of them.
ROWS, MOST = 1 << 14, 1 << 12


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _smallest(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Bottom-k sketch of a text column."""

    def shingles(words: Column) -> Column:
        """Hashes of the words' hashes, taken together; of a short text, of all its words."""
        long = F.transform(
            F.sequence(F.lit(0), F.size(words) - F.lit(shingle)),
            lambda i: F.xxhash64(*[words[i + F.lit(j)] for j in range(shingle)]),
        )
        short = F.array(F.xxhash64(F.lit(shingle), words))
        empty = F.array().cast("array<bigint>")
        return F.when(F.size(words) >= shingle, long).when(F.size(words) > 0, short).otherwise(empty)

    words = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return _smallest(_let(hashed, shingles), k)


def as_text(found: Column) -> Column:
    """A sketch as 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(found, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], sketch_col: str, k: int = K, salts: int = 64) -> DataFrame:
    """(keys, sketch_col): the merged sketch of each group.  Hashes are reduced to k per salt before the groups meet, so
    that a group that holds a third of all rows gives its last task salts * k hashes at most."""
    hashes = df.select(*keys, F.explode(sketch_col).alias("_h"))
    hashes = hashes.withColumn("_salt", F.pmod("_h", F.lit(salts))).distinct()
    first = Window.partitionBy(*keys, "_salt").orderBy("_h")
    few = hashes.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    merged = few.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(sketch_col))
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"m.{c}")) for c in keys]
    joined = groups.alias("g").join(merged.alias("m"), same, "left")
    filled = F.coalesce(F.col(f"m.{sketch_col}"), F.array().cast("array<bigint>"))
    return joined.select(*[F.col(f"g.{c}") for c in keys], filled.alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketches: the share of both among the k smallest hashes of either."""

    def share(union: Column) -> Column:
        both = F.size(F.array_intersect(F.array_intersect(union, a), b))
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union)).cast("double")

    return _let(merge(a, b, k), share)


def distinct_shingles(found: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles of a sketch."""
    place = (F.element_at(found, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(found) < k, F.size(found).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first's shingles that the second has too."""
    whole = distinct_shingles(merge(a, b, k), k)
    shared = resemblance(a, b, k) * whole
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def in_order(docs: DataFrame, key: str, ties: list[str], buckets: int | None = None) -> tuple[DataFrame, Window]:
    """docs dealt to buckets that follow each other by key, and the window in which every row stands before the next one.

    The order is cyclic.  Rows with _copy = 1 are the first of the following bucket, to be left out once neighbours are
    taken.  A bucket's bound is a quantile of the key, so buckets hold about equally many rows, whatever the ids are.
    """
    n = buckets or max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST, docs.count() // ROWS))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    least, found = docs.agg(F.min(key), F.percentile_approx(key, shares, 100_000)).first()
    bounds = sorted({least, *(found or [])}) if least is not None else []
    bucket, opens, opens_all = F.lit(1), F.lit(True), F.lit(True)
    if bounds:
        # Two short scans instead of a long one: the row of bounds, then the place in it.
        step = max(1, round(len(bounds) ** 0.5))
        rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
        heads, grid = F.array(*[F.lit(r[0]) for r in rows]), F.array(*[F.array(*map(F.lit, r)) for r in rows])
        upto = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col(key)))
        bucket = _let(upto(heads), lambda r: (r - 1) * step + upto(F.element_at(grid, r)))
        bucket = F.when(F.col(key).isNull(), F.lit(len(bounds))).otherwise(bucket)
        opens = F.array_contains(F.element_at(grid, F.floor((F.col("_b") - 1) / step).cast("int") + 1), F.col(key))
        opens_all = F.col(key) == F.lit(bounds[0])
    own = F.struct(F.col("_b").alias("_bucket"), F.lit(0).alias("_copy"))
    before = F.when(opens_all, F.lit(max(1, len(bounds)))).otherwise(F.col("_b") - 1)
    both = F.array(own, F.struct(before.alias("_bucket"), F.lit(1).alias("_copy")))
    dealt = docs.withColumn("_b", bucket.cast("int"))
    dealt = dealt.select(*docs.columns, F.inline(F.when(F.coalesce(opens, F.lit(False)), both).otherwise(F.array(own))))
    return dealt, Window.partitionBy("_bucket").orderBy("_copy", *[F.col(c).asc_nulls_last() for c in (key, *ties)])


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose second half is replaced by the next one's beginning.

    (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.
    """
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    dealt, window = in_order(rows, "id", ["text"])
    found = dealt.select("*", F.lead("text").over(window).alias("next_text"), F.row_number().over(window).alias("_at"))
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), chars - half), F.coalesce(F.col("next_text").substr(F.lit(1), half), F.lit("")))
    found = found.select(
        "id", "_bucket", "_copy", "_at", chars.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"),
        sketch(F.col("text"), k, shingle).alias("own"), sketch(edited, k, shingle).alias("changed"),
    )
    found = found.withColumn("next", F.lead("own").over(Window.partitionBy("_bucket").orderBy("_at"))).where("_copy = 0")
    return found.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next"), k).alias("near_next"),
    )
