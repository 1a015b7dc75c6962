"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is its share of all words by weight, at most ``MOST`` times its own words; what is above is shared
out anew by weight.  The mix takes every document of a source as often as the target holds the whole source, and fills
the remaining budget with single documents: they are counted by exact length, each length first gives its even share,
and a bounded subset-sum program over the lengths' left-over counts spends the rest to the word.  Which documents of a
length are taken is decided by a seeded hash of the id, so reruns agree.

No source comes to the driver, however many there are: targets settle by sums over the table of sources.  A length's
budget is fitted per source from its histogram (a row for each distinct length); documents are picked by hash bucket, one
for each ``RANKED`` of them, so that a length that a third of all rows share is never ordered in one task: only its one
bucket in which the count is reached is ranked.

Defined results: a null text has size 0; a document of size 0 is taken with 0 words; null sources are one source, the
last; null ids are hashed as such; repeated rows are picked each for itself, in either order; of documents of one size
and hash those with the smaller id are picked first; an empty table gives an empty result; columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut, named, row_keys, rows_times, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
SEED = 42
#: Documents of one source and length that are ordered together, about.
RANKED = 1 << 14
#: The budget that is left to the subset-sum program, about.
PROGRAM = 1 << 15


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by weight, none above most times its size, the excess shared out by weight."""
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), [i for i in range(len(sizes))]
    while open_ and left > 0:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def subset_sum(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take, so that their sum is as near to budget as counts allow; of equals the lower sum.

    Bounded subset sum on bit sets: a count is split into binary parts, and the program ends when the budget is met.
    """
    takes = [0] * len(lengths)
    limit = budget + min(budget, max(lengths, default=0))  # nothing is further off than the sum 0, or one document less is nearer
    reach, steps = 1, []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        left, part = min(counts[i], limit // lengths[i]), 1
        while left > 0 and not reach >> budget & 1:
            k = min(part, left)
            steps.append((i, k, reach))
            reach |= (reach << (lengths[i] * k)) & ((2 << limit) - 1)
            left, part = left - k, part * 2
    at = (reach & ((2 << budget) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    if above and (up := budget + (above & -above).bit_length()) - budget < budget - at:
        at = up
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            takes[i] += k
            at -= lengths[i] * k
    return takes


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for a budget of words: an even share of each, then the longest ones
    while much is left, and the subset-sum program for the rest."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    whole = int((lengths * counts).sum())
    takes = np.zeros(len(lengths), np.int64)
    if budget <= 0 or whole <= 0:
        return takes
    budget = min(budget, whole)
    takes = np.where(lengths > 0, [int(c) * budget // whole for c in counts], 0).astype(np.int64)
    left = budget - int((lengths * takes).sum())
    for i in np.argsort(-lengths):
        if left <= PROGRAM or lengths[i] <= 0:
            break
        k = min(int(counts[i] - takes[i]), (left - PROGRAM // 2) // int(lengths[i]))
        takes[i] += max(0, k)
        left -= max(0, k) * int(lengths[i])
    usable = np.flatnonzero((lengths > 0) & (counts > takes) & (lengths <= 2 * left))
    more = subset_sum(lengths[usable].tolist(), (counts - takes)[usable].tolist(), left)
    takes[usable] += np.array(more, np.int64)
    return takes


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def weighted(totals: DataFrame, weights: Sequence[float]) -> DataFrame:
    """totals (source, source_size) with each source's weight by its place in code point order, null last.

    Sources are put in order by ranges; only the number of sources in each range comes to the driver.
    """
    order = F.col("source").asc_nulls_last()
    placed = cut(totals.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftrightunsigned("at", 33).cast("int")
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, upto = [], 0
    for p in range(max(counts, default=0) + 1):
        before.append(upto % len(weights))
        upto += counts.get(p, 0)
    place = F.pmod(F.element_at(F.lit(before), part + 1) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), F.lit(len(weights)))
    weight = F.element_at(F.lit([float(w) for w in weights]), (place + 1).cast("int"))
    return cut(placed.select("source", "source_size", weight.alias("weight")), "weights")


def targets_of(totals: DataFrame, weights: Sequence[float], most: float = MOST) -> DataFrame:
    """(source, source_size, target) of totals (source, source_size), as ``targets`` says it, without gathering sources:
    every round is one sum over them, and rounds end when no further source is above its most."""
    rows = weighted(totals, weights)
    whole = F.col("source_size").cast("double")
    left, share, full = (rows.agg(F.sum(whole)).first()[0] or 0.0), None, None
    total, capped = left, F.lit(False)
    while True:
        said = rows.agg(
            F.coalesce(F.sum(F.when(capped, F.lit(0.0)).otherwise(F.col("weight"))), F.lit(0.0)).alias("open"),
            F.coalesce(F.sum(F.when(capped, most * whole)), F.lit(0.0)).alias("capped"), F.sum(capped.cast("long")).alias("n"),
        ).first()
        if said["n"] == full or not said["open"]:
            break
        full, left, share = said["n"], total - said["capped"], said["open"]
        capped = F.lit(left) * F.col("weight") / F.lit(share) > most * whole
    target = F.lit(0.0) if share is None else F.when(capped, most * whole).otherwise(F.lit(left) * F.col("weight") / F.lit(share))
    return rows.select("source", "source_size", (target if total > 0 else F.lit(0.0)).alias("target"))


def _mixed(rows: DataFrame, weights: Sequence[float], seed: int) -> DataFrame:
    """(keys of the rows, size, source_size, target, copies) of rows (id, source, size, keys ...)."""
    keys = [c for c in rows.columns if c not in ("source", "size")]
    rows = cut(rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "size")), "sizes")
    histogram = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    aims = targets_of(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        base = min(MOST, int(target // size)) if size else 0
        extra = fit_lengths(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(target) - base * size if base < MOST else 0)
        return pdf.assign(base=base, extra=extra)

    kinds = "source string, size long, n long, source_size long, target double, base long, extra long"
    plan = histogram.join(aims.withColumnRenamed("source", "s"), _same("source", "s")).drop("s")
    plan = plan.groupBy("source").applyInPandas(fitted, kinds)
    plan = cut(plan.select(F.col("source").alias("s"), F.col("size").alias("l"), "source_size", "target", "base", "extra", (1 + F.floor(F.col("n") / RANKED)).alias("buckets")), "plan")
    joined = rows.join(plan, _same("source", "s") & (F.col("size") == F.col("l")))
    joined = joined.withColumn("bucket", F.pmod(F.xxhash64("h"), F.col("buckets")))
    # The bucket of a length in which its count of extra documents is reached, and how many of that bucket.
    counted = joined.where("extra > 0").groupBy("s", "l", "extra", "bucket").agg(F.count("*").alias("m"))
    up = Window.partitionBy("s", "l").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("upto", F.sum("m").over(up)).where("upto >= extra and upto - m < extra")
    edge = cut(summed.select(F.col("s").alias("e"), F.col("l").alias("k"), F.col("bucket").alias("edge"), (F.col("extra") - F.col("upto") + F.col("m")).alias("some")), "edges")
    joined = joined.join(edge, _same("s", "e") & (F.col("l") == F.col("k")), "left")
    at_edge = F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))
    group = F.when(at_edge, F.xxhash64("s", "l", "bucket")).otherwise(F.col("h"))
    ranked = joined.withColumn("at_edge", at_edge).withColumn("group", group)
    order = Window.partitionBy("group", "at_edge").orderBy("h", *keys)
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    more = F.when(F.col("at_edge"), F.col("rank") <= F.col("some")).otherwise(F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)))
    return ranked.select(*keys, "size", "source_size", "target", (F.col("base") + more.cast("long")).alias("copies"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    source, size = named(source_col).cast("string").alias("source"), word_count(named(text_col).cast("string")).alias("size")
    return docs.select(named(id_col).alias("id"), source, size, *more)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, seed: int = SEED,
) -> DataFrame:
    """(id_col, size, source_size, target, taken, copies) of every row; taken is size times copies."""
    found = _mixed(_sizes(docs, id_col, text_col, source_col), weights, seed)
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def repeat_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, seed: int = SEED,
) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs.  Every row has its own number of
    copies, whatever other rows have its id; equal rows have theirs together."""
    k1, k2 = row_keys(docs)
    found = _mixed(_sizes(docs, id_col, text_col, source_col, k1.alias("k1"), k2.alias("k2")), weights, seed)
    chosen = found.groupBy("k1", "k2").agg(F.sum("copies").alias("times"), F.count("*").alias("n"))
    return rows_times(docs, cut(chosen.where("times > 0"), "copies"), ("k1", "k2"))
