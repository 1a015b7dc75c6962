"""Time-ordered target encoding by packed bitvector rank indexes.

Every row asks how many rows with its key stand before its time, and how many of them are hits, those of its own fold left
out.  Rows are dealt by ranges of (key, time), so that a hot key spreads over as many tasks as it has rows for; a task
builds an index over each block of its sorted rows.  Counts are sliced into bits, one packed bitvector for each binary digit
of rows and hits, of all folds and of each, with a directory of popcounts before each 64-bit word.  A binary search finds
the cutoff of a row in its key's sorted times, and rank queries there and at the key's start give exact counts.  What
earlier ranges hold of a key that goes on into a range is one row of totals for each range, summed by a window and joined
back.

Defined results: rows without a time have no history, are in none and don't come out; a null key is a value of its own, and
so is a null fold; rows at the same instant are in none of one another's histories; equal rows each count; counts of a row
may be of any size; an empty table gives an empty result; columns that aren't asked for are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import cut, free_names, id_crc, named

#: Rows of one index at most.
BLOCK_ROWS = 1 << 17
FOLDS = 5
#: The weight of a prior in rows, and the rate that stands for a whole, in millionths.
PRIOR_ROWS, WHOLE = 50, 1_000_000
#: The prior of the rate of all history.
FIRST_PRIOR = 500_000


class RankIndex:
    """Sums of a sequence's first values: a packed bitvector for each binary digit, with the ones before every word."""

    def __init__(self, values: np.ndarray):
        self.planes = []
        for digit in range(int(values.max(initial=0)).bit_length()):
            packed = np.packbits(((values >> digit) & 1).astype(np.uint8), bitorder="little")
            words = np.zeros(len(values) // 64 + 1, "<u8")
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.bitwise_count(words).astype(np.int64)
            self.planes.append((digit, words, np.cumsum(ones) - ones))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The sum of the values before each position."""
        total = np.zeros(len(at), np.int64)
        word, below = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        for digit, words, before in self.planes:
            total += (before[word] + np.bitwise_count(words[word] & below)) << digit
        return total


@dataclass
class Running:
    """What a task has seen of a key: its times' ends, rows and hits by fold, and those of them at the last time."""

    key: tuple[int, int]
    first: int
    last: int
    whole: np.ndarray
    at_last: np.ndarray

    def after(self, before: Running) -> Running:
        """This part of a key behind an earlier part of it."""
        at_last = self.at_last + before.at_last if before.last == self.last else self.at_last
        return Running(self.key, before.first, self.last, self.whole + before.whole, at_last)


def _totals(counts: np.ndarray, fold: np.ndarray, folds: int) -> np.ndarray:
    """(2, folds + 1): sums of rows and of hits by fold."""
    return np.stack([[counts[k][fold == f].sum() for f in range(folds + 1)] for k in (0, 1)]).astype(np.int64)


def _block(code: np.ndarray, key: np.ndarray, at: np.ndarray, fold: np.ndarray, counts: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """(2, rows): rows and hits of every row's history inside a block sorted by key and time; and where keys start."""
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (code[1:] != code[:-1])])
    shard = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
    times, place = np.unique(at, return_inverse=True)
    placed = shard * (len(times) + 1) + place
    cutoff = np.searchsorted(placed, placed, "left")
    past = np.zeros((2, len(key)), np.int64)
    for k in (0, 1):
        index = RankIndex(counts[k])
        past[k] = index.rank(cutoff) - index.rank(starts)[shard]
        for f in np.unique(fold):
            own = np.flatnonzero(fold == f)
            index = RankIndex(np.where(fold == f, counts[k], 0))
            past[k, own] -= index.rank(cutoff[own]) - index.rank(starts)[shard[own]]
    return past, starts


def _ended(key: tuple[int, int], at: np.ndarray, fold: np.ndarray, counts: np.ndarray, folds: int) -> Running:
    """A key's rows of one block, in order of time."""
    first, last = int(at[0]), int(at[-1])
    tail = slice(np.searchsorted(at, last), None)
    return Running(key, first, last, _totals(counts, fold, folds), _totals(counts[:, tail], fold[tail], folds))


def _without_own(totals: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """(2, rows): totals of all folds but each row's own."""
    return totals.sum(1)[:, None] - totals[:, fold]


def _history(kept: pa.Schema, made: pa.Schema, names: dict[str, str], folds: int, block_rows: int):
    """The work of a task that gets its range in order: counts of each row's history inside the range, and at the end a
    mark for the range's first key and its last one."""
    schema = pa.schema([*kept, *made])

    def mark(part: int, run: Running) -> pa.RecordBatch:
        said = {"part": part, "code": run.key[0], "key": run.key[1], "first": run.first, "last": run.last}
        said["totals"] = np.concatenate([run.whole.ravel(), run.at_last.ravel()]).tolist()
        return pa.RecordBatch.from_pylist([{names[k]: v for k, v in said.items()}], schema)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, now = TaskContext.get().partitionId(), None, None
        for block in _blocks(batches, block_rows):
            code, key, fold, n, s = (block.column(names[c]).to_numpy(zero_copy_only=False) for c in ("code", "key", "fold", "n", "s"))
            at, counts = block.column(names["at"]).cast(pa.int64()).to_numpy(), np.stack([n, s])
            past, starts = _block(code, key, at, fold, counts, folds)
            ends = np.r_[starts[1:], len(key)]
            for i in sorted({0, len(starts) - 1}):
                rows = slice(starts[i], ends[i])
                run = _ended((int(code[starts[i]]), int(key[starts[i]])), at[rows], fold[rows], counts[:, rows], folds)
                if now is not None and now.key == run.key:
                    earlier = _without_own(now.whole - now.at_last, fold[rows])
                    past[:, rows] += np.where(at[rows] == now.last, earlier, _without_own(now.whole, fold[rows]))
                    run = run.after(now)
                now = run
                if first is None or first.key == run.key:
                    first = run
            opens = (code == first.key[0]) & (key == first.key[1])
            found = {"past_n": past[0], "past_s": past[1], "part": np.full(len(key), part), "opens": opens, "tied": opens & (at == first.first)}
            arrays = [block.column(f.name).cast(f.type) for f in kept]
            said = {names[k]: v for k, v in found.items()}
            arrays += [pa.array(said[f.name], f.type) if f.name in said else pa.nulls(len(key), f.type) for f in made]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        if first is not None:
            yield mark(part, first)
            if now.key != first.key:
                yield mark(part, now)

    return answers


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches put together to so many rows or a batch's more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _carried(marks: DataFrame, names: dict[str, str], folds: int) -> DataFrame:
    """(part, code, key, upto, before): what earlier ranges hold of a range's first key, and what of that stands before the
    range's first time.  There are two marks a range at most."""
    code, key, part, first, last, totals = (named(names[c]) for c in ("code", "key", "part", "first", "last", "totals"))
    size = 2 * (folds + 1)
    at = lambda c, i: F.element_at(c, i + 1)
    earlier = Window.partitionBy("code", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    plain = marks.select(code.alias("code"), key.alias("key"), part.alias("part"), first.alias("first"), last.alias("last"), totals.alias("totals"))
    zero = F.lit(0).cast("long")
    summed = plain.withColumn("upto", F.array(*[F.coalesce(F.sum(at(F.col("totals"), i)).over(earlier), zero) for i in range(size)]))
    # Ranges that end at a time, and those that begin with it: the first ones count where they stand before the second.
    begun = summed.select("code", "key", "part", F.col("first").alias("t"), F.lit(0).alias("side"), "upto", *[zero.alias(f"l{i}") for i in range(size)])
    ended = summed.select("code", "key", "part", F.col("last").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("array<bigint>").alias("upto"), *[at(F.col("totals"), size + i).alias(f"l{i}") for i in range(size)])
    until = Window.partitionBy("code", "key", "t").orderBy("part", "side").rowsBetween(Window.unboundedPreceding, 0)
    ties = begun.unionByName(ended).select("code", "key", "part", "side", "upto", F.array(*[F.sum(f"l{i}").over(until) for i in range(size)]).alias("ties"))
    return ties.where("side = 0").select(F.col("part").alias("at_part"), F.col("code").alias("at_code"), F.col("key").alias("at_key"), "upto", F.zip_with("upto", "ties", lambda a, b: a - b).alias("before"))


def history(rows: DataFrame, keep: list[str], at: str, fold: str, n: str, s: str, code: str, key: str, folds: int = FOLDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keep, code, key and (past_n, past_s): rows n and hits s of each row's history, that is of all rows of its (code, key)
    with an earlier time at and another fold (0 to folds - 1, or null).

    code and key are whole numbers without nulls; keep has no column with the name of another of the result.  The result
    reads a table in the shared folder.
    """
    inner = ["code", "key", "at", "fold", "n", "s"]
    made = ["past_n", "past_s", "part", "opens", "tied", "first", "last", "totals"]
    joined_in = ["at_part", "at_code", "at_key", "upto", "before"]
    names = dict(zip(inner + made + joined_in, free_names(keep, *inner, *made, *joined_in), strict=True))
    given = {"code": named(code).cast("int"), "key": named(key).cast("long"), "at": named(at), "n": named(n).cast("long"), "s": named(s).cast("long")}
    given["fold"] = F.coalesce(named(fold).cast("int"), F.lit(folds))
    units = rows.where(named(at).isNotNull()).select(*[named(c) for c in keep], *[given[c].alias(names[c]) for c in inner])
    deal = [F.col(names[c]) for c in ("key", "code", "at")]
    # A hash beside the time lets ranges share even one instant of one key.
    ranged = units.repartitionByRange(*deal, F.xxhash64(*[named(c) for c in [*keep, names["n"]]])).sortWithinPartitions(*deal)
    held = [f for f in units.schema.fields if f.name not in (names["at"], names["n"], names["s"])]
    kinds = [T.LongType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.BooleanType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType())]
    out = T.StructType([T.StructField(f.name, f.dataType) for f in held] + [T.StructField(names[c], kind) for c, kind in zip(made, kinds, strict=True)])
    arrow = to_arrow_schema(out)
    work = _history(pa.schema(list(arrow)[: len(held)]), pa.schema(list(arrow)[len(held) :]), names, folds, block_rows)
    done = cut(ranged.mapInArrow(work, out), "history")
    col = {k: named(v) for k, v in names.items()}
    carried = _carried(done.where(col["totals"].isNotNull()), names, folds).toDF(*[names[c] for c in joined_in])
    joined = done.where(col["totals"].isNull()).join(carried, col["opens"] & (col["part"] == col["at_part"]) & (col["code"] == col["at_code"]) & (col["key"] == col["at_key"]), "left")
    before = F.when(col["tied"], col["before"]).otherwise(col["upto"])
    size = folds + 1

    def others(start: int) -> Column:
        part = F.slice(before, start + 1, size)
        return F.coalesce(F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b) - F.element_at(part, col["fold"] + 1), F.lit(0))

    return joined.select(*[named(c) for c in keep], col["code"].alias(code), col["key"].alias(key), (col["past_n"] + others(0)).alias("past_n"), (col["past_s"] + others(size)).alias("past_s"))


def rate(n: Column, s: Column, prior: Column) -> Column:
    """The share of s in n in millionths, drawn to the prior by the weight of PRIOR_ROWS rows; whole numbers throughout."""
    return F.when(n < 1, prior).otherwise(F.call_function("div", s * WHOLE + prior * PRIOR_ROWS, n + PRIOR_ROWS))


def _one_each(table: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, value): one row for each key that isn't null, of several values the smallest; written, so that what joins it can
    be split where a key is hot."""
    return cut(table.where(named(key).isNotNull()).groupBy(named(key).alias(key)).agg(F.min(value).alias("value")), key)


#: The values that a line shares with its history, in pairs of a shared label and the id whose prior it gives.
ITEM, KIND, VENDOR, NATION, CLIENT, SEGMENT, ALL = range(7)


def _coded(what: int, value: Column, hashed: bool = False) -> Column:
    """(code, key) of a value: labels by a hash of 64 bits, and null as the only key of a code of its own."""
    key = F.xxhash64(value) if hashed else value.cast("long")
    return F.struct((F.lit(2 * what) + value.isNull().cast("int")).alias("code"), F.when(value.isNull(), F.lit(0)).otherwise(key).alias("key"))


def shop_rates(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """sale_id, item_id, vendor_id, n_lines, n_returned, and n and rate of the item, the vendor and the client over the
    history of each: one row for all lines of a sale that have the same item and vendor.

    A null vendor is a vendor like others.  A sale that comes in several rows counts with its earliest time and the smallest
    client of that; a label that an id has several of counts with its smallest.
    """
    sale = F.struct(named("sold_at").alias("sold_at"), F.coalesce(named("client_id"), F.lit(-1)).cast("long").alias("client_id"))
    sold = _one_each(sales.where(named("sold_at").isNotNull()), "sale_id", sale)
    label = {"item_id": _one_each(items, "item_id", named("kind")), "vendor_id": _one_each(vendors, "vendor_id", named("nation_id")), "client_id": _one_each(clients, "client_id", named("segment"))}
    groups = (
        lines.where(named("sale_id").isNotNull())
        .groupBy(named("sale_id").cast("long").alias("sale_id"), F.coalesce(named("item_id"), F.lit(-1)).cast("long").alias("item_id"), named("vendor_id").cast("long").alias("vendor_id"))
        .agg(F.count("*").alias("n"), F.coalesce(F.sum((named("flag") == "returned").cast("long")), F.lit(0)).alias("s"))
        .join(sold, "sale_id").select("sale_id", "item_id", "vendor_id", "n", "s", "value.sold_at", "value.client_id")
    )
    for key, value in (("item_id", "kind"), ("vendor_id", "nation"), ("client_id", "segment")):
        groups = groups.join(label[key].withColumnRenamed("value", value), key, "left")
    groups = cut(groups.withColumns({"fold": F.pmod(id_crc("sale_id"), F.lit(FOLDS)).cast("int"), "row": F.monotonically_increasing_id()}), "groups")
    shared = ["sale_id", "sold_at", "fold"]
    by_sale = groups.groupBy(*shared, "client_id", "segment").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("row", F.lit(None).cast("long"))
    per_line = [_coded(ITEM, F.col("item_id")), _coded(KIND, F.col("kind"), True), _coded(VENDOR, F.col("vendor_id")), _coded(NATION, F.col("nation"))]
    per_sale = [_coded(CLIENT, F.col("client_id")), _coded(SEGMENT, F.col("segment"), True), _coded(ALL, F.lit(0))]
    columns = [*shared, "n", "s", "row"]
    units = groups.select(*columns, F.inline(F.array(*per_line))).unionByName(by_sale.select(*columns, F.inline(F.array(*per_sale))))
    done = history(units, ["row", "sale_id"], "sold_at", "fold", "n", "s", "code", "key")
    what = F.floor(F.col("code") / 2)
    only = lambda k, c: F.max(F.when(what == k, F.col(c)))
    counts = lambda k: [only(k, "past_n").alias(f"n{k}"), only(k, "past_s").alias(f"s{k}")]
    of_sales = done.where("row IS NULL").groupBy("sale_id").agg(*counts(CLIENT), *counts(SEGMENT), *counts(ALL))
    of_sales = cut(of_sales, "of_sales")
    of_lines = done.where("row IS NOT NULL").drop("sale_id").repartition("row").groupBy("row").agg(*counts(ITEM), *counts(KIND), *counts(VENDOR), *counts(NATION))
    joined = groups.select("row", "sale_id", "item_id", "vendor_id", "n", "s").join(of_lines, "row").join(of_sales, "sale_id")
    smoothed = lambda k, prior: rate(F.col(f"n{k}"), F.col(f"s{k}"), prior)
    whole = smoothed(ALL, F.lit(FIRST_PRIOR).cast("long"))
    rates = {"item": (ITEM, smoothed(KIND, F.col("whole"))), "vendor": (VENDOR, smoothed(NATION, F.col("whole"))), "client": (CLIENT, smoothed(SEGMENT, F.col("whole")))}
    values = [c for name, (k, prior) in rates.items() for c in (F.col(f"n{k}").alias(f"{name}_n"), smoothed(k, prior).alias(f"{name}_rate"))]
    return joined.withColumn("whole", whole).select("sale_id", "item_id", "vendor_id", F.col("n").alias("n_lines"), F.col("s").alias("n_returned"), *values)
