"""Reciprocal rank fusion of routes, and the merge of several query groups."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF = 60
DIGITS = 9
PER_GROUP, ALL_GROUPS, COVERED = 10, 30, 6


def reciprocal(rank: Column) -> Column:
    return F.coalesce(1.0 / (RRF + rank), F.lit(0.0))


def fuse(hits: DataFrame, routes: Sequence[str], id_col: str = "id") -> DataFrame:
    """(id, score, matched_by, rank) of every candidate: the sum over routes of the reciprocal best rank.

    Routes are columns of one aggregation, added in their order, so that sums never depend on the shuffle.
    """
    best = [F.min(F.when(F.col("route") == r, F.col("rank"))).alias(f"r{i}") for i, r in enumerate(routes)]
    sides = [F.max(F.col("path") == p).alias(p) for p in ("fts", "vector")]
    grouped = hits.groupBy(F.col(id_col).alias("id")).agg(*best, *sides)
    score: Column = F.lit(0.0)
    for i in range(len(routes)):
        score = score + reciprocal(F.col(f"r{i}"))
    matched = F.when(F.col("fts") & F.col("vector"), "fts+vector").when(F.col("fts"), "fts").otherwise("vector")
    out = grouped.select("id", F.round(score, DIGITS).alias("score"), matched.alias("matched_by"))
    return out


def ranked(fused: DataFrame, limit: int, tracked: object | None = None) -> DataFrame:
    """The best rows with their rank, and the tracked one with its own even if it comes later."""
    order = Window.orderBy(F.desc("score"), F.asc("id"))
    if tracked is None:
        return fused.orderBy(F.desc("score"), F.asc("id")).limit(limit).withColumn("rank", F.row_number().over(order))
    mine = F.broadcast(fused.where(F.col("id") == tracked).select(F.col("score").alias("_s")))
    before = fused.crossJoin(mine).where((F.col("score") > F.col("_s")) | ((F.col("score") == F.col("_s")) & (F.col("id") < tracked)))
    place = before.agg((F.count("*") + 1).cast("int").alias("rank"))
    own = fused.where(F.col("id") == tracked).crossJoin(F.broadcast(place))  # a row each
    first = ranked(fused, limit)
    return first.unionByName(own.where(F.col("rank") > limit))


def force(hits: DataFrame, routes: Sequence[tuple[str, str]], tracked: object, depth: int, matches: DataFrame | None = None) -> DataFrame:
    """hits with the tracked id in each route, as if it stood right behind the depth where the route lacks it.

    With matches (route, score), only in the routes that match it when they are run on it alone, with its score there.
    """
    spark = hits.sparkSession
    rows = [(r, p, depth + 1) for r, p in routes]
    extra = spark.createDataFrame(rows, "route string, path string, rank int")
    have = hits.where(F.col("id") == tracked).select(F.col("route").alias("_r")).distinct()
    missing = extra.join(F.broadcast(have), F.col("route") == F.col("_r"), "left_anti")  # a row for each route
    if matches is None:
        missing = missing.withColumn("score", F.lit(None).cast("double"))
    else:
        missing = missing.join(F.broadcast(matches), "route")  # a row for each route
    missing = missing.select("route", "path", F.lit(tracked).cast(hits.schema["id"].dataType).alias("id"), "rank", "score")
    return hits.withColumn("forced", F.lit(False)).unionByName(missing.withColumn("forced", F.lit(True)))


def evidence(hits: DataFrame) -> DataFrame:
    """(public_id, evidence): all hits of an id by rank, path and member."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.col("path"), F.col("id"))))
    return hits.groupBy("public_id").agg(listed.alias("evidence"))


def group_limit(explicit: int | None, groups: int) -> int:
    if explicit is not None:
        return explicit
    return PER_GROUP if groups <= 3 else max(1, -(-ALL_GROUPS // groups))


def merge_groups(items: DataFrame, key_col: str = "key") -> DataFrame:
    """(key, score, best_rank, first_group, groups, place): items of all groups by key, best first.

    The score is the sum of reciprocal ranks over groups; ties go to the better rank, the earlier group, and the key in
    the order of Unicode's root collation.
    """
    one = items.groupBy(F.col(key_col).alias("key"), "group_no").agg(F.min("rank").alias("rank"))
    parts = F.array_sort(F.collect_list(F.struct("group_no", "rank")))
    score = F.aggregate(F.transform("parts", lambda p: 1.0 / (RRF + p["rank"])), F.lit(0.0), lambda s, x: s + x)
    merged = one.groupBy("key").agg(parts.alias("parts"), F.min("rank").alias("best_rank"), F.min("group_no").alias("first_group"))
    merged = merged.withColumn("score", F.round(score, DIGITS)).withColumn("groups", F.array_join(F.transform("parts", lambda p: F.concat(F.lit("Q"), p["group_no"].cast("string"))), ","))
    order = Window.orderBy(F.desc("score"), "best_rank", "first_group", F.collate(F.col("key").cast("string"), "UNICODE"), "key")
    return merged.drop("parts").withColumn("place", F.row_number().over(order))


def coverage(merged: DataFrame, items: DataFrame, primaries: Sequence[int], covered: int = COVERED, key_col: str = "key") -> DataFrame:
    """merged in its final order: each primary group's best item that isn't taken yet, in the order of groups, then the
    others by place.  What is merged has at most ``ALL_GROUPS`` rows or a group's limit times the groups, so that the
    greedy choice runs over one small group."""
    per = items.where(F.col("group_no").isin(list(primaries))).groupBy(F.col(key_col).alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("group_no", "rank"))).alias("ranks"))
    rows = merged.join(per, "key", "left")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place").reset_index(drop=True)
        taken: list[int] = []
        for g in primaries:
            if len(taken) >= covered:
                break
            ranks = [(r[g], i) for i, r in enumerate(pdf["ranks"]) if i not in taken and r is not None and g in r]
            if ranks:
                taken.append(min(ranks)[1])
        order = taken + [i for i in range(len(pdf)) if i not in taken]
        reason = ["coverage"] * len(taken) + ["global"] * max(0, min(covered, len(pdf)) - len(taken))
        reason += ["tail"] * (len(pdf) - len(reason))
        return pdf.iloc[order].assign(final=range(1, len(pdf) + 1), reason=reason)[["key", "score", "final", "reason"]]

    kinds = f"key {merged.schema['key'].dataType.simpleString()}, score double, final int, reason string"
    return rows.groupBy(F.lit(1).alias("one")).applyInPandas(choose, kinds)
