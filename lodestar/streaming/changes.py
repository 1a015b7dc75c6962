"""Changes of files as a stream: merged per path, flushed after a quiet time, widened when there are too many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

QUIET = "750 milliseconds"
BUDGET = 1000


def merged_kind(kinds: Column) -> Column:
    """One kind of change for an ordered array of them: nothing new replaces nothing; a created file that is deleted is
    deleted, one that changes is created; others that differ are a change."""
    step = lambda a, b: (
        F.when(a.isNull(), b).when(b.isNull() | (a == b), a).when((a == "created") & (b == "deleted"), F.lit("deleted"))
        .when((a == "created") & (b == "changed"), F.lit("created")).otherwise(F.lit("changed"))
    )
    return F.aggregate(kinds, F.lit(None).cast("string"), step)


def coalesce_changes(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, events): the merged change of each path, in the order of time and event.

    Only what the fold can tell apart is gathered: runs of equal kinds are cut to their first event beforehand.
    """
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    runs = events.withColumn("_last", F.lag("kind").over(order)).withColumn("_new", F.coalesce(F.col("_last") != F.col("kind"), F.lit(True)))
    firsts = F.array_sort(F.collect_list(F.when(F.col("_new"), F.struct("ts", "event_id", "kind"))))
    grouped = runs.groupBy(*keys).agg(firsts.alias("_k"), F.count("*").alias("events"))
    return grouped.select(*keys, merged_kind(F.transform("_k", lambda k: k["kind"])).alias("kind"), "events")


def debounce(events: DataFrame, keys: list[str], quiet: str = QUIET, late: str | None = None) -> DataFrame:
    """(keys, start, end, events): bursts of changes, each ended by a quiet time.  On a stream, late is the watermark."""
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.groupBy(*keys, F.session_window("ts", quiet).alias("_w")).agg(F.count("*").alias("events"))
    return grouped.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events")


def minimal_cover(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """The paths that no other path contains: each is exploded into its ancestors and anti-joined on equality."""
    p = F.col(path_col)
    distinct = paths.select(p.alias(path_col)).distinct()
    parts = F.split(p, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    up = distinct.select(p.alias("_own"), F.explode(F.when(F.size(parts) > 1, above)).alias("_up"))
    covered = up.join(distinct.select(p.alias("_up")), "_up").select(F.col("_own").alias(path_col)).distinct()
    return distinct.join(covered, path_col, "left_anti")


def widen(paths: DataFrame, root_col: str = "root", path_col: str = "path", budget: int = BUDGET) -> DataFrame:
    """(root, path, rescan): changed paths of each root, or their folders if there are more than the budget, or if an
    ignore file changed; nothing is lost silently."""
    counts = paths.groupBy(root_col).agg(F.count_distinct(path_col).alias("_n"))
    folder = F.regexp_replace(path_col, r"(^|/)[^/]*$", "")
    wide = (F.col("_n") > budget) | F.col(path_col).rlike(r"(^|/)\.gitignore$")
    joined = paths.join(counts, root_col)
    return joined.select(root_col, F.when(wide, folder).otherwise(F.col(path_col)).alias(path_col), wide.alias("rescan")).distinct()


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, every: str = QUIET) -> StreamingQuery:
    """Run apply on every micro-batch of changes; a batch that fails is delivered again."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
