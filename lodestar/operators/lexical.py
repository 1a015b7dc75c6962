"""Exhaustive line search: regular expressions over all lines, in path order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utf16_length


def _without_end(text: Column) -> Column:
    """text without its closing line end, of which there is one at most; empty lines before it stay."""
    return F.regexp_replace(text, r"\n\z", "")


def lines(docs: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line, content): the lines of each text from 1 on; a closing line end begins no line of its own."""
    whole = _without_end(F.coalesce(F.col(text_col), F.lit("")))
    split = docs.where(F.coalesce(F.char_length(text_col), F.lit(0)) > 0).select(F.col(path_col).alias("path"), F.posexplode(F.split(whole, "\n")))
    return split.select("path", (F.col("pos") + 1).alias("line"), F.regexp_replace("col", "\r$", "").alias("content"))


def grep(docs: DataFrame, regex: str, path_col: str = "path", text_col: str = "text", max_count: int | None = None) -> DataFrame:
    """(path, line, content, start_column, end_column) of matching lines, with the first match's columns in UTF-16 units.

    A text without any match is dropped before its lines are made; max_count keeps a text's first matching lines.
    """
    some = docs.where(F.col(text_col).rlike("(?m)" + regex))
    found = lines(some, path_col, text_col).where(F.col("content").rlike(regex))
    before, hit = _split_at(F.col("content"), regex)
    found = found.withColumn("start_column", utf16_length(before)).withColumn("end_column", F.col("start_column") + utf16_length(hit))
    return first_of_each(found, max_count)


def first_of_each(found: DataFrame, max_count: int | None) -> DataFrame:
    """The first matching lines of each path."""
    if max_count is None:
        return found
    order = Window.partitionBy("path").orderBy("line")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_count).drop("_n")


def _split_at(content: Column, regex: str) -> tuple[Column, Column]:
    """What stands before a line's first match, and the match."""
    flags = regex[: regex.index(")") + 1] if regex.startswith("(?") and regex[2:3] in "iu" else ""
    body = regex[len(flags) :]
    hit = F.regexp_extract(content, f"{flags}({body})", 1)
    return F.regexp_extract(content, f"{flags}(?s)^(.*?)(?:{body})", 1), hit


def limited(found: DataFrame, limit: int) -> DataFrame:
    """The first matches by path and line, and whether there are more: one match beyond the limit is looked for."""
    few = found.orderBy("path", "line").limit(limit + 1)
    order = Window.orderBy("path", "line")
    ranked = few.withColumn("rank", F.row_number().over(order))
    more = ranked.agg((F.max("rank") > limit).alias("truncated"))
    return ranked.where(F.col("rank") <= limit).crossJoin(F.broadcast(more))  # a single row


def grep_context(docs: DataFrame, regex: str, before: int, after: int, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, line, content, start_column, end_column, first_line, last_line, context) of matching lines: the first and
    last line of each one's context, and their text.

    Contexts are cut out while a text's lines are in hand, so no text is shuffled, and only matching lines become rows.
    """
    some = docs.where(F.col(text_col).rlike("(?m)" + regex)).select(F.col(path_col).alias("path"), F.split(_without_end(F.col(text_col)), "\n").alias("_lines"))
    numbered = F.transform("_lines", lambda x, i: F.struct((i + 1).alias("line"), F.regexp_replace(x, "\r$", "").alias("content")))
    hits = some.select("path", "_lines", F.filter(numbered, lambda h: h["content"].rlike(regex)).alias("_hits"))

    def around(h: Column) -> Column:
        first, last = F.greatest(F.lit(1), h["line"] - before), F.least(F.size("_lines"), h["line"] + after)
        context = F.array_join(F.slice("_lines", first, last - first + 1), "\n")
        return F.struct(h["line"].alias("line"), h["content"].alias("content"), first.alias("first_line"), last.alias("last_line"), context.alias("context"))

    found = hits.select("path", F.inline(F.transform("_hits", around)))
    head, hit = _split_at(F.col("content"), regex)
    found = found.withColumn("start_column", utf16_length(head))
    return found.withColumn("end_column", F.col("start_column") + utf16_length(hit))


#: Lines of a node of the next level for one of a level, and the levels: nodes of the last hold all lines there can be.
FAN, LEVELS = 16, 8


def _at_level(nodes: Column, level: int) -> Column:
    return F.transform(nodes, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))


def _nodes(first: Column, last: Column) -> Column:
    """The fewest nodes (level, node) that make up a range of lines: at each level those that lie in the range, but not in a
    larger node that does.  At most 2 * (FAN - 1) a level, and no array of lines is made."""
    out = []
    inside = lambda size: (F.ceil(first / size), F.floor((last + 1) / size) - 1)
    some = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    for level in range(LEVELS):
        lo, hi = inside(FAN**level)
        up_lo, up_hi = inside(FAN ** (level + 1))
        split = (up_lo <= up_hi) if level + 1 < LEVELS else F.lit(False)
        left = F.when(split, some(lo, up_lo * FAN - 1)).otherwise(some(lo, hi))
        right = F.when(split, some((up_hi + 1) * FAN, hi)).otherwise(F.array().cast("array<bigint>"))
        out.append(_at_level(F.concat(left, right), level))
    return F.flatten(F.array(*out))


def containers(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, line, container, span): the smallest range of the same path that holds each match's line; ties go to the more
    specific, then the id.

    ranges has path, id, start_line, end_line and specificity.  A range is a few nodes of a tree over the lines, and a line
    lies in one node of each level, so they meet by equality, each pair once: a path with many matches and many ranges isn't
    all their pairs, and isn't one key.  The choice is an aggregation, so nothing is sorted.
    """
    wide = lambda c: F.col(c).cast("long")
    r = ranges.where(wide("start_line") <= wide("end_line")).select(F.col("path").alias("_path"), F.col("id").alias("container"), wide("start_line").alias("start_line"), wide("end_line").alias("end_line"), "specificity")
    r = r.select("*", F.inline(_nodes(F.col("start_line"), F.col("end_line"))))
    lines_ = found.select("path", "line").distinct()
    above = F.array(*[F.struct(F.lit(k).alias("_level"), F.floor(wide("line") / FAN**k).alias("_node")) for k in range(LEVELS)])
    asked = lines_.select("path", "line", F.inline(above))
    joined = asked.join(r, (F.col("path") == F.col("_path")) & (F.col("_level") == F.col("level")) & (F.col("_node") == F.col("node")), "left")
    best = F.min(F.when(F.col("container").isNotNull(), F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("specificity")).alias("s"), F.col("container"))))
    return joined.groupBy("path", "line").agg(best.alias("_best")).select("path", "line", F.col("_best.container").alias("container"), F.col("_best.span").alias("span"))
