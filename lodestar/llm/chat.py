"""Multi-party chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once: that speaker's turns are the assistant's, the
other speakers' are users' by name, and system turns stay what they are.  A rendered turn is a header, the text and a
closing mark; only the text and closing mark of the assistant's turns are to be learned from, which is what the mask
spans say.  Neither a text nor a name can forge a mark: a backslash goes between the signs of ``<|`` and ``|>`` that they
hold, one more than stands there, so ``unescape`` gives them back.

A rendering is a table of turns with their offsets in the dialogue, so that no conversation, however long, is gathered in
one task: turns are numbered and summed within blocks of consecutive turn numbers (turns that repeat a number, or have
none, within parts of them by hash), and the sums of blocks are carried over a window that has one row for each block.
All of that is done on the texts' lengths and digests; the texts themselves meet their places in a single join.
``render`` joins the turns into whole strings for conversations that are known to be short.

Defined results: a null text is an empty one; a null speaker takes part as ``unknown``; a conversation of system turns
alone has no perspective and no row; turns follow by number, nulls last, then by the MD5 digest of text and speaker, and
repeated rows are turns of their own; the null conversation is one conversation; an empty table gives an empty result; extra columns of the
input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import named

#: Turn numbers of a block, and parts by digest of the turns that have one number.
BLOCK, PARTS = 64, 16
SYSTEM = "system"
UNKNOWN = "unknown"
END = "\n<|end|>\n"


def escape(text: Column) -> Column:
    """text in which no mark begins or ends."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|"), r"\|(\\*)>", r"|\\$1>")


def unescape(text: Column) -> Column:
    """What ``escape`` made it of."""
    return F.regexp_replace(F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|"), r"\|\\(\\*)>", r"|$1>")


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_col, perspective, position, speaker, role, rendered, start, mask_start, mask_end) of every turn as every
    participant sees it.  Offsets count code points of the whole rendered dialogue; a turn that isn't the assistant's has
    an empty mask span at its end."""
    said = turns.select(
        named(conv_col).alias("conv"), named(turn_col).cast("long").alias("turn"),
        F.coalesce(named(role_col).cast("string"), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"),
    )
    said = said.withColumn("digest", F.md5(F.concat_ws("/", "text", "speaker")))
    light = said.select("conv", "turn", "speaker", "digest", F.char_length(escape(F.col("text"))).cast("long").alias("chars"))
    # Equal turns are one row with a count from here on, so each has one row to meet its text by.
    light = light.groupBy("conv", "turn", "speaker", "digest").agg(F.first("chars").alias("chars"), F.count("*").alias("n"))
    light = light.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("part", F.conv(F.substring("digest", 1, 1), 16, 10).cast("int"))
    parties = light.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = light.join(parties, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    label = F.when(role == "user", F.concat(F.lit("user name="), escape(F.col("speaker")))).otherwise(role)
    seen = seen.withColumn("r", role).withColumn("header", F.concat(F.lit("<|"), label, F.lit("|>\n")))
    seen = seen.withColumn("length", F.char_length("header") + F.col("chars") + F.lit(len(END)))
    # What a turn number sums to comes first, then blocks of numbers: no step orders more than a block's rows.
    keys = ["conv", "perspective", "block", "turn", "part"]
    sums = seen.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("length")).alias("chars"))
    tops = sums.groupBy("conv", "perspective", "block").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    before = Window.partitionBy("conv", "perspective").orderBy(F.col("block").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("conv", "perspective", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_top"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("c_top"))
    inside = Window.partitionBy("g", "conv", "perspective", "block").orderBy(F.col("turn").asc_nulls_last(), "part").rowsBetween(Window.unboundedPreceding, -1)
    # The groups are keyed by a hash, so that the join's distribution by conversation isn't taken for theirs.
    sums = sums.withColumn("g", F.xxhash64("conv", "perspective", "block"))
    sums = sums.select(*keys, F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n_in"), F.coalesce(F.sum("chars").over(inside), F.lit(0)).alias("c_in"))
    places = _joined(sums, tops, ["conv", "perspective", "block"])
    places = places.select(*keys, (F.col("n_top") + F.col("n_in")).alias("n_before"), (F.col("c_top") + F.col("c_in")).alias("c_before"))
    own = Window.partitionBy("g", *keys).orderBy("digest", "speaker").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("g", F.xxhash64(*keys))
    seen = seen.withColumn("n_own", F.coalesce(F.sum("n").over(own), F.lit(0))).withColumn("c_own", F.coalesce(F.sum(F.col("n") * F.col("length")).over(own), F.lit(0)))
    placed = _joined(seen, places, keys)
    again = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    placed = placed.select("*", again)
    placed = placed.withColumn("position", F.col("n_before") + F.col("n_own") + F.col("copy")).withColumn("start", F.col("c_before") + F.col("c_own") + F.col("copy") * F.col("length"))
    texts = said.dropDuplicates(["conv", "turn", "speaker", "digest"])
    whole = _joined(placed, texts.select("conv", "turn", "speaker", "digest", escape(F.col("text")).alias("text")), ["conv", "turn", "speaker", "digest"])
    end = F.col("start") + F.col("length")
    mask = F.when(F.col("r") == "assistant", F.col("start") + F.char_length("header")).otherwise(end)
    return whole.select(
        F.col("conv").alias(conv_col), "perspective", F.col("position").cast("long").alias("position"), "speaker", F.col("r").alias("role"),
        F.concat("header", "text", F.lit(END)).alias("rendered"), F.col("start").cast("long").alias("start"), mask.cast("long").alias("mask_start"), end.cast("long").alias("mask_end"),
    )


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with right on keys that may be null; each key stands once in the result."""
    right = right.withColumnsRenamed({k: f"{k}_" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return left.join(right, same).drop(*[f"{k}_" for k in keys])


def render(seen: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, perspective, dialogue, mask): whole strings of conversations known to be short, and the spans to learn
    from."""
    turns = F.array_sort(F.collect_list(F.struct("position", "rendered", "role", "mask_start", "mask_end")))
    whole = seen.groupBy(conv_col, "perspective").agg(turns.alias("turns"))
    own = F.filter("turns", lambda t: t["role"] == "assistant")
    spans = F.transform(own, lambda t: F.struct(t["mask_start"].alias("start"), t["mask_end"].alias("end")))
    return whole.select(conv_col, "perspective", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("dialogue"), spans.alias("mask"))
