"""Multi-party perspective rotation of dialogues.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users; only the assistant's turns are marked for training.
Speakers that are in ``system`` give neutral turns in every rendering and take no perspective.
A dialogue of at most ``part`` turns is one row of each speaker. A longer one is cut by the running
number of its turns into parts, one after the other, so that no task holds more than a part,
however long the conversation and whatever its turn numbers. All of it is DataFrame operations.

What is said can't forge a tag: a backslash is put into every "<|" of the words, and before every
backslash, bar and angle bracket of a speaker's name in a tag. ``unescaped`` takes it out again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut

PART = 1024


def escaped(words: Column) -> Column:
    """Words without "<|"."""
    return F.regexp_replace(words, r"<(\\*)\|", r"<\\$1|")


def unescaped(words: Column) -> Column:
    """The words that :func:`escaped` was given."""
    return F.regexp_replace(words, r"<\\(\\*)\|", r"<$1|")


def escaped_name(name: Column) -> Column:
    """A name on one line, without a bare backslash, bar or angle bracket."""
    return F.regexp_replace(F.regexp_replace(name, r"([\\|<>])", r"\\$1"), "\n", r"\\n")


def _placed(rows: DataFrame, sizes: DataFrame, part: int) -> DataFrame:
    """rows with ``part``: the running number of a turn in its conversation, over ``part``.

    Only conversations of more turns are numbered: their rows are range-partitioned in order, counted
    by range, and numbered inside of a range.
    """
    long = cut(sizes.where(F.col("n") > part).select(F.col("conv_id").alias("own_id")))
    if long.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    same = F.col("conv_id").eqNullSafe(F.col("own_id"))
    short = rows.join(bounded(long), same, "left_anti").withColumn("part", F.lit(0).cast("long"))
    order = ["turn", "name", "words", "tie"]
    some = rows.join(bounded(long), same, "left_semi").withColumn("tie", F.monotonically_increasing_id())
    ranged = cut(some.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    each = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = each.select(F.col("conv_id").alias("own_id"), F.col("range").alias("own_range"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    numbered = ranged.withColumn("inside", inside).join(bounded(cut(before)), same & (F.col("range") == F.col("own_range")))
    place = F.col("before") + F.col("inside") - 1
    return short.unionByName(numbered.withColumn("part", F.floor(place / part).cast("long")).select(*rows.columns, "part"))


def rotate(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: tuple[str, ...] = ("system",),
    part: int = PART,
) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_masked, rendered, names, roles, mask, spans).

    Turns are ordered by number, then speaker, then text. rendered is the part's text: for each
    turn its tag, a line feed, its words and a line feed; a dialogue is its parts in order. names,
    roles and mask have an entry for each turn (mask 1: the assistant's). spans are the half-open
    ranges of code points of the assistant's words in rendered. A null speaker is "unknown", a
    null text is empty, a null turn number counts as 0, all rows of a null conversation are one
    conversation; repeated rows are repeated turns. A conversation with system turns only has no
    participant and no row, an empty table gives none, and other columns aren't read.
    """
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("name"),
        F.coalesce(F.col(text), F.lit("")).alias("words"),
    )
    neutral = F.col("name").isin(*system) if system else F.lit(False)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    parts = _placed(rows, sizes, part).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "name", "words"))).alias("turns"))
    # at most a row for each conversation and speaker, folded before the shuffle, and then for each part
    voices = rows.where(~neutral).select("conv_id", F.col("name").alias("perspective")).distinct()
    counted = voices.join(sizes.withColumnRenamed("conv_id", "own_id"), F.col("conv_id").eqNullSafe(F.col("own_id")))
    own = counted.select(F.col("conv_id").alias("own_id"), "perspective", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part))).alias("own_part"))
    both = parts.join(own, F.col("conv_id").eqNullSafe(F.col("own_id")) & (F.col("part") == F.col("own_part"))).drop("own_id", "own_part")

    def role(x):
        tag = F.when(x["name"] == F.col("perspective"), F.lit("assistant"))
        return (tag.when(x["name"].isin(*system), F.lit("system")) if system else tag).otherwise(F.lit("user"))

    def head(x):
        kind = role(x)
        return F.when(kind == "user", F.concat(F.lit("<|user name="), escaped_name(x["name"]), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>\n")))

    both = both.select(
        "conv_id", "perspective", "part",
        F.transform("turns", lambda x: F.struct(role(x).alias("role"), x["name"].alias("name"), head(x).alias("head"), escaped(x["words"]).alias("words"))).alias("said"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("spans"))

    def step(state, x):
        first = state["at"] + F.char_length(x["head"])
        last = first + F.char_length(x["words"])
        span = F.struct(first.cast("long").alias("first"), last.cast("long").alias("last"))
        return F.struct((last + 1).cast("long").alias("at"), F.when(x["role"] == "assistant", F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    mask = F.transform("said", lambda x: (x["role"] == "assistant").cast("int"))
    return both.select(
        "conv_id", "perspective", "part",
        F.size("said").cast("long").alias("n_turns"),
        F.aggregate(mask, F.lit(0), lambda a, b: a + b).cast("long").alias("n_masked"),
        F.concat_ws("", F.transform("said", lambda x: F.concat(x["head"], x["words"], F.lit("\n")))).alias("rendered"),
        F.transform("said", lambda x: x["name"]).alias("names"),
        F.transform("said", lambda x: x["role"]).alias("roles"),
        mask.alias("mask"),
        F.aggregate("said", zero, step, lambda s: s["spans"]).alias("spans"),
    )
