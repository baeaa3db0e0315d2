"""Chat formatting by perspective rotation, for dialogues of any number of parties.

Each dialogue is rendered once for every participant: that speaker's turns are
the assistant's, all others are users with their names, and only the
assistant's text carries loss. Turns are rendered row by row and then put
together in segments of consecutive turns, so that a dialogue of millions of
turns is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import materialise

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """Text in which the markers cannot occur: a zero-width space parts ``<|`` from the rest."""
    return F.replace(text, F.lit("<|"), F.lit("<​|"))


def dense_turns(turns: DataFrame, conv: str, turn: str, order: list, ties: list[str], salt_turns: int = 4096, hot_rows: int = 1 << 17) -> DataFrame:
    """Adds ``_nth``, the 0-based place of a row within its dialogue.

    Rows are ranked within stretches of ``salt_turns`` turn numbers and the
    stretches added up, so that a long dialogue is dealt over many tasks. A
    stretch of more than ``hot_rows`` rows, whose turns are null or equal, is
    ranked over several tasks (see :func:`_split_ranks`); ``ties`` are the
    columns of ``order``.
    """
    part = F.floor(F.coalesce(F.col(turn), F.lit(0)) / F.lit(salt_turns))
    parted = turns.withColumn("_part", part)
    sizes = parted.groupBy(conv, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(conv).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(conv).alias("_conv"), F.col("_part").alias("_p"), before.alias("_before"))
    hot = materialise(sizes.where(F.col("_n") > hot_rows).select(F.col(conv).alias("_hot_conv"), F.col("_part").alias("_hot_part")), "hot-turns")
    is_hot = parted[conv].eqNullSafe(hot["_hot_conv"]) & (parted["_part"] == hot["_hot_part"])
    within = F.row_number().over(Window.partitionBy(conv, "_part").orderBy(*order)).cast("long") - 1
    if hot.isEmpty():
        ranked = parted.withColumn("_within", within)
    else:  # at most one row for every ``hot_rows`` rows
        ranked = parted.join(hot, is_hot, "left_anti").withColumn("_within", within).unionByName(_split_ranks(parted.join(hot, is_hot, "left_semi"), conv, order, ties))
    joined = ranked.join(starts, ranked[conv].eqNullSafe(starts["_conv"]) & (ranked["_part"] == starts["_p"]))
    return joined.withColumn("_nth", F.col("_before") + F.col("_within")).drop("_part", "_p", "_conv", "_before", "_within")


def _split_ranks(rows: DataFrame, conv: str, order: list, ties: list[str]) -> DataFrame:
    """Adds ``_within``, the place of a row in its stretch, with a stretch in as many ranges as its size asks for.

    Equal rows are counted first, so any number of them is one row; the ranges
    are written, as other borders would be drawn for them a second time.
    """
    counted = rows.groupBy(conv, "_part", *ties).agg(F.count(F.lit(1)).alias("_copies"))
    ranged = materialise(counted.repartitionByRange(F.col(conv), F.col("_part"), *order).withColumn("_range", F.spark_partition_id()), "turn-ranges")
    sizes = ranged.groupBy(conv, "_part", "_range").agg(F.sum("_copies").alias("_n"))
    upto = Window.partitionBy(conv, "_part").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(conv).alias("_c"), F.col("_part").alias("_p"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first"))
    own = Window.partitionBy(conv, "_part", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_at", F.coalesce(F.sum("_copies").over(own), F.lit(0)))
    joined = placed.join(starts, placed[conv].eqNullSafe(starts["_c"]) & (placed["_part"] == starts["_p"]) & (placed["_range"] == starts["_r"]))
    return joined.withColumn("_within", F.explode(F.sequence(F.col("_first") + F.col("_at"), F.col("_first") + F.col("_at") + F.col("_copies") - 1))).select(*rows.columns, "_within")


def rotate(
    turns: DataFrame, segment: int = 64, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", hot_rows: int = 1 << 17
) -> DataFrame:
    """``conv_id, participant, segment, first_turn, n_turns, text, mask``.

    ``text`` is the segment's turns as ``<|im_start|>who\\ntext<|im_end|>\\n``,
    where ``who`` is ``assistant`` for the participant and ``user name=NAME``
    for everybody else. ``mask`` lists the spans of code points
    ``[start, end)`` of the text that carry loss: what the participant says
    with its end marker. Turns go by number, then role and text; nulls come
    first. A null text is empty; a null role is the participant ``unknown``; a
    null conv_id is one dialogue. Repeated rows are repeated turns. Markers
    inside texts and names are broken up, so they cannot forge a turn.
    ``hot_rows``: see :func:`dense_turns`; it changes no result.
    """
    said = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    people = said.select("conv_id", F.col("role").alias("participant")).distinct()
    placed = dense_turns(said, "conv_id", "turn", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["turn", "role", "text"], hot_rows=hot_rows)
    placed = placed.withColumns({"segment": F.floor(F.col("_nth") / F.lit(segment)).cast("long"), "body": escaped(F.col("text"))})
    parts = placed.groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("_nth", "role", "body"))).alias("said")  # ``segment`` turns at most
    )
    views = parts.join(people.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")

    me = F.col("participant")

    def head(t: Column) -> Column:
        other = F.concat(F.lit("user name="), F.regexp_replace(escaped(t["role"]), r"\s+", "_"))
        return F.concat(F.lit(START), F.when(t["role"] == me, F.lit("assistant")).otherwise(other), F.lit("\n"))

    tail = F.lit(END + "\n")
    pieces = F.transform("said", lambda t: F.struct(head(t).alias("head"), F.concat(t["body"], tail).alias("body"), (t["role"] == me).alias("mine")))
    views = views.withColumn("pieces", pieces)
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    span = "array<struct<start:int,end:int>>"

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        one = F.array(F.struct(start.cast("int").alias("start"), (end - 1).cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(p["mine"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))
    mask = F.aggregate("pieces", zero, step, lambda acc: acc["spans"])
    return views.select("conv_id", "participant", "segment", (F.col("segment") * segment).alias("first_turn"), F.size("said").alias("n_turns"), text.alias("text"), mask.alias("mask"))
