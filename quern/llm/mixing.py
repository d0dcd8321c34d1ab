"""Mixing sources to target weights.

Word totals per source give a repetition rate per source; a document is emitted floor(rate) times, plus one
copy if a hash of its id and the seed falls below the fraction.  Only sums per source are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Work, checked_broadcast, word_count


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``source, source_size, target`` per source, from rows with ``source`` and ``size``.

    Sources in code-point order (null last) weigh ``weights``, repeating, and share ``share`` of all sizes; no
    target passes ``cap`` times its source's size, and what that leaves over is shared again by weight.  That
    fixed point is a water level: with sources ordered by size per weight, the first whose cap is not reached
    by the level left for it and those after it sets the level for all of them.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    )
    sums = sums.withColumn("w", weight)
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    size = F.col("source_size").cast("double")
    filled = sums.select(
        "source", "source_size", "w",
        (F.sum(size).over(everything) * F.lit(share) - F.coalesce(F.sum(size).over(before), F.lit(0.0)) * F.lit(cap)).alias("rest"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("w_rest"),
        F.row_number().over(order).alias("k"),
    ).withColumn("level", F.col("rest") / F.col("w_rest"))
    open_ = F.col("level") * F.col("w") <= size * cap
    first = filled.withColumn("k0", F.min(F.when(open_, F.col("k"))).over(everything))
    level = first.withColumn("at", F.max(F.when(F.col("k") == F.col("k0"), F.col("level"))).over(everything))
    target = F.when(F.col("k0").isNull() | (F.col("k") < F.col("k0")), size * cap).otherwise(
        F.least(F.col("w") * F.col("at"), size * cap)
    )
    return level.select("source", "source_size", target.alias("target"))


def copies(rate: Column, key: Column, seed: str) -> Column:
    """floor(rate), plus one with probability of the fraction, decided by a hash of seed and key alone."""
    whole = F.floor(rate)
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    chance = F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))
    return (whole + (chance < rate - whole).cast("long")).cast("long")


def _rates(targets: DataFrame) -> DataFrame:
    """``q_source, q_size, q_target, q_rate`` per source; a source without words has rate 0."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return targets.select(
        F.col("source").alias("q_source"), F.col("source_size").alias("q_size"), F.col("target").alias("q_target"), rate.alias("q_rate")
    )


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``, ``id_col`` and ``_size, _source_size, _target, _copies``.

    A null text has size 0; null is a source of its own, the last; rows with the same id get the same decision, also
    null ids, which count as the empty text; a source without words has target 0.  An empty table stays empty.  Other
    columns are not read and may have any name.

    The words taken of a source come near its target, not on it: whether the fraction of the rate r gives a document
    of n words one copy more is a coin, so the sum spreads by the root of the sum of n * n * f * (1 - f), f = r - floor(r).
    That is below 0.5 * sqrt(source size * longest text) and vanishes against the target as sources grow.
    """
    work = Work(docs.sparkSession, "mix")
    # the texts are read once; ids, sources and sizes are narrow
    sized = work.save(docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size")), "sizes")
    rates = _rates(source_targets(sized, weights, share, cap))
    joined = sized.join(checked_broadcast(rates), sized["source"].eqNullSafe(F.col("q_source")), "left")
    return joined.select(
        F.col("id").alias(id_col), F.col("size").alias("_size"), F.col("q_size").alias("_source_size"), F.col("q_target").alias("_target"),
        copies(F.col("q_rate"), F.col("id"), seed).alias("_copies"),
    )


def mix_documents(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``plan_mix`` plans it, with the columns of ``docs``, whatever their names.

    Sizes are summed in one pass; copies need a row's id and its source's rate alone, so the second pass emits rows.
    """
    sized = docs.select(docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    rates = Work(docs.sparkSession, "mix").save(_rates(source_targets(sized, weights, share, cap)), "rates")
    given = docs.select(docs[id_col].alias("q_id"), docs[source_col].alias("q_of"), F.struct(*[docs[c] for c in docs.columns]).alias("q_row"))
    joined = given.join(checked_broadcast(rates), F.col("q_of").eqNullSafe(F.col("q_source")), "left")
    again = F.explode(F.array_repeat(F.lit(0), copies(F.col("q_rate"), F.col("q_id"), seed).cast("int"))).alias("q_again")
    return joined.select("q_row", again).select("q_row.*")
