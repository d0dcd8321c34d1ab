"""Exact quantiles without a buffer of all values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rank error of the brackets is one in so many.
ACCURACY = 20_000


def exact_quantiles(cells: DataFrame, by: str, value: str, probs: list[float]) -> DataFrame:
    """``by, q``: exact linear quantiles of the non-null numbers in ``value`` per ``by``.

    Approximate quantiles on either side bracket each wanted one.  Then values inside of a bracket are counted one by
    one and all between two brackets together, with map-side combining, and a window over these few thousandths of the
    values finds the wanted ranks.  Two passes at any size; no task holds a column.
    """
    x, slack = F.col(value), 4 / ACCURACY
    given = cells.where(x.isNotNull()).select(F.col(by), x.cast("double").alias(value))
    ends = [min(max(p + side, 0.0), 1.0) for p in probs for side in (-slack, slack)]
    brackets = given.groupBy(by).agg(F.percentile_approx(x, ends, ACCURACY).alias("_ends"), F.count(x).alias("_total"))
    low = lambda i: F.col("_ends")[2 * i]
    high = lambda i: F.col("_ends")[2 * i + 1]
    inside, beyond = F.lit(False), F.lit(0)
    for i in range(len(probs)):
        inside = inside | ((x >= low(i)) & (x <= high(i)))
        beyond = beyond + (x > high(i)).cast("int")
    met = given.join(F.broadcast(brackets), by).groupBy(by, F.when(inside, x).alias("_one"), F.when(~inside, beyond).alias("_gap"))
    counts = met.agg(F.count(F.lit(1)).alias("_n"), F.min(x).alias("_at"), F.max(x).alias("_top"), F.first("_total").alias("_total"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    placed = counts.withColumn("_before", before)
    last = F.col("_before") + F.col("_n") - 1

    def at(k):
        """The value at rank ``k``: a bracket's end may miss it by one in a small group, where it is an end of a gap."""
        known = F.when((F.col("_at") == F.col("_top")) | (k == F.col("_before")), F.col("_at")).when(k == last, F.col("_top"))
        return F.max(F.when((F.col("_before") <= k) & (k <= last), known.otherwise(F.raise_error(F.lit("a quantile lies outside of its bracket")))))

    found = []
    for p in probs:
        rank = (F.col("_total") - 1) * F.lit(float(p))
        floor, ceil = F.floor(rank), F.ceil(rank)
        one, two = at(floor), at(ceil)
        found.append(F.when(one == two, one).otherwise((F.max(ceil) - F.max(rank)) * one + (F.max(rank) - F.max(floor)) * two))
    return placed.groupBy(by).agg(F.array(*found).alias("q"))
