"""Drift between two tables, from their (bounded) profiles joined on the column name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import profile as P

#: Limits of the drift findings.
MISSING_POINTS, SHIFT_INFO, SHIFT_WARN, CARDINALITY, SHARE_POINTS, ROW_RATIO = 5.0, 0.10, 0.5, 0.5, 15.0, 2.0


def snapshot(df: DataFrame) -> DataFrame:
    """``column, kind, count, missing, unique, mean, std, top`` (five values and counts) of every column."""
    numeric = P.columns_of(df, P.is_numeric)
    base = P.column_kinds(df).join(P.unique_missing(df).select("column", "missing"), "column")
    if numeric:
        stats = P.melt(df, numeric, "double").groupBy("column").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
        base = base.join(F.broadcast(stats), "column", "left")
    else:
        base = base.withColumns({"mean": F.lit(None).cast("double"), "std": F.lit(None).cast("double")})
    top = P.top_values(df).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("top"))
    return base.join(F.broadcast(top), "column", "left")


SNAPSHOT = "column string, kind string, count bigint, missing bigint, unique bigint, mean double, std double, top array<struct<rank:int,value:string,count:bigint>>"


def snapshot_of_profile(spark: SparkSession, saved) -> DataFrame:
    """The snapshot that a saved profile holds: a row per column, without the data."""
    rows = [
        (c.name, c.kind, c.count, c.missing, c.unique, c.stats.get("mean"), c.stats.get("std"), [(i + 1, v, n) for i, (v, n) in enumerate(c.top_values)])
        for c in saved.columns
    ]
    return spark.createDataFrame(rows, SNAPSHOT)


def drift_of_sides(before: tuple[DataFrame, int], after: tuple[DataFrame, int]) -> DataFrame:
    """Drift between two snapshots with their tables' numbers of rows."""
    spark = before[0].sparkSession
    rows = (spark.createDataFrame([(side[1],)], f"n{k} bigint") for k, side in enumerate((before, after)))
    return drift_of_snapshots(before[0], after[0]).unionByName(_row_count_drift(*rows))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """``kind, severity, column, value, metric``, a row per finding; ``value`` is the new category where there is one."""
    return drift_of_snapshots(snapshot(before), snapshot(after)).unionByName(row_count_drift(before, after))


def row_count_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    return _row_count_drift(*(d.agg(F.count(F.lit(1)).alias(c)) for d, c in ((before, "n0"), (after, "n1"))))


def _row_count_drift(n0: DataFrame, n1: DataFrame) -> DataFrame:
    ratio = F.try_divide(F.col("n1").cast("double"), F.col("n0"))
    both = n0.crossJoin(n1)  # one row each
    return both.where((ratio > ROW_RATIO) | (ratio < 1 / ROW_RATIO) | (ratio.isNull() & (F.col("n1") > 0))).select(*_row("row-count-changed", "warn", F.lit(None), ratio))


def _row(kind: str, severity: Column | str, column: Column, metric: Column, value: Column | None = None) -> list[Column]:
    return [
        F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), column.cast("string").alias("column"),
        (F.lit(None).cast("string") if value is None else value).alias("value"), metric.cast("double").alias("metric"),
    ]


def drift_of_snapshots(a: DataFrame, b: DataFrame) -> DataFrame:
    old = a.select("column", *[F.col(c).alias(f"{c}0") for c in a.columns if c != "column"], F.lit(True).alias("in0"))
    new = b.select("column", *[F.col(c).alias(f"{c}1") for c in b.columns if c != "column"], F.lit(True).alias("in1"))
    both = old.join(new, "column", "full")
    col, null = F.col("column"), F.lit(None)
    parts = [
        both.where("in1 is null").select(*_row("column-removed", "high", col, null)),
        both.where("in0 is null").select(*_row("column-added", "info", col, null)),
        both.where("kind0 <> kind1").select(*_row("type-changed", "high", col, null)),
    ]
    same = both.where("kind0 = kind1")
    share = lambda k: F.coalesce(F.try_divide(100.0 * F.col(f"missing{k}"), F.col(f"count{k}") + F.col(f"missing{k}")), F.lit(0.0))
    change = share(1) - share(0)
    parts.append(same.where(F.abs(change) >= MISSING_POINTS).select(*_row("missingness-changed", F.when(change > 0, "warn").otherwise("info"), col, change)))
    scale = F.when(F.col("std0") > 0, F.col("std0")).when(F.col("mean0") != 0, F.abs("mean0")).otherwise(F.lit(1.0))
    shift = (F.col("mean1") - F.col("mean0")) / scale
    numbers = same.where("kind0 = 'numeric'").withColumn("shift", shift)
    parts.append(numbers.where(F.abs("shift") >= SHIFT_INFO).select(*_row("distribution-shifted", F.when(F.abs("shift") >= SHIFT_WARN, "warn").otherwise("info"), col, F.col("shift"))))
    labels = same.where("kind0 in ('categorical', 'boolean')")
    ratio = F.try_divide(F.col("unique1").cast("double"), F.col("unique0")) - 1
    parts.append(labels.where(F.abs(ratio) >= CARDINALITY).select(*_row("cardinality-changed", "warn", col, ratio)))
    fresh = F.array_except(F.col("top1")["value"], F.col("top0")["value"])
    parts.append(labels.select("*", F.explode(fresh).alias("fresh")).select(*_row("new-categories", "warn", col, null, F.col("fresh"))))
    mode = lambda k: 100.0 * F.get(F.col(f"top{k}"), F.lit(0))["count"] / F.col(f"count{k}")
    parts.append(labels.where(F.abs(mode(1) - mode(0)) >= SHARE_POINTS).select(*_row("category-share-changed", "info", col, mode(1) - mode(0))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
