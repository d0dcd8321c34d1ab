"""Per-column profiles.

Columns of a kind are melted to (column, value) and summed in one aggregate, so the number of jobs does not
depend on the number of columns and every aggregate combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.quantiles import exact_quantiles
from quern.functions.stats import plain_missing, unbiased_kurtosis, unbiased_skew

#: Rules of the kinds and sizes of the profile.
TEXT_LENGTH, TEXT_RATIO, TEXT_COUNT = 50, 0.9, 100
BINS, TOP = 20, 5


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def columns_of(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def as_text(name: str, t: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    return F.to_json(c) if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def melt(df: DataFrame, names: list[str], cast: str, keep: list[str] | None = None) -> DataFrame:
    """``column, value`` (and ``keep``), a row per cell of the named columns; NaN as null."""
    kinds = dict(df.dtypes)
    pairs = []
    for n in names:
        field = df.schema[n]
        value = plain_missing(n, kinds[n]).cast(cast) if cast != "string" else (
            as_text(n, field.dataType) if kinds[n] not in ("double", "float") else plain_missing(n, kinds[n]).cast("string")
        )
        pairs.append(F.struct(F.lit(n).alias("column"), value.alias("value")))
    return df.select(*(keep or []), F.inline(F.array(*pairs)))


def numeric_profile(df: DataFrame, names: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Counts, moments, quartiles and outliers of numeric columns.

    Quartiles are exact and linear (``approx`` saves a pass).  Fences are 1.5 interquartile
    ranges from the quartiles, and values beyond them are outliers; a zero range has neither.
    """
    names = names or columns_of(df, is_numeric)
    cells = melt(df, names, "double")
    x = F.col("value")
    probs = [0.25, 0.5, 0.75]
    quartiles = F.percentile_approx(x, probs, 10_000) if approx else F.lit(None).cast("array<double>")
    moments = cells.groupBy("column").agg(
        F.count(x).alias("count"), F.sum(x.isNull().cast("long")).alias("missing"), F.avg(x).alias("mean"),
        F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        quartiles.alias("q"), F.count_if(x == 0).alias("zeros"), F.count_if(x < 0).alias("negatives"),
        unbiased_skew(x).alias("skew"), unbiased_kurtosis(x).alias("kurtosis"),
    )
    if not approx:  # a row per column
        moments = moments.drop("q").join(F.broadcast(exact_quantiles(cells, "column", "value", probs)), "column", "left")
    moments = moments.select("*", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75")).drop("q")
    moments = moments.withColumn("iqr", F.col("p75") - F.col("p25"))
    moments = moments.withColumn("outlier_low", F.when(F.col("iqr") > 0, F.col("p25") - 1.5 * F.col("iqr")))
    moments = moments.withColumn("outlier_high", F.when(F.col("iqr") > 0, F.col("p75") + 1.5 * F.col("iqr")))
    # distinct values and outliers: sums over value counts, which are also what top values need
    values = cells.where(x.isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    fenced = values.join(F.broadcast(moments.select("column", "outlier_low", "outlier_high")), "column")
    outside = (x < F.col("outlier_low")) | (x > F.col("outlier_high"))
    counted = fenced.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique"), F.sum(F.when(outside, F.col("n")).otherwise(F.lit(0))).alias("outliers")
    )
    return moments.join(F.broadcast(counted), "column", "left").fillna(0, ["unique", "outliers"])


def histogram(df: DataFrame, names: list[str] | None = None, bins: int = BINS) -> DataFrame:
    """``column, bin, low, high, count``: equal bins over the finite range, the last one closed; one bin if constant."""
    names = names or columns_of(df, is_numeric)
    x = F.col("value")
    cells = melt(df, names, "double").where(x.isNotNull() & (F.abs(x) < float("inf")))
    ranges = cells.groupBy("column").agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    ranges = ranges.withColumn("bins", F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins)).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("bins"))
    number = F.when(F.col("bins") == 1, 0).otherwise(F.least(F.floor((x - F.col("lo")) / F.col("w")).cast("int"), F.col("bins") - 1))
    counts = cells.join(F.broadcast(ranges), "column").groupBy("column", number.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = ranges.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    full = every.join(counts, ["column", "bin"], "left")
    return full.select(
        "column", "bin", (F.col("lo") + F.col("w") * F.col("bin")).alias("low"), (F.col("lo") + F.col("w") * (F.col("bin") + 1)).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def value_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return melt(df, names or df.columns, "string").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, names: list[str] | None = None, top: int = TOP) -> DataFrame:
    """The most frequent values as text, ties by value.

    A column may have as many values as rows, so the first ``top`` are taken per column and bucket of values
    before they meet: no task sorts a whole column.
    """
    counts = value_counts(df, names)
    order = [F.desc("count"), F.asc("value")]
    bucket = counts.withColumn("b", F.pmod(F.xxhash64("value"), F.lit(64)))
    first = bucket.withColumn("r", F.row_number().over(Window.partitionBy("column", "b").orderBy(*order))).where(f"r <= {top}")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).where(f"rank <= {top}")
    return ranked.select("column", "rank", "value", "count")


def unique_missing(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``column, count, missing, unique``."""
    cells = melt(df, names or df.columns, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    return cells.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"), F.count_if(present).alias("unique"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``rows, duplicate_rows``: rows beyond the first of each group of equal rows, nulls equal."""
    row = df.select(*[as_text(f.name, f.dataType).alias(f"c{i}") if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType)) else F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    groups = row.groupBy(*row.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def text_lengths(df: DataFrame, names: list[str]) -> DataFrame:
    size = F.length("value")
    return melt(df, names, "string").groupBy("column").agg(
        F.count("value").alias("count"), F.avg(size).alias("mean_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length")
    )


def datetime_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """``column, count, missing, min_epoch, max_epoch, span_days``; times without zone are taken as UTC."""
    parts = []
    for n in names:
        t = F.col(f"`{n}`")
        text = F.date_format(t.cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        parts.append(F.struct(F.lit(n).alias("column"), (F.unix_micros(F.to_utc_timestamp(F.to_timestamp(text), F.current_timezone())) / 1e6).alias("value")))
    x = F.col("value")
    return df.select(F.inline(F.array(*parts))).groupBy("column").agg(
        F.count(x).alias("count"), F.sum(x.isNull().cast("long")).alias("missing"), F.min(x).alias("min_epoch"), F.max(x).alias("max_epoch"),
        ((F.max(x) - F.min(x)) / 86400).alias("span_days"),
    )


def column_kinds(df: DataFrame) -> DataFrame:
    """``column, kind``: numeric, boolean, datetime, categorical, text or empty.

    Strings are text if they are long on average, or nearly all different in more than a handful of rows.
    """
    names = df.columns
    base = {f.name: "numeric" if is_numeric(f.dataType) else "boolean" if isinstance(f.dataType, T.BooleanType) else
            "datetime" if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "string" for f in df.schema.fields}
    counts = melt(df, names, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    facts = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("count"), F.count("value").alias("unique"),
        F.try_divide(F.sum(F.length("value") * F.col("n")), F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean_length"),
    )
    kind = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])[F.col("column")]
    text = (F.col("mean_length") > TEXT_LENGTH) | ((F.col("unique") / F.col("count") > TEXT_RATIO) & (F.col("count") > TEXT_COUNT))
    return facts.select(
        "column",
        F.when(F.col("count") == 0, "empty").when(kind != "string", kind).when(text, "text").otherwise("categorical").alias("kind"),
        "count", "unique",
    )
