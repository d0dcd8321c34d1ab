"""Data-quality findings, as rows ``kind, severity, columns, metric``.

Predicates on a profile are projections of bounded tables; those on the data are one aggregate each.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import profile as P
from quern.operators import metrics, recipe_ops

#: The order of severities.
RANKS = {"high": 0, "warn": 1, "info": 2}


@dataclass(frozen=True)
class Thresholds:
    tiny_rows: int = 50
    duplicate_warn: float = 1.0
    missing_high: float = 50.0
    missing_warn: float = 5.0
    identifier_count: int = 10
    cardinality: int = 50
    cardinality_ratio: float = 0.5
    skew_info: float = 2.0
    skew_warn: float = 5.0
    outlier_info: float = 1.0
    outlier_warn: float = 5.0
    correlation: float = 0.95
    pair_columns: int = 200
    parse_share: float = 0.95
    imbalance_high: float = 0.05
    imbalance_warn: float = 0.20
    class_limit: int = 20
    leak_correlation: float = 0.98
    leak_rows: int = 10
    leak_coverage: float = 0.5
    leak_repeats: int = 3


DEFAULT = Thresholds()


def _finding(kind: Column | str, severity: Column | str, columns: Column, metric: Column) -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [lit(kind).alias("kind"), lit(severity).alias("severity"), columns.alias("columns"), metric.cast("double").alias("metric")]


def _steps(value: Column, *steps: tuple[float, str]) -> Column:
    """The severity of the first limit that ``value`` reaches, null if it reaches none."""
    out = None
    for limit, name in steps:
        out = F.when(value >= limit, name) if out is None else out.when(value >= limit, name)
    return out


def dataset_shape(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    d = P.duplicate_rows(df)
    share = F.try_divide(100.0 * F.col("duplicate_rows"), F.col("rows"))
    none = F.array().cast("array<string>")
    tiny = d.where(F.col("rows") < t.tiny_rows).select(*_finding("tiny-dataset", "warn", none, F.col("rows")))
    twice = d.where("duplicate_rows > 0").select(*_finding("duplicate-rows", F.when(share >= t.duplicate_warn, "warn").otherwise("info"), none, F.col("duplicate_rows")))
    return tiny.unionByName(twice)


def column_quality(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Empty, constant, missing, identifier-like and high-cardinality columns."""
    facts = P.column_kinds(df).join(F.broadcast(P.unique_missing(df).select("column", "missing")), "column")
    n = F.col("count") + F.col("missing")
    gone = F.try_divide(100.0 * F.col("missing"), n)
    full = facts.where("kind <> 'empty'")
    name = F.array("column")
    parts = [facts.where("kind = 'empty'").select(*_finding("empty-column", "high", name, F.lit(100.0)))]
    parts.append(full.where("unique = 1").select(*_finding("constant-column", "high", name, F.lit(1.0))))
    missing = F.when(gone >= t.missing_high, "high").when(gone >= t.missing_warn, "warn").otherwise("info")
    parts.append(full.where("missing > 0").select(*_finding(F.when(gone >= t.missing_high, "high-missing").otherwise("missing"), missing, name, gone)))
    ident = F.col("kind").isin("categorical", "text") & (F.col("unique") == F.col("count")) & (F.col("count") > t.identifier_count) & (gone < 50)
    parts.append(full.where(ident).select(*_finding("identifier-like", "info", name, F.col("unique"))))
    many = ~ident & (F.col("kind") == "categorical") & (F.col("unique") >= t.cardinality) & (F.col("unique") / F.col("count") >= t.cardinality_ratio)
    parts.append(full.where(many).select(*_finding("high-cardinality", "warn", name, F.col("unique"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distribution(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Skewed columns and columns with outliers."""
    stats = P.numeric_profile(df)
    skew = stats.withColumn("s", F.abs("skew")).where(F.col("s") >= t.skew_info)
    share = stats.withColumn("s", F.try_divide(100.0 * F.col("outliers"), F.col("count"))).where(F.col("s") >= t.outlier_info)
    return skew.select(*_finding("high-skew", F.when(F.col("s") >= t.skew_warn, "warn").otherwise("info"), F.array("column"), F.col("skew"))).unionByName(
        share.select(*_finding("outliers", F.when(F.col("s") >= t.outlier_warn, "warn").otherwise("info"), F.array("column"), F.col("s")))
    )


def duplicate_columns(df: DataFrame) -> DataFrame:
    """``column, duplicate_of``: columns of one type whose values agree in every row, nulls equal.

    An order-free signature of each column finds candidates in one aggregate; a second one confirms them.
    """
    kinds = dict(df.dtypes)
    text = {f.name: P.as_text(f.name, f.dataType) for f in df.schema.fields}
    sign = df.agg(*[F.sum(F.xxhash64(F.coalesce(text[n], F.lit("\0null"))).cast("decimal(38,0)")).alias(f"s{i}") for i, n in enumerate(df.columns)]).first()
    groups: dict[tuple, list[str]] = {}
    for i, n in enumerate(df.columns):
        groups.setdefault((kinds[n], sign[i]), []).append(n)
    pairs = [(g[0], n) for g in groups.values() for n in g[1:] if sign[0] is not None]
    schema = "column string, duplicate_of string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    same = df.agg(*[F.bool_and(text[a].eqNullSafe(text[b])).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return df.sparkSession.createDataFrame([(b, a) for i, (a, b) in enumerate(pairs) if same[i]], schema)


def correlated_pairs(df: DataFrame, names: list[str] | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """``left, right, correlation`` of numeric columns, over rows where both have values: one aggregate for all pairs.

    Beyond ``pair_columns`` columns nothing is compared, which ``analysis_skipped`` reports.
    """
    names = names or P.columns_of(df, P.is_numeric)
    schema = "left string, right string, correlation double"
    pairs = list(combinations(names, 2)) if len(names) <= t.pair_columns else []
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    spread = lambda a, b: (F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) > 0) & (F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b))) > 0)
    corr = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.when(spread(a, b), F.corr(a, b)).alias("correlation")) for a, b in pairs]
    return df.agg(F.array(*corr).alias("x")).select(F.inline("x")).where(F.abs("correlation") >= t.correlation)


def analysis_skipped(df: DataFrame, t: Thresholds = DEFAULT) -> bool:
    return len(df.columns) > t.pair_columns


#: What is stripped from numbers in text, and the shape of a date in text.
NUMBER_DRESS = r"[,\s$€£¥%_]"


def to_number(c: Column) -> Column:
    """A number written in text, with currency signs and separators stripped; null if it is none."""
    text = c.cast("string")
    x = F.coalesce(text.try_cast("double"), F.regexp_replace(text, NUMBER_DRESS, "").try_cast("double"))
    return F.nanvl(x, F.lit(None).cast("double"))


def to_moment(c: Column) -> Column:
    """A date or time written in text, as recipes cast it; null if none fits."""
    return recipe_ops.parsed_moment(c)


def text_encoded(df: DataFrame, names: list[str] | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """``column, kind, share``: string columns that hold numbers, or else dates."""
    names = names or [n for n, k in df.dtypes if k == "string"]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, kind string, share double")
    v = F.col("value")
    shares = P.melt(df, names, "string").where(v.isNotNull()).groupBy("column").agg(
        F.avg(to_number(v).isNotNull().cast("double")).alias("numbers"), F.avg(to_moment(v).isNotNull().cast("double")).alias("dates")
    )
    kind = F.when(F.col("numbers") >= t.parse_share, "numeric-stored-as-text").when(F.col("dates") >= t.parse_share, "datetime-stored-as-text")
    return shares.select("column", kind.alias("kind"), F.when(F.col("numbers") >= t.parse_share, F.col("numbers")).otherwise(F.col("dates")).alias("share")).where("kind is not null")


def mixed_types(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``column, types``: VARIANT columns whose values are of several types, sorted; a null is of none.

    Other columns hold one type by their schema.  One narrow aggregate: a column has few types.
    """
    names = names if names is not None else [n for n, k in df.dtypes if k == "variant"]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, types array<string>")
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.regexp_extract(F.schema_of_variant(F.col(f"`{n}`")), "^[A-Z_]+", 0).alias("type")) for n in names])
    each = df.select(F.inline(cells)).where("type <> 'VOID'").groupBy("column").agg(F.sort_array(F.collect_set("type")).alias("types"))
    return each.where(F.size("types") > 1)


def class_imbalance(df: DataFrame, target: str, t: Thresholds = DEFAULT) -> DataFrame:
    """``classes, min_share, severity`` of a classification target; empty if it is balanced or has one class."""
    shares = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    facts = shares.agg(F.count(F.lit(1)).alias("classes"), (F.min("n") / F.sum("n")).alias("min_share"))
    numeric = P.is_numeric(df.schema[target].dataType)
    severity = F.when(F.col("min_share") < t.imbalance_high, "high").when(F.col("min_share") < t.imbalance_warn, "warn")
    shaped = (F.col("classes") >= 2) & (F.lit(not numeric) | (F.col("classes") <= t.class_limit))
    return facts.where(shaped).select("classes", "min_share", severity.alias("severity")).where("severity is not null")


def leakage_correlation(df: DataFrame, target: str, t: Thresholds = DEFAULT) -> DataFrame:
    """``column, correlation`` of numeric features that nearly equal a numeric target."""
    names = [n for n in P.columns_of(df, P.is_numeric) if n != target]
    y = F.col(target)
    cells = [F.struct(F.lit(n).alias("column"), F.when((F.stddev_pop(F.when(y.isNotNull(), F.col(n))) > 0) & (F.stddev_pop(F.when(F.col(n).isNotNull(), y)) > 0), F.corr(n, target)).alias("correlation")) for n in names]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.array(*cells).alias("x")).where(F.col("rows") >= t.leak_rows).select(F.inline("x")).where(
        F.abs("correlation") >= t.leak_correlation
    )


def leakage_partition(df: DataFrame, target: str, names: list[str] | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """``column, unique, coverage``: features whose every value goes with one class, in one melted aggregate."""
    names = [n for n in (names or df.columns) if n != target]
    known = df.where(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("string"))
    total = known.agg(F.count(F.lit(1)).alias("rows"))
    cells = P.melt(known, names, "string", ["_y"]).where("value is not null").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("_y").alias("lo"), F.max("_y").alias("hi")
    )
    facts = cells.groupBy("column").agg(F.count(F.lit(1)).alias("unique"), F.sum("n").alias("n"), F.bool_and(F.col("lo") == F.col("hi")).alias("pure"))
    joined = facts.crossJoin(F.broadcast(total))  # one row
    good = F.col("pure") & (F.col("unique") >= 2) & (F.col("n") / F.col("unique") >= t.leak_repeats) & (F.col("n") / F.col("rows") >= t.leak_coverage)
    return joined.where(good).select("column", "unique", (F.col("n") / F.col("rows")).alias("coverage"))


def detect_findings(df: DataFrame, target: str | None = None, t: Thresholds = DEFAULT) -> DataFrame:
    """All findings, the most severe first (``rank``).

    VARIANT columns are looked at as JSON text.  Features that the correlation with the target has flagged are not
    flagged again for parting its classes, and only a classification target is parted.
    """
    several = mixed_types(df).select(*_finding("mixed-types", "warn", F.array("column"), F.size("types")))
    df = df.withColumns({n: F.to_json(F.col(f"`{n}`")) for n, k in df.dtypes if k == "variant"})
    parts = [several, dataset_shape(df, t), column_quality(df, t)]
    if P.columns_of(df, P.is_numeric):
        parts.append(distribution(df, t))
    parts.append(duplicate_columns(df).select(*_finding("duplicate-columns", "warn", F.array("duplicate_of", "column"), F.lit(1.0))))
    if analysis_skipped(df, t):
        parts.append(df.sparkSession.range(1).select(*_finding("analysis-skipped", "info", F.array().cast("array<string>"), F.lit(len(df.columns)))))
    else:
        parts.append(correlated_pairs(df, t=t).select(*_finding("highly-correlated", "warn", F.array("left", "right"), F.col("correlation"))))
    parts.append(text_encoded(df, t=t).select(*_finding(F.col("kind"), "warn", F.array("column"), F.col("share"))))
    if target:
        parts.append(class_imbalance(df, target, t).select(*_finding("class-imbalance", F.col("severity"), F.array(F.lit(target)), F.col("min_share"))))
        flagged = []
        if P.is_numeric(df.schema[target].dataType):
            near = leakage_correlation(df, target, t)
            flagged = [r["column"] for r in near.select("column").collect()]  # columns
            parts.append(near.select(*_finding("leakage-suspect", "high", F.array("column"), F.col("correlation"))))
        rest = [n for n in df.columns if n != target and n not in flagged]
        if rest and metrics.detect_task(df, target) == "classification":
            parts.append(leakage_partition(df, target, rest, t).select(*_finding("leakage-suspect", "high", F.array("column"), F.col("coverage"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])[F.col("severity")]
    return out.dropDuplicates(["kind", "columns"]).withColumn("rank", rank).orderBy("rank", "kind", F.array_join("columns", ","))
