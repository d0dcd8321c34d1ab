"""The driver's queries on the reference tables: each operator applied to whole tables, with equal SQL for DuckDB.

Doubles are rounded to 4 digits and whole numbers are 64-bit on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import drift, findings, metrics, profile, recipe, recipe_ops, runs, significance, splits

DIGITS = 4
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        if t in ("double", "float") or t.startswith("decimal"):
            c = F.round(c.cast("double"), DIGITS) + F.lit(0.0)
        elif t in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(n))
    return df.select(*out)


def expect(spec: str, sql: str) -> str:
    """SQL with typed output columns: ``d:x`` double, ``i:x`` whole number, ``s:x`` as it is."""
    made = {"d": 'round(("{0}")::DOUBLE, %d) + 0.0 AS "{0}"' % DIGITS, "i": '("{0}")::BIGINT AS "{0}"', "s": '"{0}"'}
    return f"SELECT {', '.join(made[x[0]].format(x[2:]) for x in spec.split())} FROM ({sql}) AS q"


def query(name: str, spec: str | None = None, sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        _queries[name] = lambda spark, sf_dir: tidy(f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")))
        if sql:
            _sql[name] = expect(spec, sql)
        return f

    return add


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# --- profiles ---------------------------------------------------------------------------------------------

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
GAPS = "(SELECT * REPLACE (CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS l_quantity) FROM lineitem)"


def gaps(t) -> DataFrame:
    return t("lineitem").withColumn("l_quantity", F.when(F.col("l_quantity") <= 45, F.col("l_quantity")))


def each(names: list[str], select: str, table: str = GAPS) -> str:
    return " UNION ALL ".join(f"({select.replace('{c}', n).replace('{t}', table)})" for n in names)


_Q = "quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS p75"
_FENCED = (
    "SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"unique\", avg({c}) AS mean, "
    "coalesce(stddev_samp({c}), 0) AS std, min({c}) AS min, max({c}) AS max, " + _Q + ", count(*) FILTER ({c} = 0) AS zeros, "
    "count(*) FILTER ({c} < 0) AS negatives, skewness({c}) AS skew, kurtosis({c}) AS kurtosis, max(p75 - p25) AS iqr, max(lo) AS outlier_low, "
    "max(hi) AS outlier_high, count(*) FILTER ({c} < lo OR {c} > hi) AS outliers FROM (SELECT *, CASE WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) END AS lo, "
    "CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) END AS hi, q1 AS p25, q3 AS p75 FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}))"
)
_FENCED = _FENCED.replace(_Q, "max(p25) AS p25, quantile_cont({c}, 0.5) AS median, max(p75) AS p75")
PROFILE_SPEC = "s:column i:count i:missing i:unique d:mean d:std d:min d:max d:p25 d:median d:p75 i:zeros i:negatives d:skew d:kurtosis d:iqr d:outlier_low d:outlier_high i:outliers"


@query("profile_numeric", PROFILE_SPEC, each(NUMBERS, _FENCED))
def _(t):
    return profile.numeric_profile(gaps(t), NUMBERS).select(*[x[2:] for x in PROFILE_SPEC.split()])


@query(
    "profile_histogram", "s:column i:bin d:low d:high i:count",
    each(["l_quantity", "l_extendedprice"], "SELECT '{c}' AS \"column\", b AS bin, lo + w * b AS low, lo + w * (b + 1) AS high, (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL AND least(floor(({c} - lo) / w), 19) = b) AS count "
    "FROM (SELECT min({c}) AS lo, (max({c}) - min({c})) / 20 AS w FROM {t}), (SELECT unnest(range(20)) AS b)"),
)
def _(t):
    return profile.histogram(gaps(t), ["l_quantity", "l_extendedprice"])


@query(
    "profile_unique_missing", "s:column i:count i:missing i:unique",
    each(["l_quantity", "l_linenumber", "l_returnflag", "l_shipdate"], "SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"unique\" FROM {t}"),
)
def _(t):
    return profile.unique_missing(gaps(t), ["l_quantity", "l_linenumber", "l_returnflag", "l_shipdate"])


@query(
    "profile_top_values", "s:column i:rank s:value i:count",
    each(["event_type", "user_id"], "SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS rank, {c}::VARCHAR AS value, count(*) AS count FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY rank LIMIT 5", "events"),
)
def _(t):
    return profile.top_values(t("events"), ["event_type", "user_id"])


@query("profile_duplicates", "i:rows i:duplicate_rows", "SELECT sum(n) AS rows, sum(n - 1) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_quantity, l_returnflag)")
def _(t):
    return profile.duplicate_rows(t("lineitem").select("l_suppkey", "l_quantity", "l_returnflag"))


@query("profile_kind", "s:column s:kind i:count i:unique", each(
    ["event_id", "ts", "event_type", "props"],
    "SELECT '{c}' AS \"column\", CASE WHEN count({c}) = 0 THEN 'empty' WHEN '{c}' = 'event_id' THEN 'numeric' WHEN '{c}' = 'ts' THEN 'datetime' WHEN avg(length({c}::VARCHAR)) > 50 OR (count(DISTINCT {c}) / count({c}) > 0.9 AND count({c}) > 100) THEN 'text' ELSE 'categorical' END AS kind, count({c}) AS count, count(DISTINCT {c}) AS \"unique\" FROM {t}", "events"))
def _(t):
    return profile.column_kinds(t("events").select("event_id", "ts", "event_type", "props"))


@query("profile_text_lengths", "s:column i:count d:mean_length i:min_length i:max_length", "SELECT 'text' AS \"column\", count(text) AS count, avg(length(text)) AS mean_length, min(length(text)) AS min_length, max(length(text)) AS max_length FROM documents")
def _(t):
    return profile.text_lengths(t("documents"), ["text"])


@query("profile_datetime", "s:column i:count i:missing d:min_epoch d:max_epoch d:span_days", "SELECT 'o_orderdate' AS \"column\", count(o_orderdate) AS count, count(*) - count(o_orderdate) AS missing, min(epoch(o_orderdate)) AS min_epoch, max(epoch(o_orderdate)) AS max_epoch, (max(epoch(o_orderdate)) - min(epoch(o_orderdate))) / 86400 AS span_days FROM orders")
def _(t):
    return profile.datetime_profile(t("orders"), ["o_orderdate"])


@query("sample_hash", "i:o_orderkey", "SELECT o_orderkey FROM orders WHERE ('0x' || substr(md5('7:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 < 0.1")
def _(t):
    from quern.sources.io import hash_sample

    return hash_sample(t("orders"), 1, 10, 7, ["o_orderkey"]).select("o_orderkey")


# --- findings ---------------------------------------------------------------------------------------------


@query("find_missing", "s:kind s:severity d:metric", f"SELECT CASE WHEN p >= 50 THEN 'high-missing' ELSE 'missing' END AS kind, CASE WHEN p >= 50 THEN 'high' WHEN p >= 5 THEN 'warn' ELSE 'info' END AS severity, p AS metric FROM (SELECT 100.0 * (count(*) - count(l_quantity)) / count(*) AS p FROM {GAPS}) WHERE p > 0")
def _(t):
    return findings.column_quality(gaps(t).select("l_quantity")).where("kind like '%missing'").select("kind", "severity", "metric")


@query("find_constant_empty", "s:kind s:severity s:column", "SELECT * FROM (VALUES ('constant-column', 'high', 'same'), ('empty-column', 'high', 'gone')) AS v(kind, severity, \"column\")")
def _(t):
    df = t("part").select("p_size", F.lit("JP").alias("same"), F.lit(None).cast("string").alias("gone"))
    return findings.column_quality(df).select("kind", "severity", F.col("columns")[0].alias("column"))


@query("find_identifier", "s:kind s:column d:metric", "SELECT 'identifier-like' AS kind, 'c_name' AS \"column\", count(DISTINCT c_name) AS metric FROM customer HAVING count(DISTINCT c_name) = count(c_name) AND count(*) > 10")
def _(t):
    return findings.column_quality(t("customer").select("c_name", "c_mktsegment")).select("kind", F.col("columns")[0].alias("column"), "metric")


@query("find_high_cardinality", "s:kind s:severity d:metric", "SELECT 'high-cardinality' AS kind, 'warn' AS severity, count(DISTINCT v) AS metric FROM (SELECT 'k' || (p_partkey % (SELECT count(*) * 6 // 10 FROM part)) AS v FROM part) HAVING count(DISTINCT v) >= 50 AND count(DISTINCT v) / count(*) >= 0.5")
def _(t):
    n = t("part").count() * 6 // 10
    return findings.column_quality(t("part").select(F.concat(F.lit("k"), F.col("p_partkey") % n).alias("v"))).select("kind", "severity", "metric")


@query("find_skew_outliers", "s:kind s:severity s:column d:metric", (
    "WITH x AS (SELECT exp(l_quantity / 8) AS v FROM lineitem), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x) "
    "SELECT 'high-skew' AS kind, CASE WHEN abs(skewness(v)) >= 5 THEN 'warn' ELSE 'info' END AS severity, 'v' AS \"column\", skewness(v) AS metric FROM x HAVING abs(skewness(v)) >= 2 UNION ALL "
    "SELECT 'outliers', CASE WHEN p >= 5 THEN 'warn' ELSE 'info' END, 'v', p FROM (SELECT 100.0 * count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) / count(*) AS p FROM x, q) WHERE p >= 1"))
def _(t):
    return findings.distribution(t("lineitem").select(F.exp(F.col("l_quantity") / 8).alias("v"))).select("kind", "severity", F.col("columns")[0].alias("column"), "metric")


@query("find_shape", "s:kind s:severity d:metric", "SELECT 'tiny-dataset' AS kind, 'warn' AS severity, count(*) AS metric FROM nation HAVING count(*) < 50 UNION ALL SELECT 'duplicate-rows', CASE WHEN 100.0 * d / n >= 1 THEN 'warn' ELSE 'info' END, d FROM (SELECT count(*) AS n, count(*) - count(DISTINCT n_regionkey) AS d FROM nation) WHERE d > 0")
def _(t):
    return findings.dataset_shape(t("nation").select("n_regionkey")).select("kind", "severity", "metric")


@query("find_duplicate_columns", "s:column s:duplicate_of", "SELECT 'copy' AS \"column\", 'l_returnflag' AS duplicate_of FROM (SELECT bool_and(l_returnflag IS NOT DISTINCT FROM c) AS ok FROM (SELECT l_returnflag, l_returnflag AS c FROM lineitem)) WHERE ok")
def _(t):
    return findings.duplicate_columns(t("lineitem").select("l_returnflag", "l_linestatus", F.col("l_returnflag").alias("copy")))


@query("find_correlated_pairs", "s:left s:right d:correlation", "SELECT * FROM (SELECT 'l_quantity' AS \"left\", 'shifted' AS \"right\", corr(l_quantity, s) AS correlation FROM (SELECT l_quantity, 3 * l_quantity + l_tax AS s FROM lineitem)) WHERE abs(correlation) >= 0.95")
def _(t):
    return findings.correlated_pairs(t("lineitem").select("l_quantity", "l_tax", (3 * F.col("l_quantity") + F.col("l_tax")).alias("shifted")))


@query("find_text_encoded", "s:column s:kind d:share", "SELECT * FROM (VALUES ('money', 'numeric-stored-as-text', 1.0), ('day', 'datetime-stored-as-text', 1.0)) AS v(\"column\", kind, share)")
def _(t):
    df = t("orders").select(F.format_string("$%,.2f", F.round("o_totalprice", 2)).alias("money"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus")
    return findings.text_encoded(df)


@query("find_class_imbalance", "i:classes d:min_share s:severity", "SELECT classes, min_share, CASE WHEN min_share < 0.05 THEN 'high' WHEN min_share < 0.2 THEN 'warn' END AS severity FROM (SELECT count(*) AS classes, min(n) / sum(n) AS min_share FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) WHERE classes BETWEEN 2 AND 20 AND min_share < 0.2")
def _(t):
    return findings.class_imbalance(t("labels"), "toxic")


@query("find_leakage_correlation", "s:column d:correlation", "SELECT 'double' AS \"column\", corr(o_totalprice * 2 + 1, o_totalprice) AS correlation FROM orders")
def _(t):
    df = t("orders").select("o_totalprice", "o_custkey", (F.col("o_totalprice") * 2 + 1).alias("double"))
    return findings.leakage_correlation(df, "o_totalprice")


@query("find_leakage_partition", "s:column i:unique d:coverage", "SELECT 'code' AS \"column\", count(DISTINCT 'class-' || l_returnflag) AS \"unique\", 1.0 AS coverage FROM lineitem")
def _(t):
    df = t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", F.concat(F.lit("class-"), "l_returnflag").alias("code"))
    return findings.leakage_partition(df, "l_returnflag", ["l_linenumber", "code"])


@query("find_all")
def _(t):
    return findings.detect_findings(gaps(t).select("l_orderkey", *NUMBERS, "l_returnflag", "l_linestatus"), "l_returnflag")


@query("find_mixed_types", "s:column s:types", "SELECT 'v' AS \"column\", string_agg(DISTINCT k, ',' ORDER BY k) AS types FROM (SELECT CASE WHEN event_id % 3 = 0 THEN 'STRING' WHEN event_id % 3 = 1 THEN 'BIGINT' END AS k FROM events) HAVING count(DISTINCT k) > 1")
def _(t):
    third = F.pmod("event_id", F.lit(3))
    text = F.when(third == 0, F.to_json(F.array("event_type"))).when(third == 1, F.col("event_id").cast("string")).otherwise("null")
    text = F.when(third == 0, F.regexp_replace(text, r"^\[|\]$", "")).otherwise(text)
    df = t("events").select(F.parse_json(text).alias("v"), F.parse_json(F.col("event_id").cast("string")).alias("one"))
    return findings.mixed_types(df).select("column", F.array_join("types", ",").alias("types"))


# --- drift ------------------------------------------------------------------------------------------------

HALVES = "(SELECT count(*) // 2 AS h FROM events)"


def halves(t) -> tuple[DataFrame, DataFrame]:
    e = t("events").select("event_id", "event_type", "value")
    cut = e.agg(F.max("event_id")).first()[0] // 2
    return e.where(F.col("event_id") <= cut), e.where(F.col("event_id") > cut)


@query("drift_schema_type", "s:kind s:severity s:column", "SELECT * FROM (VALUES ('column-removed', 'high', 'value'), ('column-added', 'info', 'extra'), ('type-changed', 'high', 'event_id')) AS v(kind, severity, \"column\")")
def _(t):
    a, b = halves(t)
    b = b.drop("value").withColumns({"extra": F.lit(1), "event_id": F.concat(F.lit("e"), F.col("event_id") % 7)})
    return drift.drift(a, b).where("kind in ('column-removed', 'column-added', 'type-changed')").select("kind", "severity", "column")


@query("drift_numeric", "s:kind s:severity s:column d:metric", (
    "WITH h AS (SELECT max(event_id) // 2 AS c FROM events), a AS (SELECT avg(event_id) AS m, stddev_samp(event_id) AS s FROM events, h WHERE event_id <= c), b AS (SELECT avg(event_id) AS m FROM events, h WHERE event_id > c) "
    "SELECT 'distribution-shifted' AS kind, CASE WHEN abs((b.m - a.m) / a.s) >= 0.5 THEN 'warn' ELSE 'info' END AS severity, 'event_id' AS \"column\", (b.m - a.m) / a.s AS metric FROM a, b WHERE abs((b.m - a.m) / a.s) >= 0.1"))
def _(t):
    a, b = halves(t)
    return drift.drift(a.select("event_id"), b.select("event_id")).where("kind = 'distribution-shifted'").select("kind", "severity", "column", "metric")


@query("drift_missing", "s:kind s:severity s:column d:metric", f"SELECT 'missingness-changed' AS kind, 'warn' AS severity, 'l_quantity' AS \"column\", p AS metric FROM (SELECT 100.0 * (count(*) - count(l_quantity)) / count(*) AS p FROM {GAPS}) WHERE p >= 5")
def _(t):
    return drift.drift(t("lineitem").select("l_quantity"), gaps(t).select("l_quantity")).where("kind = 'missingness-changed'").select("kind", "severity", "column", "metric")


@query("drift_categorical", "s:kind s:column s:value", "SELECT 'new-categories' AS kind, 'event_type' AS \"column\", 'brand-new' AS value")
def _(t):
    a, b = halves(t)
    first = a.agg(F.min("event_type")).first()[0]
    b = b.withColumn("event_type", F.when(F.col("event_type") == first, "brand-new").otherwise(F.col("event_type")))
    return drift.drift(a.select("event_type"), b.select("event_type")).where("kind = 'new-categories'").select("kind", "column", "value")


@query("drift_cardinality", "s:kind s:column d:metric", "SELECT 'cardinality-changed' AS kind, 'c' AS \"column\", b / a - 1 AS metric FROM (SELECT count(DISTINCT l_linenumber)::DOUBLE AS b, count(DISTINCT l_linenumber) FILTER (l_linenumber <= 3) AS a FROM lineitem) WHERE abs(b / a - 1) >= 0.5")
def _(t):
    df = t("lineitem").select(F.concat(F.lit("line "), "l_linenumber").alias("c"), "l_linenumber")
    found = drift.drift(df.where("l_linenumber <= 3").select("c"), df.select("c"))
    return found.where("kind = 'cardinality-changed'").select("kind", "column", "metric")


@query("drift_category_share", "s:kind s:column d:metric", (
    "WITH a AS (SELECT l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'N' ELSE l_returnflag END AS f, count(*) AS n FROM lineitem GROUP BY 1), "
    "s AS (SELECT 100.0 * (SELECT max(n) / sum(n) FROM b) - 100.0 * (SELECT max(n) / sum(n) FROM a) AS metric) SELECT 'category-share-changed' AS kind, 'l_returnflag' AS \"column\", metric FROM s WHERE abs(metric) >= 15"))
def _(t):
    a = t("lineitem").select("l_returnflag")
    b = a.select(F.when(F.col("l_returnflag") == "A", "N").otherwise(F.col("l_returnflag")).alias("l_returnflag"))
    return drift.drift(a, b).where("kind = 'category-share-changed'").select("kind", "column", "metric")


@query("drift_rows", "s:kind s:severity d:metric", "SELECT 'row-count-changed' AS kind, 'warn' AS severity, m / n AS metric FROM (SELECT count(*) AS n, count(*) FILTER (l_linenumber = 1) AS m FROM lineitem) WHERE m / n < 0.5")
def _(t):
    return drift.row_count_drift(t("lineitem"), t("lineitem").where("l_linenumber = 1")).select("kind", "severity", "metric")


# --- recipes ----------------------------------------------------------------------------------------------


def step(op: str, df: DataFrame, **params) -> DataFrame:
    return recipe.apply(recipe.Recipe((recipe.Step(op, params),)), df).frame


KEYS = ["l_orderkey", "l_linenumber"]
L = "i:l_orderkey i:l_linenumber "


@query("recipe_drop", "i:l_orderkey i:l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem")
def _(t):
    return step("drop", t("lineitem").select(*KEYS, "l_tax"), columns=["l_tax"])


@query("recipe_dedupe", "i:l_suppkey i:l_orderkey i:l_linenumber", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def _(t):
    return step("dedupe", t("lineitem").select("l_suppkey", *KEYS), subset=["l_suppkey"], key=KEYS)


@query("recipe_dedupe_all", "i:l_suppkey s:l_returnflag", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(t):
    return step("dedupe", t("lineitem").select("l_suppkey", "l_returnflag"))


@query("recipe_cast_numeric", "i:o_orderkey d:money", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS money FROM orders")
def _(t):
    money = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.format_string("$%,.2f", F.round("o_totalprice", 2)))
    return step("cast", t("orders").select("o_orderkey", money.alias("money")), columns=["money"], to="numeric")


@query("recipe_cast_datetime", "i:o_orderkey i:y", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders")
def _(t):
    df = step("cast", t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("d")), columns=["d"], to="datetime")
    return df.select("o_orderkey", F.year("d").alias("y"))


for _how, _sql_value in {"median": "(SELECT quantile_cont(l_quantity, 0.5) FROM g)", "mean": "(SELECT avg(l_quantity) FROM g)", "constant": "-1"}.items():
    query(f"recipe_impute_{_how}", L + "d:l_quantity", f"WITH g AS {GAPS} SELECT l_orderkey, l_linenumber, coalesce(l_quantity, {_sql_value}) AS l_quantity FROM g")(
        lambda t, how=_how: step("impute", gaps(t).select(*KEYS, "l_quantity"), columns=["l_quantity"], strategy=how, value=-1)
    )


@query("recipe_impute_mode", L + "s:flag", "WITH g AS (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce(flag, (SELECT flag FROM g WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM g")
def _(t):
    df = t("lineitem").select(*KEYS, F.nullif("l_returnflag", F.lit("N")).alias("flag"))
    return step("impute", df, columns=["flag"], strategy="most_frequent")


@query("recipe_impute_drop_rows", L + "d:l_quantity", f"SELECT l_orderkey, l_linenumber, l_quantity FROM {GAPS} WHERE l_quantity IS NOT NULL")
def _(t):
    return step("impute", gaps(t).select(*KEYS, "l_quantity"), columns=["l_quantity"], strategy="drop_rows")


@query("recipe_clip", L + "d:l_extendedprice", "SELECT l_orderkey, l_linenumber, greatest(a, least(b, l_extendedprice)) AS l_extendedprice FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.01) AS a, quantile_cont(l_extendedprice, 0.99) AS b FROM lineitem)")
def _(t):
    return step("clip", t("lineitem").select(*KEYS, "l_extendedprice"), columns=["l_extendedprice"])


@query("recipe_onehot", L + "s:l_returnflag_A s:l_returnflag_N s:l_returnflag_R", "SELECT l_orderkey, l_linenumber, l_returnflag = 'A' AS \"l_returnflag_A\", l_returnflag = 'N' AS \"l_returnflag_N\", l_returnflag = 'R' AS \"l_returnflag_R\" FROM lineitem")
def _(t):
    return step("encode", t("lineitem").select(*KEYS, "l_returnflag"), columns=["l_returnflag"], method="onehot")


@query("recipe_ordinal", "i:o_orderkey i:o_orderpriority", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders")
def _(t):
    return step("encode", t("orders").select("o_orderkey", "o_orderpriority"), columns=["o_orderpriority"], method="ordinal")


for _how, _centre, _width in (
    ("standard", "avg(l_extendedprice)", "stddev_samp(l_extendedprice)"), ("minmax", "min(l_extendedprice)", "max(l_extendedprice) - min(l_extendedprice)"),
    ("robust", "quantile_cont(l_extendedprice, 0.5)", "quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)"),
):
    query(f"recipe_scale_{_how}", L + "d:l_extendedprice", f"SELECT l_orderkey, l_linenumber, (l_extendedprice - c) / w AS l_extendedprice FROM lineitem, (SELECT {_centre} AS c, {_width} AS w FROM lineitem)")(
        lambda t, how=_how: step("scale", t("lineitem").select(*KEYS, "l_extendedprice"), columns=["l_extendedprice"], method=how)
    )

PARTS = ["year", "month", "day", "dayofweek", "dayofyear", "quarter", "hour", "week"]


@query("recipe_datepart", "i:event_id " + " ".join(f"i:ts_{p}" for p in PARTS), "SELECT event_id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, isodow(ts) - 1 AS ts_dayofweek, dayofyear(ts) AS ts_dayofyear, quarter(ts) AS ts_quarter, hour(ts) AS ts_hour, weekofyear(ts) AS ts_week FROM events")
def _(t):
    return step("datepart", t("events").select("event_id", "ts"), columns=["ts"], parts=PARTS).drop("ts")


@query("recipe_log", "i:c_custkey d:plain d:signed", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN ln(1 + c_acctbal) END AS plain, sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS signed FROM customer")
def _(t):
    df = t("customer").select("c_custkey", F.col("c_acctbal").alias("plain"), F.col("c_acctbal").alias("signed"))
    return step("log", step("log", df, columns=["plain"]), columns=["signed"], method="signed")


@query("recipe_interact_product", L + "d:x", "SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS x FROM lineitem")
def _(t):
    return step("interact", t("lineitem").select(*KEYS, "l_quantity", "l_discount"), columns=["l_quantity", "l_discount"]).select(*KEYS, F.col("l_quantity_x_l_discount").alias("x"))


@query("recipe_interact_ratio", L + "d:x", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS x FROM lineitem")
def _(t):
    return step("interact", t("lineitem").select(*KEYS, "l_quantity", "l_discount"), columns=["l_quantity", "l_discount"], method="ratio").select(*KEYS, F.col("l_quantity_over_l_discount").alias("x"))


@query("recipe_binarize", L + "d:l_quantity", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 20 THEN 1.0 WHEN l_quantity <= 20 THEN 0.0 END AS l_quantity FROM {GAPS}")
def _(t):
    return step("binarize", gaps(t).select(*KEYS, "l_quantity"), columns=["l_quantity"], threshold=20)


@query("recipe_bin_quantile", "i:p_partkey i:p_retailprice", "SELECT p_partkey, (p_retailprice > a)::INT + (p_retailprice > b AND b <> a)::INT + (p_retailprice > c AND c <> b)::INT + (p_retailprice > d AND d <> c)::INT AS p_retailprice FROM part, (SELECT quantile_cont(p_retailprice, 0.2) AS a, quantile_cont(p_retailprice, 0.4) AS b, quantile_cont(p_retailprice, 0.6) AS c, quantile_cont(p_retailprice, 0.8) AS d FROM part)")
def _(t):
    return step("bin", t("part").select("p_partkey", "p_retailprice"), columns=["p_retailprice"])


@query("recipe_bin_uniform", "i:p_partkey i:p_size", "SELECT p_partkey, greatest(ceil((p_size - lo) / ((hi - lo) / 5)) - 1, 0) AS p_size FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)")
def _(t):
    return step("bin", t("part").select("p_partkey", "p_size"), columns=["p_size"], method="uniform")


_FOLD = "(('0x' || substr(md5('0:' || event_id), 1, 8))::BIGINT % 5)"


@query("recipe_target_encode_oof", "i:event_id d:event_type", (
    f"WITH e AS (SELECT event_id, event_type, value, {_FOLD} AS f FROM events), c AS (SELECT event_type, f, sum(value) AS s, count(*) AS n FROM e GROUP BY ALL), "
    "p AS (SELECT f, (SELECT sum(value) FROM e AS x WHERE x.f <> g.f) / (SELECT count(*) FROM e AS x WHERE x.f <> g.f) AS p FROM (SELECT DISTINCT f FROM e) AS g), "
    "o AS (SELECT c.event_type, c.f, sum(d.s) - c.s AS s, sum(d.n) - c.n AS n FROM c JOIN c AS d USING (event_type) GROUP BY c.event_type, c.f, c.s, c.n) "
    "SELECT event_id, (s + 20 * p) / (n + 20) AS event_type FROM e JOIN o USING (event_type, f) JOIN p USING (f)"))
def _(t):
    return step("target-encode", t("events").select("event_id", "event_type", "value"), columns=["event_type"], target="value", key=["event_id"]).drop("value")


@query("recipe_target_encode_apply", "i:event_id d:event_type", "WITH m AS (SELECT event_type, sum(value) AS s, count(*) AS n FROM events GROUP BY 1), p AS (SELECT avg(value) AS p FROM events) SELECT event_id, (s + 20 * p) / (n + 20) AS event_type FROM events JOIN m USING (event_type), p")
def _(t):
    df = t("events").select("event_id", "event_type", "value")
    p = {"columns": ["event_type"], "target": "value"}
    return recipe_ops.target_encode(df, p, recipe_ops.fit_target_encode(df, p)).drop("value")


@query("recipe_text_length", "i:doc_id i:text_chars i:text_words", r"SELECT doc_id, length(text) AS text_chars, len(regexp_extract_all(text, '\S+')) AS text_words FROM documents")
def _(t):
    return step("text-length", t("documents").select("doc_id", "text"), columns=["text"]).drop("text")


@query("recipe_tfidf_vocabulary", "s:term d:idf", (
    r"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_]+')) AS term FROM documents WHERE lang = 'en'), c AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS d FROM w GROUP BY term ORDER BY tf DESC, term LIMIT 20) "
    "SELECT term, ln((1.0 + (SELECT count(*) FROM documents WHERE lang = 'en')) / (1.0 + d)) + 1 AS idf FROM c"))
def _(t):
    df = t("documents").where("lang = 'en'").select("doc_id", "text")
    idf = recipe_ops.fit_tfidf(df, {"column": "text", "max_features": 20})["idf"]
    return df.sparkSession.createDataFrame(list(idf.items()), "term string, idf double")


@query("recipe_tfidf")
def _(t):
    return step("tfidf", t("conversations").select("conv_id", "turn", "text"), column="text", max_features=20, ngrams=2)


@query("recipe_lag", "i:event_id d:value_lag2", "SELECT event_id, lag(value, 2) OVER (ORDER BY ts, event_id) AS value_lag2 FROM events")
def _(t):
    return step("lag", t("events").select("event_id", "ts", "value"), columns=["value"], by="ts", periods=2, key=["event_id"]).select("event_id", "value_lag2")


@query("recipe_lag_group", "i:event_id d:value_lag1", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag1 FROM events")
def _(t):
    return step("lag", t("events").select("event_id", "ts", "user_id", "value"), columns=["value"], by="ts", group="user_id", key=["event_id"]).select("event_id", "value_lag1")


for _stat, _f in {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp"}.items():
    query(f"recipe_rolling_{_stat}", "i:event_id d:v", f"SELECT event_id, {_f}(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM events")(
        lambda t, stat=_stat: step("rolling", t("events").select("event_id", "ts", "user_id", "value"), columns=["value"], by="ts", stat=stat, group="user_id", key=["event_id"]).select("event_id", F.col(f"value_roll3_{stat}").alias("v"))
    )


@query("recipe_rolling_all", "i:event_id d:v", "SELECT event_id, avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM events")
def _(t):
    df = step("rolling", t("events").select("event_id", "ts", "value"), columns=["value"], by="ts", window=5, key=["event_id"])
    return df.select("event_id", F.col("value_roll5_mean").alias("v"))


# --- splits -----------------------------------------------------------------------------------------------

_H = "('0x' || substr(md5('0:' || {k}), 1, 8))::BIGINT"


@query("split_random", "i:o_orderkey s:is_test", f"SELECT o_orderkey, {_H.format(k='o_orderkey')} / 4294967296.0 < 0.2 AS is_test FROM orders")
def _(t):
    return splits.split(t("orders"), ["o_orderkey"], "random").select("o_orderkey", "is_test")


@query("split_stratified", "i:o_orderkey s:is_test", f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H.format(k='o_orderkey')}, o_orderkey) <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test FROM orders")
def _(t):
    return splits.split(t("orders"), ["o_orderkey"], "auto", target="o_orderstatus").select("o_orderkey", "is_test")


@query("split_group", "i:o_orderkey s:is_test", f"WITH g AS (SELECT quantile_cont({_H.format(k='o_custkey')}, 0.2) AS c FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, {_H.format(k='o_custkey')} <= c AS is_test FROM orders, g")
def _(t):
    return splits.split(t("orders"), ["o_orderkey"], "auto", group="o_custkey").select("o_orderkey", "is_test")


@query("split_time", "i:o_orderkey s:is_test", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) > floor(count(*) OVER () * 0.8) AS is_test FROM orders")
def _(t):
    return splits.split(t("orders"), ["o_orderkey"], "auto", time="o_orderdate").select("o_orderkey", "is_test")


@query("cv_folds_stratified", "i:o_orderkey i:fold", f"SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H.format(k='o_orderkey')}, o_orderkey) - 1) % 5 AS fold FROM orders")
def _(t):
    return splits.stratified_folds(t("orders"), ["o_orderkey"], "o_orderstatus").select("o_orderkey", "fold")


@query("cv_folds_group", "i:o_orderkey i:fold", f"SELECT o_orderkey, {_H.format(k='o_custkey')} % 5 AS fold FROM orders")
def _(t):
    return splits.group_folds(t("orders"), "o_custkey").select("o_orderkey", "fold")


# --- evaluation -------------------------------------------------------------------------------------------

SCORED = (
    "(SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS guess FROM (SELECT *, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 3) AS score, CASE WHEN (l_quantity + l_linenumber * 4) > 40 THEN 1 ELSE 0 END AS y FROM lineitem))"
)


def scored(t) -> DataFrame:
    df = t("lineitem").withColumn("score", F.round(1 / (1 + F.exp(-(F.col("l_quantity") - 25) / 10)), 3))
    return df.withColumn("y", (F.col("l_quantity") + F.col("l_linenumber") * 4 > 40).cast("int")).withColumn("guess", (F.col("score") >= 0.5).cast("int"))


@query("eval_task", "s:y s:price", "SELECT 'classification' AS y, 'regression' AS price")
def _(t):
    df = scored(t)
    return df.sparkSession.createDataFrame([(metrics.detect_task(df, "y"), metrics.detect_task(df, "l_extendedprice"))], "y string, price string")


@query("eval_confusion", "i:truth i:predicted i:n", f"SELECT y AS truth, guess AS predicted, count(*) AS n FROM {SCORED} GROUP BY ALL")
def _(t):
    return metrics.confusion(scored(t), "y", "guess")


@query("eval_label_metrics", "i:rows i:labels d:accuracy d:balanced_accuracy d:precision d:recall d:f1 d:mcc", (
    f"WITH c AS (SELECT count(*) FILTER (y = 1 AND guess = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND guess = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND guess = 0)::DOUBLE AS fn, count(*) FILTER (y = 0 AND guess = 0)::DOUBLE AS tn FROM {SCORED}) "
    "SELECT tp + fp + fn + tn AS rows, 2 AS labels, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, "
    "(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc FROM c"))
def _(t):
    return metrics.label_metrics(metrics.confusion(scored(t), "y", "guess"))


@query("eval_regression_metrics", "i:rows d:rmse d:mae d:r2 d:median_ae d:mape_percent d:rmsle", (
    "WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem) SELECT count(*) AS rows, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, "
    "quantile_cont(abs(y - p), 0.5) AS median_ae, 100 * avg(abs((y - p) / nullif(y, 0))) AS mape_percent, sqrt(avg((ln(1 + greatest(y, 0)) - ln(1 + greatest(p, 0))) ** 2)) AS rmsle FROM x"))
def _(t):
    return metrics.regression_metrics(t("lineitem").withColumn("p", F.col("l_quantity") * 1500), "l_extendedprice", "p")


@query("eval_score_metrics", "i:rows d:brier d:log_loss d:roc_auc d:pr_auc", (
    f"WITH x AS (SELECT y, score FROM {SCORED}), g AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM x GROUP BY score), r AS (SELECT *, sum(p) OVER w - p AS pa, sum(n) OVER w - n AS na FROM g WINDOW w AS (ORDER BY score DESC)), "
    "m AS (SELECT count(*) AS rows, avg((score - y) ** 2) AS brier, -avg(CASE WHEN y = 1 THEN ln(least(greatest(score, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END) AS log_loss FROM x) "
    "SELECT m.*, a.roc_auc, a.pr_auc FROM m, (SELECT sum((pa + p / 2) * n) / (sum(p) * sum(n)) AS roc_auc, sum(p * (pa + p) / (pa + p + na + n)) / sum(p) AS pr_auc FROM r) AS a"))
def _(t):
    return metrics.score_metrics(scored(t), F.col("y"), F.col("score"))


def _area(label: str, score: str) -> str:
    counts = f"SELECT {score} AS s, count(*) FILTER (l_returnflag = '{label}')::DOUBLE AS p, count(*) FILTER (l_returnflag <> '{label}')::DOUBLE AS n FROM lineitem GROUP BY 1"
    return f"SELECT sum((pa + p / 2) * n) / (sum(p) * sum(n)) AS area FROM (SELECT *, sum(p) OVER (ORDER BY s DESC) - p AS pa FROM ({counts}))"


_AREAS = " UNION ALL ".join(_area(c, s) for c, s in {"A": "l_quantity", "N": "-l_quantity", "R": "l_tax"}.items())


@query("eval_roc_auc_ovr", "d:roc_auc_ovr", f"SELECT avg(area) AS roc_auc_ovr FROM ({_AREAS})")
def _(t):
    q = F.col("l_quantity")
    return metrics.roc_auc_ovr(t("lineitem"), "l_returnflag", {"A": q, "N": -q, "R": F.col("l_tax")})


@query("eval_baselines", "s:strategy d:accuracy d:balanced_accuracy", "WITH c AS (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_returnflag) SELECT 'most_frequent' AS strategy, max(n) / sum(n) AS accuracy, 1.0 / count(*) AS balanced_accuracy FROM c UNION ALL SELECT 'stratified', sum(n * n) / (sum(n) * sum(n)), 1.0 / count(*) FROM c")
def _(t):
    return metrics.classification_baselines(t("lineitem"), "l_returnflag")


@query("eval_regression_baselines", "s:strategy d:rmse d:mae", "WITH m AS (SELECT avg(o_totalprice) AS a, quantile_cont(o_totalprice, 0.5) AS b FROM orders) SELECT 'mean' AS strategy, sqrt(avg((o_totalprice - a) ** 2)) AS rmse, avg(abs(o_totalprice - a)) AS mae FROM orders, m UNION ALL SELECT 'median', sqrt(avg((o_totalprice - b) ** 2)), avg(abs(o_totalprice - b)) FROM orders, m")
def _(t):
    return metrics.regression_baselines(t("orders"), "o_totalprice")


@query("eval_slices", "s:column s:value i:rows d:balanced_accuracy", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", v AS value, sum(n) AS rows, avg(hit / n) AS balanced_accuracy FROM (SELECT {c}::VARCHAR AS v, y, count(*) AS n, sum((y = guess)::INT) AS hit FROM {SCORED} GROUP BY ALL) GROUP BY v HAVING sum(n) >= 20" for c in ("l_returnflag", "l_linestatus", "l_linenumber")))
def _(t):
    return metrics.slices(scored(t), "y", "guess", ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("eval_slice_columns", "s:column", "SELECT unnest(['l_linenumber', 'l_returnflag', 'l_linestatus']) AS \"column\"")
def _(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice")
    return df.sparkSession.createDataFrame([(c,) for c in metrics.slice_columns(df, "l_extendedprice")], "column string")


_BINS = f"SELECT least(floor(score * 10), 9) AS bin, count(*) AS rows, avg(score) AS mean_score, avg(y) AS mean_truth FROM {SCORED} GROUP BY 1"


@query("eval_calibration", "i:bin i:rows d:mean_score d:mean_truth", _BINS)
def _(t):
    return metrics.calibration(scored(t), F.col("y"), F.col("score"))


@query("eval_calibration_error", "d:ece", f"SELECT round(sum(rows * abs(mean_score - mean_truth)) / sum(rows), 4) AS ece FROM ({_BINS})")
def _(t):
    return metrics.calibration_error(metrics.calibration(scored(t), F.col("y"), F.col("score")))


_CURVE = (
    f"WITH k AS (SELECT round(0.05 + 0.9 * unnest(range(19)) / 18, 10) AS cutoff), c AS (SELECT cutoff, count(*) FILTER (y = 1 AND score >= cutoff)::DOUBLE AS tp, count(*) FILTER (y = 0 AND score >= cutoff)::DOUBLE AS fp, count(*) FILTER (y = 1 AND score < cutoff)::DOUBLE AS fn, count(*) FILTER (y = 0 AND score < cutoff)::DOUBLE AS tn FROM {SCORED}, k GROUP BY cutoff) "
    "SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy, tp + fp AS flagged, fn * 5 + fp AS cost FROM c"
)
_CURVE_SPEC = "d:cutoff i:tp i:fp i:fn i:tn d:precision d:recall d:f1 d:balanced_accuracy i:flagged d:cost"


@query("threshold_curve", _CURVE_SPEC, _CURVE)
def _(t):
    return metrics.threshold_curve(scored(t), F.col("y"), F.col("score"), miss_cost=5)


@query("threshold_best", _CURVE_SPEC, f"SELECT * FROM ({_CURVE}) ORDER BY cost, cutoff LIMIT 1")
def _(t):
    return metrics.best_cutoff(metrics.threshold_curve(scored(t), F.col("y"), F.col("score"), miss_cost=5), "cost")


@query("errors_top", L + "i:y i:guess d:confidence", f"SELECT l_orderkey, l_linenumber, y, guess, greatest(score, 1 - score) AS confidence FROM {SCORED} WHERE y <> guess")
def _(t):
    return metrics.error_rows(scored(t), "y", "guess", F.greatest("score", 1 - F.col("score"))).select(*KEYS, "y", "guess", "confidence")


@query("errors_regression_top", L + "d:residual", "SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity * 1500 AS residual FROM lineitem")
def _(t):
    return metrics.residual_rows(t("lineitem").withColumn("p", F.col("l_quantity") * 1500), "l_extendedprice", "p").select(*KEYS, "residual")


@query("errors_patterns", "s:column s:value i:rows d:error_rate d:lift", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value, count(*) AS rows, avg((y <> guess)::INT) AS error_rate, avg((y <> guess)::INT) / (SELECT avg((y <> guess)::INT) FROM {SCORED}) AS lift FROM {SCORED} GROUP BY {c} HAVING count(*) >= 10 AND avg((y <> guess)::INT) / (SELECT avg((y <> guess)::INT) FROM {SCORED}) >= 1.1" for c in ("l_linenumber", "l_returnflag")))
def _(t):
    return metrics.error_patterns(scored(t), F.col("y") != F.col("guess"), ["l_linenumber", "l_returnflag"], lift=1.1)


@query("bootstrap_label_ci")
def _(t):
    df = metrics.confusion(scored(t), "y", "guess")
    cells = [tuple(r) for r in df.collect()]
    low, high = metrics.bootstrap_label_metric(cells, metrics.balanced_accuracy_of)
    return df.sparkSession.createDataFrame([(metrics.balanced_accuracy_of(cells), low, high)], "balanced_accuracy double, ci_low double, ci_high double")


@query("bootstrap_row_ci")
def _(t):
    e = F.col("l_extendedprice") - F.col("l_quantity") * 1500
    return metrics.bootstrap_rows(t("lineitem"), {"mae": F.abs(e), "bias": e}, ["l_orderkey", "l_linenumber"], resamples=50)


@query("holm_adjust", "s:model d:p d:adjusted", "WITH v AS (SELECT * FROM (VALUES ('a', 0.01), ('b', 0.04), ('c', 0.03), ('d', 0.005)) AS v(model, p)), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM v) SELECT model, p, least(1, max(p * (m - k + 1)) OVER (ORDER BY k)) AS adjusted FROM r")
def _(t):
    spark = t("region").sparkSession
    ps = {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.005}
    return spark.createDataFrame([(m, ps[m], a) for m, a in significance.holm(ps).items()], "model string, p double, adjusted double")


_FOLDS = "(SELECT l_orderkey % 5 AS fold, avg(l_discount) AS a, avg(l_tax) AS b, avg(l_discount) - avg(l_tax) AS d FROM lineitem GROUP BY 1)"


@query("bench_t_test", "d:difference d:t", f"SELECT avg(d) AS difference, avg(d) / sqrt((1 / 5 + 20 / 80) * var_samp(d)) AS t FROM {_FOLDS}")
def _(t):
    """Two models' scores on five folds, here means per fold; the rows that reach the driver are the folds."""
    df = t("lineitem").groupBy((F.col("l_orderkey") % 5).alias("fold")).agg(F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b"))
    folds = df.orderBy("fold").collect()
    difference, value, _ = significance.corrected_paired_t_test([r["a"] for r in folds], [r["b"] for r in folds], 80, 20)
    return df.sparkSession.createDataFrame([(difference, value)], "difference double, t double")


@query("runs_ranked", "s:run_id s:dataset s:target d:value i:rank", "SELECT *, rank() OVER (PARTITION BY dataset, target ORDER BY value) AS rank FROM (SELECT l_returnflag || l_linenumber AS run_id, l_returnflag AS dataset, 'tax' AS target, round(avg(l_tax), 4) AS value FROM lineitem GROUP BY l_returnflag, l_linenumber)")
def _(t):
    made = t("lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.round(F.avg("l_tax"), 4).alias("value")).select(
        F.concat("l_returnflag", "l_linenumber").alias("run_id"), F.col("l_returnflag").alias("dataset"), F.lit("tax").alias("target"), "value",
        F.lit(False).alias("greater_is_better"),
    )
    return runs.rank_runs(made).drop("greater_is_better")
