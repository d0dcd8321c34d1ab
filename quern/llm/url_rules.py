"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefixes, then full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_ROWS, lower_ascii


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``[("block", "net/"), ...]`` -> ``rule, verdict``."""
    return spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def _short(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url",
    prefix_digits: int = 8,
) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict`` by the longest rule that fits.

    A rule is a host, then a path from its first ``/`` on.  It fits that host and its subdomains if the page's
    path starts with the rule's.  Of equally long rules a block wins; of equal rules that disagree, too.  Each
    URL is expanded to all suffixes of its host times its path's prefixes of those lengths that rules have;
    expressions and rules meet on the first ``prefix_digits`` digits of SHA-256, as a number, and what meets is
    confirmed on all of it.  Repeated rows come back as often; a page without a rule has a null rule and the
    ``default`` verdict; a null url has an empty host and path.  Rules that are null or repeated change nothing.
    """
    cut = F.locate("/", F.col("rule"))
    known = rules.where("rule is not null").select(
        "rule", "verdict",
        lower_ascii(F.when(cut > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule"))).alias("r_host"),
        F.when(cut > 0, F.expr("substring(rule, locate('/', rule))")).otherwise(F.lit("")).alias("r_path"),
    )
    known = known.select(
        "rule", "verdict", F.length("rule").alias("size"), F.length("r_path").alias("r_len"),
        _digest(F.col("r_host"), F.col("r_path")).alias("digest"),
    )
    known = known.withColumn("short", _short(F.col("digest"), prefix_digits))
    # the lengths of rule paths, a set bounded by the longest URL and checked as any broadcast
    facts = known.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("r_len")).alias("lengths")).first()
    lengths = [int(x) for x in facts["lengths"]] or [0]

    host, path = url_parts(F.col(url_col))
    page = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    # repeated pages are judged once and counted
    page = page.groupBy(id_col, "host", "path").agg(F.count(F.lit(1)).alias("_times"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    row = F.xxhash64(F.col(id_col), F.col("host"), F.col("path"))
    exploded = page.withColumn("_row", row).select("*", F.explode_outer(both).alias("_expr"))
    exploded = exploded.withColumn("_digest", F.sha2("_expr", 256))
    side = F.broadcast(known) if facts["n"] <= BROADCAST_ROWS else known
    # an equality of digests would become a join key; a prefix test of equally long strings stays a confirmation
    met = (_short(F.col("_digest"), prefix_digits) == F.col("short")) & F.startswith(F.col("_digest"), F.col("digest"))
    matched = exploded.join(side, met, "left")
    strength = F.when(
        F.col("rule").isNotNull(),
        F.struct("size", (F.col("verdict") == "block").alias("blocks"), "rule", F.col("verdict").alias("said")),
    )
    best = matched.groupBy("_row", id_col, "host", "path", "_times").agg(F.max(strength).alias("_best"))
    again = F.explode(F.array_repeat(F.lit(0), F.col("_times").cast("int"))).alias("_again")
    return best.select(
        id_col, "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.said"), F.lit(default)).alias("verdict"), again,
    ).drop("_again")
