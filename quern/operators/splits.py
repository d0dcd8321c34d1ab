"""Train/test splits and folds by hashes of a key: the same rows in any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.stats import hash_bucket, hash_share
from quern.operators import profile as P

STRATEGIES = ("auto", "random", "stratified", "group", "time")


def resolve(df: DataFrame, strategy: str = "auto", target: str | None = None, group: str | None = None, time: str | None = None) -> str:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    if strategy != "auto":
        return strategy
    if group:
        return "group"
    if time:
        return "time"
    if target and (not P.is_numeric(df.schema[target].dataType) or df.select(target).distinct().limit(21).count() <= 20):
        return "stratified"
    return "random"


#: Rows that one task numbers, about.
SLICE_ROWS = 1_000_000


def _numbered(df: DataFrame, within: str, key: list[str], seed: int, rows: int) -> DataFrame:
    """``df`` with ``_k``, a row's number from 1 within its class by hash and key, and ``_n``, the class's size.

    Hashes are cut into even slices, so that a large class is numbered by many tasks; a slice starts where those before it end.
    """
    slices = max(1, -(-rows // SLICE_ROWS))
    keys = [F.col(c) for c in key]
    cut = df.withColumn("_h", hash_bucket(*keys, seed=seed)).withColumn("_slice", F.floor(F.col("_h") * F.lit(slices / (1 << 32))))
    of_class = Window.partitionBy("_class")
    starts = cut.groupBy(F.col(within).alias("_class"), F.col("_slice").alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    starts = starts.withColumn("_start", F.sum("_c").over(of_class.orderBy("_part")) - F.col("_c")).withColumn("_n", F.sum("_c").over(of_class)).drop("_c")
    met = cut.join(starts, F.col(within).eqNullSafe(F.col("_class")) & (F.col("_slice") == F.col("_part")))
    number = F.row_number().over(Window.partitionBy("_class", "_part").orderBy("_h", *keys))
    return met.withColumn("_k", F.col("_start") + number).drop("_h", "_slice", "_class", "_part", "_start")


def _classes(df: DataFrame, target: str) -> tuple[int, int]:
    """Rows of the rarest class, and of all."""
    found = df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"), F.sum("n")).first()
    return found[0] or 0, found[1] or 0


def split(
    df: DataFrame, key: list[str], strategy: str = "auto", test_size: float = 0.2, target: str | None = None, group: str | None = None,
    time: str | None = None, seed: int = 0,
) -> DataFrame:
    """``df`` with ``is_test``.

    random: rows whose hash share is below ``test_size``.  stratified: per class, the rows of smallest hash, in
    proportion.  group: whole groups, so many of them.  time: the latest rows, cut at a quantile of ``time`` (ties
    at the cut go by hash, gaps last).
    """
    how = resolve(df, strategy, target, group, time)
    keys = [F.col(c) for c in key]
    share = hash_share(*keys, seed=seed)
    if how == "random":
        return df.withColumn("is_test", share < test_size)
    if how == "stratified":
        if not target:
            raise ValueError("a stratified split needs a target")
        rarest, rows = _classes(df, target)
        if rarest == 1:
            raise ValueError(f"the rarest class of {target} has one row; it can't be on both sides")
        numbered = _numbered(df, target, key, seed, rows)
        return numbered.withColumn("is_test", F.col("_k") <= F.round(F.col("_n") * test_size)).drop("_k", "_n")
    if how == "group":
        if not group:
            raise ValueError("a group split needs a group")
        groups = df.select(F.col(group).alias("_g")).distinct().withColumn("_h", hash_bucket(F.col("_g"), seed=seed))
        # the cut is a quantile of the groups' hashes
        cut = groups.agg(F.percentile(F.col("_h"), F.lit(test_size))).first()[0]
        return df.withColumn("is_test", F.coalesce(hash_bucket(F.col(group), seed=seed) <= F.lit(cut or 0.0), F.lit(False)))
    if not time:
        raise ValueError("a time split needs a time column")
    return time_split(df, key, time, test_size)


def time_split(df: DataFrame, key: list[str], time: str, test_size: float) -> DataFrame:
    """The first floor(n (1 - test_size)) rows by time and key train; found by one count per distinct time."""
    counts = df.groupBy(F.col(time).alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    n = df.count()
    cut = int(n * (1 - test_size) + 1e-9)
    edge = counts.where("_t is not null").agg(F.percentile(F.col("_t").cast("timestamp").cast("double"), F.lit((cut - 1) / max(n - 1, 1)), F.col("_c"))).first()[0] if cut else None
    if edge is None:
        return df.withColumn("is_test", F.lit(True))
    t = F.col(time).cast("timestamp").cast("double")
    # percentile interpolates, so the row at the cut has the largest time at or below it
    at = df.where(t <= edge + 1e-6).agg(F.max(t)).first()[0]
    before = df.where(t < at).count()
    ties = df.where(t == at).withColumn("_k", F.row_number().over(Window.partitionBy(time).orderBy(*key))).where(F.col("_k") <= cut - before).select(*key, F.lit(True).alias("_edge"))
    joined = df.join(ties, key, "left")
    return joined.withColumn("is_test", ~F.coalesce((t < at) | F.col("_edge"), F.lit(False))).drop("_edge")


def overlap(df: DataFrame, group: str) -> bool:
    """Whether a group stands on both sides."""
    return not df.groupBy(group).agg(F.min("is_test").alias("a"), F.max("is_test").alias("b")).where("a <> b").isEmpty()


def stratified_folds(df: DataFrame, key: list[str], target: str, folds: int = 5, seed: int = 0) -> DataFrame:
    numbered = _numbered(df, target, key, seed, _classes(df, target)[1])
    return numbered.withColumn("fold", F.pmod(F.col("_k") - 1, F.lit(folds)).cast("int")).drop("_k", "_n")


def random_folds(df: DataFrame, key: list[str], folds: int = 5, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", F.pmod(hash_bucket(*[F.col(c) for c in key], seed=seed), F.lit(folds)).cast("int"))


def group_folds(df: DataFrame, group: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """Whole groups in one fold, by the hash of the group: no table of groups is gathered anywhere."""
    return df.withColumn("fold", F.pmod(hash_bucket(F.col(group), seed=seed), F.lit(folds)).cast("int"))


def make_folds(df: DataFrame, key: list[str], target: str | None, group: str | None, folds: int, seed: int = 0) -> DataFrame:
    """Folds shrink to the rarest class or the number of groups, to 2 at least."""
    if group:
        have = df.agg(F.count_distinct(group)).first()[0]
        return group_folds(df, group, max(2, min(folds, have)), seed)
    if target:
        return stratified_folds(df, key, target, max(2, min(folds, _classes(df, target)[0])), seed)
    return random_folds(df, key, folds, seed)
