"""Connected components over an edge table, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).  Every step is an
aggregate with map-side combining and one equi-join, which adaptive execution splits when one
vertex is hot; each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Work


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, work: Work, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, component)`` for every node on an edge but the smallest of its component.

    ``component`` is the smallest node reachable.  Self-loops are ignored; an empty input gives an empty result.
    """
    now = work.save(edges.select("u", "v").where("u <> v").distinct(), f"{name}_0")
    seen, last = _mark(now), f"{name}_0"
    for k in range(1, max_rounds + 1):
        if not seen[0]:
            break
        now = work.save(_small_star(_large_star(now)), f"{name}_{k}")
        work.drop(last)
        last = f"{name}_{k}"
        found = _mark(now)
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
