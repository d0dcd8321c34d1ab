"""Profiles and drift of a stream, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quern.operators import drift


def watch(stream: DataFrame, baseline: DataFrame, report: Callable[[int, DataFrame], None], checkpoint: str):
    """Start a query that compares each micro-batch with ``baseline`` and hands the drift findings to ``report``.

    The baseline's snapshot is taken once; an empty micro-batch is skipped.
    """
    before = drift.snapshot(baseline).cache()

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            report(number, drift.drift_of_snapshots(before, drift.snapshot(batch)))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
