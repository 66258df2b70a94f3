"""Incremental builds: new files of a table become partial counts that add up to what one full build would give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import versions


def build(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], root: str) -> None:
    """Take all that is new in the stream, and return. partial: makes partial counts of one batch's rows.

    Each batch is written to a folder named by its number, whole or not at all from the reader's view, since a batch that is run again after a
    failure replaces its own folder and no other. Which rows are in which batch is in the checkpoint under root.
    """

    def write(rows: DataFrame, batch: int) -> None:
        partial(rows).write.mode("overwrite").parquet(f"{root}/partial/batch={batch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def partials(spark: SparkSession, root: str) -> DataFrame:
    """The partial counts of all batches, with the number of each as `batch`."""
    return spark.read.parquet(f"{root}/partial")


def merged(rows: DataFrame, keys: list[str], sums: tuple[str, ...] = (), least: tuple[str, ...] = (), most: tuple[str, ...] = ()) -> DataFrame:
    """One row per key of partial counts: sums, least and greatest values. Null keys are keys."""
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in most))


def compact(spark: SparkSession, root: str, keys: list[str], sums: tuple[str, ...] = (), least: tuple[str, ...] = (), most: tuple[str, ...] = ()) -> DataFrame:
    """The merged counts as a new version of the table at root/table, and its rows; readers of the version before aren't disturbed.

    The partial folders stay, so it can be done again after a failure and gives the same rows.
    """
    versions.replace(merged(partials(spark, root), keys, sums, least, most), f"{root}/table")
    return versions.current(spark, f"{root}/table")
