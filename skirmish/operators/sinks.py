"""Writing: merge policies as plans over the old and the new rows, and tables replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import versions


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str, first: tuple[str, ...] = (), last: tuple[str, ...] = (), most: tuple[str, ...] = (), add: tuple[str, ...] = ()) -> DataFrame:
    """target after updates, one row per key: by column the first or the last value by `order`, the greatest, or the sum.

    Both sides have the same columns. One partial aggregation takes the place of a join, so a key with very many
    updates is one row per task before the shuffle. Nulls never replace values.
    """
    at = F.col(order)
    policies = [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in first] + [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in last]
    policies += [F.max(c).alias(c) for c in most] + [F.sum(c).alias(c) for c in add]
    return target.unionByName(updates).groupBy(*keys).agg(*policies, F.max(order).alias(order))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """target with the rows whose key it doesn't have, the first of each key."""
    new = rows.join(target.select(*keys).distinct(), keys, "left_anti")
    columns = [c for c in rows.columns if c not in keys]
    return target.unionByName(new.groupBy(*keys).agg(*(F.min_by(c, order).alias(c) for c in columns)).select(*target.columns))


def rejected(rows: DataFrame, casts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """rows with the columns cast, and apart those of which a value can't be."""
    bad = F.lit(False)
    for c, kind in casts.items():
        bad = bad | (F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull())
    return rows.filter(~bad).withColumns({c: F.col(c).try_cast(kind) for c, kind in casts.items()}), rows.filter(bad)


def replace_table(df: DataFrame, name: str, root: str) -> None:
    """The whole of a table by way of a staged version under root; the view `name` is then set to it in one step of the catalog.

    Readers see the old rows or the new ones: a query that runs keeps the files it began with, which only versions.vacuum() removes.
    """
    version = versions.replace(df, root)
    df.sparkSession.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{root}/{version}`")


def swept(source: DataFrame, dead: Column, root: str) -> tuple[int, int]:
    """Rows of source for which `dead` holds, apart from the rest, as the next version of root; returns (kept, dead) counts.

    One scan and one write serve both outputs: rows are tagged, and the tag is the partition. Counts are observed in that write
    and must add up to the rows read, else nothing is committed. kept() and dead() read the newest version, so a rerun on
    kept rows finds none, and on the same source gives the same rows again. A null condition keeps the row.
    """
    tag = F.when(F.coalesce(dead, F.lit(False)), "dead").otherwise("kept")
    seen = Observation()
    rows = source.withColumn("outcome", tag).observe(seen, F.count("*").alias("all"), F.count_if(F.col("outcome") == "dead").alias("dead"))
    versions.replace(rows, root, "outcome", lambda written: _whole(written, seen))
    return seen.get["all"] - seen.get["dead"], seen.get["dead"]


def _whole(written: DataFrame, seen: Observation) -> None:
    found = {r["outcome"]: r["count"] for r in written.groupBy("outcome").count().collect()}
    if sum(found.values()) != seen.get["all"] or found.get("dead", 0) != seen.get["dead"]:
        raise ValueError(f"{seen.get} rows were read, {found} were written")


def outcome(spark: SparkSession, root: str, which: str) -> DataFrame:
    """The kept or the dead rows of the newest sweep."""
    return versions.current(spark, root).filter(F.col("outcome") == which).drop("outcome")


def dead_letters(waiting: DataFrame, known: DataFrame, attempts: int = 5, now: Column | None = None) -> tuple[Column, DataFrame]:
    """The condition of a dead row of a queue (tried often enough, not locked any more), and the error rows for players not known yet.

    waiting: steamid, source, attempts, locked_until.
    """
    at = F.current_timestamp() if now is None else now
    dead = (F.col("attempts") >= attempts) & (F.col("locked_until").isNull() | (F.col("locked_until") < at))
    new = waiting.filter(dead).groupBy("steamid").agg(F.min("source").alias("source")).join(known.select("steamid").distinct(), "steamid", "left_anti")
    return dead, new.select("steamid", "source", F.lit("error").alias("items_status"), F.lit("error").alias("stats_status"))


def daily_snapshot(df: DataFrame, path: str, day: str = "day") -> None:
    """One partition for each day; a rerun replaces the days that it has and leaves others."""
    df.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
