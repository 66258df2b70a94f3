"""The state of the corpus at a glance, each from one pass over its table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_counts(players: DataFrame) -> DataFrame:
    """How many players, known, private, banned, flagged and active."""
    known, flagged = F.col("personaname").isNotNull(), F.col("botness") >= 0.5
    return players.agg(F.count("*").alias("players"), F.count_if(known).alias("named"), F.count_if(F.col("items_status") == "private").alias("private"), F.count_if("vac_banned").alias("banned"), F.count_if(flagged).alias("flagged"), F.count_if(F.col("active_min") > 0).alias("active"))


def frontier(queue: DataFrame) -> DataFrame:
    """What is queued, by source, and since when at the longest. queue: source, enqueued_at."""
    return queue.groupBy("source").agg(F.count("*").alias("n"), F.min("enqueued_at").alias("oldest"))


def top_countries(players: DataFrame, top: int = 24) -> DataFrame:
    return players.filter("country is not null").groupBy("country").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country").limit(top)


def class_totals(stats: DataFrame) -> DataFrame:
    """Hours, players and points by class."""
    return stats.groupBy("class_num").agg((F.sum("playtime_seconds") / 3600.0).alias("hours"), F.count_distinct("steamid").alias("players"), F.sum("points_scored").alias("points"))


def keyed_values(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """rows with the fields of a JSON column as columns; what can't be read, and fields that are absent, are null."""
    parsed = rows.withColumn("_parsed", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    return parsed.select(*rows.columns, "_parsed.*")
