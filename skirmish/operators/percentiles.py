"""Exact percentiles by selection: no task holds the values of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Of the sketch that brackets a rank: its rank error is at most the group's size by this.
ACCURACY = 10_000


def percentiles(values: DataFrame, by: list[str], value: str, fractions: tuple[float, ...], accuracy: int = ACCURACY) -> DataFrame:
    """by, step (place in fractions), value: the interpolated percentile of each group, from its two neighbours in order.

    A mergeable sketch of bounded size gives for each rank two values with the rank surely between them: its error is known, and the
    bracket is wider than that. (Of a group of no more values than the accuracy it is the whole group.) Then exact counts tell how many values lie below the bracket, and only those inside are sorted:
    a part of the group that falls with the accuracy, whatever the distribution. All fractions share the passes. Equal values are
    counted before they are moved. Nulls don't count; a group without values, and groups of a null key, have no rows.
    """
    rows = values.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    margin = 5 / accuracy  # of the sketch, and of the neighbours' places
    edges = [min(max(f + sign * margin, 0.0), 1.0) for f in fractions for sign in (-1, 1)]
    groups = rows.groupBy(*by).agg(F.count("*").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", edges, accuracy).alias("edges"))

    def edge(i: int):
        return F.col("low") if edges[i] == 0 else F.col("high") if edges[i] == 1 else F.col("edges")[i]

    small = F.col("total") <= accuracy
    steps = F.array(*(F.struct(F.lit(i).alias("step"), F.when(small, F.col("low")).otherwise(edge(2 * i)).alias("least"), F.when(small, F.col("high")).otherwise(edge(2 * i + 1)).alias("most")) for i in range(len(fractions))))
    known = groups.select(*by, "total", steps.alias("steps"))
    counted = rows.groupBy(*by, "v").agg(F.count("*").alias("n")).join(known, by)
    below = counted.groupBy(*by).agg(F.first("total").alias("total"), F.array(*(F.sum(F.when(F.col("v") < F.col("steps")[i]["least"], F.col("n")).otherwise(0)) for i in range(len(fractions)))).alias("below"))
    below = below.select(*by, "total", F.posexplode("below").alias("step", "below"))
    inside = counted.select(*by, "v", "n", F.explode(F.filter("steps", lambda s: (F.col("v") >= s["least"]) & (F.col("v") <= s["most"]))["step"]).alias("step"))
    inside = inside.withColumn("upto", F.sum("n").over(W.partitionBy(*by, "step").orderBy("v")))
    at = F.element_at(F.array(*(F.lit(float(f)) for f in fractions)), F.col("step") + 1) * (F.col("total") - 1)
    met = inside.join(below, [*by, "step"]).withColumn("at", at).withColumn("last", F.col("below") + F.col("upto"))
    holds = lambda rank: (rank >= F.col("last") - F.col("n")) & (rank < F.col("last"))
    ends = met.groupBy(*by, "step").agg(F.first("at").alias("at"), F.max(F.when(holds(F.floor("at")), F.col("v"))).alias("down"), F.max(F.when(holds(F.ceil("at")), F.col("v"))).alias("up"))
    return ends.select(*by, "step", (F.col("down") + (F.col("up") - F.col("down")) * (F.col("at") - F.floor("at"))).alias("value"))


def percentile_columns(values: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """by, and a column for each named fraction."""
    found = percentiles(values, by, value, tuple(fractions.values()))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("step") == i, F.col("value"))).alias(name) for i, name in enumerate(fractions)))
