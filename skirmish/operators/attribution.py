"""Who a name on a scoreboard is: candidates by name, scores, and sightings that only one profile explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clamp, normal_name
from ..sources.tables import written
from .observations import in_intervals
from .similarity import near_names

SURE = 0.9


def growing(logged: DataFrame) -> DataFrame:
    """logged: steamid, seen, minutes. The times between consecutive looks in which the minutes grew, both ends included: steamid, start, end."""
    order = W.partitionBy("steamid").orderBy("seen")
    pairs = logged.select("steamid", F.col("seen").alias("start"), F.lead("seen").over(order).alias("end"), "minutes", F.lead("minutes").over(order).alias("later"))
    return pairs.filter("end is not null and later > minutes").select("steamid", "start", "end")


def name_candidates(names: DataFrame, profiles: DataFrame, least: float = 0.3, top: int = 50) -> DataFrame:
    """names: norm. profiles: steamid, personaname, recent_min. The profiles with the most similar names, same names first, at most `top` a name.

    Profiles of one spelling are as similar as each other, so no more than `top` of each go into the join, however many there are.
    """
    known = profiles.filter("personaname is not null").select("steamid", "recent_min", F.lower("personaname").alias("low"))
    known = known.withColumn("n", F.row_number().over(W.partitionBy("low").orderBy("steamid"))).filter(F.col("n") <= top).drop("n")
    spelt = known.groupBy("low").agg(F.count("*").alias("n"))
    near = near_names(names.select("norm").distinct(), spelt.select("low"), least).select(F.col("a").alias("norm"), F.col("b").alias("low"), "similarity")
    same = F.regexp_replace(F.trim("low"), r"\s+", " ") == F.col("norm")
    near = near.join(spelt, "low").withColumn("exact", same)
    # Spellings before which there are `top` profiles of nearer ones aren't spelled out.
    upto = F.sum("n").over(W.partitionBy("norm").orderBy(F.desc("exact"), F.desc("similarity")).rangeBetween(W.unboundedPreceding, W.currentRow))
    near = near.withColumn("nearer", upto - F.sum("n").over(W.partitionBy("norm", "exact", "similarity"))).filter(F.col("nearer") < top)
    ranked = near.drop("n", "nearer").join(known, "low")
    ranked = ranked.withColumn("place", F.row_number().over(W.partitionBy("norm").orderBy(F.desc("exact"), F.desc("similarity"), "steamid"))).filter(F.col("place") <= top)
    whole = W.partitionBy("norm")
    return ranked.withColumn("candidates", F.count("*").over(whole)).withColumn("same", F.count_if("exact").over(whole)).drop("low")


def _confidence(played: Column) -> Column:
    """How sure a candidate is, of its columns from name_candidates() and `recent`."""
    sign = lambda c, weight: F.when(c, F.lit(weight)).otherwise(0.0)
    score = 0.45 * clamp(F.col("similarity"), 0.0, 1.0) + sign(F.col("exact"), 0.15) + sign(F.col("recent"), 0.15) + sign(played, 0.35)
    score = score + sign(F.col("exact") & (F.col("same") == 1), 0.15) + sign(F.col("candidates") > 20, -0.1)
    return clamp(score, 0.0, 1.0)


def _named(observed: DataFrame) -> DataFrame:
    return observed.select("segment", "name", "started", normal_name(F.col("name")).alias("norm")).filter("norm <> ''")


def scored(observed: DataFrame, profiles: DataFrame, logged: DataFrame) -> DataFrame:
    """observed: segment, name, started. Every candidate of every observed name with its confidence.

    played: the profile's minutes grew over a time that holds the start of the segment.
    """
    seen = _named(observed)
    pairs = seen.join(name_candidates(seen, profiles), "norm")
    asked = pairs.select("steamid", "started").distinct()
    played = asked.join(growing(logged), "steamid").filter(F.col("started").between(F.col("start"), F.col("end"))).select("steamid", "started").distinct().withColumn("played", F.lit(True))
    pairs = pairs.join(played, ["steamid", "started"], "left").withColumn("played", F.coalesce("played", F.lit(False))).withColumn("recent", F.coalesce(F.col("recent_min") > 0, F.lit(False)))
    out = pairs.withColumn("confidence", _confidence(F.col("played")))
    return out.select("segment", "name", "started", "steamid", "similarity", "exact", "recent", "played", "place", "confidence")


def sure(observed: DataFrame, profiles: DataFrame, logged: DataFrame, least: float = SURE, bin_seconds: int = 86_400) -> DataFrame:
    """Of the rows of scored() the best of each observed name, if its confidence is at least `least`; for attributions().

    Names aren't paired with all their candidates: of those that don't play only the best can win, which hangs on the name alone, and of the
    others only those that would be sure enough are looked for, among the times of the name's candidates in the same bin of time.
    """
    seen = _named(observed)
    fields = ("confidence", "similarity", "place", "played", "steamid", "exact", "recent")
    row = lambda played: F.struct(_confidence(F.lit(played)).alias("confidence"), "similarity", (-F.col("place")).alias("place"), F.lit(played).alias("played"), "steamid", "exact", "recent")
    known = name_candidates(seen, profiles).withColumn("recent", F.coalesce(F.col("recent_min") > 0, F.lit(False)))
    known = written(known.select("norm", "steamid", row(True).alias("on"), row(False).alias("off")).filter(F.col("on.confidence") >= least))
    alone = written(known.groupBy("norm").agg(F.max(F.when(F.col("off.confidence") >= least, F.col("off"))).alias("off")))
    at = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / bin_seconds)
    times = growing(logged).join(known.select("norm", "steamid", "on"), "steamid").drop("steamid").withColumn("bin", F.explode(F.sequence(at("start"), at("end"))))
    asked = seen.join(alone, "norm").withColumn("bin", at("started"))
    met = asked.join(times, (asked["norm"] == times["norm"]) & (asked["bin"] == times["bin"]) & asked["started"].between(times["start"], times["end"]), "left").select(asked["*"], "on")
    best = met.groupBy("norm", "bin", "segment", "name", "started").agg(F.max("on").alias("on"), F.max("off").alias("off"))
    best = best.select("segment", "name", "started", F.greatest("on", "off").alias("b")).filter("b is not null").select("segment", "name", "started", *(F.col(f"b.{c}") for c in fields))
    return best.select("segment", "name", "started", "steamid", "similarity", "exact", "recent", "played", (-F.col("place")).alias("place"), "confidence")


def candidate_tiers(scores: DataFrame) -> DataFrame:
    """The candidates with how far to trust them: strong, possible or weak."""
    tier = F.when(F.col("played") & (F.col("confidence") >= 0.7), "strong").when(F.col("confidence") >= 0.45, "possible").otherwise("weak")
    return scores.select("segment", "name", "steamid", "similarity", "confidence", "exact", "recent", "played", tier.alias("tier"))


def attributions(scores: DataFrame, least: float = SURE) -> DataFrame:
    """The best candidate of each observed name, if it is sure enough; of two as good, the one first among the candidates."""
    best = F.max_by(F.struct("steamid", "similarity", "exact", "recent", "played", "confidence"), F.struct("confidence", "similarity", -F.col("place")))
    out = scores.groupBy("segment", "name").agg(best.alias("b")).select("segment", "name", "b.*").filter(F.col("confidence") >= least)
    return out.withColumn("strong", F.col("played") & (F.col("confidence") >= 0.7))


def pending(observed: DataFrame, done: DataFrame, days: int = 14, top: int = 4000) -> DataFrame:
    """The newest observed names of the last days that aren't done, at most `top` for one pass; those left come in a later one."""
    last = observed.agg(F.max("started").alias("as_of"))
    recent = observed.crossJoin(F.broadcast(last)).filter(F.col("started") > F.col("as_of") - F.make_interval(days=F.lit(days))).drop("as_of")  # one row
    return recent.join(done.select("segment", "name").distinct(), ["segment", "name"], "left_anti").orderBy(F.desc("started"), "segment", "name").limit(top)


def merged_intervals(intervals: DataFrame, key: str) -> DataFrame:
    """Intervals of each key that overlap or touch, as one."""
    order = W.partitionBy(key).orderBy("start", "end")
    until = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = intervals.withColumn("new", F.when(until.isNull() | (F.col("start") > until), 1).otherwise(0))
    marked = marked.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def sightings(observed: DataFrame, profiles: DataFrame, logged: DataFrame, days: int = 30) -> DataFrame:
    """observed: segment, name, started, first_score, last_score. How many profiles of the same name provably played when the segment began.

    steamid: that profile where there is one; where there are more, the sighting is ambiguous. Open times are counted by
    name and time, with the sum of the ids, so profiles and segments of a common name are never paired.
    """
    last = observed.agg(F.max("started").alias("as_of"))
    recent = observed.crossJoin(F.broadcast(last)).filter(F.col("started") > F.col("as_of") - F.make_interval(days=F.lit(days)))  # one row
    recent = recent.select("segment", "name", normal_name(F.col("name")).alias("key"), F.col("started").alias("at"), F.greatest(F.col("last_score") - F.col("first_score"), F.lit(0)).alias("gain")).filter("key <> ''")
    named = profiles.filter("personaname is not null").select("steamid", normal_name(F.col("personaname")).alias("key"))
    times = merged_intervals(growing(logged), "steamid").withColumn("end", F.expr("end + INTERVAL 1 MICROSECOND"))
    open_ = in_intervals(recent, times.join(named, "steamid"), value="steamid")
    who = F.when(F.col("n") == 1, F.col("total")).cast("long")
    return recent.join(open_, ["key", "at"]).filter("n > 0").select("segment", "name", F.col("at").alias("started"), "gain", F.col("n").alias("players"), who.alias("steamid"))
