"""What is seen of servers and matches: segments from scoreboards, series, coverage, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .similarity import near_names


def match_segments(scores: DataFrame, returning: int = 4, dropped: float = 0.6) -> DataFrame:
    """scores: server, round, map, name, score, one row each. Returns one row per segment of rounds.

    A round begins a segment if it is the server's first, if the map changed, or if at least `returning`
    players came back and at least the share `dropped` of them with less score than in the round before.
    """
    rounds = scores.groupBy("server", "round").agg(F.min("map").alias("map"), F.count("*").alias("players"))
    order = W.partitionBy("server").orderBy("round")
    rounds = rounds.withColumn("before", F.lag("round").over(order)).withColumn("was", F.lag("map").over(order))
    old = scores.select("server", F.col("round").alias("before"), "name", F.col("score").alias("old"))
    back = scores.select("server", "round", "name", "score").join(rounds.select("server", "round", "before"), ["server", "round"]).join(old, ["server", "before", "name"])
    resets = back.groupBy("server", "round").agg(F.count("*").alias("came"), F.count_if(F.col("score") < F.col("old")).alias("fell"))
    r = rounds.join(resets, ["server", "round"], "left")
    reset = (F.coalesce("came", F.lit(0)) >= returning) & (F.coalesce("fell", F.lit(0)) >= dropped * F.coalesce("came", F.lit(0)))
    why = F.when(F.col("before").isNull(), "first").when(F.col("map") != F.col("was"), "map_change").when(reset, "score_reset")
    r = r.withColumn("why", why).withColumn("segment", F.count("why").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy("server", "segment").agg(F.min("round").alias("started"), F.max("round").alias("ended"), F.min_by("map", "round").alias("map"), F.count("*").alias("observations"), F.max("why").alias("opened_by"), F.sum("players").alias("seen"))


def closed_segments(scores: DataFrame, returning: int = 4, dropped: float = 0.6, gone: int = 2) -> DataFrame:
    """The segments of match_segments() that are closed, also by more than `gone` rounds without the server, and why. Batch twin of streaming.live.segments."""
    order = W.partitionBy("server").orderBy("round")
    away = scores.select("server", "round").distinct().withColumn("since", F.col("round") - F.lag("round").over(order)).filter(F.col("since") > gone)
    opened = match_segments(scores, returning, dropped)
    rounds = scores.groupBy("server", "round").agg(F.min("map").alias("map"))
    starts = opened.select("server", F.col("started").alias("round"), F.col("opened_by").alias("why")).join(away.select("server", "round", F.lit(True).alias("away")), ["server", "round"], "full")
    starts = starts.select("server", "round", F.when(F.col("away"), "server_gone").otherwise(F.col("why")).alias("why"))
    r = rounds.join(starts, ["server", "round"], "left").withColumn("segment", F.count("why").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = r.groupBy("server", "segment").agg(F.min("round").alias("started"), F.max("round").alias("ended"), F.min_by("map", "round").alias("map"), F.count("*").alias("observations"), F.max("why").alias("why"))
    out = whole.withColumn("closed_by", F.lead("why").over(W.partitionBy("server").orderBy("segment"))).filter("closed_by is not null")
    return out.select("server", "started", "ended", "map", "observations", "closed_by")


def timed_segments(scores: DataFrame, as_of: Column, gone_seconds: int = 1800, returning: int = 4, dropped: float = 0.6) -> DataFrame:
    """scores: server, round, at, map, name, score. The closed segments of rounds in order of their time, and why: the first that holds of server_gone
    (over `gone_seconds` since the round before, or up to as_of), map_change and score_reset. Batch twin of streaming.live.timed_segments.

    A name twice in a round counts with its greatest score; of two maps of a round the lesser is taken.
    """
    scores = scores.groupBy("server", "round", F.unix_timestamp(F.col("at").cast("timestamp")).alias("second"), "name").agg(F.max("score").alias("score"), F.min("map").alias("map"))
    order = W.partitionBy("server").orderBy("second", "round")
    rounds = scores.groupBy("server", "second", "round").agg(F.min("map").alias("map"))
    rounds = rounds.withColumn("was", F.lag("map").over(order)).withColumn("before", F.lag("second").over(order)).withColumn("prior", F.lag("round").over(order))
    old = scores.select("server", F.col("second").alias("before"), F.col("round").alias("prior"), "name", F.col("score").alias("old"))
    back = scores.select("server", "second", "round", "name", "score").join(rounds.select("server", "second", "round", "before", "prior"), ["server", "second", "round"]).join(old, ["server", "before", "prior", "name"])
    resets = back.groupBy("server", "second", "round").agg(F.count("*").alias("came"), F.count_if(F.col("score") < F.col("old")).alias("fell"))
    reset = (F.coalesce("came", F.lit(0)) >= returning) & (F.coalesce("fell", F.lit(0)) >= dropped * F.coalesce("came", F.lit(0)))
    why = F.when(F.col("before").isNull(), "first").when(F.col("second") - F.col("before") > gone_seconds, "server_gone").when(F.col("map") != F.col("was"), "map_change").when(reset, "score_reset")
    marked = rounds.join(resets, ["server", "second", "round"], "left").withColumn("why", why)
    marked = marked.withColumn("segment", F.count("why").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = marked.groupBy("server", "segment").agg(F.min("second").alias("started"), F.max("second").alias("ended"), F.min_by("map", F.struct("second", "round")).alias("map"), F.count("*").alias("observations"), F.max("why").alias("why"))
    left = F.when(F.unix_timestamp(as_of) > F.col("ended") + gone_seconds, "server_gone")
    out = whole.withColumn("closed_by", F.coalesce(F.lead("why").over(W.partitionBy("server").orderBy("segment")), left)).filter("closed_by is not null")
    return out.select("server", "started", "ended", "map", "observations", "closed_by")


def trend(events: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """Hourly means of per-scan sums, one column for each mode; a mode without scans in an hour has none."""
    scans = events.groupBy(F.date_trunc("minute", "ts").alias("scan"), F.col("event_type").alias("mode")).agg(F.count("*").alias("players"))
    hourly = scans.groupBy(F.date_trunc("hour", "scan").alias("hour"), "mode").agg(F.avg("players").alias("players"))
    return hourly.groupBy("hour").pivot("mode", list(modes)).agg(F.first("players"))


def scan_totals(events: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """events: ts, user_id, gametype (tags, comma-separated). Rows by scan of five minutes and region, and how many carry each tag."""
    parts = F.split("gametype", ",")
    scans = events.groupBy(F.window("ts", "5 minutes")["start"].alias("scan"), (F.col("user_id") % 4).alias("region"))
    return scans.agg(F.count("*").alias("servers"), *(F.count_if(F.array_contains(parts, t)).alias(t) for t in tags))


def peaks(events: DataFrame) -> DataFrame:
    """Players in the newest hour, and the highest hour of each day."""
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count_distinct("user_id").alias("players"))
    days = hours.groupBy(F.to_date("hour").alias("day")).agg(F.max("players").alias("peak"))
    return days.crossJoin(F.broadcast(hours.agg(F.max_by("players", "hour").alias("live"))))  # one row


def rush_hours(events: DataFrame) -> DataFrame:
    """Mean players by hour of the day, and share of the whole."""
    scans = events.groupBy(F.date_trunc("hour", "ts").alias("scan")).agg(F.count("*").alias("players"))
    out = scans.groupBy(F.hour("scan").alias("hour")).agg(F.avg("players").alias("players"))
    return out.crossJoin(F.broadcast(out.agg(F.sum("players").alias("all")))).select("hour", "players", ratio(F.col("players"), F.col("all")).alias("share"))


def outcome_rates(events: DataFrame) -> DataFrame:
    """Calls and failures by endpoint and hour, from one pass."""
    failed = F.col("value") > 90
    out = events.groupBy(F.col("event_type").alias("endpoint"), F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failed"))
    return out.withColumn("rate", ratio(F.col("failed"), F.col("calls")))


def recapture(events: DataFrame, days: int = 7, least: float = 100) -> DataFrame:
    """Chapman's estimate of a population from who is seen in each of the last two periods."""
    last = events.agg(F.max("ts").alias("as_of"))
    seen = events.filter(F.col("value") > least).crossJoin(F.broadcast(last)).filter(F.col("ts") > F.col("as_of") - F.make_interval(days=F.lit(2 * days)))
    late = F.col("ts") > F.col("as_of") - F.make_interval(days=F.lit(days))
    who = seen.groupBy("user_id").agg(F.bool_or(~late).alias("a"), F.bool_or(late).alias("b"))
    n = who.agg(F.count_if("a").alias("n1"), F.count_if("b").alias("n2"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    return n.withColumn("estimate", (F.col("n1") + 1) * (F.col("n2") + 1) / (F.col("both") + 1) - 1)


def name_classes(rows: DataFrame) -> DataFrame:
    """rows: key, name. Each key with the least key of its name, which stands for all rows of the name; rows without a name have none."""
    least = rows.filter("name is not null").groupBy("name").agg(F.min("key").alias("class_key"))
    return rows.join(least, "name", "left").select("key", "name", "class_key")


def similar_names(left: DataFrame, right: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of names whose trigram sets have at least this Jaccard similarity; both: key, name.

    One row per pair of distinct names: the least key of each (see name_classes() for the other keys), and how many rows
    have it. So a name that very many rows share makes no more pairs than any other.
    """
    def named(df: DataFrame, name: str, side: str) -> DataFrame:
        return df.filter("name is not null").groupBy(F.col("name").alias(name)).agg(F.min("key").alias(f"{side}_key"), F.count("*").alias(f"{side}_rows"))

    a, b = named(left, "a", "left"), named(right, "b", "right")
    near = near_names(a.select("a"), b.select("b"), least)
    return near.join(a, "a").join(b, "b").select("left_key", "right_key", "left_rows", "right_rows", "similarity")


def in_intervals(points: DataFrame, intervals: DataFrame, bin_seconds: int = 86_400, value: str | None = None) -> DataFrame:
    """points: key, at. intervals: key, start, end (half-open). Each point with the number of intervals of its key that hold it.

    value: a whole-number column of the intervals whose sum over these is returned as `total`.

    What is open at a time is the number of starts up to it less the number of ends up to it. Both are summed by key and time first,
    then within time bins and over the totals of bins, so neither a crowded key nor a long interval makes pairs of points and intervals.
    """
    whole = intervals.filter("key is not null and start < end")
    sums = {"by": "n"} | ({"much": "total"} if value else {})
    much = F.col(value).cast("decimal(38,0)") if value else F.lit(None).cast("decimal(38,0)")
    moves = whole.select("key", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("by"), much.alias("much")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("by"), (-much).alias("much")))).alias("m"))
    moves = moves.select("key", "m.at", *(f"m.{c}" for c in sums), F.lit(False).alias("asked"))
    asked = points.select("key", "at", *(F.lit(0).alias(c) for c in sums), F.lit(True).alias("asked"))
    times = moves.unionByName(asked).groupBy("key", "at").agg(*(F.sum(c).cast("long" if c == "by" else "decimal(38,0)").alias(c) for c in sums), F.bool_or("asked").alias("asked"))
    times = times.withColumn("bin", F.floor(F.unix_timestamp(F.col("at").cast("timestamp")) / bin_seconds))
    bins = times.groupBy("key", "bin").agg(*(F.sum(c).alias(c) for c in sums))
    earlier = W.partitionBy("key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select("key", "bin", *(F.sum(c).over(earlier).alias(f"before_{c}") for c in sums))
    within = times.withColumns({f"within_{c}": F.sum(c).over(W.partitionBy("key", "bin").orderBy("at")) for c in sums}).filter("asked")
    held = lambda c: F.when(F.col("at").isNull(), 0).otherwise(F.col(f"within_{c}") + F.coalesce(f"before_{c}", F.lit(0)))
    return within.join(bins, ["key", "bin"], "left").select("key", "at", *(held(c).cast("long" if c == "by" else "decimal(38,0)").alias(name) for c, name in sums.items()))


def stat_windows(snapshots: DataFrame) -> DataFrame:
    """snapshots: steamid, at, total. Consecutive pairs with the difference; `reset` where it is negative, `lag` where nothing moved."""
    w = W.partitionBy("steamid").orderBy("at")
    out = snapshots.withColumn("start", F.lag("at").over(w)).withColumn("delta", F.col("total") - F.lag("total").over(w)).filter("start is not null")
    return out.select("steamid", "start", F.col("at").alias("end"), "delta", (F.col("delta") < 0).alias("reset"), (F.col("delta") == 0).alias("lag"))
