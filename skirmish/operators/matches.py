"""Matches: segments, their participants, lengths, maps, and what players did between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .percentiles import percentile_columns


def seconds(a: Column, b: Column) -> Column:
    """From a to b, with fractions."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def recent_segments(segments: DataFrame, participants: DataFrame, days: int = 10, top: int = 50) -> DataFrame:
    """The newest segments of the last days with their players and best score."""
    last = segments.agg(F.max("started").alias("as_of"))
    recent = segments.crossJoin(F.broadcast(last)).filter(F.col("started") > F.col("as_of") - F.make_interval(days=F.lit(days))).drop("as_of")
    newest = recent.orderBy(F.desc("started"), "segment").limit(top)
    seen = participants.join(F.broadcast(newest.select("segment")), "segment").groupBy("segment").agg(F.count("*").alias("players"), F.max("last_score").alias("best"))
    return newest.join(F.broadcast(seen), "segment").select("segment", "server", "map", "started", "players", "best")


def sampled_maps(segments: DataFrame, participants: DataFrame, top: int = 8) -> DataFrame:
    """The maps with the most participants."""
    return participants.join(segments.select("segment", "map"), "segment").groupBy("map").agg(F.count("*").alias("participants"), F.count_distinct("segment").alias("segments")).orderBy(F.desc("participants"), "map").limit(top)


def points_per_hour(least: int = 2) -> Column:
    """Score gained an hour; null with fewer observations, or without time between them."""
    span = seconds(F.col("first_seen"), F.col("last_seen"))
    return F.when((F.col("observations") >= least) & (span > 0), (F.col("last_score") - F.col("first_score")) * 3600.0 / span)


def segment_detail(segments: DataFrame, participants: DataFrame) -> DataFrame:
    """Every participant with the gain of score an hour and the place in the segment, unknown gains last."""
    out = participants.join(segments.select("segment", "map", "server"), "segment").withColumn("pph", points_per_hour())
    return out.withColumn("place", F.row_number().over(W.partitionBy("segment").orderBy(F.desc_nulls_last("pph"), F.desc("last_score"), "steamid"))).select("segment", "map", "server", "steamid", "last_score", "pph", "place")


def match_leaderboard(segments: DataFrame, participants: DataFrame, observations: int = 3, window: int = 1800, days: int = 20, top: int = 100) -> DataFrame:
    """The best hourly gains among those seen often and long enough, whose score never fell."""
    last = segments.agg(F.max("ended").alias("as_of"))
    span = seconds(F.col("first_seen"), F.col("last_seen"))
    fit = participants.filter((F.col("observations") >= observations) & (span >= window) & (F.col("last_score") >= F.col("first_score"))).crossJoin(F.broadcast(last))
    fit = fit.filter(F.col("last_seen") > F.col("as_of") - F.make_interval(days=F.lit(days))).withColumn("pph", points_per_hour())
    best = fit.orderBy(F.desc("pph"), "segment", "steamid").limit(top).select("segment", "steamid", "observations", "pph")
    return best.join(segments.select("segment", "map"), "segment")


WITNESSED = ("score_reset", "map_change")


def match_durations(segments: DataFrame, gap: float = 540, least: int = 5) -> DataFrame:
    """Median and quartiles of the lengths of segments whose both ends were seen, by mode and map and by mode.

    Both this segment and the server's one before were closed by a reset of scores or a change of map, and less than `gap` seconds lie
    between them. Segments seen once don't count, neither as matches nor as the one before. Maps need `least` matches.
    """
    order = W.partitionBy("server").orderBy("started", "segment")
    s = segments.filter("observations >= 2").withColumn("before", F.lag("ended").over(order)).withColumn("why", F.lag("closed_by").over(order))
    s = s.filter(F.col("closed_by").isin(*WITNESSED) & F.col("why").isin(*WITNESSED) & (seconds(F.col("before"), F.col("started")) < gap) & (F.col("ended") > F.col("started")))
    s = s.withColumn("length", seconds(F.col("started"), F.col("ended")))
    both = s.select("mode", F.coalesce("map", F.lit("")).alias("map"), F.lit(0).alias("whole"), "length").unionByName(s.select("mode", F.lit("").alias("map"), F.lit(1).alias("whole"), "length"))
    by = ["mode", "map", "whole"]
    counts = both.groupBy(*by).agg(F.count("*").alias("matches")).filter((F.col("whole") == 1) | (F.col("matches") >= least))
    out = counts.join(percentile_columns(both, by, "length", {"p25": 0.25, "median": 0.5, "p75": 0.75}), by)
    return out.select("mode", F.when(F.col("whole") == 0, F.col("map")).alias("map"), "matches", "p25", "median", "p75")


def duration_histogram(segments: DataFrame, edges: tuple[int, ...] = (0, 3600, 14_400, 28_800, 43_200, 10_000_000)) -> DataFrame:
    """Number of segments by length between fixed edges; the last is open, and empty ones stay."""
    length = seconds(F.col("started"), F.col("ended"))
    bucket = sum(((length >= e).cast("int") for e in edges[1:]), F.lit(0))
    found = segments.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = segments.sparkSession.createDataFrame(list(enumerate(edges)), "bucket int, low int")
    return every.join(found, "bucket", "left").select("bucket", "low", F.coalesce("n", F.lit(0)).alias("n"))


def class_windows(snapshots: DataFrame) -> DataFrame:
    """snapshots: steamid, snapshot, taken, class_num, seconds so far. One row per player and snapshot but the first; before: the snapshot before.

    moved: class -> seconds gained since the class was seen last; reset if any fell; lag if none moved; pure_class if one did.
    """
    deltas = snapshots.withColumn("delta", F.col("seconds") - F.coalesce(F.lag("seconds").over(W.partitionBy("steamid", "class_num").orderBy("taken", "snapshot")), F.lit(0)))
    gained = F.when(F.col("delta") > 0, F.struct("class_num", "delta"))
    whole = deltas.groupBy("steamid", "snapshot", F.col("taken").alias("end")).agg(F.array_sort(F.collect_list(gained)).alias("moved"), F.bool_or(F.col("delta") < 0).alias("reset"))
    order = W.partitionBy("steamid").orderBy("end", "snapshot")
    whole = whole.withColumn("start", F.lag("end").over(order)).withColumn("before", F.lag("snapshot").over(order)).filter("start is not null")
    pure = F.when(F.size("moved") == 1, F.element_at("moved", 1)["class_num"])
    return whole.select("steamid", "snapshot", "before", "start", "end", "moved", "reset", (F.size("moved") == 0).alias("lag"), pure.alias("pure_class"))


def points_gained(snapshots: DataFrame) -> DataFrame:
    """Points since the class was seen last, by player, snapshot and class."""
    before = F.lag("points").over(W.partitionBy("steamid", "class_num").orderBy("taken", "snapshot"))
    return snapshots.select("steamid", "snapshot", "class_num", (F.col("points") - F.coalesce(before, F.lit(0))).alias("points"))


def moved_classes(windows: DataFrame) -> DataFrame:
    """One row per window and class that moved."""
    return windows.select("steamid", "snapshot", "start", "end", "reset", F.explode("moved").alias("m")).select("steamid", "snapshot", "start", "end", "reset", "m.class_num", "m.delta")


def play_sessions(windows: DataFrame, top: int = 25) -> DataFrame:
    """The newest windows of each player with play, not reset, and their classes by time."""
    fit = windows.filter(~F.col("reset") & (F.size("moved") > 0))
    newest = fit.withColumn("place", F.row_number().over(W.partitionBy("steamid").orderBy(F.desc("end"), F.desc("snapshot")))).filter(F.col("place") <= top)
    by_time = F.transform(F.array_sort(F.transform("moved", lambda m: F.struct((-m["delta"]).alias("t"), m["class_num"].alias("c")))), lambda x: x["c"])
    return newest.select("steamid", "snapshot", "place", by_time.alias("classes"), F.aggregate("moved", F.lit(0).cast("long"), lambda a, m: a + m["delta"]).alias("seconds"))


def overlapping(windows: DataFrame, stays: DataFrame, bin_seconds: int | None = None) -> DataFrame:
    """windows: key, window, start, end. stays: key, map, from, to. The distinct (key, window, map) with from < end and to > start.

    Time is cut into bins, and windows and stays at their edges; two of them overlap if their parts in some bin do. So the rows of a
    crowded key are dealt by time, and windows only meet what is in their bins. Stays on one map in a bin that overlap or touch
    are one, so many stays at once make no more pairs than one. By default a bin is as long as the mean window or stay,
    whichever is longer, so the parts grow with the rows. Null keys, maps and times, and what ends before it begins, meet nothing.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    w = windows.select("key", "window", micros("start").alias("a"), micros("end").alias("b")).filter("key is not null and a <= b")
    s = stays.select("key", "map", micros("from").alias("a"), micros("to").alias("b")).filter("key is not null and map is not null and a <= b")
    if bin_seconds is None:
        means = [x.agg(F.avg(F.col("b") - F.col("a"))).first()[0] or 0 for x in (w, s)]
        bin_seconds = max(1, int(max(means) / 1e6))
    size = F.lit(bin_seconds * 1_000_000)

    def parts(x: DataFrame) -> DataFrame:
        # A part that began before its bin begins a microsecond before it, so that what has no length is inside at the edge too.
        x = x.withColumn("bin", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor(F.greatest(F.col("b") - 1, F.col("a")) / size))))
        return x.withColumn("a", F.greatest("a", F.col("bin") * size - 1)).withColumn("b", F.least("b", (F.col("bin") + 1) * size))

    order = W.partitionBy("key", "bin", "map").orderBy("a", "b")
    until = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    there = parts(s).withColumn("new", F.when(until.isNull() | (F.col("a") > until), 1).otherwise(0))
    there = there.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("key", "bin", "map", "run").agg(F.min("a").alias("from"), F.max("b").alias("to"))
    return parts(w).join(there, ["key", "bin"]).filter((F.col("from") < F.col("b")) & (F.col("to") > F.col("a"))).select("key", "window", "map").distinct()


def stays_of(participants: DataFrame, segments: DataFrame) -> DataFrame:
    """key, map, from, to: when a player was in a segment, and where."""
    return participants.join(segments.select("segment", "map"), "segment").select(F.col("steamid").alias("key"), "map", F.col("first_seen").alias("from"), F.col("last_seen").alias("to"))


def overlapping_maps(windows: DataFrame, participants: DataFrame, segments: DataFrame) -> DataFrame:
    """Windows (key, start, end) with the distinct maps of the stays of their key that overlap them; pure_map if there is one."""
    maps = overlapping(windows.select("key", "start", "end", F.struct("start", "end").alias("window")).distinct(), stays_of(participants, segments))
    maps = maps.groupBy("key", F.col("window.start").alias("start"), F.col("window.end").alias("end")).agg(F.array_sort(F.collect_list("map")).alias("maps"))
    out = windows.join(maps, ["key", "start", "end"], "left").withColumn("maps", F.coalesce("maps", F.array().cast("array<string>")))
    return out.withColumn("pure_map", F.when(F.size("maps") == 1, F.element_at("maps", 1)))


def windows_on_maps(windows: DataFrame, stays: DataFrame) -> DataFrame:
    """windows, as of class_windows(), with pure_map: the map of their player's stays that overlap them, if there is one. stays: key, map, from, to.

    Windows and stays without length are in no segment: they meet nothing.
    """
    long = windows.filter(F.col("start") < F.col("end")).select(F.col("steamid").alias("key"), F.col("snapshot").alias("window"), "start", "end")
    maps = overlapping(long, stays.filter(F.col("from") < F.col("to")))
    maps = maps.groupBy(F.col("key").alias("steamid"), F.col("window").alias("snapshot")).agg(F.count("*").alias("maps"), F.min("map").alias("one"))
    return windows.join(maps, ["steamid", "snapshot"], "left").select(*windows.columns, F.when(F.col("maps") == 1, F.col("one")).alias("pure_map"))


def full_windows(windows: DataFrame, stays: DataFrame, kits: DataFrame, slots: tuple[int, ...] = (0, 1, 2, 3, 4, 5, 6)) -> DataFrame:
    """windows, as of class_windows(), with pure_map, as of windows_on_maps(), and loadout_stable on the same row, one row per window.

    stays: key, map, from, to: attributed segments of players. kits: snapshot, class_num, slot_num, gid, known for some snapshots. A
    window is stable if both its snapshots are known and every class that moved wore the same weapons in both, so
    also if none moved.
    """
    worn = kits.groupBy("snapshot", "class_num").agg(F.array_sort(F.collect_set(F.when(F.col("slot_num").isin(*slots), F.col("gid")))).alias("gids"))
    known = kits.select("snapshot").distinct()
    both = windows.select("steamid", "snapshot", "before").join(known, "snapshot", "left_semi").join(known.withColumnRenamed("snapshot", "before"), "before", "left_semi").select("steamid", "snapshot", F.lit(True).alias("both"))
    moved = windows.select("steamid", "snapshot", "before", F.explode("moved.class_num").alias("class_num"))
    now = moved.join(worn.withColumnRenamed("gids", "now"), ["snapshot", "class_num"], "left")
    then = now.join(worn.withColumnsRenamed({"snapshot": "before", "gids": "then"}), ["before", "class_num"], "left")
    none = F.array().cast(worn.schema["gids"].dataType)
    same = then.groupBy("steamid", "snapshot").agg(F.bool_and(F.coalesce("now", none) == F.coalesce("then", none)).alias("same"))
    out = windows_on_maps(windows, stays).join(both, ["steamid", "snapshot"], "left").join(same, ["steamid", "snapshot"], "left")
    stable = F.coalesce(F.col("both") & F.coalesce(F.col("same"), F.lit(True)), F.lit(False))
    return out.select(*windows.columns, "pure_map", stable.alias("loadout_stable"))


def map_class_time(windows: DataFrame) -> DataFrame:
    """Time, windows and players by map and class, of windows on one map that weren't reset. windows: as of windows_on_maps()."""
    fit = windows.filter(F.col("pure_map").isNotNull() & ~F.col("reset")).select("steamid", F.col("pure_map").alias("map"), F.explode("moved").alias("m"))
    return fit.groupBy("map", "m.class_num").agg(F.sum("m.delta").alias("seconds"), F.count("*").alias("windows"), F.count_distinct("steamid").alias("players"))


def map_shares(played: DataFrame, least: int = 3600, top: int = 40) -> DataFrame:
    """played: map, class_num, seconds. Share of each class in the map's time, for the maps played most."""
    by = played.groupBy("map", "class_num").agg(F.sum("seconds").alias("seconds"))
    whole = by.groupBy("map").agg(F.sum("seconds").alias("total")).filter(F.col("total") >= least).orderBy(F.desc("total"), "map").limit(top)
    return by.join(F.broadcast(whole), "map").select("map", "class_num", "seconds", ratio(F.col("seconds"), F.col("total")).alias("share"))


def bracketing(snapshots: DataFrame, times: DataFrame) -> DataFrame:
    """times: steamid, at. The pair of consecutive snapshots around each time: start <= at < next.

    Times and snapshots go through one window by player, so neither side is multiplied.
    """
    taken = snapshots.select("steamid", F.col("taken").alias("at")).distinct()
    both = taken.select("steamid", "at", F.lit(0).alias("asked")).unionByName(times.select("steamid", "at", F.lit(1).alias("asked")).distinct())
    order = W.partitionBy("steamid").orderBy("at", "asked")
    mark = F.when(F.col("asked") == 0, F.col("at"))
    out = both.withColumn("start", F.last(mark, ignorenulls=True).over(order)).withColumn("next", F.first(mark, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))
    return out.filter("asked = 1 and start is not null and next is not null").select("steamid", "at", "start", "next")


def trajectories(scores: DataFrame) -> DataFrame:
    """scores: segment, name, ts, event_id, score. First kept, last advanced, best and number, as repeated upserts would leave them."""
    when = F.struct("ts", "event_id")
    return scores.groupBy("segment", "name").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min_by("score", when).alias("first_score"), F.max_by("score", when).alias("last_score"), F.max("score").alias("best"), F.count("*").alias("observations"))
