"""What users page through: combinations, performance, boards of hours, trends, scans."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import gamemode, ratio
from ..sources.tables import dropped, written
from .loadouts import WEAPON_SLOT, ascending, population
from .ratings import upper_medians

#: Rates by name: column, seconds of the unit, and the rate above which nobody plays.
RATES = {
    "points_hr": ("points_scored", 3600, 5000), "points_min": ("points_scored", 60, 100), "kills_hr": ("kills", 3600, 500), "damage_min": ("damage_dealt", 60, 10_000),
    "assists_hr": ("kill_assists", 3600, 500), "captures_hr": ("captures", 3600, 500), "dominations_hr": ("dominations", 3600, 500),
}
#: Flags of a server by the tag that sets them.
TAGS = {"alltalk": "alltalk", "nocrits": "nocrits", "respawntimes": "respawntimes", "maxplayers": "increased_maxplayers", "highlander": "highlander"}
#: Combinations whose rates are moved at a time.
AT_ONCE = 1 << 25
MODES = ("payload", "cp", "koth", "ctf", "mvm", "pd", "other")


def slot_loads(facts: DataFrame, slot: int) -> DataFrame:
    """What players wear in one slot, as loadouts: steamid, class_num, lifetime_min, weapon_gids (sorted distinct)."""
    return facts.filter(F.col("slot_num") == slot).groupBy("steamid", "class_num").agg(F.max("lifetime_min").alias("lifetime_min"), F.array_sort(F.collect_set("cgid")).alias("weapon_gids"))


def combo_page(source: DataFrame, loads: DataFrame, size: int, class_num: int = -1, minutes: int = 0, minutes_b: int | None = None, by_delta: bool = False, exclude: tuple[int, ...] = (), offset: int = 0, page: int = 50) -> DataFrame:
    """One page of combinations of `size` groups (2 or 3; 4 counts as 3), and the offset of the next page if there is one.

    source: loadouts or slot_loads(), whose weapon_gids are combined; loads: the loadouts, whose numbers are the populations in every mode. minutes_b compares two
    levels of experience: counts of both, and rows of two wearers in sum. Rows go by count, or by the difference of shares. Groups of `exclude` (pseudo-items)
    are in no combination. class_num -1: all.
    """
    fit = lambda df: df if class_num == -1 else df.filter(F.col("class_num") == class_num)
    low = minutes if minutes_b is None else min(minutes, minutes_b)
    gids = F.array_except("weapon_gids", F.array(*map(F.lit, exclude))) if exclude else F.col("weapon_gids")
    each = fit(source).filter(F.col("lifetime_min") >= low).select("lifetime_min", gids.alias("g")).select("lifetime_min", F.explode(ascending(F.col("g"), min(max(size, 2), 3))).alias("members"))
    b = minutes_b if minutes_b is not None else 2**62
    counts = each.groupBy("members").agg(F.count_if(F.col("lifetime_min") >= minutes).alias("count_a"), F.count_if(F.col("lifetime_min") >= b).alias("count_b")).filter(F.col("count_a") + F.col("count_b") >= 2)
    pops = fit(loads).agg(F.count_if(F.col("lifetime_min") >= minutes).alias("pop_a"), F.count_if(F.col("lifetime_min") >= b).alias("pop_b"))
    share = lambda x: F.col(f"count_{x}") / F.greatest(f"pop_{x}", F.lit(1))
    rows = counts.crossJoin(F.broadcast(pops))  # one row
    order = [F.desc(F.abs(share("b") - share("a"))), F.desc("count_b"), F.col("members")] if by_delta and minutes_b is not None else [F.desc("count_a"), F.col("members")]
    more = rows.orderBy(*order).offset(offset).limit(page + 1)
    following = more.agg(F.when(F.count("*") > page, F.lit(offset + page)).alias("next_offset"))
    out = more.orderBy(*order).limit(page).withColumn("usage_a", ratio(F.col("count_a"), F.col("pop_a")))
    if minutes_b is not None:
        out = out.withColumn("usage_b", ratio(F.col("count_b"), F.col("pop_b"))).withColumn("delta", F.col("usage_b") - F.col("usage_a"))
    else:
        out = out.drop("count_b", "pop_b")
    return out.crossJoin(F.broadcast(following))  # one row


def _rated(stats: DataFrame, metric: str, least_seconds: int) -> DataFrame:
    column, unit, cap = RATES[metric]
    return stats.filter(F.col("playtime_seconds") >= least_seconds).select("steamid", "class_num", "playtime_seconds", (F.col(column).cast("double") * unit / F.col("playtime_seconds")).alias("rate")).filter(F.col("rate") <= cap)


def _enough(met: DataFrame, least_players: int) -> DataFrame:
    """members, players, avg_hours of what enough players wear. met: members, steamid, playtime_seconds, rate."""
    return met.groupBy("members").agg(F.count_distinct("steamid").alias("players"), (F.avg("playtime_seconds") / 3600).alias("avg_hours")).filter(F.col("players") >= least_players)


def _valued(met: DataFrame, whole: DataFrame) -> DataFrame:
    """whole, of _enough(), with the upper median of the rate."""
    kept = met.join(whole.select("members"), "members", "left_semi")
    return whole.join(upper_medians(kept, "members", "rate"), "members").select("members", F.col("rate").alias("value"), "players", "avg_hours")


def performance(worn: DataFrame, stats: DataFrame, metric: str = "points_hr", class_num: int = -1, least_seconds: int = 36_000, minutes: int = 0, least_players: int = 5, offset: int = 0, page: int = 50) -> DataFrame:
    """members, value (upper median of a rate), players, avg_hours: the best groups or combinations among those worn by enough players.

    worn: steamid, class_num, lifetime_min, members (array), a row for each time worn. Rates above the metric's cap are out.
    """
    fit = worn.filter(F.col("lifetime_min") >= minutes)
    fit = (fit if class_num == -1 else fit.filter(F.col("class_num") == class_num)).select("steamid", "class_num", "members")
    met = fit.join(_rated(stats, metric, least_seconds), ["steamid", "class_num"])
    return _valued(met, _enough(met, least_players)).orderBy(F.desc("value"), "members").offset(offset).limit(page)


def combo_performance(loads: DataFrame, stats: DataFrame, size: int, exclude: tuple[int, ...] = (), metric: str = "points_hr", least_seconds: int = 36_000, minutes: int = 0, least_players: int = 5, page: int = 50, at_once: int = AT_ONCE) -> DataFrame:
    """performance() of worn_combos(), in parts of about `at_once` combinations, so that disk holds the rows of one part at a time."""
    gids = F.array_except("weapon_gids", F.array(*map(F.lit, exclude))) if exclude else F.col("weapon_gids")
    rated = written(loads.filter(F.col("lifetime_min") >= minutes).select("steamid", "class_num", gids.alias("g")).filter(F.size("g") >= size).join(_rated(stats, metric, least_seconds), ["steamid", "class_num"]))
    n = F.size("g").cast("double")
    ways = {1: n, 2: n * (n - 1) / 2, 3: n * (n - 1) * (n - 2) / 6}[size]
    parts = max(1, math.ceil((rated.agg(F.sum(ways)).first()[0] or 0) / at_once))
    found = []
    for i in range(parts):
        met = rated.select("steamid", "playtime_seconds", "rate", F.explode(ascending(F.col("g"), size, (i, parts) if parts > 1 else None)).alias("members"))
        whole = written(_enough(met, least_players))
        found.append(written(_valued(met, whole)))
        dropped(whole)
    dropped(rated)
    return reduce(DataFrame.unionByName, found).orderBy(F.desc("value"), "members").limit(page)


def worn_items(facts: DataFrame, slot: int = -1, merged: bool = True, exclude: tuple[int, ...] = ()) -> DataFrame:
    """Facts as `worn` of performance(): class-wise groups, or items as they are; of a slot, or of all weapon slots."""
    item = F.col("cgid" if merged else "defindex")
    at = F.col("slot_num") <= WEAPON_SLOT if slot == -1 else F.col("slot_num") == slot
    return facts.filter(at & ~item.isin(*exclude) if exclude else at).select("steamid", "class_num", "lifetime_min", F.array(item).alias("members"))


def worn_combos(loads: DataFrame, size: int, exclude: tuple[int, ...] = ()) -> DataFrame:
    """Loadouts as `worn` of performance(): combinations of 2 or 3 weapons."""
    gids = F.array_except("weapon_gids", F.array(*map(F.lit, exclude))) if exclude else F.col("weapon_gids")
    return loads.select("steamid", "class_num", "lifetime_min", gids.alias("g")).select("steamid", "class_num", "lifetime_min", F.explode(ascending(F.col("g"), size)).alias("members"))


def hours_ranks(players: DataFrame, minutes: str = "lifetime_min", width: int = 4096) -> DataFrame:
    """steamid, rank, participants, value: rank by hours played among the board population; equal times have one rank.

    Times are counted, and ranks summed up over ranges of `width` minutes and within each, so no task sorts all players. The value is
    a 32-bit float of hours, as boards show it.
    """
    fit = players.filter(population() & F.col(minutes).isNotNull()).select("steamid", F.col(minutes).alias("m"))
    counts = fit.groupBy("m").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("m") / width))
    ranges = counts.groupBy("range").agg(F.sum("n").alias("in_range"))
    # A row for each range of minutes that somebody has: a person's lifetime has some thousands.
    above = ranges.select("range", "in_range", F.coalesce(F.sum("in_range").over(W.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    total = ranges.agg(F.sum("in_range").alias("participants"))
    within = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy(F.desc("m")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("within", within).join(above, "range").select("m", (F.col("above") + F.col("within") + 1).alias("rank"))
    return fit.join(ranks, "m").crossJoin(F.broadcast(total)).select("steamid", "rank", "participants", (F.col("m") / 60.0).cast("float").cast("double").alias("value"))  # one row


def playerbase(scans: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """One row: players of the newest scan, and the most of any scan of the last days before `now`. scans: scanned_at, players."""
    recent = F.when(F.col("scanned_at") > now - F.make_interval(days=F.lit(days)), F.col("players"))
    return scans.agg(F.max_by("players", "scanned_at").alias("live"), F.max(recent).alias("peak"))


def attributed_names(attributions: DataFrame, players: DataFrame, ids: Column, least: float = 0.9) -> DataFrame:
    """The sure attributions of a list of segments, with the profile's name. attributions: segment, name, steamid, confidence, strong. ids: a JSON array of ids, as texts."""
    asked = attributions.sparkSession.range(1).select(F.explode(F.from_json(ids, "array<string>")).alias("id")).select(F.col("id").try_cast("bigint").alias("segment")).distinct()
    sure = attributions.filter(F.col("confidence") >= least).join(asked, "segment", "left_semi")
    return sure.join(players.select("steamid", "personaname"), "steamid").select("segment", "name", "steamid", "personaname", "confidence", "strong")


def server_trend(snapshots: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """A row per time with players by mode, in all, and on official servers; absent modes are 0. snapshots: scanned_at, map, official, players.

    Up to 24 hours the scans as they are; beyond that hourly means of the scans' sums, rounded, over the scans in which a mode was seen.
    """
    recent = snapshots.filter(F.col("scanned_at") > now - F.make_interval(hours=F.lit(hours)))
    scans = recent.groupBy("scanned_at", gamemode(F.col("map")).alias("mode")).agg(F.sum("players").alias("players"), F.coalesce(F.sum(F.when(F.col("official"), F.col("players"))), F.lit(0)).alias("official"))
    if hours > 24:
        scans = scans.groupBy(F.date_trunc("hour", "scanned_at").alias("scanned_at"), "mode").agg(*(F.round(F.avg(c)).cast("long").alias(c) for c in ("players", "official")))
    modes = [F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("players"))), F.lit(0)).alias(m) for m in MODES]
    return scans.groupBy(F.col("scanned_at").alias("t")).agg(*modes, F.sum("players").alias("total"), F.sum("official").alias("official"))


def scan_buckets(servers: DataFrame) -> DataFrame:
    """Servers of each scan by map, region and official, with the flags of their tags; community servers without people by region alone (map null).

    servers: scanned_at, region (null counts as 255), map, gametype (tags, comma-separated), players, bots, max_players. Bots among players aren't people.
    """
    tags = F.split(F.coalesce("gametype", F.lit("")), ",")
    people = F.greatest(F.lit(0), F.col("players") - F.col("bots"))
    marked = servers.select("scanned_at", F.coalesce("region", F.lit(255)).alias("region"), F.substring(F.lower("map"), 1, 64).alias("map"), F.array_contains(tags, "valve").alias("official"), people.alias("people"), "bots", "max_players", *(F.array_contains(tags, t).alias(n) for n, t in TAGS.items()))
    hollow = ~F.col("official") & (F.col("people") == 0)
    keyed = marked.withColumn("map", F.when(~hollow, F.col("map"))).withColumn("bots", F.when(~hollow, F.col("bots")).otherwise(0))
    flags = [F.count_if(F.col(n) & ~hollow).alias(f"{n}_servers") for n in TAGS]
    return keyed.groupBy("scanned_at", "region", "map", "official", hollow.alias("empty")).agg(F.count("*").alias("servers"), F.sum("people").alias("players"), F.sum("bots").alias("bots"), F.sum("max_players").alias("capacity"), *flags)
