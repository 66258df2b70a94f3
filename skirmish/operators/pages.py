"""What one page shows: an item, a player, a map, the servers; and performance by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import gamemode, ratio
from ..sources.tables import written
from .loadouts import STOCK_MELEE, WEAPON_SLOT, population
from .matches import points_per_hour, seconds
from .ratings import LEAST_SECONDS, upper_medians

# --- items -------------------------------------------------------------------------------------


def members(items: DataFrame, defindex: int) -> DataFrame:
    """defindex, gid: the items of the group of one item, or the item alone."""
    own = items.filter(F.col("defindex") == defindex).select(F.coalesce("reskin_group", "defindex").alias("gid"))
    return items.select("defindex", F.coalesce("reskin_group", "defindex").alias("gid")).join(F.broadcast(own), "gid")  # one row


def item_variants(equipped: DataFrame, items: DataFrame, defindex: int) -> DataFrame:
    """How often each item of the group is worn, by quality."""
    return equipped.join(members(items, defindex), "defindex", "left_semi").groupBy("defindex", "quality").agg(F.count("*").alias("n"))


def item_usage(cube: DataFrame, items: DataFrame, defindex: int) -> DataFrame:
    """The group's usage by class for all and active players, at any and at much experience."""
    gid = members(items, defindex).select(F.col("gid").alias("item")).distinct()
    slice_ = cube.filter("merged and slot_num = -1 and active in (0, 1) and hours in (0, 120000)")
    return slice_.join(F.broadcast(gid), "item").select("class_num", (F.col("active") >= 1).alias("active_only"), "hours", "worn", "sample", "usage")  # one row


def item_performance(medians: DataFrame, items: DataFrame, defindex: int, pan: int) -> DataFrame:
    """The medians of the group by class; of the pan family also those of the stock melee weapons that stand for it."""
    gid = members(items, defindex).select(F.col("gid").alias("cgid")).distinct()
    family = members(items, pan).select(F.col("gid").alias("cgid")).distinct()
    stock = F.explode(F.array(*(F.lit(w).cast("long") for w in sorted(STOCK_MELEE.values()))))
    wanted = gid.union(gid.join(family, "cgid", "left_semi").select(stock.alias("cgid"))).distinct()
    return medians.join(F.broadcast(wanted), "cgid", "left_semi")  # ten rows


def usage_history(cube: DataFrame, day: str) -> DataFrame:
    """The rows of a day that a daily snapshot keeps: merged items over all classes, slots, experience and activity."""
    head = cube.filter("merged and class_num = -1 and slot_num = -1 and hours = 0 and active = 0")
    return head.select(F.lit(day).cast("date").alias("day"), F.col("item").alias("gid"), "worn", "sample", "usage")


# --- players -----------------------------------------------------------------------------------


def profile_classes(stats: DataFrame, steamid: int) -> DataFrame:
    """Hours and hourly rates of one player by class, most played first."""
    per = lambda c, k: ratio(F.col(c) * F.lit(k), F.col("playtime_seconds"))
    own = stats.filter(F.col("steamid") == steamid)
    return own.select("class_num", (F.col("playtime_seconds") / 3600.0).alias("hours"), per("kills", 3600).alias("kph"), per("damage_dealt", 60).alias("dpm"), per("points_scored", 3600).alias("pph")).orderBy(F.desc("hours"), "class_num")


def profile_items(equipped: DataFrame, items: DataFrame, steamid: int) -> DataFrame:
    """What one player wears, with names; an item that isn't known has none."""
    own = equipped.filter(F.col("steamid") == steamid)
    return own.join(items.select("defindex", "name", "reskin_group"), "defindex", "left").select("class_num", "slot_num", "defindex", "name", "reskin_group", "quality", "strange_kills")


# --- sessions ----------------------------------------------------------------------------------


def window_facts(windows: DataFrame, gains: DataFrame, kits: DataFrame, players: DataFrame) -> DataFrame:
    """One row per window, not reset, and class that moved, with what the class wore at its end and whether it wore the same at its begin.

    windows: as of matches.class_windows(). gains: steamid, snapshot, class_num, points since the class was seen before.
    kits: snapshot, class_num, slot_num, gid, known for some snapshots. A window is stable if both its snapshots are known
    and every class that moved wore the same weapons at both.
    """
    sets = kits.filter(F.col("slot_num") <= WEAPON_SLOT).groupBy("snapshot", "class_num").agg(F.array_sort(F.collect_set("gid")).alias("gids"))
    known = kits.select("snapshot").distinct().withColumn("known", F.lit(True))
    moved = windows.filter(~F.col("reset")).select("steamid", "snapshot", "before", "end", (F.size("moved") == 1).alias("pure"), F.explode("moved").alias("m"))
    moved = moved.select("steamid", "snapshot", "before", "end", "pure", "m.class_num", F.col("m.delta").alias("seconds"))
    for when in ("before", "snapshot"):
        side = sets.select(F.col("snapshot").alias(when), "class_num", F.col("gids").alias(f"{when}_gids"))
        moved = moved.join(side, [when, "class_num"], "left").join(known.select(F.col("snapshot").alias(when), F.col("known").alias(f"{when}_known")), when, "left")
    none = F.array().cast("array<bigint>")
    now, then = F.coalesce("snapshot_gids", none), F.coalesce("before_gids", none)
    both = F.coalesce("snapshot_known", F.lit(False)) & F.coalesce("before_known", F.lit(False))
    moved = moved.withColumn("weapon_gids", F.when(both, now).otherwise(none)).withColumn("stable", F.bool_and(both & (now == then)).over(W.partitionBy("steamid", "snapshot")))
    eligible = players.filter(F.coalesce("botness", F.lit(0.0)) < 0.5).select("steamid", F.coalesce("lifetime_min", F.lit(0)).alias("lifetime_min"))
    out = moved.join(gains, ["steamid", "snapshot", "class_num"]).join(eligible, "steamid")
    return out.select("steamid", "snapshot", "class_num", "seconds", F.greatest("points", F.lit(0)).alias("points"), "weapon_gids", "stable", "pure", "lifetime_min")


def session_rates(facts: DataFrame, cap: float = 5000, least_window: int = 600, least_seconds: int = LEAST_SECONDS, least_players: int = 5) -> DataFrame:
    """Upper median of points an hour over the stable windows in which a weapon group was worn."""
    rate = F.col("points") * 3600.0 / F.col("seconds")
    worn = facts.filter(F.col("stable") & (F.col("seconds") >= least_window)).withColumn("rate", rate).filter(F.col("rate") <= cap).select("steamid", "seconds", "rate", F.explode("weapon_gids").alias("gid"))
    out = worn.groupBy("gid").agg(F.sum("seconds").alias("seconds"), F.count_distinct("steamid").alias("players")).filter((F.col("seconds") >= least_seconds) & (F.col("players") >= least_players))
    return out.join(upper_medians(worn, "gid", "rate"), "gid").select("gid", F.col("rate").alias("value"), "players", (F.col("seconds") / 3600.0 / F.col("players")).alias("avg_hours"))


# --- maps --------------------------------------------------------------------------------------


def map_scorers(segments: DataFrame, participants: DataFrame, name: str, top: int = 15) -> DataFrame:
    """The best hourly gains on one map, of those seen three times over five minutes whose score never fell."""
    here = participants.join(segments.filter(F.col("map") == name).select("segment"), "segment")
    fit = here.filter((F.col("observations") >= 3) & (seconds(F.col("first_seen"), F.col("last_seen")) >= 300) & (F.col("last_score") >= F.col("first_score"))).withColumn("pph", points_per_hour())
    return fit.orderBy(F.desc("pph"), "segment", "steamid").limit(top).select("segment", "steamid", "observations", "pph")


def map_regulars(segments: DataFrame, attributed: DataFrame, players: DataFrame, name: str, least: float = 0.9, top: int = 500) -> DataFrame:
    """Players named with certainty in most segments of one map."""
    here = attributed.filter(F.col("confidence") >= least).join(segments.filter(F.col("map") == name).select("segment"), "segment")
    seen = here.groupBy("steamid").agg(F.count_distinct("segment").alias("segments"))
    return seen.join(players.filter(population()).select("steamid", "personaname"), "steamid").orderBy(F.desc("segments"), "steamid").limit(top)


def regulars_weapons(facts: DataFrame, regulars: DataFrame, least: int = 12, top: int = 12) -> DataFrame:
    """The weapon groups that most regulars wear; nothing if there are fewer than `least` regulars."""
    regulars = written(regulars.select("steamid"))
    enough = regulars.agg(F.count("*").alias("regulars")).filter(F.col("regulars") >= least)
    worn = facts.filter(F.col("slot_num").between(0, WEAPON_SLOT)).join(F.broadcast(regulars), "steamid", "left_semi").groupBy("gid").agg(F.count_distinct("steamid").alias("players"))  # 500 rows
    return worn.crossJoin(F.broadcast(enough)).orderBy(F.desc("players"), "gid").limit(top)  # one row


# --- servers -----------------------------------------------------------------------------------

#: Region codes by continent; others are hidden or unknown.
CONTINENTS = {0: "North America", 1: "North America", 2: "South America", 3: "Europe", 4: "Asia", 5: "Oceania", 6: "Middle East", 7: "Africa"}


def continent(region: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in CONTINENTS.items():
        out = F.when(region == code, name).otherwise(out)
    return out


def server_overview(scans: DataFrame, top_maps: int = 30) -> DataFrame:
    """scans: scanned_at, region, map, official, players, bots, servers, capacity. The newest scan in total and by region, map, mode and continent.

    One aggregation over (section, key) makes all sections, so the scan is read once. Continents count community servers
    of known regions only; the fullest maps are shown.
    """
    last = scans.agg(F.max("scanned_at").alias("scanned_at"))
    now = scans.join(F.broadcast(last), "scanned_at")  # one row
    known = F.when(~F.col("official"), continent(F.col("region")))
    parts = {"total": F.lit(""), "region": F.col("region").cast("string"), "map": F.col("map"), "mode": gamemode(F.col("map")), "continent": known}
    each = now.select("players", "bots", "servers", "capacity", "official", F.explode(F.array(*(F.struct(F.lit(s).alias("section"), k.alias("key")) for s, k in parts.items()))).alias("p")).select("p.*", "players", "bots", "servers", "capacity", "official")
    official = lambda c: F.coalesce(F.sum(F.when(F.col("official"), F.col(c))), F.lit(0)).alias(f"official_{c}")
    out = each.filter("key is not null").groupBy("section", "key").agg(*(F.sum(c).alias(c) for c in ("players", "bots", "servers", "capacity")), official("players"), official("servers"))
    maps = out.filter("section = 'map'").orderBy(F.desc("players"), "key").limit(top_maps)
    return out.filter("section <> 'map'").unionByName(maps)


def server_rush(scans: DataFrame, days: int = 7) -> DataFrame:
    """Mean players by hour of the day over the last days, on official and on community servers."""
    last = scans.agg(F.max("scanned_at").alias("as_of"))
    recent = scans.crossJoin(F.broadcast(last)).filter(F.col("scanned_at") > F.col("as_of") - F.make_interval(days=F.lit(days)))  # one row
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("players"))), F.lit(0))
    by = recent.groupBy("scanned_at").agg(side(F.col("official")).alias("o"), side(~F.col("official")).alias("c"))
    return by.groupBy(F.hour("scanned_at").alias("hour")).agg(F.round(F.avg("o")).cast("int").alias("official"), F.round(F.avg("c")).cast("int").alias("community"))


def seat_fill(overview: DataFrame) -> DataFrame:
    """Share of seats taken and of players on official servers, by section; 0 where there are none."""
    return overview.select("section", "key", ratio(F.col("players"), F.col("capacity")).alias("fill"), ratio(F.col("official_players"), F.col("players")).alias("official_share"))
