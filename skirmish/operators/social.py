"""Players among others and catalogue work: friends, queues, search, schedules, reskin groups, usage by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ratio, tier

def circle(friends: DataFrame, steamid: int) -> DataFrame:
    """The player and the friends, edges of either direction, each once."""
    edges = friends.filter(F.col("a") == steamid).select(F.col("b").alias("steamid")).union(friends.filter(F.col("b") == steamid).select("a"))
    return edges.union(friends.sparkSession.createDataFrame([(steamid,)], "steamid long")).distinct()


def friend_ranks(totals: DataFrame, friends: DataFrame, steamid: int) -> DataFrame:
    """totals: steamid and metrics. The player's rank by each metric in the circle; empty if alone."""
    metrics = [c for c in totals.columns if c != "steamid"]
    inside = totals.join(circle(friends, steamid), "steamid", "left_semi")
    mine = inside.filter(F.col("steamid") == steamid).select(*(F.col(m).alias(f"my_{m}") for m in metrics))
    better = [(F.count_if(F.col(m) > F.col(f"my_{m}")) + 1).alias(m) for m in metrics]
    ranks = inside.crossJoin(F.broadcast(mine)).agg(*better, F.count("*").alias("of")).filter("of >= 2")  # one player's row
    return ranks.unpivot("of", metrics, "metric", "rank")


#: How often a source is drawn; others 1.
SOURCE_WEIGHTS = {"seed": 8, "recrawl": 5, "review_sample": 3, "random_sample": 3, "friend_bfs": 4}


def queue_eta(queue: DataFrame, players: DataFrame, steamid: int, now: Column, source: str = "recrawl", weights: dict[str, int] = SOURCE_WEIGHTS) -> DataFrame:
    """One row: is the player queued, at which position of the source, and in how many seconds is it their turn.

    queue: steamid, source, priority, enqueued_at, locked_until. players: last_crawled. The rate is what was crawled in the hour before
    `now`; the source has the share of its weight among the sources with rows that aren't locked. No rate, or no such source: no time.
    """
    mine = queue.filter(F.col("steamid") == steamid).agg(F.max("priority").alias("my_priority"), F.max("enqueued_at").alias("my_time"))
    ahead = (F.col("source") == source) & ((F.col("priority") > F.col("my_priority")) | ((F.col("priority") == F.col("my_priority")) & (F.col("enqueued_at") < F.col("my_time"))))
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col("source")), F.lit(1))
    free = F.col("locked_until").isNull() | (F.col("locked_until") < now)
    by = queue.crossJoin(F.broadcast(mine)).groupBy("source").agg(F.count_if(ahead).alias("ahead"), F.bool_or(free).alias("open"), F.first("my_time").alias("my_time"))  # one row; every row has the same time
    state = by.agg(F.sum("ahead").alias("ahead"), F.coalesce(F.sum(F.when(F.col("open"), weight)), F.lit(0)).alias("total_weight"), F.max("my_time").alias("my_time"))
    rate = players.agg(F.count_if(F.col("last_crawled") > now - F.expr("INTERVAL 1 HOUR")).alias("per_hour"))
    share = F.when(F.col("total_weight") > 0, F.col("per_hour") * F.lit(float(weights.get(source, 1))) / F.col("total_weight"))
    out = state.crossJoin(F.broadcast(rate)).withColumn("share", share)  # one row each
    position = F.col("ahead") + 1
    present = F.col("my_time").isNotNull()
    eta = F.when(present & (F.col("share") > 0), F.floor(position / F.col("share") * 3600 + 0.5))
    return out.select(present.alias("present"), F.when(present, position).alias("position"), "per_hour", "total_weight", eta.alias("eta_seconds"))


def recrawl(players: DataFrame, queue: DataFrame, now: Column, tiers: tuple[tuple[int, int, int, bool], ...] = ((2, 8, 1500, True), (1, 14 * 24, 500, False))) -> DataFrame:
    """steamid, source, priority: whom to crawl again. players: steamid, stats_status, active_min, lifetime_min, last_crawled.

    tiers: (priority, hours since the last crawl, limit, only active players). The active are taken by lifetime, the longest first, then by
    who waits longest; the others by who waits longest. Who is queued already isn't taken, and who is in two tiers is taken in the first.
    """
    open_ = players.filter("stats_status = 'ok'").join(queue.select("steamid").distinct(), "steamid", "left_anti")
    parts = []
    for priority, hours, limit, active in tiers:
        fit = open_.filter(F.col("last_crawled") < now - F.make_interval(hours=F.lit(hours)))
        if active:
            fit = fit.filter(F.coalesce("active_min", F.lit(0)) > 0)
        order = ([F.desc(F.coalesce("lifetime_min", F.lit(0)))] if active else []) + [F.col("last_crawled"), F.col("steamid")]
        parts.append(fit.orderBy(*order).limit(limit).select("steamid", F.lit(priority).alias("priority")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("steamid").agg(F.max("priority").alias("priority")).select("steamid", F.lit("recrawl").alias("source"), "priority")


def search(items: DataFrame, players: DataFrame, text: str, items_top: int = 8, players_top: int = 5) -> DataFrame:
    """Items, weapons (slot 0) first, and players whose name holds the text, wildcards taken as they are; 17 digits are an id."""
    needle = F.lower(F.lit(text.strip()))
    found = items.filter(F.contains(F.lower("name"), needle)).withColumn("weapon", F.col("slot_num") == 0)
    found = found.orderBy(F.desc_nulls_first("weapon"), "name", "defindex").limit(items_top).select(F.lit("item").alias("kind"), F.col("defindex").alias("id"), "name")
    named = players.filter(F.col("steamid") == int(text)) if text.isdigit() and len(text) == 17 else players.filter(F.contains(F.lower("personaname"), needle))
    named = named.orderBy("personaname", "steamid").limit(players_top).select(F.lit("player").alias("kind"), F.col("steamid").alias("id"), F.col("personaname").alias("name"))
    return found.unionByName(named)


def capabilities(items: DataFrame, overrides: DataFrame | dict[tuple[int, int], int] | None = None) -> DataFrame:
    """One row per item and class it can be worn by, with the slot. overrides: (defindex, class_num) -> slot, where it differs from the item's own,
    as a dict or as rows (defindex, class_num, slot_num) with each pair once.

    Items with definitions get theirs from reskins.class_slots().
    """
    each = items.select("defindex", "slot_num", F.explode(F.array_distinct(F.array("class_a", "class_b"))).alias("class_num"))
    if overrides is None:
        return each.select("defindex", "class_num", "slot_num")
    if isinstance(overrides, dict):
        overrides = items.sparkSession.createDataFrame([(*pair, slot) for pair, slot in overrides.items()], "defindex long, class_num int, slot_num int")
    told = overrides.select("defindex", "class_num", F.col("slot_num").alias("told"))
    return each.join(told, ["defindex", "class_num"], "left").select("defindex", "class_num", F.coalesce("told", "slot_num").alias("slot_num"))


def usage_deltas(days: DataFrame, back: int = 90) -> DataFrame:
    """days: day, gid, worn. Share of each item on the newest day, and on the newest day at least `back` days earlier, else the earliest.

    An item absent on one of the days has no wearers there.
    """
    ends = days.agg(F.max("day").alias("now"), F.min("day").alias("first"))
    before = days.crossJoin(F.broadcast(ends)).groupBy("now", "first").agg(F.max(F.when(F.col("day") <= F.date_sub("now", back), F.col("day"))).alias("b"))
    ends = before.select("now", F.coalesce("b", "first").alias("then"))
    two = days.crossJoin(F.broadcast(ends)).filter((F.col("day") == F.col("now")) | (F.col("day") == F.col("then")))
    new, old = F.col("day") == F.col("now"), F.col("day") == F.col("then")
    worn = two.groupBy("gid").agg(F.sum(F.when(new, F.col("worn")).otherwise(0)).alias("a"), F.sum(F.when(old, F.col("worn")).otherwise(0)).alias("b"))
    whole = two.agg(F.sum(F.when(new, F.col("worn"))).alias("na"), F.sum(F.when(old, F.col("worn"))).alias("nb"))
    out = worn.crossJoin(F.broadcast(whole)).withColumn("now", ratio(F.col("a"), F.col("na"))).withColumn("then", ratio(F.col("b"), F.col("nb")))
    return out.select("gid", "now", "then", (F.col("now") - F.col("then")).alias("delta"))


def usage_page(cube: DataFrame, hours: int, active: int, class_num: int, slot_num: int, page: int, offset: int) -> DataFrame:
    """One page of the cube's slice, most used first (the later item of two that are as much used), with the offset of the next page if there is one."""
    rows = cube.filter((F.col("hours") == hours) & (F.col("active") == active) & (F.col("class_num") == class_num) & (F.col("slot_num") == slot_num))
    more = rows.orderBy(F.desc("usage"), F.desc("item")).offset(offset).limit(page + 1)
    n = more.agg(F.when(F.count("*") > page, F.lit(offset + page)).alias("next_offset"))
    return more.orderBy(F.desc("usage"), F.desc("item")).limit(page).select("item", "worn", "usage").crossJoin(F.broadcast(n))  # one row


def counter_tiers(facts: DataFrame, floors: tuple[int, ...] = (0, 10, 100, 1000, 8500)) -> DataFrame:
    """Copies of each item group by the tier of their counter."""
    x = facts.filter("quality = 11").withColumn("tier", tier(F.col("strange_kills"), floors))
    return x.groupBy("gid", "tier").agg(F.count("*").alias("copies"))


def item_counter_board(facts: DataFrame, defindex: int, top: int = 20) -> DataFrame:
    """The highest counters on one item."""
    own = facts.filter((F.col("defindex") == defindex) & (F.col("quality") == 11)).groupBy("steamid").agg(F.max("strange_kills").alias("kills"))
    return own.orderBy(F.desc("kills"), "steamid").limit(top)


def round_robin(servers: DataFrame, top: int = 40) -> DataFrame:
    """servers: server, region, humans, tracked. The fullest of each region in turn, first those tracked least."""
    w = W.partitionBy("region").orderBy(F.desc("humans"), "server")
    return servers.withColumn("turn", F.row_number().over(w)).orderBy("turn", "tracked", "region", "server").limit(top)


def inventory(items: DataFrame, order: tuple[int, ...] = (5, 11, 6, 1)) -> DataFrame:
    """items: steamid, raw (a JSON array of objects with defindex and quality). Copies by item and quality, in a custom order of qualities."""
    parsed = F.from_json("raw", "array<struct<defindex: bigint, quality: int>>", {"mode": "PERMISSIVE"})
    each = items.select("steamid", F.explode(parsed).alias("i")).groupBy("steamid", "i.defindex", "i.quality").agg(F.count("*").alias("copies"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("quality"))
    return each.withColumn("place", F.when(place == 0, len(order) + 1).otherwise(place))
