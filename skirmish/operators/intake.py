"""From what is fetched to tables: worn items with stock filled in, class stats, what has changed, and what is fetched next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clamp

#: The stock item of each class (1 to 9) by physical slot (0 to 6); -1 where a class has none.
STOCK_ITEMS = (
    (13, 23, 0, -1, -1, -1, -1),
    (14, 16, 3, -1, -1, -1, -1),
    (18, 10, 6, -1, -1, -1, -1),
    (19, 20, 1, -1, -1, -1, -1),
    (17, 29, 8, -1, -1, -1, -1),
    (15, 11, 5, -1, -1, -1, -1),
    (21, 12, 2, -1, -1, -1, -1),
    (-1, 24, 4, 27, 735, -1, 30),
    (9, 22, 7, -1, 26, 25, 28),
)
UNIQUE, COUNTER = 6, 214
#: Class names as the stats spell them, by number.
CLASSES = {"Scout": 1, "Sniper": 2, "Soldier": 3, "Demoman": 4, "Medic": 5, "Heavy": 6, "Pyro": 7, "Spy": 8, "Engineer": 9}
#: The stats of a class.
STATS = {"iPlayTime": "playtime_seconds", "iNumberOfKills": "kills", "iKillAssists": "kill_assists", "iDamageDealt": "damage_dealt", "iPointsScored": "points_scored", "iDominations": "dominations", "iPointCaptures": "captures", "iPointDefenses": "defenses"}
_ITEM = "array<struct<defindex: bigint, quality: int, custom_name: string, attributes: array<struct<defindex: bigint, value: string, float_value: string>>, equipped: array<struct<class: int, slot: int>>>>"


def read_items(raw: DataFrame) -> DataFrame:
    """raw: steamid, payload (a JSON array of items). One row per item and place it is worn in, and a row of nulls for a player who wears nothing.

    An attribute whose value isn't a number counts as none; a payload that can't be read is one without items.
    """
    items = raw.select("steamid", F.posexplode_outer(F.from_json("payload", _ITEM, {"mode": "PERMISSIVE"})).alias("position", "i"))
    counter = F.get(F.filter("i.attributes", lambda a: a["defindex"] == COUNTER), 0)
    kills = F.coalesce(counter["value"].try_cast("double"), counter["float_value"].try_cast("double"), F.lit(0.0)).cast("long")
    rows = items.select("steamid", "position", "i.defindex", F.coalesce("i.quality", F.lit(UNIQUE)).alias("quality"), kills.alias("kills"), F.col("i.custom_name").isNotNull().alias("renamed"), F.explode_outer("i.equipped").alias("e"))
    return rows.select("steamid", "position", "defindex", "quality", "kills", "renamed", F.col("e.class").alias("class_num"), F.col("e.slot").alias("place"))


def meaning(class_num: Column, slot: Column) -> Column:
    """The slot that a physical slot stands for in a class."""
    out = F.when((class_num == 9) & slot.isin(4, 6), 5).when((class_num == 8) & (slot == 1), 0).when((class_num == 8) & (slot == 4), 1)
    return out.otherwise(slot)


def worn_rows(items: DataFrame) -> DataFrame:
    """items: as of read_items(). What each player wears, one row per class, slot and item (the first of the items, the least of rows at one position); stock where a physical slot is empty.

    Empty slots are found from the set of filled ones, at most 63 a player, made in one aggregation: nothing is joined.
    """
    fit = F.col("class_num").between(1, 9) & (F.col("place") != 9)
    slot = F.when(F.col("place") < 7, F.col("place")).when(F.col("place") < 11, 7).otherwise(8)
    own = items.filter(fit).select("steamid", F.col("class_num").cast("int").alias("class_num"), meaning(F.col("class_num"), slot).cast("int").alias("slot_num"), "defindex", "quality", "kills", "renamed", "position")
    place = F.when(fit & (F.col("place") < 7), F.col("class_num") * 10 + F.col("place")).cast("int")
    filled = items.groupBy("steamid").agg(F.collect_set(place).alias("filled"))
    stock = [(c, s, d) for c, row in enumerate(STOCK_ITEMS, 1) for s, d in enumerate(row) if d >= 0]
    every = F.array(*(F.struct(F.lit(c).alias("class_num"), F.lit(s).alias("place"), F.lit(d).cast("long").alias("defindex")) for c, s, d in stock))
    empty = filled.select("steamid", F.explode(F.filter(every, lambda x: ~F.array_contains(F.col("filled"), x["class_num"] * 10 + x["place"]))).alias("x"))
    backfill = empty.select("steamid", "x.class_num", meaning(F.col("x.class_num"), F.col("x.place")).cast("int").alias("slot_num"), "x.defindex", F.lit(UNIQUE).alias("quality"), F.lit(0).cast("long").alias("kills"), F.lit(False).alias("renamed"), F.lit(None).cast("long").alias("position"))
    first = F.min(F.struct(F.coalesce("position", F.lit(1 << 60)).alias("position"), "quality", "kills", "renamed"))
    out = own.unionByName(backfill).groupBy("steamid", "class_num", "slot_num", "defindex").agg(first.alias("f"))
    return out.filter(~((F.col("class_num") == 8) & (F.col("slot_num") == 3))).select("steamid", "class_num", "slot_num", "defindex", "f.quality", "f.kills", "f.renamed")


def class_rows(stats: DataFrame) -> DataFrame:
    """stats: steamid, stats (name -> value). One row per class with play time; stats that are absent are 0."""
    each = stats.select("steamid", "stats", F.explode(F.create_map(*(F.lit(x) for kv in CLASSES.items() for x in kv))).alias("name", "class_num"))
    value = lambda stat: F.coalesce(F.try_element_at("stats", F.concat("name", F.lit(f".accum.{stat}"))), F.lit(0)).cast("long")
    return each.select("steamid", "class_num", *(value(s).alias(c) for s, c in STATS.items())).filter("playtime_seconds > 0")


def unchanged(snapshots: DataFrame) -> DataFrame:
    """snapshots: steamid, snapshot, taken, class_num, seconds. Each snapshot with whether its sum over classes is that of the one before."""
    sums = snapshots.groupBy("steamid", "snapshot", "taken").agg(F.sum("seconds").alias("seconds"))
    before = F.lag("seconds").over(W.partitionBy("steamid").orderBy("taken", "snapshot"))
    return sums.select("steamid", "snapshot", "taken", F.coalesce(F.col("seconds") == before, F.lit(False)).alias("unchanged"))


def _lot(*parts: Column) -> Column:
    """A number in 0 to 1, the same for the same parts: chance that can be repeated."""
    return (F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def weighted_draw(waiting: DataFrame, weights: dict[str, int], seed: str, attempts: int = 3) -> DataFrame:
    """waiting: steamid, source, priority, queued_at, attempts. A source by lot, as likely as its weight (1 if it has none), and the row of it that is first."""
    fit = waiting.filter(F.col("attempts") < attempts)
    best = fit.groupBy("source").agg(F.min_by("steamid", F.struct((-F.col("priority")).alias("p"), "queued_at", "steamid")).alias("steamid"))
    weight = F.lit(1)
    for source, w in weights.items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    return best.orderBy(F.desc(F.pow(_lot(F.lit(seed), F.col("source")), 1.0 / weight)), "source").limit(1)


def fan_out(players: DataFrame, shares: DataFrame, base: int = 12, hours: int = 100_000, low: int = 5, high: int = 30) -> DataFrame:
    """players: steamid, country, lifetime_min. How many friends of each player are queued: more for much play, fewer from crowded countries.

    shares: country, factor; a country without one has the factor 1.
    """
    by_play = clamp(F.round(base * F.log2(F.col("lifetime_min") / hours + 1)), float(low), float(high))
    out = players.join(shares.select("country", "factor"), "country", "left")
    return out.select("steamid", clamp(F.round(by_play * F.coalesce("factor", F.lit(1.0))), float(low), float(high)).cast("int").alias("k"))


def drawn_friends(edges: DataFrame, sizes: DataFrame, seed: str) -> DataFrame:
    """edges: a, b. For each a of sizes (steamid, k), k of its distinct friends by lot."""
    lots = edges.select("a", "b").distinct().join(sizes.select(F.col("steamid").alias("a"), "k"), "a").withColumn("lot", _lot(F.lit(seed), F.col("a"), F.col("b")))
    return lots.withColumn("place", F.row_number().over(W.partitionBy("a").orderBy("lot", "b"))).filter("place <= k").select("a", "b", "place")
