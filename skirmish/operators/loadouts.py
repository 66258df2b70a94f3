"""What players wear: enriched facts, loadouts, usage shares, combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, two_proportions

HOURS = (0, 30_000, 60_000, 120_000, 240_000)
ACTIVITY = (0, 1, 300, 900)
BOT = 0.5
WEAPON_SLOT = 6


def population() -> Column:
    """Named players who are known not to be banned and not known to be bots: a null ban is out, a null botness is in."""
    return F.col("personaname").isNotNull() & (F.col("vac_banned") == F.lit(False)) & (F.coalesce("botness", F.lit(0.0)) < BOT)


#: The weapon that each class has where others have the pan family's.
STOCK_MELEE = {1: 0, 4: 1, 7: 2, 2: 3, 8: 4, 6: 5, 3: 6, 9: 7, 5: 8}


def enriched(equipped: DataFrame, players: DataFrame, items: DataFrame, pan: int = 264) -> DataFrame:
    """Equipped rows of eligible players with their item group and the players' experience.

    gid: the reskin group, or the item; cgid: as gid, but the family of `pan` counts as the stock weapon of the class.
    """
    eligible = players.filter((F.col("items_status") == "ok") & (F.coalesce("botness", F.lit(0.0)) < BOT)).select("steamid", "lifetime_min", "active_min")
    groups = items.select("defindex", "reskin_group")
    family = items.agg(F.coalesce(F.max(F.when(F.col("defindex") == pan, F.coalesce("reskin_group", "defindex"))), F.lit(pan)).alias("pan"))
    out = equipped.join(eligible, "steamid").join(groups, "defindex", "left").withColumn("gid", F.coalesce("reskin_group", "defindex")).drop("reskin_group")
    stock = F.try_element_at(F.create_map(*(F.lit(x) for kv in STOCK_MELEE.items() for x in kv)), F.col("class_num")).cast("long")
    return out.crossJoin(F.broadcast(family)).withColumn("cgid", F.when(F.col("gid") == F.col("pan"), F.coalesce(stock, "gid")).otherwise(F.col("gid"))).drop("pan")  # one row


def loadouts(facts: DataFrame) -> DataFrame:
    """One row per player and class with the sorted distinct groups worn: all, weapons (slots to 6) and all to slot 7, of class-wise groups."""
    upto = lambda slot: F.array_sort(F.collect_set(F.when(F.col("slot_num") <= slot, F.col("cgid"))))
    return facts.groupBy("steamid", "class_num").agg(F.array_sort(F.collect_set("gid")).alias("gids"), upto(WEAPON_SLOT).alias("weapon_gids"), upto(WEAPON_SLOT + 1).alias("all_gids"), F.max("lifetime_min").alias("lifetime_min"))


def _reached(x: Column, floors: tuple[int, ...]) -> Column:
    """The place of the highest of the ascending floors that x reaches, -1 below all."""
    return sum(((x >= f).cast("int") for f in floors), F.lit(-1))


def _every(df: DataFrame, *keys: str) -> DataFrame:
    """Counts c by keys and highest thresholds (h, a), summed up for each pair of thresholds."""
    wide = df.filter("h >= 0 and a >= 0").withColumn("hours", F.explode(F.sequence(F.lit(0), "h"))).withColumn("active", F.explode(F.sequence(F.lit(0), "a")))
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), F.col(i) + 1)
    return wide.groupBy(*keys, at(HOURS, "hours").alias("hours"), at(ACTIVITY, "active").alias("active")).agg(F.sum("c").alias("c"))


def usage_cube(facts: DataFrame, players: DataFrame, items: DataFrame, slots: DataFrame) -> DataFrame:
    """Share of the places an item could be worn in, by class and slot, any class, any slot; -1 is any.

    For each experience and activity threshold, for items as they are and for merged ones. Counts are rows; the
    sample is all eligible players. A class is one place, any class as many as can wear the item (in the slot), 9 if
    unknown. slots: defindex, class_num, slot_num.

    Facts are read once and counted by the highest thresholds they meet; only these counts go into the eight roll-ups.
    A roll-up's row holds its counts for all pairs of thresholds as columns, which become rows after the joins.
    """
    met = (_reached(F.col("lifetime_min"), HOURS).alias("h"), _reached(F.col("active_min"), ACTIVITY).alias("a"))
    counts = facts.groupBy("class_num", "slot_num", "defindex", "gid", "cgid", *met).agg(F.count("*").alias("c")).filter("h >= 0 and a >= 0")
    anything = F.lit(-1).cast("long")
    c, s = F.col("class_num").cast("long"), F.col("slot_num").cast("long")
    kinds = [(False, "defindex", c, s), (False, "defindex", anything, s), (False, "defindex", c, anything), (False, "defindex", anything, anything)]
    kinds += [(True, "cgid", c, s), (True, "cgid", c, anything), (True, "gid", anything, s), (True, "gid", anything, anything)]
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("merged"), F.col(i).alias("item"), k.alias("class_num"), p.alias("slot_num")) for m, i, k, p in kinds)))
    pairs = [(i, j) for i in range(len(HOURS)) for j in range(len(ACTIVITY))]
    upto = [F.sum(F.when((F.col("h") >= i) & (F.col("a") >= j), F.col("c"))).alias(f"c{n}") for n, (i, j) in enumerate(pairs)]
    rows = counts.select(each.alias("k"), "h", "a", "c").select("k.*", "h", "a", "c").groupBy("merged", "item", "class_num", "slot_num").agg(*upto)

    eligible = players.filter((F.col("items_status") == "ok") & (F.coalesce("botness", F.lit(0.0)) < BOT))
    sample = _every(eligible.groupBy(*met).agg(F.count("*").alias("c"))).withColumnRenamed("c", "sample")
    named = items.select("defindex", F.coalesce("reskin_group", "defindex").alias("gid"), F.array_distinct(F.array("class_a", "class_b")).alias("classes"))
    both = named.select(F.lit(False).alias("merged"), F.col("defindex").alias("item"), "classes").unionByName(named.select(F.lit(True).alias("merged"), F.col("gid").alias("item"), "classes"))
    classes = both.select("merged", "item", F.explode("classes").alias("k")).groupBy("merged", "item").agg(F.count_distinct("k").alias("n"))
    can = slots.join(named.select("defindex", "gid"), "defindex").select("slot_num", "class_num", F.explode(F.array(F.struct(F.lit(False).alias("merged"), F.col("defindex").alias("item")), F.struct(F.lit(True).alias("merged"), F.col("gid").alias("item")))).alias("i"))
    by_slot = can.groupBy("i.merged", "i.item", F.col("slot_num").cast("long").alias("slot_num")).agg(F.count_distinct("class_num").alias("ns"))
    places = F.when(F.col("class_num") != -1, 1).when(F.col("slot_num") == -1, F.coalesce("n", F.lit(9))).otherwise(F.coalesce("ns", "n", F.lit(9)))
    out = rows.join(classes, ["merged", "item"], "left").join(by_slot, ["merged", "item", "slot_num"], "left").withColumn("places", places)
    cells = F.explode(F.array(*(F.struct(F.lit(HOURS[i]).alias("hours"), F.lit(ACTIVITY[j]).alias("active"), F.col(f"c{n}").alias("worn")) for n, (i, j) in enumerate(pairs))))
    out = out.select("merged", "item", "class_num", "slot_num", "places", cells.alias("x")).select("merged", "x.hours", "x.active", "item", "class_num", "slot_num", "x.worn", "places").filter("worn is not null")
    out = out.join(F.broadcast(sample), ["hours", "active"])  # at most 20 rows
    return out.select("merged", "hours", "active", "item", "class_num", "slot_num", "worn", "sample", ratio(F.col("worn"), F.col("sample") * F.col("places")).alias("usage"))


def ascending(gids: Column, size: int, part: tuple[int, int] | None = None) -> Column:
    """All ascending combinations of 1 to 3 elements of a sorted array, formed inside the array, so nothing is joined with itself.

    part: (number, of how many); only the combinations of this part, by a hash of the first two elements. The parts are about even, and make up the whole.
    """
    n = F.size(gids)
    nothing = F.array().cast("array<int>")
    first = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(nothing)
    later = lambda i: F.when(i < n, F.sequence(i + 1, n)).otherwise(nothing)
    at = lambda i: F.element_at(gids, i)
    chosen = lambda places, *before: F.filter(places, lambda i: F.pmod(F.xxhash64(*map(at, before), at(i)), F.lit(part[1])) == part[0]) if part else places
    if size == 1:
        return F.transform(chosen(first), lambda i: F.array(at(i)))
    second = lambda i: chosen(later(i), i)
    if size == 2:
        return F.flatten(F.transform(first, lambda i: F.transform(second(i), lambda j: F.array(at(i), at(j)))))
    return F.flatten(F.transform(first, lambda i: F.flatten(F.transform(second(i), lambda j: F.transform(later(j), lambda k: F.array(at(i), at(j), at(k)))))))


def combos(loads: DataFrame, size: int, least: int = 2, exclude: tuple[int, ...] = ()) -> DataFrame:
    """Combinations of `size` (2 or 3) groups in one loadout, ascending, with count and share of loadouts."""
    size = min(max(size, 2), 3)
    gids = F.array_except("gids", F.array(*map(F.lit, exclude))) if exclude else F.col("gids")
    base = loads.select(gids.alias("g"))
    total = loads.agg(F.count("*").alias("loadouts"))
    counted = base.select(F.explode(ascending(F.col("g"), size)).alias("members")).groupBy("members").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.crossJoin(F.broadcast(total)).select("members", "n", ratio(F.col("n"), F.col("loadouts")).alias("share"))  # one row


def pairs_with(loads: DataFrame, gid: int, top: int = 12) -> DataFrame:
    """The groups most often worn together with one group."""
    mine = loads.filter(F.array_contains("gids", F.lit(gid).cast("long")))
    total = mine.agg(F.count("*").alias("with_item"))
    out = mine.select(F.explode("gids").alias("other")).filter(F.col("other") != gid).groupBy("other").agg(F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(total)).withColumn("share", ratio(F.col("n"), F.col("with_item"))).orderBy(F.desc("n"), "other").limit(top)


def experience_compare(facts: DataFrame, class_num: int, slot_num: int, low: int, high: int) -> DataFrame:
    """Wearers of each group in a class and slot among players of two experience thresholds, the largest difference first.

    Populations are the loadouts of the class at each threshold. Each wearer of an item is counted once, by one distinct.
    """
    loads = facts.filter(F.col("class_num") == class_num).select("steamid", "lifetime_min").distinct()
    totals = loads.agg(F.count_if(F.col("lifetime_min") >= low).alias("pop_a"), F.count_if(F.col("lifetime_min") >= high).alias("pop_b"))
    worn = facts.filter((F.col("class_num") == class_num) & (F.col("slot_num") == slot_num)).select("cgid", "steamid", "lifetime_min").distinct()
    out = worn.groupBy("cgid").agg(F.count_if(F.col("lifetime_min") >= low).alias("count_a"), F.count_if(F.col("lifetime_min") >= high).alias("count_b")).filter(F.col("count_a") + F.col("count_b") >= 2)
    test = two_proportions(F.col("count_a"), F.col("pop_a"), F.col("count_b"), F.col("pop_b"))
    share = lambda x: F.col(f"count_{x}") / F.greatest(f"pop_{x}", F.lit(1))
    out = out.crossJoin(F.broadcast(totals)).withColumn("delta", share("b") - share("a")).withColumn("t", test)  # one row
    return out.select("cgid", "count_a", "count_b", "pop_a", "pop_b", "delta", F.col("t.z").alias("z"), F.col("t.significant").alias("significant")).orderBy(F.desc(F.abs("delta")), F.desc("count_b"), "cgid")
