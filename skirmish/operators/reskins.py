"""Weapons that play alike: groups by signature, merges by hand, slots by class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dropped, written

#: Attributes that change looks, sounds or trade only.
COSMETIC = (
    "kill eater", "kill eater score type", "kill eater score type 2", "kill eater score type 3", "kill eater kill type", "kill eater user 1", "kill eater user 2", "kill eater user 3",
    "kill eater user score type 1", "kill eater user score type 2", "kill eater user score type 3", "strange restriction type 1", "strange restriction value 1", "cannot trade",
    "always tradable", "never craftable", "tradable after date", "cannot restore", "cannot delete", "cannot giftwrap", "deactive date", "is marketable", "is commodity",
    "limited quantity item", "is australium item", "loot rarity", "item style override", "paintkit_proto_def_index", "set_item_texture_wear", "has team color paintkit",
    "min_viewmodel_offset", "inspect_viewmodel_offset", "weapon_allow_inspect", "weapon_uses_stattrak_module", "texture_wear_default", "special taunt",
    "weapon_stattrak_module_scale", "custom texture lo", "custom texture hi", "killstreak tier", "killstreak effect", "killstreak idleeffect", "hide_strange_prefix",
    "attach particle effect", "attach particle effect static", "set attached particle", "particle effect vertical offset", "particle effect use head origin",
    "style changes on strange level", "kill refills meter", "elevate quality", "elevate to unusual if applicable", "turn to gold", "spell: set item tint rgb",
    "spell: set halloween footstep type", "disable fancy class select anim", "sapper voice pak", "sapper voice pak idle wait", "override projectile type",
    "vision opt in flags", "pyrovision only display only", "pyrovision opt in display only", "ragdolls become ash", "ragdolls plasma effect", "is giger counter",
)
#: Variants merged by hand, with the item that each is a variant of.
MERGES = {513: 18, 741: 21, 433: 159, 863: 42, 1002: 42, 1100: 239}
#: Slots in which weapons are, numbers of those that are told by class, and classes.
WEAPON_SLOTS = ("primary", "secondary", "melee", "pda", "pda2", "building", "utility")
SLOTS = {"primary": 0, "secondary": 1, "melee": 2}
CLASSES = {"scout": 1, "sniper": 2, "soldier": 3, "demoman": 4, "medic": 5, "heavy": 6, "pyro": 7, "spy": 8, "engineer": 9}


def signatures(values: DataFrame, cosmetic: tuple[str, ...] = COSMETIC, slots: tuple[str, ...] = WEAPON_SLOTS) -> DataFrame:
    """defindex, sign of each weapon. values: defindex, path, value, as prefabs.resolved() gives them.

    Paths: `item_slot`, `item_class`, `used_by_classes/<class>`, `attributes/<name>` or `attributes/<name>/value`, `static_attrs/<name>`.
    The sign holds the item class and all attributes that aren't cosmetic. The two names of the sapper's class are one; what is
    built is also told apart by who builds it. Neither slot nor classes count otherwise. Items without slot or class have no sign.
    """
    keys = F.split("path", "/")
    each = values.select("defindex", keys[0].alias("head"), F.lower(F.try_element_at(keys, F.lit(2))).alias("name"), F.try_element_at(keys, F.lit(3)).alias("deep"), "value")
    one = each.repartition("defindex").groupBy("defindex", "head", "name").agg(F.max(F.when(F.col("deep").isNull() | (F.col("deep") == "value"), F.col("value"))).alias("value"))
    matters = F.col("head").isin("attributes", "static_attrs") & ~F.col("name").isin(*cosmetic)
    found = one.groupBy("defindex").agg(
        F.max(F.when(F.col("head") == "item_slot", F.lower("value"))).alias("slot"), F.max(F.when(F.col("head") == "item_class", F.lower("value"))).alias("kind"),
        F.array_join(F.array_sort(F.collect_list(F.when(matters, F.concat(F.col("name"), F.lit("="), F.coalesce("value", F.lit("")))))), "|").alias("matter"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("head") == "used_by_classes", F.col("name")))), ",").alias("classes"),
    ).filter(F.col("slot").isin(*slots) & F.col("kind").isNotNull())
    building = F.col("slot") == "building"
    kind = F.when(building & (F.col("kind") == "tf_weapon_builder"), "tf_weapon_sapper").otherwise(F.col("kind"))
    users = F.when(F.col("classes") == "", "all").otherwise(F.col("classes"))
    return found.select("defindex", F.when(building, F.concat_ws("::", kind, F.lit("building"), users, "matter")).otherwise(F.concat_ws("::", kind, "matter")).alias("sign"))


def linked(edges: DataFrame) -> DataFrame:
    """node, least: the least node that can be reached from each, itself included. edges: a, b."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null").distinct())
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("near"))
        step = label.join(near, "node").select("node", F.least("least", "near").alias("least"))
        jump = step.join(step.select(F.col("node").alias("least"), F.col("least").alias("beyond")), "least").select("node", F.least("least", "beyond").alias("least"))
        after = written(jump)
        ended = after.join(label, ["node", "least"], "left_anti").isEmpty()
        dropped(label)
        if ended:
            dropped(both)
            return after
        label = after


def reskin_groups(signs: DataFrame, merges: dict[int, int] | DataFrame = MERGES) -> DataFrame:
    """defindex, reskin_group: weapons of one sign, at least two, and those merged by hand (variant, base), as one equivalence.

    The id of a group is that of its sign group's least item, as far as there is one, for the base of each merge; merges that
    meet are one group of the least id. Items alone have no row.
    """
    spark = signs.sparkSession
    signs = written(signs)
    if isinstance(merges, dict):
        merges = spark.createDataFrame(list(merges.items()) or [], "variant long, base long")
    groups = signs.groupBy("sign").agg(F.min("defindex").alias("own"), F.count("*").alias("size")).filter("size >= 2")
    grouped = signs.join(groups, "sign").select("defindex", "own")
    by_sign = grouped.select(F.col("defindex").alias("a"), F.col("own").alias("b"))
    by_hand = merges.select(F.col("variant").cast("long").alias("a"), F.col("base").cast("long").alias("b"))
    whole = linked(by_sign.unionByName(by_hand))
    # Of a merged group the id is the one that the base's sign group has, not that of a variant with a lower number.
    named = by_hand.join(grouped.select(F.col("defindex").alias("b"), "own"), "b", "left").select(F.col("b").alias("node"), F.coalesce("own", "b").alias("id"))
    ids = named.join(whole, "node").groupBy("least").agg(F.min("id").alias("id"))
    return whole.join(ids, "least", "left").select(F.col("node").alias("defindex"), F.coalesce("id", "least").alias("reskin_group"))


def class_slots(values: DataFrame, slots: dict[str, int] = SLOTS, classes: dict[str, int] = CLASSES) -> DataFrame:
    """defindex, class_num, slot: who can wear a weapon where; `used_by_classes/<class>` holds 1, or the slot of that class."""
    number = lambda c, table: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)
    own = values.filter("path = 'item_slot'").select("defindex", F.lower("value").alias("slot_name"))
    users = values.filter("path like 'used_by_classes/%'").select("defindex", F.lower(F.split("path", "/")[1]).alias("class_name"), F.lower("value").alias("at"))
    met = users.join(own, "defindex", "left").withColumn("name", F.when(F.col("at") == "1", F.col("slot_name")).otherwise(F.col("at")))
    known = F.col("class_name").isin(*classes) & F.col("name").isin(*slots)
    return met.filter(known).select("defindex", number(F.col("class_name"), classes).alias("class_num"), number(F.col("name"), slots).alias("slot"))
