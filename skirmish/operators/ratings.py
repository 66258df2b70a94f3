"""How players do: rates by item, boards, ranks, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ramp, ratio
from .loadouts import WEAPON_SLOT, population
from .percentiles import percentile_columns, percentiles

LEAST_SECONDS = 36_000
METRICS = ("kills", "kill_assists", "damage_dealt", "points_scored", "dominations", "captures", "defenses")
HOUR_STEPS = (10, 50, 150, 500)


def upper_medians(values: DataFrame, by: str, value: str) -> DataFrame:
    """by, value: the element at floor(n / 2) of each group's sorted values, without a group's values in one row or task.

    Equal values are counted first; the unit range that holds the place is found from counts by range, and only its values are sorted.
    """
    counts = values.groupBy(by, value).agg(F.count("*").alias("n")).withColumn("range", F.floor(value))
    whole = W.partitionBy(by)
    ranges = counts.groupBy(by, "range").agg(F.sum("n").alias("n"))
    ranges = ranges.withColumn("upto", F.sum("n").over(whole.orderBy("range"))).withColumn("place", F.floor(F.sum("n").over(whole) / 2) + 1)
    ranges = ranges.filter((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
    inside = counts.join(ranges.select(by, "range", (F.col("place") - F.col("upto") + F.col("n")).alias("place")), [by, "range"])
    inside = inside.withColumn("upto", F.sum("n").over(W.partitionBy(by, "range").orderBy(value)))
    return inside.filter((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place"))).select(by, value)


def item_rates(facts: DataFrame, stats: DataFrame, metric: str = "points_scored", cap: float = 5000, least_players: int = 5) -> DataFrame:
    """Upper median of an hourly rate over the players who wear an item group in a class."""
    rate = F.col(metric) * 3600.0 / F.col("playtime_seconds")
    rated = stats.filter(F.col("playtime_seconds") >= LEAST_SECONDS).select("steamid", "class_num", rate.alias("rate"), (F.col("playtime_seconds") / 3600.0).alias("hours")).filter(F.col("rate") <= cap)
    worn = facts.select("steamid", "class_num", "gid").distinct()
    worn = worn.join(rated, ["steamid", "class_num"])
    out = worn.groupBy("gid").agg(F.count_distinct("steamid").alias("players"), F.avg("hours").alias("avg_hours")).filter(F.col("players") >= least_players)
    return out.join(upper_medians(worn, "gid", "rate"), "gid").select("gid", F.col("rate").alias("value"), "players", "avg_hours")


def class_medians(facts: DataFrame, stats: DataFrame, least_players: int = 3) -> DataFrame:
    """Interpolated medians of points and damage a minute and kills an hour, by class-wise item group and class; weapons only."""
    s = stats.filter(F.col("playtime_seconds") >= LEAST_SECONDS)
    joined = facts.filter(F.col("slot_num") <= WEAPON_SLOT).select("steamid", "class_num", "cgid").distinct().join(s, ["steamid", "class_num"])
    per = lambda c, k: F.percentile(F.col(c) * k / F.col("playtime_seconds"), F.lit(0.5))
    return joined.groupBy("cgid", "class_num").agg(per("points_scored", 60.0).alias("ppm"), per("kills", 3600.0).alias("kph"), per("damage_dealt", 60.0).alias("dpm"), F.count_distinct("steamid").alias("players")).filter(F.col("players") >= least_players)


def scoped(stats: DataFrame, players: DataFrame) -> DataFrame:
    """steamid, scope (a class, or all), and the sums of the metrics and of the time, of the board population."""
    eligible = players.filter(population()).select("steamid")
    s = stats.filter(F.col("playtime_seconds") > 0).join(eligible, "steamid")
    sums = [F.sum(m).alias(m) for m in (*METRICS, "playtime_seconds")]
    out = s.groupingSets([[F.col("steamid"), F.col("class_num")], [F.col("steamid")]], F.col("steamid"), F.col("class_num")).agg(*sums, F.grouping("class_num").alias("g"))
    return out.select("steamid", F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("class_num").cast("string")).alias("scope"), *METRICS, "playtime_seconds")


def board_columns() -> list[tuple[str, str, Column]]:
    """Metric, kind and value of each board of a scope; the value is null below the hours that the board asks for."""
    out = [(m, "total", F.col(m).cast("double")) for m in METRICS] + [("playtime", "total", F.col("playtime_seconds").cast("double"))]
    for h in HOUR_STEPS:
        out += [(m, f"per_hour:{h}h", F.when(F.col("playtime_seconds") >= h * 3600, F.col(m) * 3600.0 / F.col("playtime_seconds"))) for m in METRICS]
    return out


def _named(metric: str, kind: str) -> Column:
    return F.concat(F.lit(f"{metric}:"), F.col("scope"), F.lit(f":{kind}"))


def board_values(stats: DataFrame, players: DataFrame) -> DataFrame:
    """board, steamid, value for every board: totals, and hourly rates from some hours on, over all classes and each.

    The scopes are made by grouping sets and the boards by one unpivot, so the stats are read once however many boards there are.
    """
    return _values(scoped(stats, players))


def _values(scopes: DataFrame) -> DataFrame:
    boards = F.array(*(F.struct(_named(m, kind).alias("board"), value.alias("value")) for m, kind, value in board_columns()))
    return scopes.select("steamid", F.explode(boards).alias("b")).select(F.col("b.board").alias("board"), "steamid", F.col("b.value").alias("value")).filter("value is not null")


def leaderboards(scopes: DataFrame, top: int = 100) -> DataFrame:
    """The first `top` of each board with the board's participants. scopes: as of scoped()."""
    values = _values(scopes)
    w = W.partitionBy("board").orderBy(F.desc("value"), "steamid")
    best = values.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return best.join(values.groupBy("board").agg(F.count("*").alias("participants")), "board")


def distribution(values: DataFrame, board: str, points: int = 41, least: int = 20) -> DataFrame:
    """The percentile curve of a board; empty below `least` participants."""
    steps = [i / (points - 1) for i in range(points)]
    own = values.filter(F.col("board") == board)
    n = own.groupBy("board").agg(F.count("*").alias("participants")).filter(F.col("participants") >= least)
    return percentiles(own, ["board"], "value", tuple(steps)).join(n, "board").select("step", "value", "participants")


def player_ranks(scopes: DataFrame, steamid: int) -> DataFrame:
    """One player's rank on every board by counting who is better: no sort, and one pass. scopes: as of scoped()."""
    values = _values(scopes)
    mine = values.filter(F.col("steamid") == steamid).select("board", F.col("value").alias("mine"))
    out = values.join(mine, "board").groupBy("board").agg((F.count_if(F.col("value") > F.col("mine")) + 1).alias("rank"), F.count("*").alias("of"), F.first("mine").alias("value"))
    return out.withColumn("percentile", 100.0 * F.col("rank") / F.col("of")).orderBy(F.col("rank") / F.col("of"), "board")


def counter_boards(facts: DataFrame, top: int = 100, full: int = 8500) -> DataFrame:
    """Sum, best and number of full counters of each player's distinct items, as boards."""
    own = facts.filter("quality = 11").groupBy("steamid", "defindex").agg(F.max("strange_kills").alias("k"))
    per = own.groupBy("steamid").agg(F.sum("k").alias("total"), F.max("k").alias("best"), F.count_if(F.col("k") >= full).cast("long").alias("full"))
    long = per.unpivot("steamid", ["total", "best", "full"], "board", "value")
    return long.withColumn("rank", F.row_number().over(W.partitionBy("board").orderBy(F.desc("value"), "steamid"))).filter(F.col("rank") <= top)


def counter_distribution(facts: DataFrame) -> DataFrame:
    """Copies, mean, median, 90th percentile and maximum of the counters by item group."""
    x = facts.filter("quality = 11").select("gid", "strange_kills")
    whole = x.groupBy("gid").agg(F.count("*").alias("copies"), F.avg("strange_kills").alias("mean"), F.max("strange_kills").alias("most"))
    return whole.join(percentile_columns(x, ["gid"], "strange_kills", {"median": 0.5, "p90": 0.9}), "gid").select("gid", "copies", "mean", "median", "p90", "most")


#: The stock weapons.
STOCK = (*range(25), 29, 30, 735)
#: Counters at or over this, or at the top of 32 bits, are the mark of a hack.
HACKED, TOP = 1_000_000_000, 2_147_483_647


def botness(stats: DataFrame, players: DataFrame, equipped: DataFrame, stock: tuple[int, ...] = STOCK, scale: float = 1.0) -> DataFrame:
    """A score in 0 to 1: 1 for what can't be, else independent signs combined as 1 - prod(1 - weight * sign).

    Signs: rates near the possible, time played, hours without points, stock weapons only, and much lifetime with
    little of it played. scale: what a second of the stats counts for, for tables of short play.
    """
    t = F.col("playtime_seconds") * scale
    hour, hours = t >= 3600, F.col("total") / 3600.0
    per = lambda c, k: F.col(c) * F.lit(float(k)) / t
    rates = {"kills": (3600, 600, 1500), "damage_dealt": (60, 700, 3000), "points_scored": (60, 6, 30)}
    hack = F.lit(False)
    for c in ("kills", "points_scored", "damage_dealt", "kill_assists"):
        hack = hack | (F.col(c) >= HACKED) | (F.col(c) == TOP)
    beyond = hour & ((per("kills", 3600) > 1500) | (per("damage_dealt", 60) > 3000) | (per("points_scored", 60) > 30))
    sign = F.when(hour, F.greatest(*(ramp(per(c, k), lo, hi) for c, (k, lo, hi) in rates.items()))).otherwise(0.0)
    own = stats.filter("playtime_seconds > 0").groupBy("steamid").agg(
        F.sum(t).alias("total"), F.max(t).alias("longest"), F.bool_or(hack).alias("hack"), F.bool_or(beyond).alias("beyond"), F.max(sign).alias("rate"),
        F.min(F.when(t >= 360_000, per("points_scored", 3600))).alias("least_pph"))
    played = stats.filter(t >= 36_000).select("steamid", "class_num")
    worn = equipped.filter("slot_num in (0, 1, 2)").join(played, ["steamid", "class_num"]).groupBy("steamid").agg(F.count_distinct("class_num").alias("classes"), F.count("*").alias("slots"), F.count_if(F.col("defindex").isin(*stock)).alias("stock"))
    x = own.join(players.select("steamid", "lifetime_min"), "steamid").join(worn, "steamid", "left")
    idle = F.when(F.col("least_pph").isNotNull(), ramp(-F.col("least_pph"), -5.0, -2.0)).otherwise(0.0)
    plain = F.when((F.col("total") >= 300 * 3600) & (F.col("classes") >= 2), F.col("stock") / F.col("slots")).otherwise(0.0)
    life = F.col("lifetime_min") * 60
    absent = F.when((F.col("lifetime_min") >= 120_000) & (F.col("total") > 0) & (life > F.col("total")), ramp(-F.col("total") / life, -0.4, -0.1)).otherwise(0.0)
    soft = 1 - (1 - 0.9 * F.col("rate")) * (1 - 0.8 * ramp(hours, 15_000.0, 30_000.0)) * (1 - 0.9 * idle) * (1 - 0.6 * plain) * (1 - 0.6 * absent)
    hard = F.col("hack") | F.col("beyond") | (F.col("total") > 30_000 * 3600) | (F.col("longest") > 30_000 * 3600)
    return x.select("steamid", F.when(hard, 1.0).otherwise(soft).alias("botness"))


def country_shares(players: DataFrame) -> DataFrame:
    """Share of the population by country, and the factor that damps crowded countries."""
    n = players.filter(population() & F.col("country").isNotNull()).groupBy("country").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    out = n.crossJoin(F.broadcast(total)).withColumn("share", ratio(F.col("n"), F.col("total"))).drop("total")
    return out.withColumn("factor", F.least(F.greatest(F.lit(0.15) / F.greatest("share", F.lit(0.15)), F.lit(0.25)), F.lit(1.0)))


def combo_rates(loads: DataFrame, stats: DataFrame, metric: str = "points_scored", least_players: int = 5) -> DataFrame:
    """Upper median of an hourly rate over the players who wear two groups together in a class."""
    rate = F.col(metric) * 3600.0 / F.col("playtime_seconds")
    rated = stats.filter(F.col("playtime_seconds") >= LEAST_SECONDS).select("steamid", "class_num", rate.alias("rate"))
    n = F.size("g")
    later = lambda i: F.when(i < n, F.sequence(i + 1, n)).otherwise(F.array().cast("array<int>"))
    first = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    pairs = F.flatten(F.transform(first, lambda i: F.transform(later(i), lambda j: F.concat_ws("+", F.element_at("g", i), F.element_at("g", j)))))
    worn = loads.withColumn("g", F.col("weapon_gids")).select("steamid", "class_num", F.explode(pairs).alias("pair")).join(rated, ["steamid", "class_num"])
    out = worn.groupBy("pair").agg(F.count_distinct("steamid").alias("players")).filter(F.col("players") >= least_players)
    return out.join(upper_medians(worn, "pair", "rate"), "pair").select("pair", F.col("rate").alias("value"), "players")
