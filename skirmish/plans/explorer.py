"""Registers the queries of what users page through, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as co
from ..operators import explore as ex
from ..operators import ratings as ra
from ..registry import register
from ..sources.tables import cte, load
from .catalog import _FACTS, _LOADS, _POP, _facts, _loads

#: Groups that stand for pseudo-items in the generated tables.
PSEUDO = (3, 12)
AS_OF = "2024-01-25 00:00:00"


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


# Combinations by mode, alone and compared.
_PSEUDO = ", ".join(map(str, PSEUDO))
_PAGE = """c AS (SELECT [a, b{more}] AS members, count(*) FILTER (lifetime_min >= {a}) AS count_a, count(*) FILTER (lifetime_min >= {b}) AS count_b FROM {source}, unnest(weapon_gids) t1(a), unnest(weapon_gids) t2(b){join}
 WHERE a < b{chain} AND lifetime_min >= least({a}, {b}) {cls} AND a NOT IN ({no}) AND b NOT IN ({no}){third} GROUP BY 1 HAVING count_a + count_b >= 2),
p AS (SELECT count(*) FILTER (lifetime_min >= {a}) AS pop_a, count(*) FILTER (lifetime_min >= {b}) AS pop_b FROM loads WHERE true {cls}), r AS (SELECT *, row_number() OVER (ORDER BY {order}) AS k, count(*) OVER () AS n FROM c, p)"""
register("combo_compare", lambda s, d: ex.combo_page(_loads(s, d), _loads(s, d), 2, 3, 0, 120_000, True, PSEUDO, 10, 25), cte(f"""WITH {_FACTS}, {_LOADS},
{_PAGE.format(more="", source="loads", join="", chain="", third="", a=0, b=120000, cls="AND class_num = 3", no=_PSEUDO, order="abs(count_b::DOUBLE / greatest(pop_b, 1) - count_a::DOUBLE / greatest(pop_a, 1)) DESC, count_b DESC, members")}
SELECT members, count_a, count_b, pop_a, pop_b, coalesce(count_a::DOUBLE / nullif(pop_a, 0), 0) AS usage_a, coalesce(count_b::DOUBLE / nullif(pop_b, 0), 0) AS usage_b, coalesce(count_b::DOUBLE / nullif(pop_b, 0), 0) - coalesce(count_a::DOUBLE / nullif(pop_a, 0), 0) AS delta, CASE WHEN n > 35 THEN 35 END AS next_offset FROM r WHERE k > 10 AND k <= 35"""))
register("combo_triples", lambda s, d: ex.combo_page(_loads(s, d), _loads(s, d), 4, exclude=PSEUDO), cte(f"""WITH {_FACTS}, {_LOADS},
{_PAGE.format(more=", c", source="loads", join=", unnest(weapon_gids) t3(c)", chain=" AND b < c", third=f" AND c NOT IN ({_PSEUDO})", a=0, b=2**62, cls="", no=_PSEUDO, order="count_a DESC, members")}
SELECT members, count_a, pop_a, coalesce(count_a::DOUBLE / nullif(pop_a, 0), 0) AS usage_a, CASE WHEN n > 50 THEN 50 END AS next_offset FROM r WHERE k <= 50"""))
register("combo_slot", lambda s, d: ex.combo_page(ex.slot_loads(_facts(s, d), 2), _loads(s, d), 2, exclude=PSEUDO, minutes=30_000), cte(f"""WITH {_FACTS}, {_LOADS}, sl AS (SELECT class_num, max(lifetime_min) AS lifetime_min, list(DISTINCT cgid) AS weapon_gids FROM facts WHERE slot_num = 2 GROUP BY steamid, class_num),
{_PAGE.format(more="", source="sl", join="", chain="", third="", a=30000, b=2**62, cls="", no=_PSEUDO, order="count_a DESC, members")}
SELECT members, count_a, pop_a, coalesce(count_a::DOUBLE / nullif(pop_a, 0), 0) AS usage_a, CASE WHEN n > 50 THEN 50 END AS next_offset FROM r WHERE k <= 50"""))

# Performance of items and combinations by any metric.
_RATED = """m AS (SELECT members, steamid, {column}::DOUBLE * {unit} / playtime_seconds AS rate, playtime_seconds FROM wo JOIN class_stats USING (steamid, class_num) WHERE playtime_seconds >= 36000 AND {column}::DOUBLE * {unit} / playtime_seconds <= {cap} AND lifetime_min >= {minutes} {cls}),
g AS (SELECT members, list_sort(list(rate))[cast(floor(count(*) / 2) AS int) + 1] AS value, count(DISTINCT steamid) AS players, avg(playtime_seconds) / 3600 AS avg_hours FROM m GROUP BY 1 HAVING players >= 5)
SELECT * FROM g ORDER BY value DESC, members LIMIT 50 OFFSET {offset}"""


def _rated(metric: str, cls: str = "", minutes: int = 0, offset: int = 0) -> str:
    column, unit, cap = ex.RATES[metric]
    return _RATED.format(column=column, unit=unit, cap=cap, cls=cls, minutes=minutes, offset=offset)


register("item_damage", lambda s, d: ex.performance(ex.worn_items(_facts(s, d), 1, False, PSEUDO), load(s, d, "class_stats"), "damage_min", minutes=1000, offset=3), cte(f"""WITH {_FACTS}, wo AS (SELECT steamid, class_num, lifetime_min, [defindex] AS members FROM facts WHERE slot_num = 1 AND defindex NOT IN ({_PSEUDO})), {_rated("damage_min", "", 1000, 3)}"""))
register("triple_kills", lambda s, d: ex.combo_performance(_loads(s, d), load(s, d, "class_stats"), 3, PSEUDO, "kills_hr"), cte(f"""WITH {_FACTS}, {_LOADS}, wo AS (SELECT steamid, class_num, lifetime_min, [a, b, c] AS members FROM loads, unnest(weapon_gids) t1(a), unnest(weapon_gids) t2(b), unnest(weapon_gids) t3(c) WHERE a < b AND b < c AND a NOT IN ({_PSEUDO}) AND b NOT IN ({_PSEUDO}) AND c NOT IN ({_PSEUDO})), {_rated("kills_hr")}"""))

# Hours, counters, the population and the last build.
register("hours_ranks", lambda s, d: ex.hours_ranks(load(s, d, "players")), cte(f"SELECT steamid, rank() OVER (ORDER BY lifetime_min DESC) AS rank, count(*) OVER () AS participants, (lifetime_min / 60.0::DOUBLE)::FLOAT::DOUBLE AS value FROM players WHERE {_POP} AND lifetime_min IS NOT NULL"))


def _fit_counters(s, d):
    fit = load(s, d, "players").filter(ex.population()).select("steamid")
    return ra.counter_boards(_facts(s, d).join(fit, "steamid", "left_semi"))


register("counter_boards_population", _fit_counters, cte(f"""WITH {_FACTS}, o AS (SELECT steamid, defindex, max(strange_kills) AS k FROM facts WHERE quality = 11 AND steamid IN (SELECT steamid FROM players WHERE {_POP}) GROUP BY 1, 2),
p AS (SELECT steamid, sum(k)::BIGINT AS total, max(k) AS best, count(*) FILTER (k >= 8500) AS full FROM o GROUP BY 1), l AS (SELECT steamid, 'total' AS board, total AS value FROM p UNION ALL SELECT steamid, 'best', best FROM p UNION ALL SELECT steamid, 'full', p.full FROM p)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY value DESC, steamid) AS rank FROM l) WHERE rank <= 100"""))
register("playerbase", lambda s, d: ex.playerbase(load(s, d, "server_scans").groupBy("scanned_at").agg(F.sum("players").alias("players")), _as_of()), cte(f"WITH n AS (SELECT scanned_at, sum(players)::BIGINT AS players FROM server_scans GROUP BY 1) SELECT arg_max(players, scanned_at) AS live, max(players) FILTER (scanned_at > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY) AS peak FROM n"))
register("last_run", lambda s, d: load(s, d, "usage_days").agg(F.max("day").alias("day"), F.datediff(F.lit("1999-01-01"), F.max("day")).alias("days_ago")), cte("SELECT max(day) AS day, date_diff('day', max(day), DATE '1999-01-01') AS days_ago FROM usage_days"))

# Matches and servers.
_IDS = '["1", "3", "3", "x", "7", "12"]'
register("attributed_names", lambda s, d: ex.attributed_names(load(s, d, "claims"), load(s, d, "players"), F.lit(_IDS)), cte("SELECT segment, name, steamid, personaname, confidence, strong FROM claims JOIN players USING (steamid) WHERE confidence >= 0.9 AND segment IN (1, 3, 7, 12)"))
_MODE = "CASE WHEN map LIKE 'plr\\_%' ESCAPE '\\' THEN 'other' WHEN map LIKE 'pl\\_%' ESCAPE '\\' THEN 'payload' WHEN map LIKE 'koth\\_%' ESCAPE '\\' THEN 'koth' WHEN map LIKE 'ctf\\_%' ESCAPE '\\' THEN 'ctf' WHEN map LIKE 'cp\\_%' ESCAPE '\\' THEN 'cp' ELSE 'other' END"
_SCANS = f"sc AS (SELECT scanned_at, {_MODE} AS mode, sum(players)::BIGINT AS players, coalesce(sum(players) FILTER (official), 0)::BIGINT AS official FROM server_scans WHERE scanned_at > TIMESTAMP '{AS_OF}' - INTERVAL {{}} GROUP BY 1, 2)"
_WIDE = ", ".join(f"coalesce(sum(players) FILTER (mode = '{m}'), 0)::BIGINT AS {m}" for m in ex.MODES)
register("server_trend_raw", lambda s, d: ex.server_trend(load(s, d, "server_scans"), _as_of()), cte(f"WITH {_SCANS.format('24 HOUR')} SELECT scanned_at::TIMESTAMP AS t, {_WIDE}, sum(players)::BIGINT AS total, sum(official)::BIGINT AS official FROM sc GROUP BY 1"))
register("server_trend_week", lambda s, d: ex.server_trend(load(s, d, "server_scans"), _as_of(), 168), cte(f"WITH {_SCANS.format('168 HOUR')}, h AS (SELECT date_trunc('hour', scanned_at) AS t, mode, round(avg(players))::BIGINT AS players, round(avg(official))::BIGINT AS official FROM sc GROUP BY 1, 2) SELECT t::TIMESTAMP AS t, {_WIDE}, sum(players)::BIGINT AS total, sum(official)::BIGINT AS official FROM h GROUP BY 1"))
_FLAGS = ", ".join(f"count(*) FILTER (NOT empty AND list_contains(tags, '{t}')) AS {n}_servers" for n, t in ex.TAGS.items())
register("scan_buckets", lambda s, d: ex.scan_buckets(load(s, d, "listed")), cte(f"""WITH x AS (SELECT scanned_at, coalesce(region, 255)::INT AS region, lower(map)[1:64] AS map, string_split(coalesce(gametype, ''), ',') AS tags, greatest(0, players - bots) AS people, bots, max_players FROM listed),
y AS (SELECT *, list_contains(tags, 'valve') AS official, NOT list_contains(tags, 'valve') AND people = 0 AS empty FROM x)
SELECT scanned_at::TIMESTAMP AS scanned_at, region, CASE WHEN NOT empty THEN map END AS map, official, empty, count(*) AS servers, sum(people)::BIGINT AS players, sum(CASE WHEN empty THEN 0 ELSE bots END)::BIGINT AS bots, sum(max_players)::BIGINT AS capacity, {_FLAGS} FROM y GROUP BY ALL"""))


# Names and tiers of items, as pages show them.
def _labels(s, d):
    x = load(s, d, "labels_of")
    shown = co.display_name(F.col("item_name"), F.col("name"), F.col("defindex"))
    x = x.withColumn("shown", shown).withColumn("kind", co.variant_kind(F.col("name"))).withColumn("percent", co.percent_to_top(F.col("kills"))).withColumn("bucket", co.snapped(F.col("kills"), (0, 1000, 8500, 30_000)))
    return x.filter(co.holds("an", F.col("shown"), F.col("name"), F.col("defindex"))).select("defindex", "shown", "kind", "percent", "bucket")


_PLAIN = "replace(regexp_replace(coalesce(CASE WHEN item_name LIKE '#%' THEN substr(item_name, 2) ELSE name END, defindex::VARCHAR), '^TF_WEAPON_', '', 'i'), '_', ' ')"
register("item_labels", _labels, cte(f"""WITH x AS (SELECT defindex, name, kills, CASE WHEN item_name <> '' AND item_name NOT LIKE '#%' THEN item_name ELSE array_to_string(list_transform(string_split(lower({_PLAIN}), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS shown FROM labels_of)
SELECT defindex, shown, CASE WHEN name ILIKE 'TF\\_WEAPON\\_%' ESCAPE '\\' THEN 'stock' WHEN name LIKE 'Upgradeable TF%' THEN 'renamed / strange' WHEN name ILIKE '%botkiller%' THEN 'botkiller' WHEN name ILIKE 'Festive%' THEN 'festive' WHEN name ILIKE '%australium%' THEN 'australium' WHEN regexp_full_match(name, '[a-z0-9_]+') THEN 'warpaint' END AS kind,
 least(100.0::DOUBLE, kills / 8500.0::DOUBLE * 100) AS percent, CASE WHEN kills <= 500 THEN 0 WHEN kills <= 4750 THEN 1000 WHEN kills <= 19250 THEN 8500 ELSE 30000 END AS bucket FROM x WHERE shown ILIKE '%an%' OR name ILIKE '%an%'"""))


def _tier_json(s, d):
    copies = _facts(s, d).filter("quality = 11").select("gid", co.tier(F.col("strange_kills"), (0, 10, 100, 1000, 8500)).alias("tier")).groupBy("gid", "tier").agg(F.count("*").alias("count"))
    return copies.groupBy("gid").agg(F.to_json(F.array_sort(F.collect_list(F.struct("tier", "count")))).alias("tiers"))


register("tier_json", _tier_json, cte(f"""WITH {_FACTS}, c AS (SELECT gid, (strange_kills >= 0)::INT + (strange_kills >= 10)::INT + (strange_kills >= 100)::INT + (strange_kills >= 1000)::INT + (strange_kills >= 8500)::INT AS tier, count(*) AS n FROM facts WHERE quality = 11 GROUP BY 1, 2)
SELECT gid, '[' || string_agg('{{"tier":' || tier || ',"count":' || n || '}}', ',' ORDER BY tier) || ']' AS tiers FROM c GROUP BY gid"""))
