"""Registers the engine's queries over the domain tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as at
from ..operators import health as he
from ..operators import intake as ta
from ..operators import loadouts as lo
from ..operators import matches as ma
from ..operators import observations as ob
from ..operators import pages as pa
from ..operators import ratings as ra
from ..operators import sinks as si
from ..operators import social as so
from ..registry import register
from ..sources.tables import cte, kept, load

#: The item that stands for the pan family in the generated tables.
PAN = 5
_STOCK = " ".join(f"WHEN {c} THEN {w}" for c, w in lo.STOCK_MELEE.items())
_FACTS = f"""fp AS (SELECT coalesce(max(coalesce(reskin_group, defindex)) FILTER (defindex = {PAN}), {PAN}) AS pan FROM items),
f0 AS (SELECT e.*, coalesce(i.reskin_group, e.defindex) AS gid, p.lifetime_min, p.active_min FROM equipped e
  JOIN players p ON p.steamid = e.steamid AND p.items_status = 'ok' AND coalesce(p.botness, 0) < 0.5 LEFT JOIN items i ON i.defindex = e.defindex),
facts AS (SELECT f0.*, CASE WHEN gid = pan THEN coalesce(CASE class_num {_STOCK} END, gid) ELSE gid END AS cgid FROM f0, fp)"""
_LOADS = """loads AS (SELECT steamid, class_num, list_sort(list(DISTINCT gid)) AS gids, coalesce(list_sort(list(DISTINCT cgid) FILTER (slot_num <= 6)), []) AS weapon_gids,
  coalesce(list_sort(list(DISTINCT cgid) FILTER (slot_num <= 7)), []) AS all_gids, max(lifetime_min) AS lifetime_min FROM facts GROUP BY 1, 2)"""
_POP = "personaname IS NOT NULL AND vac_banned = false AND coalesce(botness, 0) < 0.5"


def _facts(spark, d):
    return lo.enriched(load(spark, d, "equipped"), load(spark, d, "players"), load(spark, d, "items"), PAN)


def _loads(spark, d):
    return lo.loadouts(_facts(spark, d))


def _scopes(spark, d):
    return ra.scoped(load(spark, d, "class_stats"), load(spark, d, "players"))


def _values(spark, d):
    return ra.board_values(load(spark, d, "class_stats"), load(spark, d, "players"))


register("enriched_equipped", lambda s, d: _facts(s, d).select("steamid", "class_num", "slot_num", "defindex", "gid", "cgid", "quality", "strange_kills", "lifetime_min", "active_min"),
         cte(f"WITH {_FACTS} SELECT steamid, class_num, slot_num, defindex, gid, cgid, quality, strange_kills, lifetime_min, active_min FROM facts"))
register("loadout_arrays", _loads, cte(f"WITH {_FACTS}, {_LOADS} SELECT * FROM loads"))


def _caps(spark, d):
    return so.capabilities(load(spark, d, "items"), load(spark, d, "slot_overrides"))


def _cube(spark, d):
    return lo.usage_cube(_facts(spark, d), load(spark, d, "players"), load(spark, d, "items"), _caps(spark, d))


def _gold(spark, d):
    """The cube as a table, built once for each state of the base tables, for the pages that show a slice."""
    return kept(spark, d, "usage_cube", ("customer", "part", "orders", "lineitem"), lambda: _cube(spark, d), "merged", "hours", "active").select("merged", "hours", "active", "item", "class_num", "slot_num", "worn", "sample", "usage")


_CAPS = """us AS (SELECT defindex, coalesce(reskin_group, defindex) AS gid, slot_num, unnest(list_distinct([class_a, class_b])) AS k FROM items),
caps AS (SELECT defindex, gid, k AS class_num, slot_num FROM us)"""
# With the slots that some classes have of their own; pages show rows of any slot only, which don't depend on them.
_OWN_CAPS = _CAPS.replace("k AS class_num, slot_num", "k AS class_num, CASE WHEN k = 2 AND defindex % 2 = 1 THEN 1 ELSE slot_num END AS slot_num")
_CUBE = f"""{_FACTS}, {_CAPS},
h AS (SELECT * FROM (VALUES (0), (30000), (60000), (120000), (240000)) t(hours)), a AS (SELECT * FROM (VALUES (0), (1), (300), (900)) t(active)),
pop AS (SELECT hours, active, count(*) AS sample FROM players, h, a WHERE items_status = 'ok' AND coalesce(botness, 0) < 0.5 AND lifetime_min >= hours AND active_min >= active GROUP BY 1, 2),
x AS (SELECT * FROM facts, h, a WHERE lifetime_min >= hours AND active_min >= active),
ro AS (SELECT false AS merged, hours, active, defindex AS item, class_num, slot_num, count(*) AS worn FROM x GROUP BY ALL
 UNION ALL SELECT false, hours, active, defindex, -1, slot_num, count(*) FROM x GROUP BY ALL UNION ALL SELECT false, hours, active, defindex, class_num, -1, count(*) FROM x GROUP BY ALL
 UNION ALL SELECT false, hours, active, defindex, -1, -1, count(*) FROM x GROUP BY ALL UNION ALL SELECT true, hours, active, cgid, class_num, slot_num, count(*) FROM x GROUP BY ALL
 UNION ALL SELECT true, hours, active, cgid, class_num, -1, count(*) FROM x GROUP BY ALL UNION ALL SELECT true, hours, active, gid, -1, slot_num, count(*) FROM x GROUP BY ALL
 UNION ALL SELECT true, hours, active, gid, -1, -1, count(*) FROM x GROUP BY ALL),
dc AS (SELECT false AS merged, defindex AS item, count(DISTINCT k) AS n FROM us GROUP BY ALL UNION ALL SELECT true, gid, count(DISTINCT k) FROM us GROUP BY ALL),
ds AS (SELECT false AS merged, defindex AS item, slot_num, count(DISTINCT class_num) AS n FROM caps GROUP BY ALL UNION ALL SELECT true, gid, slot_num, count(DISTINCT class_num) FROM caps GROUP BY ALL),
cube AS (SELECT ro.*, sample, worn::DOUBLE / (sample * CASE WHEN ro.class_num <> -1 THEN 1 WHEN ro.slot_num = -1 THEN coalesce(dc.n, 9) ELSE coalesce(ds.n, dc.n, 9) END) AS usage
 FROM ro JOIN pop USING (hours, active) LEFT JOIN dc ON dc.merged = ro.merged AND dc.item = ro.item LEFT JOIN ds ON ds.merged = ro.merged AND ds.item = ro.item AND ds.slot_num = ro.slot_num)"""
register("usage_cube", _cube, cte(f"WITH {_CUBE.replace(_CAPS, _OWN_CAPS)} SELECT * FROM cube"))
register("usage_page", lambda s, d: so.usage_page(_gold(s, d).filter("merged"), 0, 0, -1, -1, 20, 20), cte(f"""WITH {_CUBE},
r AS (SELECT item, worn, usage, row_number() OVER (ORDER BY usage DESC, item DESC) AS k, count(*) OVER () AS n FROM cube WHERE merged AND hours = 0 AND active = 0 AND class_num = -1 AND slot_num = -1)
SELECT item, worn, usage, CASE WHEN n > 40 THEN 40 END AS next_offset FROM r WHERE k > 20 AND k <= 40"""))
register("capabilities", _caps, cte(f"WITH {_OWN_CAPS} SELECT defindex, class_num, slot_num FROM caps"))

for _n, _members, _joins in ((2, "[a, b]", ""), (3, "[a, b, c]", ", unnest(gids) t3(c)")):
    _where = "a < b" + (" AND b < c" if _n == 3 else "")
    register(f"combos_{_n}", lambda s, d, n=_n: lo.combos(_loads(s, d), n), cte(f"""WITH {_FACTS}, {_LOADS}
SELECT {_members} AS members, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM loads) AS share FROM loads, unnest(gids) t1(a), unnest(gids) t2(b){_joins} WHERE {_where} GROUP BY ALL HAVING count(*) >= 2"""))  # fmt: skip

register("item_pairs", lambda s, d: lo.pairs_with(_loads(s, d), 5), cte(f"""WITH {_FACTS}, {_LOADS}, m AS (SELECT * FROM loads WHERE list_contains(gids, 5)), t AS (SELECT count(*) AS with_item FROM m)
SELECT other, count(*) AS n, with_item, count(*)::DOUBLE / with_item AS share FROM m, unnest(gids) u(other), t WHERE other <> 5 GROUP BY other, with_item ORDER BY n DESC, other LIMIT 12"""))
register("experience_compare", lambda s, d: lo.experience_compare(_facts(s, d), 3, 0, 0, 120_000), cte(f"""WITH {_FACTS}, {_LOADS},
t AS (SELECT count(*) AS pop_a, count(*) FILTER (lifetime_min >= 120000) AS pop_b FROM loads WHERE class_num = 3),
g AS (SELECT cgid, count(DISTINCT steamid) AS count_a, count(DISTINCT steamid) FILTER (lifetime_min >= 120000) AS count_b FROM facts WHERE class_num = 3 AND slot_num = 0 GROUP BY cgid HAVING count_a + count_b >= 2),
z AS (SELECT *, (count_a + count_b)::DOUBLE / nullif(pop_a + pop_b, 0) AS p FROM g, t), e AS (SELECT *, sqrt(p * (1 - p) * (1.0 / nullif(pop_a, 0) + 1.0 / nullif(pop_b, 0))) AS err FROM z)
SELECT cgid, count_a, count_b, pop_a, pop_b, count_b::DOUBLE / greatest(pop_b, 1) - count_a::DOUBLE / greatest(pop_a, 1) AS delta,
 CASE WHEN err > 0 THEN (count_a::DOUBLE / pop_a - count_b::DOUBLE / pop_b) / err ELSE 0 END AS z, coalesce(abs(count_a::DOUBLE / pop_a - count_b::DOUBLE / pop_b) / nullif(err, 0), 0) > 1.959964 AS significant FROM e"""))

register("item_rates", lambda s, d: ra.item_rates(_facts(s, d), load(s, d, "class_stats")), cte(f"""WITH {_FACTS},
r AS (SELECT steamid, class_num, points_scored * 3600.0::DOUBLE / playtime_seconds AS rate, playtime_seconds / 3600.0::DOUBLE AS hours FROM class_stats WHERE playtime_seconds >= 36000),
j AS (SELECT * FROM (SELECT DISTINCT steamid, class_num, gid FROM facts) JOIN r USING (steamid, class_num) WHERE rate <= 5000)
SELECT gid, list_sort(list(rate))[cast(floor(count(*) / 2) AS int) + 1] AS value, count(DISTINCT steamid) AS players, avg(hours) AS avg_hours FROM j GROUP BY gid HAVING players >= 5"""))
register("class_medians", lambda s, d: ra.class_medians(_facts(s, d), load(s, d, "class_stats")), cte(f"""WITH {_FACTS},
j AS (SELECT * FROM (SELECT DISTINCT steamid, class_num, cgid FROM facts WHERE slot_num <= 6) JOIN class_stats USING (steamid, class_num) WHERE playtime_seconds >= 36000)
SELECT cgid, class_num, quantile_cont(points_scored * 60.0::DOUBLE / playtime_seconds, 0.5) AS ppm, quantile_cont(kills * 3600.0::DOUBLE / playtime_seconds, 0.5) AS kph,
 quantile_cont(damage_dealt * 60.0::DOUBLE / playtime_seconds, 0.5) AS dpm, count(DISTINCT steamid) AS players FROM j GROUP BY 1, 2 HAVING players >= 3"""))

_values_sql = " UNION ALL ".join(
    [f"SELECT '{m}:' || scope || ':total' AS board, steamid, {m}::DOUBLE AS value FROM sc" for m in ra.METRICS]
    + [f"SELECT '{m}:' || scope || ':per_hour:{h}h', steamid, {m} * 3600.0::DOUBLE / playtime_seconds FROM sc WHERE playtime_seconds >= {h * 3600}" for m in ra.METRICS for h in ra.HOUR_STEPS]
    + ["SELECT 'playtime:' || scope || ':total', steamid, playtime_seconds::DOUBLE FROM sc"]
)
_VALUES = f"""el AS (SELECT class_stats.* FROM class_stats JOIN players USING (steamid) WHERE {_POP} AND playtime_seconds > 0),
sc AS (SELECT steamid, CASE WHEN grouping(class_num) = 1 THEN 'all' ELSE class_num::VARCHAR END AS scope, {', '.join(f'sum({m}) AS {m}' for m in (*ra.METRICS, 'playtime_seconds'))} FROM el GROUP BY GROUPING SETS ((steamid, class_num), (steamid))),
va AS ({_values_sql})"""
register("leaderboards", lambda s, d: ra.leaderboards(_scopes(s, d)), cte(f"WITH {_VALUES} SELECT * FROM (SELECT board, steamid, value, row_number() OVER (PARTITION BY board ORDER BY value DESC, steamid) AS rank, count(*) OVER (PARTITION BY board) AS participants FROM va) WHERE rank <= 100"))
register("board_distribution", lambda s, d: ra.distribution(_values(s, d), "kills:all:per_hour:10h"), cte(f"WITH {_VALUES}, c AS (SELECT quantile_cont(value, {[i / 40 for i in range(41)]}) AS c, count(*) AS participants FROM va WHERE board = 'kills:all:per_hour:10h') SELECT unnest(range(41))::INT AS step, unnest(c) AS value, participants FROM c WHERE participants >= 20"))
register("player_ranks", lambda s, d: ra.player_ranks(_scopes(s, d), 7), cte(f"WITH {_VALUES}, r AS (SELECT board, steamid, value, rank() OVER (PARTITION BY board ORDER BY value DESC) AS rank, count(*) OVER (PARTITION BY board) AS of FROM va) SELECT board, rank, of, value, 100.0::DOUBLE * rank / of AS percentile FROM r WHERE steamid = 7"))
register("counter_boards", lambda s, d: ra.counter_boards(_facts(s, d)), cte(f"""WITH {_FACTS}, o AS (SELECT steamid, defindex, max(strange_kills) AS k FROM facts WHERE quality = 11 GROUP BY 1, 2),
p AS (SELECT steamid, sum(k)::BIGINT AS total, max(k) AS best, count(*) FILTER (k >= 8500) AS full FROM o GROUP BY 1),
l AS (SELECT steamid, 'total' AS board, total AS value FROM p UNION ALL SELECT steamid, 'best', best FROM p UNION ALL SELECT steamid, 'full', p.full FROM p)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY board ORDER BY value DESC, steamid) AS rank FROM l) WHERE rank <= 100"""))
register("counter_distribution", lambda s, d: ra.counter_distribution(_facts(s, d)), cte(f"WITH {_FACTS} SELECT gid, count(*) AS copies, avg(strange_kills) AS mean, quantile_cont(strange_kills, 0.5) AS median, quantile_cont(strange_kills, 0.9) AS p90, max(strange_kills) AS most FROM facts WHERE quality = 11 GROUP BY gid"))
_BOT_SCALE = 60
register("botness", lambda s, d: ra.botness(load(s, d, "class_stats"), load(s, d, "players"), load(s, d, "equipped"), scale=_BOT_SCALE), cte(f"""WITH c AS (SELECT *, playtime_seconds * {_BOT_SCALE}::DOUBLE AS t FROM class_stats WHERE playtime_seconds > 0),
a AS (SELECT steamid, sum(t) AS total, max(t) AS longest, bool_or(kills >= 1000000000 OR points_scored >= 1000000000 OR damage_dealt >= 1000000000 OR kill_assists >= 1000000000) AS hack,
 bool_or(t >= 3600 AND (kills * 3600 / t > 1500 OR damage_dealt * 60 / t > 3000 OR points_scored * 60 / t > 30)) AS beyond,
 max(CASE WHEN t >= 3600 THEN greatest(least(greatest((kills * 3600 / t - 600) / 900, 0), 1), least(greatest((damage_dealt * 60 / t - 700) / 2300, 0), 1), least(greatest((points_scored * 60 / t - 6) / 24, 0), 1)) ELSE 0 END) AS rate,
 min(CASE WHEN t >= 360000 THEN points_scored * 3600 / t END) AS pph FROM c GROUP BY 1),
w AS (SELECT e.steamid, count(DISTINCT e.class_num) AS classes, count(*) AS slots, count(*) FILTER (defindex IN {ra.STOCK}) AS stock FROM equipped e JOIN c ON c.steamid = e.steamid AND c.class_num = e.class_num AND c.t >= 36000 WHERE slot_num IN (0, 1, 2) GROUP BY 1)
SELECT a.steamid, CASE WHEN hack OR beyond OR total > 108000000 OR longest > 108000000 THEN 1.0::DOUBLE ELSE 1 - (1 - 0.9::DOUBLE * rate) * (1 - 0.8::DOUBLE * least(greatest((total / 3600 - 15000) / 15000, 0), 1))
 * (1 - 0.9::DOUBLE * coalesce(least(greatest((5 - pph) / 3, 0), 1), 0)) * (1 - 0.6::DOUBLE * CASE WHEN total >= 1080000 AND coalesce(classes, 0) >= 2 THEN stock::DOUBLE / slots ELSE 0 END)
 * (1 - 0.6::DOUBLE * CASE WHEN lifetime_min >= 120000 AND lifetime_min * 60 > total THEN least(greatest((0.4 - total / (lifetime_min * 60)) / 0.3, 0), 1) ELSE 0 END) END AS botness FROM a JOIN players USING (steamid) LEFT JOIN w USING (steamid)"""))
register("country_shares", lambda s, d: ra.country_shares(load(s, d, "players")), cte(f"WITH n AS (SELECT country, count(*) AS n FROM players WHERE {_POP} AND country IS NOT NULL GROUP BY 1), f AS (SELECT country, n, n::DOUBLE / sum(n) OVER () AS share FROM n) SELECT *, least(greatest(0.15::DOUBLE / greatest(share, 0.15), 0.25), 1.0) AS factor FROM f"))

_ROUNDS = """ob AS (SELECT server, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS round, name, max(score) AS score, CAST(floor(epoch(ts) / 172800) AS BIGINT) % 5 AS m FROM scores GROUP BY ALL)"""


def _observed(s, d):
    x = load(s, d, "scores").withColumn("sec", F.unix_timestamp(F.col("ts").cast("timestamp")))
    x = x.withColumn("round", F.floor(F.col("sec") / 21600)).withColumn("map", (F.floor(F.col("sec") / 172800) % 5).cast("string"))
    return x.groupBy("server", "round", "map", "name").agg(F.max("score").alias("score"))


register("match_segments", lambda s, d: ob.match_segments(_observed(s, d)), cte(f"""WITH {_ROUNDS},
r AS (SELECT server, round, any_value(m)::VARCHAR AS map, count(*) AS players FROM ob GROUP BY 1, 2), l AS (SELECT *, lag(round) OVER w AS before, lag(map) OVER w AS was FROM r WINDOW w AS (PARTITION BY server ORDER BY round)),
b AS (SELECT n.server, n.round, count(*) AS came, count(*) FILTER (n.score < o.score) AS fell FROM ob n JOIN l USING (server, round) JOIN ob o ON o.server = n.server AND o.round = l.before AND o.name = n.name GROUP BY 1, 2),
y AS (SELECT l.*, CASE WHEN before IS NULL THEN 'first' WHEN map <> was THEN 'map_change' WHEN came >= 4 AND fell >= 0.6::DOUBLE * came THEN 'score_reset' END AS why FROM l LEFT JOIN b USING (server, round)),
g AS (SELECT *, count(why) OVER (PARTITION BY server ORDER BY round) AS segment FROM y)
SELECT server, segment, min(round) AS started, max(round) AS ended, any_value(map) AS map, count(*) AS observations, max(why) AS opened_by, sum(players)::BIGINT AS seen FROM g GROUP BY 1, 2"""))
_MODES = ("click", "login", "logout", "purchase", "view")
register("rush_hours", lambda s, d: ob.rush_hours(load(s, d, "events")), "WITH s AS (SELECT date_trunc('hour', ts) AS scan, count(*) AS players FROM events GROUP BY 1), h AS (SELECT hour(scan)::INT AS hour, avg(players) AS players FROM s GROUP BY 1) SELECT hour, players, players / sum(players) OVER () AS share FROM h")
register("outcome_rates", lambda s, d: ob.outcome_rates(load(s, d, "events")), "SELECT event_type AS endpoint, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS calls, count(*) FILTER (value > 90) AS failed, count(*) FILTER (value > 90)::DOUBLE / count(*) AS rate FROM events GROUP BY 1, 2")
register("recapture", lambda s, d: ob.recapture(load(s, d, "events")), "WITH m AS (SELECT max(ts) AS t FROM events), w AS (SELECT user_id, bool_or(ts <= t - INTERVAL 7 DAY) AS a, bool_or(ts > t - INTERVAL 7 DAY) AS b FROM events, m WHERE value > 100 AND ts > t - INTERVAL 14 DAY GROUP BY 1) SELECT count(*) FILTER (a) AS n1, count(*) FILTER (b) AS n2, count(*) FILTER (a AND b) AS both, (n1 + 1) * (n2 + 1) / (\"both\" + 1)::DOUBLE - 1 AS estimate FROM w")


def _names(s, d):
    return load(s, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))


register("similar_names", lambda s, d: ob.similar_names(_names(s, d), _names(s, d)), """WITH n AS (SELECT DISTINCT p_name AS name FROM part),
w AS (SELECT name, unnest(list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM n), g AS (SELECT DISTINCT name, substr('  ' || w || ' ', i, 3) AS gram FROM (SELECT name, w, unnest(range(1, length(w) + 2)) AS i FROM w)),
c AS (SELECT name, count(*) AS n FROM g GROUP BY 1), p AS (SELECT x.name AS a, y.name AS b, count(*) AS c FROM g x JOIN g y USING (gram) GROUP BY 1, 2),
s AS (SELECT a, b, c::DOUBLE / (ca.n + cb.n - c) AS similarity FROM p JOIN c ca ON ca.name = a JOIN c cb ON cb.name = b),
k AS (SELECT p_name AS name, min(p_partkey) AS key, count(*) AS n FROM part GROUP BY 1)
SELECT l.key AS left_key, r.key AS right_key, l.n AS left_rows, r.n AS right_rows, similarity FROM s JOIN k l ON l.name = a JOIN k r ON r.name = b WHERE similarity >= 0.3""")
register("name_classes", lambda s, d: ob.name_classes(_names(s, d)), "SELECT p_partkey AS key, p_name AS name, min(p_partkey) OVER (PARTITION BY p_name) AS class_key FROM part")


def _intervals(s, d):
    x = load(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("start"))
    return x.withColumn("end", F.expr("start + INTERVAL 30 HOURS"))


register("in_intervals", lambda s, d: ob.in_intervals(load(s, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at")), _intervals(s, d)),
         'WITH i AS (SELECT user_id AS key, ts AS s, ts + INTERVAL 30 HOUR AS e FROM events), p AS (SELECT DISTINCT user_id AS key, ts AS "at" FROM events) SELECT p.key, p."at", count(i.s) AS n FROM p LEFT JOIN i ON i.key = p.key AND i.s <= p."at" AND p."at" < i.e GROUP BY 1, 2')


def _totals(s, d):
    from pyspark.sql import Window as W

    o = load(s, d, "orders").groupBy(F.col("o_custkey").alias("steamid"), F.col("o_orderdate").alias("at")).agg(F.sum(F.expr("cast(floor(o_totalprice) as bigint) * CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END")).alias("moved"))
    return o.withColumn("total", F.sum("moved").over(W.partitionBy("steamid").orderBy("at"))).drop("moved")


register("stat_windows", lambda s, d: ob.stat_windows(_totals(s, d)), """WITH o AS (SELECT o_custkey AS steamid, o_orderdate AS t, sum(floor(o_totalprice)::BIGINT * CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE 1 END) AS moved FROM orders GROUP BY 1, 2),
l AS (SELECT steamid, t, lag(t) OVER (PARTITION BY steamid ORDER BY t) AS before, moved FROM o)
SELECT steamid, before AS start, t AS "end", moved::BIGINT AS delta, moved < 0 AS reset, moved = 0 AS lag FROM l WHERE before IS NOT NULL""")

# --- matches and windows -----------------------------------------------------------------------

_SECS = "(epoch_us({1}) - epoch_us({0})) / 1e6::DOUBLE"
_PPH = f"CASE WHEN observations >= 2 AND last_seen > first_seen THEN (last_score - first_score) * 3600.0::DOUBLE / ({_SECS.format('first_seen', 'last_seen')}) END"


def _matches(f):
    return lambda s, d: f(load(s, d, "segments"), load(s, d, "participants"))


register("recent_segments", _matches(ma.recent_segments), cte("""WITH n AS (SELECT * FROM segments WHERE started > (SELECT max(started) FROM segments) - INTERVAL 10 DAY ORDER BY started DESC, segment LIMIT 50)
SELECT n.segment, server, map, started, count(*) AS players, max(last_score) AS best FROM n JOIN participants p ON p.segment = n.segment GROUP BY ALL"""))
register("sampled_maps", _matches(ma.sampled_maps), cte("SELECT map, count(*) AS participants, count(DISTINCT segment) AS segments FROM participants JOIN segments USING (segment) GROUP BY map ORDER BY participants DESC, map LIMIT 8"))
register("segment_detail", _matches(ma.segment_detail), cte(f"""WITH p AS (SELECT *, {_PPH} AS pph FROM participants)
SELECT segment, map, server, steamid, last_score, pph, row_number() OVER (PARTITION BY segment ORDER BY pph DESC NULLS LAST, last_score DESC, steamid) AS place FROM p JOIN segments USING (segment)"""))
register("match_leaderboard", _matches(ma.match_leaderboard), cte(f"""WITH b AS (SELECT segment, steamid, observations, {_PPH} AS pph FROM participants WHERE observations >= 3 AND {_SECS.format('first_seen', 'last_seen')} >= 1800 AND last_score >= first_score
  AND last_seen > (SELECT max(ended) FROM segments) - INTERVAL 20 DAY ORDER BY pph DESC, segment, steamid LIMIT 100) SELECT b.*, map FROM b JOIN segments USING (segment)"""))
register("duration_histogram", lambda s, d: ma.duration_histogram(load(s, d, "segments")), cte(f"""WITH e AS (SELECT * FROM (VALUES (0, 0), (1, 3600), (2, 14400), (3, 28800), (4, 43200), (5, 10000000)) t(bucket, low)), n AS (SELECT {_SECS.format('started', 'ended')} AS n FROM segments)
SELECT bucket, low, (SELECT count(*) FROM n WHERE n.n >= e.low AND n.n < coalesce((SELECT min(x.low) FROM e x WHERE x.low > e.low), 1e300)) AS n FROM e"""))

_WINDOWS = """dl AS (SELECT steamid, snapshot, taken, class_num, seconds - coalesce(lag(seconds) OVER (PARTITION BY steamid, class_num ORDER BY taken, snapshot), 0) AS delta FROM snapshots),
wh AS (SELECT steamid, snapshot, taken AS t, bool_or(delta < 0) AS reset, count(*) FILTER (delta > 0) AS n, min(class_num) FILTER (delta > 0) AS c FROM dl GROUP BY ALL),
wn AS (SELECT steamid, snapshot, t, reset, n, c, lag(t) OVER (PARTITION BY steamid ORDER BY t, snapshot) AS start FROM wh)"""


def _windows(s, d):
    return ma.class_windows(load(s, d, "snapshots"))


register("class_windows", lambda s, d: _windows(s, d).drop("moved", "before"), cte(f'WITH {_WINDOWS} SELECT steamid, snapshot, start, t AS "end", reset, n = 0 AS lag, CASE WHEN n = 1 THEN c END AS pure_class FROM wn WHERE start IS NOT NULL'))
register("moved_classes", lambda s, d: ma.moved_classes(_windows(s, d)), cte(f'WITH {_WINDOWS} SELECT steamid, snapshot, start, t AS "end", reset, class_num, delta FROM wn JOIN dl USING (steamid, snapshot) WHERE start IS NOT NULL AND delta > 0'))
register("play_sessions", lambda s, d: ma.play_sessions(_windows(s, d)), cte(f"""WITH {_WINDOWS}, f AS (SELECT steamid, snapshot, row_number() OVER (PARTITION BY steamid ORDER BY t DESC, snapshot DESC) AS place FROM wn WHERE start IS NOT NULL AND NOT reset AND n > 0)
SELECT steamid, snapshot, place, list(class_num ORDER BY delta DESC, class_num) AS classes, sum(delta)::BIGINT AS seconds FROM f JOIN dl USING (steamid, snapshot) WHERE place <= 25 AND delta > 0 GROUP BY ALL"""))


def _stays(s, d):
    x = load(s, d, "events").select((F.col("user_id") % 12).alias("key"), F.date_trunc("day", "ts").alias("start")).distinct()
    return ma.overlapping_maps(x.withColumn("end", F.expr("start + INTERVAL 8 HOURS")), load(s, d, "participants"), load(s, d, "segments"))


_STAYS = """wi AS (SELECT DISTINCT user_id % 12 AS key, date_trunc('day', ts)::TIMESTAMP AS s FROM events), st AS (SELECT steamid, map, first_seen, last_seen FROM participants JOIN segments USING (segment)),
ma AS (SELECT key, s, coalesce(list_sort(list(DISTINCT map) FILTER (map IS NOT NULL)), []) AS maps FROM wi LEFT JOIN st ON steamid = key AND first_seen < s + INTERVAL 8 HOUR AND last_seen > s GROUP BY 1, 2)"""
register("overlapping_maps", _stays, cte(f'WITH {_STAYS} SELECT key, s AS start, s + INTERVAL 8 HOUR AS "end", maps, CASE WHEN len(maps) = 1 THEN maps[1] END AS pure_map FROM ma'))


def _played(s, d):
    return load(s, d, "participants").join(load(s, d, "segments"), "segment").select("map", (F.col("steamid") % 9).alias("class_num"), (F.col("last_score") * 60).alias("seconds"))


register("map_class_mix", lambda s, d: ma.map_shares(_played(s, d)), cte("""WITH p AS (SELECT map, steamid % 9 AS class_num, sum(last_score * 60)::BIGINT AS seconds FROM participants JOIN segments USING (segment) GROUP BY ALL),
w AS (SELECT map, sum(seconds) AS total FROM p GROUP BY 1 HAVING total >= 3600 ORDER BY total DESC, map LIMIT 40) SELECT map, class_num, seconds, seconds::DOUBLE / total AS share FROM p JOIN w USING (map)"""))
register("bracketing_snapshots", lambda s, d: ma.bracketing(load(s, d, "snapshots"), load(s, d, "orders").select(F.col("o_custkey").alias("steamid"), F.expr("o_orderdate + INTERVAL 36 HOURS").alias("at"))), cte("""WITH t AS (SELECT DISTINCT steamid, taken FROM snapshots),
p AS (SELECT steamid, taken, lead(taken) OVER (PARTITION BY steamid ORDER BY taken) AS next FROM t), a AS (SELECT DISTINCT o_custkey AS steamid, o_orderdate + INTERVAL 36 HOUR AS "at" FROM orders)
SELECT steamid, "at", taken AS start, next FROM p JOIN a USING (steamid) WHERE taken <= "at" AND "at" < next"""))
register("trajectories", lambda s, d: ma.trajectories(load(s, d, "scores").withColumn("segment", F.floor(F.col("event_id") / 40))), cte("""SELECT CAST(floor(event_id / 40) AS BIGINT) AS segment, name, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(score, (ts, event_id)) AS first_score, arg_max(score, (ts, event_id)) AS last_score,
 max(score) AS best, count(*) AS observations FROM scores GROUP BY ALL"""))

# --- players, items, servers -------------------------------------------------------------------


def _metric_totals(s, d):
    return load(s, d, "class_stats").groupBy("steamid").agg(F.sum("kills").alias("kills"), F.sum("damage_dealt").alias("damage_dealt"))


register("friend_ranks", lambda s, d: so.friend_ranks(_metric_totals(s, d), load(s, d, "friends"), 7), cte("""WITH c AS (SELECT b AS steamid FROM friends WHERE a = 7 UNION SELECT a FROM friends WHERE b = 7 UNION SELECT 7),
t AS (SELECT steamid, sum(kills) AS kills, sum(damage_dealt) AS damage_dealt FROM class_stats JOIN c USING (steamid) GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY kills DESC) AS rk, rank() OVER (ORDER BY damage_dealt DESC) AS rd, count(*) OVER () AS of FROM t)
SELECT of, 'kills' AS metric, rk AS rank FROM r WHERE steamid = 7 AND of >= 2 UNION ALL SELECT of, 'damage_dealt', rd FROM r WHERE steamid = 7 AND of >= 2"""))
register("search", lambda s, d: so.search(load(s, d, "items"), load(s, d, "players"), "R"), cte("""(SELECT 'item' AS kind, defindex AS id, name FROM items WHERE contains(lower(name), 'r') ORDER BY slot_num = 0 DESC, name, defindex LIMIT 8)
UNION ALL (SELECT 'player', steamid, personaname FROM players WHERE contains(lower(personaname), 'r') ORDER BY personaname, steamid LIMIT 5)"""))
register("usage_deltas", lambda s, d: so.usage_deltas(load(s, d, "usage_days")), cte("""WITH m AS (SELECT max(day) AS now, coalesce(max(day) FILTER (day <= (SELECT max(day) FROM usage_days) - 90), min(day)) AS b4 FROM usage_days),
x AS (SELECT gid, sum(CASE WHEN day = now THEN worn ELSE 0 END) AS a, sum(CASE WHEN day = b4 THEN worn ELSE 0 END) AS b FROM usage_days, m WHERE day IN (now, b4) GROUP BY 1), t AS (SELECT sum(a) AS na, sum(b) AS nb FROM x)
SELECT gid, a::DOUBLE / na AS now, b::DOUBLE / nb AS "then", a::DOUBLE / na - b::DOUBLE / nb AS delta FROM x, t"""))
register("counter_tiers", lambda s, d: so.counter_tiers(_facts(s, d)), cte(f"WITH {_FACTS} SELECT gid, CASE WHEN strange_kills >= 8500 THEN 5 WHEN strange_kills >= 1000 THEN 4 WHEN strange_kills >= 100 THEN 3 WHEN strange_kills >= 10 THEN 2 ELSE 1 END AS tier, count(*) AS copies FROM facts WHERE quality = 11 GROUP BY ALL"))
register("item_counter_board", lambda s, d: so.item_counter_board(_facts(s, d), 5), cte(f"WITH {_FACTS} SELECT steamid, max(strange_kills) AS kills FROM facts WHERE defindex = 5 AND quality = 11 GROUP BY 1 ORDER BY kills DESC, steamid LIMIT 20"))
register("combo_rates", lambda s, d: ra.combo_rates(_loads(s, d), load(s, d, "class_stats")), cte(f"""WITH {_FACTS}, {_LOADS}, r AS (SELECT steamid, class_num, points_scored * 3600.0::DOUBLE / playtime_seconds AS rate FROM class_stats WHERE playtime_seconds >= 36000),
j AS (SELECT a || '+' || b AS pair, steamid, rate FROM loads JOIN r USING (steamid, class_num), unnest(weapon_gids) t1(a), unnest(weapon_gids) t2(b) WHERE a < b)
SELECT pair, list_sort(list(rate))[cast(floor(count(*) / 2) AS int) + 1] AS value, count(DISTINCT steamid) AS players FROM j GROUP BY pair HAVING players >= 5"""))
register("round_robin", lambda s, d: so.round_robin(load(s, d, "orders").select(F.col("o_orderkey").alias("server"), (F.col("o_custkey") % 6).alias("region"), F.floor("o_totalprice").alias("humans"), (F.col("o_orderkey") % 13).alias("tracked"))), """WITH x AS (SELECT o_orderkey AS server, o_custkey % 6 AS region, floor(o_totalprice)::BIGINT AS humans, o_orderkey % 13 AS tracked FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY humans DESC, server) AS turn FROM x) SELECT * FROM w ORDER BY turn, tracked, region, server LIMIT 40""")
register("inventory", lambda s, d: so.inventory(load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("steamid")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(F.col("l_partkey").alias("defindex"), (F.col("l_linenumber") * 2 + 3).alias("quality")))), ","), F.lit("]")).alias("raw"))),
         "SELECT l_orderkey AS steamid, l_partkey AS defindex, l_linenumber * 2 + 3 AS quality, count(*) AS copies, CASE l_linenumber * 2 + 3 WHEN 5 THEN 1 WHEN 11 THEN 2 WHEN 6 THEN 3 WHEN 1 THEN 4 ELSE 5 END AS place FROM lineitem GROUP BY ALL")
register("server_trend", lambda s, d: ob.trend(load(s, d, "events"), _MODES), "WITH s AS (SELECT date_trunc('minute', ts) AS scan, event_type AS m, count(*) AS n FROM events GROUP BY 1, 2), h AS (SELECT date_trunc('hour', scan)::TIMESTAMP AS hour, m, avg(n) AS a FROM s GROUP BY 1, 2) SELECT hour, " + ", ".join(f"max(a) FILTER (m = '{m}') AS {m}" for m in _MODES) + " FROM h GROUP BY 1")
register("scan_totals", lambda s, d: ob.scan_totals(load(s, d, "events").withColumn("gametype", F.concat_ws(",", "event_type", F.when(F.col("value") > 50, "full"))), ("click", "full")), """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS scan, user_id % 4 AS region, count(*) AS servers, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (value > 50) AS "full" FROM events GROUP BY 1, 2""")
register("peaks", lambda s, d: ob.peaks(load(s, d, "events")), "WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS n FROM events GROUP BY 1) SELECT hour::DATE AS day, max(n) AS peak, (SELECT arg_max(n, hour) FROM h) AS live FROM h GROUP BY 1")

# --- sinks and health --------------------------------------------------------------------------


def _halves(s, d):
    x = load(s, d, "scores").select("name", "event_id", F.col("score").alias("first_score"), F.col("score").alias("last_score"), F.col("score").alias("best"), F.lit(1).cast("long").alias("n"))
    x = x.withColumn("last_score", F.when(F.col("event_id") % 3 > 0, F.col("last_score")))
    return x.filter("event_id % 2 = 0"), x.filter("event_id % 2 = 1")


register("upsert", lambda s, d: si.upsert(*_halves(s, d), ["name"], "event_id", ("first_score",), ("last_score",), ("best",), ("n",)), cte("""SELECT name, arg_min(score, event_id) AS first_score, arg_max(score, event_id) FILTER (event_id % 3 > 0) AS last_score, max(score) AS best, count(*) AS n, max(event_id) AS event_id FROM scores GROUP BY 1"""))
register("insert_ignore", lambda s, d: si.insert_ignore(load(s, d, "orders").filter("o_orderkey % 5 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")), load(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey"),
         "SELECT o_custkey, coalesce(min(o_orderkey) FILTER (o_orderkey % 5 = 0), min(o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
register("corpus_counts", lambda s, d: he.corpus_counts(load(s, d, "players")), cte("SELECT count(*) AS players, count(personaname) AS named, count(*) FILTER (items_status = 'private') AS private, count(*) FILTER (vac_banned) AS banned, count(*) FILTER (botness >= 0.5) AS flagged, count(*) FILTER (active_min > 0) AS active FROM players"))
register("top_countries", lambda s, d: he.top_countries(load(s, d, "players")), cte("SELECT country, count(*) AS n FROM players WHERE country IS NOT NULL GROUP BY 1 ORDER BY n DESC, country LIMIT 24"))
register("class_totals", lambda s, d: he.class_totals(load(s, d, "class_stats")), cte("SELECT class_num, sum(playtime_seconds)::DOUBLE / 3600 AS hours, count(DISTINCT steamid) AS players, sum(points_scored)::BIGINT AS points FROM class_stats GROUP BY 1"))
register("event_props", lambda s, d: he.keyed_values(load(s, d, "events").select("event_id", "props"), "props", "k int, absent string").select("event_id", "k", "absent"), "SELECT event_id, (props->>'k')::INT AS k, props->>'absent' AS absent FROM events")
register("closed_segments", lambda s, d: ob.closed_segments(_observed(s, d)), cte(f"""WITH {_ROUNDS},
r AS (SELECT server, round, any_value(m)::VARCHAR AS map FROM ob GROUP BY 1, 2), l AS (SELECT *, lag(round) OVER w AS before, lag(map) OVER w AS was FROM r WINDOW w AS (PARTITION BY server ORDER BY round)),
b AS (SELECT n.server, n.round, count(*) AS came, count(*) FILTER (n.score < o.score) AS fell FROM ob n JOIN l USING (server, round) JOIN ob o ON o.server = n.server AND o.round = l.before AND o.name = n.name GROUP BY 1, 2),
y AS (SELECT l.*, CASE WHEN before IS NULL THEN 'first' WHEN round - before > 2 THEN 'server_gone' WHEN map <> was THEN 'map_change' WHEN came >= 4 AND fell >= 0.6::DOUBLE * came THEN 'score_reset' END AS why FROM l LEFT JOIN b USING (server, round)),
g AS (SELECT *, count(why) OVER (PARTITION BY server ORDER BY round) AS segment FROM y),
e AS (SELECT server, segment, min(round) AS started, max(round) AS ended, arg_min(map, round) AS map, count(*) AS observations, max(why) AS why FROM g GROUP BY 1, 2),
f AS (SELECT *, lead(why) OVER (PARTITION BY server ORDER BY segment) AS closed_by FROM e)
SELECT server, started, ended, map, observations, closed_by FROM f WHERE closed_by IS NOT NULL"""))

# --- names on scoreboards ----------------------------------------------------------------------

_NORM = "regexp_replace(lower(trim({0})), '\\s+', ' ', 'g')"
_GRAMS = "SELECT DISTINCT name, substr('  ' || w || ' ', i, 3) AS gram FROM (SELECT name, w, unnest(range(1, length(w) + 2)) AS i FROM (SELECT name, unnest(list_filter(string_split_regex(name, '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM %s))"
_GROWING = "gr AS (SELECT * FROM (SELECT steamid, seen AS lo, lead(seen) OVER w AS hi, minutes, lead(minutes) OVER w AS later FROM logged WINDOW w AS (PARTITION BY steamid ORDER BY seen)) WHERE later > minutes)"
_SCORED = f"""sn AS (SELECT segment, name AS shown, started, {_NORM.format('name')} AS norm FROM sighted), kn AS (SELECT steamid, recent_min, lower(personaname) AS low FROM personas WHERE personaname IS NOT NULL),
an AS (SELECT DISTINCT norm AS name FROM sn), bn AS (SELECT DISTINCT low AS name FROM kn), ag AS ({_GRAMS % 'an'}), bg AS ({_GRAMS % 'bn'}),
ac AS (SELECT name, count(*) AS n FROM ag GROUP BY 1), bc AS (SELECT name, count(*) AS n FROM bg GROUP BY 1), sh AS (SELECT ag.name AS norm, bg.name AS low, count(*) AS c FROM ag JOIN bg USING (gram) GROUP BY 1, 2),
si AS (SELECT norm, low, c::DOUBLE / (ac.n + bc.n - c) AS similarity FROM sh JOIN ac ON ac.name = norm JOIN bc ON bc.name = low),
ca AS (SELECT norm, steamid, recent_min, similarity, {_NORM.format('low')} = norm AS exact FROM si JOIN kn USING (low) WHERE similarity >= 0.3),
cr AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY exact DESC, similarity DESC, steamid) AS place FROM ca),
cc AS (SELECT *, count(*) OVER (PARTITION BY norm) AS candidates, count(*) FILTER (exact) OVER (PARTITION BY norm) AS same FROM cr WHERE place <= 50), {_GROWING},
pl AS (SELECT DISTINCT steamid, started FROM (SELECT DISTINCT steamid, started FROM sn JOIN cc USING (norm)) JOIN gr USING (steamid) WHERE started BETWEEN lo AND hi),
cs AS (SELECT segment, shown AS name, started, steamid, similarity, exact, coalesce(recent_min > 0, false) AS recent, pl.steamid IS NOT NULL AS played, place, candidates, same FROM sn JOIN cc USING (norm) LEFT JOIN pl USING (steamid, started)),
sc AS (SELECT * EXCLUDE (candidates, same), least(greatest(0.45::DOUBLE * similarity + CASE WHEN exact THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN recent THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN played THEN 0.35::DOUBLE ELSE 0 END
 + CASE WHEN exact AND same = 1 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN candidates > 20 THEN -0.1::DOUBLE ELSE 0 END, 0), 1) AS confidence FROM cs)"""
_ATTRIBUTED = f"{_SCORED}, be AS (SELECT *, row_number() OVER (PARTITION BY segment, name ORDER BY confidence DESC, similarity DESC, place) AS r FROM sc), att AS (SELECT segment, name, steamid, similarity, exact, recent, played, confidence, played AND confidence >= 0.7 AS strong FROM be WHERE r = 1 AND confidence >= 0.9)"


def _scores(s, d, segment=None):
    seen = load(s, d, "sighted")
    return at.scored(seen if segment is None else seen.filter(F.col("segment") == segment), load(s, d, "personas"), load(s, d, "logged"))


def _attributed(s, d):
    return at.attributions(at.sure(load(s, d, "sighted"), load(s, d, "personas"), load(s, d, "logged")))


register("attributions", _attributed, cte(f"WITH {_ATTRIBUTED} SELECT * FROM att"))
register("match_candidates", lambda s, d: at.candidate_tiers(_scores(s, d, 3)), cte(f"""WITH {_SCORED.replace("FROM sighted)", "FROM sighted WHERE segment = 3)")}
SELECT segment, name, steamid, similarity, confidence, exact, recent, played, CASE WHEN played AND confidence >= 0.7 THEN 'strong' WHEN confidence >= 0.45 THEN 'possible' ELSE 'weak' END AS tier FROM sc"""))
register("pending_names", lambda s, d: at.pending(load(s, d, "sighted"), load(s, d, "sighted").filter("segment % 4 = 1")).select("segment", "name", "started"), cte("""SELECT segment, name, started FROM sighted x WHERE started > (SELECT max(started) FROM sighted) - INTERVAL 14 DAY
 AND NOT EXISTS (SELECT 1 FROM sighted y WHERE y.segment = x.segment AND y.name = x.name AND y.segment % 4 = 1) ORDER BY started DESC, segment, name LIMIT 4000"""))
register("sightings", lambda s, d: at.sightings(load(s, d, "sighted"), load(s, d, "personas"), load(s, d, "logged")), cte(f"""WITH re AS (SELECT segment, name, started, {_NORM.format('name')} AS norm, greatest(last_score - first_score, 0) AS gain FROM sighted WHERE started > (SELECT max(started) FROM sighted) - INTERVAL 30 DAY),
na AS (SELECT steamid, {_NORM.format('personaname')} AS norm FROM personas WHERE personaname IS NOT NULL), {_GROWING}
SELECT segment, name, started, gain, count(DISTINCT steamid) AS players, CASE WHEN count(DISTINCT steamid) = 1 THEN max(steamid) END AS steamid FROM re JOIN na USING (norm) JOIN gr USING (steamid) WHERE started BETWEEN lo AND hi GROUP BY ALL"""))
register("map_regulars", lambda s, d: pa.map_regulars(load(s, d, "segments"), _attributed(s, d), load(s, d, "players"), "map3"), cte(f"""WITH {_ATTRIBUTED}
SELECT steamid, personaname, count(DISTINCT segment) AS segments FROM att JOIN segments USING (segment) JOIN players USING (steamid) WHERE map = 'map3' AND {_POP} GROUP BY ALL ORDER BY segments DESC, steamid LIMIT 500"""))
register("regulars_weapons", lambda s, d: pa.regulars_weapons(_facts(s, d), pa.map_regulars(load(s, d, "segments"), _attributed(s, d), load(s, d, "players"), "map3"), 2), cte(f"""WITH {_ATTRIBUTED}, {_FACTS},
rg AS (SELECT steamid, count(DISTINCT segment) AS segments FROM att JOIN segments USING (segment) JOIN players USING (steamid) WHERE map = 'map3' AND {_POP} GROUP BY ALL ORDER BY segments DESC, steamid LIMIT 500), en AS (SELECT count(*) AS regulars FROM rg)
SELECT gid, count(DISTINCT steamid) AS players, regulars FROM facts JOIN rg USING (steamid), en WHERE slot_num BETWEEN 0 AND 6 AND regulars >= 2 GROUP BY ALL ORDER BY players DESC, gid LIMIT 12"""))
register("map_scorers", lambda s, d: pa.map_scorers(load(s, d, "segments"), load(s, d, "participants"), "map3"), cte(f"""SELECT segment, steamid, observations, {_PPH} AS pph FROM (SELECT p.* FROM participants p JOIN segments s USING (segment) WHERE map = 'map3')
WHERE observations >= 3 AND {_SECS.format('first_seen', 'last_seen')} >= 300 AND last_score >= first_score ORDER BY pph DESC, segment, steamid LIMIT 15"""))

# --- pages -------------------------------------------------------------------------------------

_GROUP = "gp AS (SELECT defindex, coalesce(reskin_group, defindex) AS gid FROM items WHERE coalesce(reskin_group, defindex) = (SELECT coalesce(reskin_group, defindex) FROM items WHERE defindex = {0}))"
register("item_variants", lambda s, d: pa.item_variants(load(s, d, "equipped"), load(s, d, "items"), 8), cte(f"WITH {_GROUP.format(8)} SELECT defindex, quality, count(*) AS n FROM equipped WHERE defindex IN (SELECT defindex FROM gp) GROUP BY 1, 2"))
register("item_usage", lambda s, d: pa.item_usage(_gold(s, d), load(s, d, "items"), 8), cte(f"WITH {_CUBE}, {_GROUP.format(8)} SELECT class_num, active >= 1 AS active_only, hours, worn, sample, usage FROM cube WHERE merged AND slot_num = -1 AND active IN (0, 1) AND hours IN (0, 120000) AND item IN (SELECT gid FROM gp)"))
register("item_performance", lambda s, d: pa.item_performance(ra.class_medians(_facts(s, d), load(s, d, "class_stats")), load(s, d, "items"), PAN, PAN), cte(f"""WITH {_FACTS}, {_GROUP.format(PAN)},
j AS (SELECT * FROM (SELECT DISTINCT steamid, class_num, cgid FROM facts WHERE slot_num <= 6) JOIN class_stats USING (steamid, class_num) WHERE playtime_seconds >= 36000)
SELECT cgid, class_num, quantile_cont(points_scored * 60.0::DOUBLE / playtime_seconds, 0.5) AS ppm, quantile_cont(kills * 3600.0::DOUBLE / playtime_seconds, 0.5) AS kph,
 quantile_cont(damage_dealt * 60.0::DOUBLE / playtime_seconds, 0.5) AS dpm, count(DISTINCT steamid) AS players FROM j WHERE cgid IN (SELECT gid FROM gp) OR cgid BETWEEN 0 AND 8 GROUP BY 1, 2 HAVING players >= 3"""))
register("usage_history", lambda s, d: pa.usage_history(_gold(s, d), "2024-02-01"), cte(f"WITH {_CUBE} SELECT DATE '2024-02-01' AS day, item AS gid, worn, sample, usage FROM cube WHERE merged AND class_num = -1 AND slot_num = -1 AND hours = 0 AND active = 0"))
register("profile_classes", lambda s, d: pa.profile_classes(load(s, d, "class_stats"), 7), cte("SELECT class_num, playtime_seconds / 3600.0::DOUBLE AS hours, kills * 3600::DOUBLE / playtime_seconds AS kph, damage_dealt * 60::DOUBLE / playtime_seconds AS dpm, points_scored * 3600::DOUBLE / playtime_seconds AS pph FROM class_stats WHERE steamid = 7"))
register("profile_items", lambda s, d: pa.profile_items(load(s, d, "equipped"), load(s, d, "items"), 7), cte("SELECT class_num, e.slot_num, e.defindex, name, reskin_group, quality, strange_kills FROM equipped e LEFT JOIN items i ON i.defindex = e.defindex WHERE steamid = 7"))
_WFACTS = f"""{_WINDOWS}, bf AS (SELECT steamid, snapshot, lag(snapshot) OVER (PARTITION BY steamid ORDER BY t, snapshot) AS prior FROM wh),
pt AS (SELECT steamid, snapshot, class_num, points - coalesce(lag(points) OVER (PARTITION BY steamid, class_num ORDER BY taken, snapshot), 0) AS points FROM snapshots),
ks AS (SELECT snapshot, class_num, list_sort(list(DISTINCT gid)) AS gids FROM kits WHERE slot_num <= 6 GROUP BY 1, 2),
mv AS (SELECT wn.steamid, wn.snapshot, dl.class_num, delta AS seconds, n = 1 AS pure, coalesce(k1.gids, []) AS g1, coalesce(k0.gids, []) AS g0, bf.snapshot IN (SELECT snapshot FROM kits) AND prior IN (SELECT snapshot FROM kits) AS "both"
 FROM wn JOIN dl USING (steamid, snapshot) JOIN bf USING (steamid, snapshot) LEFT JOIN ks k1 ON k1.snapshot = wn.snapshot AND k1.class_num = dl.class_num LEFT JOIN ks k0 ON k0.snapshot = prior AND k0.class_num = dl.class_num WHERE start IS NOT NULL AND NOT reset AND delta > 0),
wf AS (SELECT mv.steamid, snapshot, mv.class_num, seconds, greatest(points, 0)::BIGINT AS points, CASE WHEN "both" THEN g1 ELSE [] END AS weapon_gids, bool_and("both" AND g1 = g0) OVER (PARTITION BY mv.steamid, snapshot) AS stable, pure, coalesce(lifetime_min, 0) AS lifetime_min
 FROM mv JOIN pt USING (steamid, snapshot, class_num) JOIN players USING (steamid) WHERE coalesce(botness, 0) < 0.5)"""


def _window_facts(s, d):
    return pa.window_facts(_windows(s, d), ma.points_gained(load(s, d, "snapshots")), load(s, d, "kits"), load(s, d, "players"))


register("window_facts", _window_facts, cte(f"WITH {_WFACTS} SELECT * FROM wf"))
register("session_rates", lambda s, d: pa.session_rates(_window_facts(s, d), least_players=3), cte(f"""WITH {_WFACTS}, x AS (SELECT steamid, seconds, points * 3600.0::DOUBLE / seconds AS rate, unnest(weapon_gids) AS gid FROM wf WHERE stable AND seconds >= 600 AND points * 3600.0::DOUBLE / seconds <= 5000)
SELECT gid, list_sort(list(rate))[cast(floor(count(*) / 2) AS int) + 1] AS value, count(DISTINCT steamid) AS players, sum(seconds)::DOUBLE / 3600 / count(DISTINCT steamid) AS avg_hours FROM x GROUP BY gid HAVING sum(seconds) >= 36000 AND players >= 3"""))
_CONTINENT = "CASE region " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in pa.CONTINENTS.items()) + " END"
_MODE = "CASE WHEN map LIKE 'plr\\_%' ESCAPE '\\' THEN 'other' WHEN map LIKE 'pl\\_%' ESCAPE '\\' THEN 'payload' WHEN map LIKE 'koth\\_%' ESCAPE '\\' THEN 'koth' WHEN map LIKE 'ctf\\_%' ESCAPE '\\' THEN 'ctf' WHEN map LIKE 'cp\\_%' ESCAPE '\\' THEN 'cp' ELSE 'other' END"
_SUMS = "sum(players)::BIGINT AS players, sum(bots)::BIGINT AS bots, sum(servers)::BIGINT AS servers, sum(capacity)::BIGINT AS capacity, coalesce(sum(players) FILTER (official), 0)::BIGINT AS official_players, coalesce(sum(servers) FILTER (official), 0)::BIGINT AS official_servers"
_OVERVIEW = f"""la AS (SELECT * FROM server_scans WHERE scanned_at = (SELECT max(scanned_at) FROM server_scans)), ov AS (SELECT 'total' AS section, '' AS key, {_SUMS} FROM la HAVING count(*) > 0 UNION ALL SELECT 'region', region::VARCHAR, {_SUMS} FROM la GROUP BY region
 UNION ALL SELECT 'mode', {_MODE}, {_SUMS} FROM la GROUP BY 2 UNION ALL SELECT 'continent', {_CONTINENT}, {_SUMS} FROM la WHERE NOT official AND region BETWEEN 0 AND 7 GROUP BY 2 UNION ALL (SELECT 'map', map, {_SUMS} FROM la GROUP BY map ORDER BY players DESC, map LIMIT 30))"""
register("server_overview", lambda s, d: pa.server_overview(load(s, d, "server_scans")), cte(f"WITH {_OVERVIEW} SELECT * FROM ov"))
register("seat_fill", lambda s, d: pa.seat_fill(pa.server_overview(load(s, d, "server_scans"))), cte(f"WITH {_OVERVIEW} SELECT section, key, coalesce(players::DOUBLE / nullif(capacity, 0), 0) AS fill, coalesce(official_players::DOUBLE / nullif(players, 0), 0) AS official_share FROM ov"))
register("server_rush", lambda s, d: pa.server_rush(load(s, d, "server_scans")), cte("""WITH b AS (SELECT scanned_at, coalesce(sum(players) FILTER (official), 0) AS o, coalesce(sum(players) FILTER (NOT official), 0) AS c FROM server_scans WHERE scanned_at > (SELECT max(scanned_at) FROM server_scans) - INTERVAL 7 DAY GROUP BY 1)
SELECT hour(scanned_at)::INT AS hour, round(avg(o))::INT AS official, round(avg(c))::INT AS community FROM b GROUP BY 1"""))

# --- intake ------------------------------------------------------------------------------------

_STOCK_ROWS = ", ".join(f"({c}, {p}, {i})" for c, row in enumerate(ta.STOCK_ITEMS, 1) for p, i in enumerate(row) if i >= 0)
_MEANT = "CASE WHEN class_num = 9 AND p IN (4, 6) THEN 5 WHEN class_num = 8 AND p = 1 THEN 0 WHEN class_num = 8 AND p = 4 THEN 1 ELSE p END"
register("worn_rows", lambda s, d: ta.worn_rows(load(s, d, "backpack")), cte(f"""WITH st AS (SELECT * FROM (VALUES {_STOCK_ROWS}) t(class_num, p, defindex)), ok AS (SELECT *, CASE WHEN place < 7 THEN place WHEN place < 11 THEN 7 ELSE 8 END AS p FROM backpack WHERE class_num BETWEEN 1 AND 9 AND place <> 9),
al AS (SELECT steamid, position, class_num, p, defindex, quality, kills, renamed FROM ok UNION ALL SELECT u.steamid, 1000000000000, st.class_num, st.p, st.defindex, 6, 0, false FROM (SELECT DISTINCT steamid FROM backpack) u, st
 WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.steamid = u.steamid AND ok.class_num = st.class_num AND ok.p = st.p AND ok.p < 7)),
sl AS (SELECT *, {_MEANT} AS slot_num FROM al) SELECT steamid, class_num, slot_num, defindex, arg_min(quality, (position, quality, kills, renamed)) AS quality, arg_min(kills, (position, quality, kills, renamed)) AS kills, arg_min(renamed, (position, quality, kills, renamed)) AS renamed FROM sl WHERE NOT (class_num = 8 AND slot_num = 3) GROUP BY 1, 2, 3, 4"""))


def _stat_maps(s, d):
    name = F.element_at(F.create_map(*(F.lit(x) for n, c in ta.CLASSES.items() for x in (c, n))), F.col("class_num").cast("int"))
    pairs = F.array(*(F.struct(F.concat(name, F.lit(f".accum.{stat}")).alias("k"), F.col(c).alias("v")) for stat, c in ta.STATS.items()))
    each = load(s, d, "class_stats").select("steamid", F.explode(pairs).alias("p"))
    return each.groupBy("steamid").agg(F.map_from_entries(F.collect_list("p")).alias("stats"))


register("class_rows", lambda s, d: ta.class_rows(_stat_maps(s, d)), cte(f"SELECT steamid, class_num, {', '.join(ta.STATS.values())} FROM class_stats WHERE playtime_seconds > 0"))
register("unchanged", lambda s, d: ta.unchanged(load(s, d, "snapshots")), cte("WITH t AS (SELECT steamid, snapshot, taken, sum(seconds) AS n FROM snapshots GROUP BY ALL) SELECT steamid, snapshot, taken, coalesce(n = lag(n) OVER (PARTITION BY steamid ORDER BY taken, snapshot), false) AS unchanged FROM t"))
_LOT = "(('0x' || substr(md5({0}), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE"
register("weighted_draw", lambda s, d: ta.weighted_draw(load(s, d, "waiting"), {"seed": 8, "recrawl": 5, "friend_bfs": 4}, "draw"), cte(f"""WITH b AS (SELECT source, steamid, row_number() OVER (PARTITION BY source ORDER BY priority DESC, queued_at, steamid) AS r FROM waiting WHERE attempts < 3)
SELECT source, steamid FROM b WHERE r = 1 ORDER BY power({_LOT.format("'draw/' || source")}, 1.0::DOUBLE / CASE source WHEN 'seed' THEN 8 WHEN 'recrawl' THEN 5 WHEN 'friend_bfs' THEN 4 ELSE 1 END) DESC, source LIMIT 1"""))
_SIZES = f"""cn AS (SELECT country, count(*) AS n FROM players WHERE {_POP} AND country IS NOT NULL GROUP BY 1), cf AS (SELECT country, least(greatest(0.15::DOUBLE / greatest(n::DOUBLE / sum(n) OVER (), 0.15), 0.25), 1.0) AS factor FROM cn),
fs AS (SELECT steamid, least(greatest(round(least(greatest(round(12 * log2(lifetime_min::DOUBLE / 100000 + 1)), 5), 30) * coalesce(factor, 1)), 5), 30)::INT AS k FROM players LEFT JOIN cf USING (country))"""


def _sizes(s, d):
    players = load(s, d, "players")
    return ta.fan_out(players, ra.country_shares(players))


register("fan_out", _sizes, cte(f"WITH {_SIZES} SELECT * FROM fs"))
register("drawn_friends", lambda s, d: ta.drawn_friends(load(s, d, "friends"), _sizes(s, d), "draw"), cte(f"""WITH {_SIZES}, l AS (SELECT a, b, k, row_number() OVER (PARTITION BY a ORDER BY {_LOT.format("'draw/' || a || '/' || b")}, b) AS place FROM (SELECT DISTINCT a, b FROM friends) JOIN fs ON steamid = a)
SELECT a, b, place FROM l WHERE place <= k"""))
