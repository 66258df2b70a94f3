"""Registers the queries of joins, definitions, schedules, syncs and incremental builds, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import dimension as di
from ..operators import health as he
from ..operators import matches as ma
from ..operators import observations as ob
from ..operators import prefabs as pr
from ..operators import reskins as rk
from ..operators import sinks as si
from ..operators import social as so
from ..registry import register
from ..sources import localisation as lc
from ..sources.tables import cte, kept, load, shared
from ..streaming import increments

NOW = "1998-08-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _recursive(sql: str) -> str:
    return cte(sql).replace("WITH ", "WITH RECURSIVE ", 1)


# Names: a distinct one for about every fourth order, 36,000 at sf0.1.
_GRAMS = """n AS (SELECT DISTINCT name FROM handles WHERE name IS NOT NULL),
w AS (SELECT name, unnest(list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM n),
g AS (SELECT DISTINCT name, substr('  ' || w || ' ', i, 3) AS gram FROM (SELECT name, w, unnest(range(1, length(w) + 2)) AS i FROM w)), k AS (SELECT name, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.name AS a, y.name AS b, count(*) AS c FROM g x JOIN g y USING (gram) GROUP BY 1, 2), t AS (SELECT name, min(key) AS key, count(*) AS rows FROM handles WHERE name IS NOT NULL GROUP BY 1)"""
register("similar_handles", lambda s, d: ob.similar_names(load(s, d, "handles"), load(s, d, "handles")), cte(f"""WITH {_GRAMS}
SELECT ta.key AS left_key, tb.key AS right_key, ta.rows AS left_rows, tb.rows AS right_rows, c::DOUBLE / (ka.n + kb.n - c) AS similarity FROM p JOIN k ka ON ka.name = a JOIN k kb ON kb.name = b JOIN t ta ON ta.name = a JOIN t tb ON tb.name = b WHERE c >= 0.3 * (ka.n + kb.n - c) - 1e-9"""))


# Definitions that build on others.
def _resolved(s, d):
    return pr.resolved(load(s, d, "definitions").select("name"), load(s, d, "builds_on"), load(s, d, "defined"))


_RESOLVED = """ways AS (SELECT name, name AS base, []::BIGINT[] AS way FROM definitions UNION ALL SELECT w.name, b.parent, list_append(w.way, b.position) FROM ways w JOIN builds_on b ON b.name = w.base),
gv AS (SELECT ways.name, path, value, list_append(way, 2147483647) AS place FROM ways JOIN defined v ON v.name = base),
la AS (SELECT name, path, max(place) AS place, arg_max(value, place) AS value FROM gv GROUP BY 1, 2),
rv AS (SELECT name, path, value FROM la WHERE NOT EXISTS (SELECT 1 FROM la o WHERE o.name = la.name AND starts_with(la.path, o.path || '/') AND o.place > la.place) AND NOT EXISTS (SELECT 1 FROM la o WHERE o.name = la.name AND starts_with(o.path, la.path || '/') AND o.place > la.place))"""
register("resolved_definitions", _resolved, _recursive(f"WITH {_RESOLVED} SELECT name, path, value FROM rv"))


def _weapons(s, d):
    return _resolved(s, d).withColumnRenamed("name", "defindex")


_LIST = ", ".join(f"'{c}'" for c in rk.COSMETIC)
_SIGNS = f"""{_RESOLVED}, ats AS (SELECT name, list_sort(list(lower(split_part(path, '/', 2)) || '=' || value)) AS parts FROM rv WHERE (path LIKE 'attributes/%' OR path LIKE 'static_attrs/%') AND lower(split_part(path, '/', 2)) NOT IN ({_LIST}) GROUP BY 1),
us AS (SELECT name, list_sort(list(lower(split_part(path, '/', 2)))) AS who FROM rv WHERE path LIKE 'used_by_classes/%' GROUP BY 1),
sg AS (SELECT c.name, CASE WHEN s.value = 'building' THEN CASE WHEN lower(c.value) = 'tf_weapon_builder' THEN 'tf_weapon_sapper' ELSE lower(c.value) END || '::building::' || coalesce(array_to_string(who, ','), 'all') ELSE lower(c.value) END || '::' || coalesce(array_to_string(parts, '|'), '') AS sign
  FROM rv c JOIN rv s ON s.name = c.name AND s.path = 'item_slot' AND s.value IN ('primary', 'secondary', 'melee', 'pda', 'pda2', 'building', 'utility') LEFT JOIN ats atr ON atr.name = c.name LEFT JOIN us ON us.name = c.name WHERE c.path = 'item_class'),
og AS (SELECT name, min(name) OVER w AS own FROM sg WINDOW w AS (PARTITION BY sign) QUALIFY count(*) OVER w >= 2)"""
register("weapon_signatures", lambda s, d: rk.signatures(_weapons(s, d)), _recursive(f"WITH {_SIGNS} SELECT name AS defindex, sign FROM sg"))
register("reskin_groups", lambda s, d: rk.reskin_groups(rk.signatures(_weapons(s, d))), _recursive(f"""WITH {_SIGNS}, mg AS (SELECT * FROM (VALUES {', '.join(map(str, rk.MERGES.items()))}) t(a, b)),
ed AS (SELECT name AS a, own AS b FROM og UNION SELECT own, name FROM og UNION SELECT a, b FROM mg UNION SELECT b, a FROM mg), re AS (SELECT a, a AS b FROM ed UNION SELECT re.a, ed.b FROM re JOIN ed ON ed.a = re.b),
cm AS (SELECT a AS name, min(b) AS least FROM re GROUP BY 1), fi AS (SELECT least, min(coalesce(own, mg.b)) AS id FROM mg JOIN cm ON cm.name = mg.b LEFT JOIN og ON og.name = mg.b GROUP BY 1)
SELECT cm.name::BIGINT AS defindex, coalesce(id, least)::BIGINT AS reskin_group FROM cm LEFT JOIN fi USING (least)"""))
_NUMBER = lambda c, table: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"
register("class_slots", lambda s, d: rk.class_slots(_weapons(s, d)), _recursive(f"""WITH {_RESOLVED}, x AS (SELECT u.name, {_NUMBER("lower(split_part(u.path, '/', 2))", rk.CLASSES)} AS class_num, {_NUMBER("CASE WHEN u.value = '1' THEN lower(s.value) ELSE lower(u.value) END", rk.SLOTS)} AS slot
FROM rv u LEFT JOIN rv s ON s.name = u.name AND s.path = 'item_slot' WHERE u.path LIKE 'used_by_classes/%') SELECT name AS defindex, class_num, slot FROM x WHERE class_num IS NOT NULL AND slot IS NOT NULL"""))


# Windows between snapshots, with maps and loadouts on one row.
def _moves(s, d):
    # Dealt by player once, which serves each step of the windows; kept, since their mean length, their maps and their classes are read apart.
    windows = kept(s, d, "class_windows", ("orders", "lineitem"), lambda: ma.class_windows(load(s, d, "snapshots").repartition("steamid")))
    return windows, load(s, d, "attributed").withColumnsRenamed({"from_at": "from", "to_at": "to"})


_FULL = """dl AS (SELECT steamid, snapshot, taken, class_num, seconds - coalesce(lag(seconds) OVER (PARTITION BY steamid, class_num ORDER BY taken, snapshot), 0) AS delta FROM snapshots),
wh AS (SELECT steamid, snapshot, taken AS t, bool_or(delta < 0) AS reset, count(*) FILTER (delta > 0) AS n FROM dl GROUP BY ALL),
wn AS (SELECT *, lag(t) OVER o AS s, lag(snapshot) OVER o AS prior FROM wh WINDOW o AS (PARTITION BY steamid ORDER BY t, snapshot)),
pm AS (SELECT wn.steamid, snapshot, count(DISTINCT map) AS maps, min(map) AS one FROM wn JOIN attributed a ON a.key = wn.steamid AND a.from_at < t AND a.to_at > s AND a.from_at < a.to_at AND s < t GROUP BY ALL),
ks AS (SELECT snapshot, class_num, list_sort(list(DISTINCT gid)) AS gids FROM kits WHERE slot_num <= 6 GROUP BY 1, 2),
st AS (SELECT wn.steamid, wn.snapshot, bool_and(coalesce(k1.gids, []) = coalesce(k0.gids, [])) AS same FROM wn JOIN dl USING (steamid, snapshot) LEFT JOIN ks k1 ON k1.snapshot = wn.snapshot AND k1.class_num = dl.class_num LEFT JOIN ks k0 ON k0.snapshot = prior AND k0.class_num = dl.class_num WHERE delta > 0 GROUP BY ALL),
fw AS (SELECT wn.steamid, wn.snapshot, s, t, reset, n, CASE WHEN maps = 1 THEN one END AS pure_map, wn.snapshot IN (SELECT snapshot FROM kits) AND prior IN (SELECT snapshot FROM kits) AND coalesce(same, true) AS stable
  FROM wn LEFT JOIN pm ON pm.steamid = wn.steamid AND pm.snapshot = wn.snapshot LEFT JOIN st ON st.steamid = wn.steamid AND st.snapshot = wn.snapshot WHERE s IS NOT NULL)"""
register("full_windows", lambda s, d: ma.full_windows(*_moves(s, d), load(s, d, "kits")).select("steamid", "snapshot", "start", "end", "reset", F.size("moved").cast("long").alias("classes"), "pure_map", "loadout_stable"), cte(f'WITH {_FULL} SELECT steamid, snapshot, s AS start, t AS "end", reset, n AS classes, pure_map, stable AS loadout_stable FROM fw'))
register("map_class_time", lambda s, d: ma.map_class_time(ma.windows_on_maps(*_moves(s, d))), cte(f"WITH {_FULL} SELECT pure_map AS map, class_num, sum(delta)::BIGINT AS seconds, count(*) AS windows, count(DISTINCT steamid) AS players FROM fw JOIN dl USING (steamid, snapshot) WHERE pure_map IS NOT NULL AND NOT reset AND delta > 0 GROUP BY 1, 2"))

# The segments of the generated events lie hours apart, so the gap and the least matches are set for them.
_LENGTH = "(epoch_us(ended) - epoch_us(started)) / 1e6::DOUBLE"
register("match_durations", lambda s, d: ma.match_durations(load(s, d, "segments"), gap=43_200, least=3), cte(f"""WITH o AS (SELECT *, lag(closed_by) OVER w AS why, lag(ended) OVER w AS before FROM segments WHERE observations >= 2 WINDOW w AS (PARTITION BY server ORDER BY started, segment)),
f AS (SELECT mode, map, {_LENGTH} AS n FROM o WHERE closed_by IN ('score_reset', 'map_change') AND why IN ('score_reset', 'map_change') AND started - before < INTERVAL 12 HOUR AND ended > started),
g AS (SELECT mode, map, grouping(map) AS whole, count(*) AS matches, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS p75 FROM f GROUP BY GROUPING SETS ((mode, map), (mode)))
SELECT mode, map, matches, p25, median, p75 FROM g WHERE whole = 1 OR matches >= 3"""))

# Segments by time: rounds of six hours, of which some are missing, and a server is gone after ten hours.
def _timed(s, d):
    x = load(s, d, "timed")
    return ob.timed_segments(x, F.lit("2024-03-01 00:00:00").cast("timestamp"), 36_000)


register("timed_segments", _timed, cte("""WITH r AS (SELECT server, round, min(map) AS map FROM timed GROUP BY 1, 2), l AS (SELECT *, lag(map) OVER w AS was, lag(round) OVER w AS prior FROM r WINDOW w AS (PARTITION BY server ORDER BY round)),
b AS (SELECT n.server, n.round, count(*) AS came, count(*) FILTER (n.score < o.score) AS fell FROM timed n JOIN l USING (server, round) JOIN timed o ON o.server = n.server AND o.round = l.prior AND o.name = n.name GROUP BY 1, 2),
y AS (SELECT l.*, CASE WHEN prior IS NULL THEN 'first' WHEN (round - prior) * 21600 > 36000 THEN 'server_gone' WHEN map <> was THEN 'map_change' WHEN came >= 4 AND fell >= 0.6::DOUBLE * came THEN 'score_reset' END AS why FROM l LEFT JOIN b USING (server, round)),
g AS (SELECT *, count(why) OVER (PARTITION BY server ORDER BY round) AS segment FROM y), w AS (SELECT server, segment, min(round) * 21600 AS started, max(round) * 21600 AS ended, arg_min(map, round) AS map, count(*) AS observations, max(why) AS why FROM g GROUP BY 1, 2),
c AS (SELECT *, coalesce(lead(why) OVER (PARTITION BY server ORDER BY segment), CASE WHEN epoch(TIMESTAMP '2024-03-01') > ended + 36000 THEN 'server_gone' END) AS closed_by FROM w)
SELECT server, started::BIGINT AS started, ended::BIGINT AS ended, map, observations, closed_by FROM c WHERE closed_by IS NOT NULL"""))

# Queues and schedules.
register("frontier", lambda s, d: he.frontier(load(s, d, "queue")), cte("SELECT source, count(*) AS n, min(enqueued_at) AS oldest FROM queue GROUP BY source"))
_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in so.SOURCE_WEIGHTS.items()) + " ELSE 1 END"
register("queue_eta", lambda s, d: so.queue_eta(load(s, d, "queue"), load(s, d, "crawled"), 40, _now()), cte(f"""WITH m AS (SELECT priority AS p, enqueued_at AS e FROM queue WHERE steamid = 40),
x AS (SELECT (SELECT count(*) FROM queue q, m WHERE q.source = 'recrawl' AND (q.priority > p OR (q.priority = p AND q.enqueued_at < e))) AS ahead, (SELECT count(*) FROM crawled WHERE last_crawled > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR) AS per_hour,
 (SELECT coalesce(sum(w), 0)::BIGINT FROM (SELECT DISTINCT source, {_WEIGHT} AS w FROM queue WHERE locked_until IS NULL OR locked_until < TIMESTAMP '{NOW}')) AS total_weight, EXISTS (SELECT 1 FROM m) AS present)
SELECT present, CASE WHEN present THEN ahead + 1 END AS position, per_hour, total_weight, CASE WHEN present AND per_hour > 0 AND total_weight > 0 THEN floor((ahead + 1) / (per_hour * 5.0::DOUBLE / total_weight) * 3600 + 0.5)::BIGINT END AS eta_seconds FROM x"""))
register("recrawl", lambda s, d: so.recrawl(load(s, d, "crawled"), load(s, d, "queue").filter("attempts < 4"), _now()), cte(f"""WITH o AS (SELECT * FROM crawled c WHERE stats_status = 'ok' AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.steamid = c.steamid AND q.attempts < 4)),
u AS ((SELECT steamid, 2 AS priority FROM o WHERE coalesce(active_min, 0) > 0 AND last_crawled < TIMESTAMP '{NOW}' - INTERVAL 8 HOUR ORDER BY lifetime_min DESC, last_crawled, steamid LIMIT 1500) UNION ALL (SELECT steamid, 1 FROM o WHERE last_crawled < TIMESTAMP '{NOW}' - INTERVAL 14 DAY ORDER BY last_crawled, steamid LIMIT 500))
SELECT steamid, 'recrawl' AS source, max(priority)::INT AS priority FROM u GROUP BY steamid"""))


def _dead(s, d):
    return si.dead_letters(load(s, d, "queue"), load(s, d, "players"), now=_now())[1]


register("dead_letters", _dead, cte(f"SELECT steamid, min(source) AS source, 'error' AS items_status, 'error' AS stats_status FROM queue WHERE attempts >= 5 AND (locked_until IS NULL OR locked_until < TIMESTAMP '{NOW}') AND steamid NOT IN (SELECT steamid FROM players) GROUP BY steamid"))


# The item dimension.
def _groups(s, d):
    return load(s, d, "items").filter("reskin_group is not null").select("defindex", "reskin_group")


register("dimension_sync", lambda s, d: di.synced(load(s, d, "dim_old"), load(s, d, "dim_pages"), load(s, d, "dim_tokens"), _groups(s, d), load(s, d, "dim_paints")), cte("""WITH lo AS (SELECT p.* REPLACE (CASE WHEN item_name IS NULL OR item_name = '' THEN NULL WHEN item_name LIKE '#%' THEN coalesce(t.text, item_name) ELSE item_name END AS item_name) FROM dim_pages p LEFT JOIN dim_tokens t ON t.token = lower(substr(item_name, 2)) AND item_name LIKE '#%'),
up AS (SELECT * FROM (SELECT defindex, name, item_name, image_url, slot, classes, (SELECT reskin_group FROM dim_old o WHERE o.defindex = lo.defindex) AS reskin_group FROM lo UNION ALL SELECT * FROM dim_old WHERE defindex NOT IN (SELECT defindex FROM lo))),
gr AS (SELECT up.* REPLACE (coalesce(i.reskin_group, up.reskin_group) AS reskin_group) FROM up LEFT JOIN items i ON i.defindex = up.defindex)
SELECT gr.* REPLACE (CASE WHEN paint IS NOT NULL AND NOT starts_with(item_name, paint || ' ') THEN paint || ' ' || item_name ELSE item_name END AS item_name) FROM gr LEFT JOIN dim_paints USING (defindex)"""))


def _tokens(s, d):
    line = F.concat(F.lit('  "TF_'), F.col("p_partkey").cast("string"), F.lit('"\t\t"'), F.col("p_name"), F.lit(' \\"x\\""'))
    each = load(s, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    return lc.tokens(each.select("path", F.concat(F.lit('"lang"\n{\n"Tokens"\n{\n'), "body", F.lit("\n}\n}\n")).alias("text")))


register("localised_tokens", _tokens, """SELECT 'tf_' || p_partkey AS token, p_name || ' "x"' AS text FROM part""")


# Streams that build tables.
def _incremental(s, d):
    root = f"{shared(s)}/increments-{uuid.uuid4().hex}"
    events = load(s, d, "events")
    stream = s.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event[s].parquet")
    hours = [F.col("event_type").alias("endpoint"), F.date_trunc("hour", "ts").alias("hour")]
    increments.build(stream, lambda rows: rows.groupBy(*hours).agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 90).alias("failed")), root)
    return increments.compact(s, root, ["endpoint", "hour"], ("calls", "failed"))


register("incremental_outcomes", _incremental, "SELECT event_type AS endpoint, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS calls, count(*) FILTER (value > 90) AS failed FROM events GROUP BY 1, 2")
