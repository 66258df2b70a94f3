"""Domain tables derived from the driver's tables. One text serves both engines; integer arithmetic keeps them equal."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "players": """SELECT c_custkey AS steamid, c_name AS personaname, c_nationkey AS country, c_custkey % 50 = 0 AS vac_banned,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 97) / 100.0 END AS botness,
  cast(greatest(floor(c_acctbal), 0) AS bigint) * 25 AS lifetime_min, (c_custkey * 37) % 1200 AS active_min,
  CASE WHEN c_custkey % 10 = 0 THEN 'private' ELSE 'ok' END AS items_status FROM {customer}""",
    "items": """SELECT p_partkey AS defindex, p_name AS name, p_size % 3 AS slot_num,
  CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type) >= 2 THEN min(p_partkey) OVER (PARTITION BY p_brand, p_type) END AS reskin_group,
  1 + p_partkey % 7 AS class_a, 1 + (p_partkey * 3) % 7 AS class_b FROM {part}""",
    "slot_overrides": """SELECT DISTINCT p_partkey AS defindex, 2 AS class_num, 1 AS slot_num FROM {part} WHERE p_partkey % 2 = 1""",
    "equipped": """SELECT o_custkey AS steamid, l_linenumber AS class_num, p_size % 3 AS slot_num, l_partkey AS defindex,
  max(CASE WHEN l_returnflag = 'R' THEN 11 ELSE 6 END) AS quality, max(CASE WHEN l_returnflag = 'R' THEN cast(floor(l_extendedprice) AS bigint) % 10000 ELSE 0 END) AS strange_kills
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey GROUP BY o_custkey, l_linenumber, p_size % 3, l_partkey""",
    "class_stats": """SELECT o_custkey AS steamid, l_linenumber AS class_num, cast(sum(l_quantity) AS bigint) * 600 AS playtime_seconds,
  cast(sum(floor(l_extendedprice)) AS bigint) AS damage_dealt, cast(sum(floor(l_extendedprice / 100)) AS bigint) AS kills, cast(sum(floor(l_quantity * 3)) AS bigint) AS points_scored,
  cast(sum(floor(l_discount * 100)) AS bigint) AS dominations, cast(sum(floor(l_tax * 100)) AS bigint) AS captures,
  cast(sum(floor(l_quantity)) AS bigint) AS kill_assists, cast(sum(floor(l_tax * 50)) AS bigint) AS defenses
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey, l_linenumber""",
    "segments": """SELECT cast(floor(event_id / 40) AS bigint) AS segment, cast(floor(event_id / 40) AS bigint) % 5 AS server, concat('map', cast(cast(floor(event_id / 40) AS bigint) % 7 AS varchar(9))) AS map,
  cast(floor(event_id / 40) AS bigint) % 3 AS mode, min(ts) AS started, max(ts) AS ended, count(*) AS observations,
  CASE WHEN cast(floor(event_id / 40) AS bigint) % 4 = 3 THEN 'server_gone' ELSE 'map_change' END AS closed_by FROM {events} GROUP BY cast(floor(event_id / 40) AS bigint)""",
    "participants": """SELECT cast(floor(event_id / 40) AS bigint) AS segment, user_id % 12 AS steamid, min(ts) AS first_seen, max(ts) AS last_seen, cast(floor(min(value)) AS bigint) AS first_score,
  CASE WHEN user_id % 12 = 5 THEN 0 ELSE cast(floor(max(value)) AS bigint) END AS last_score, count(*) AS observations FROM {events} GROUP BY cast(floor(event_id / 40) AS bigint), user_id % 12""",
    "snapshots": """SELECT o_custkey AS steamid, o_orderdate AS taken, l_linenumber AS class_num,
  sum(cast(floor(sum(l_quantity)) AS bigint) * CASE WHEN o_orderkey % 29 = 0 THEN -60 ELSE 60 END) OVER (PARTITION BY o_custkey, l_linenumber ORDER BY o_orderdate, o_orderkey) AS seconds, o_orderkey AS snapshot,
  sum(cast(floor(sum(l_quantity) * 5 + sum(l_extendedprice) / 1000) AS bigint)) OVER (PARTITION BY o_custkey, l_linenumber ORDER BY o_orderdate, o_orderkey) AS points
  FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderdate, l_linenumber, o_orderkey""",
    "friends": """SELECT o_custkey AS a, 1 + (o_custkey * 7 + o_orderkey) % 150 AS b FROM {orders} WHERE o_orderkey % 3 = 0""",
    "usage_days": """SELECT cast(date_trunc('month', l_shipdate) AS date) AS day, l_partkey % 200 AS gid, count(*) AS worn FROM {lineitem} GROUP BY cast(date_trunc('month', l_shipdate) AS date), l_partkey % 200""",
    "kits": """SELECT o_orderkey AS snapshot, cast(c.class_num AS int) AS class_num, k.slot_num, (o_custkey + c.class_num * k.slot_num + CASE WHEN o_orderkey % 8 = c.class_num THEN 1 ELSE 0 END) % 40 AS gid
  FROM {orders} CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) AS c(class_num) CROSS JOIN (VALUES (0), (2), (7)) AS k(slot_num) WHERE o_orderkey % 9 <> 0""",
    "personas": """SELECT p_partkey AS steamid, CASE WHEN p_partkey % 13 <> 0 THEN concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN '  of ' ELSE ' ' END, cast(p_partkey % 40 AS varchar(9))) END AS personaname,
  CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 4 * 30 END AS recent_min FROM {part}""",
    "sighted": """SELECT cast(floor(event_id / 40) AS bigint) AS segment, concat(' ', upper(p_name), '  ', cast(user_id % 40 AS varchar(9))) AS name, min(min(ts)) OVER (PARTITION BY cast(floor(event_id / 40) AS bigint)) AS started,
  cast(floor(min(value)) AS bigint) AS first_score, cast(floor(max(value)) AS bigint) - 20 AS last_score FROM {events} JOIN {part} ON p_partkey = user_id GROUP BY cast(floor(event_id / 40) AS bigint), p_name, user_id % 40""",
    "logged": """SELECT user_id AS steamid, ts AS seen, sum(cast(floor(value) AS bigint) % 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS minutes FROM {events}""",
    "backpack": """SELECT o_custkey AS steamid, l_orderkey * 10 + l_linenumber AS position, l_partkey % 60 AS defindex, 5 + l_linenumber AS quality, cast(floor(l_extendedprice) AS bigint) % 9000 AS kills, l_partkey % 5 = 0 AS renamed,
  l_linenumber + l_orderkey % 4 AS class_num, l_suppkey % 14 AS place FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "waiting": """SELECT o_orderkey AS steamid, CASE o_custkey % 4 WHEN 0 THEN 'seed' WHEN 1 THEN 'recrawl' WHEN 2 THEN 'friend_bfs' ELSE 'other' END AS source, o_orderkey % 5 AS priority, o_orderdate AS queued_at, o_orderkey % 6 AS attempts FROM {orders}""",
    "server_scans": """SELECT date_trunc('hour', ts) AS scanned_at, CASE WHEN user_id % 9 = 8 THEN 255 ELSE user_id % 9 END AS region, CASE user_id % 6 WHEN 0 THEN 'pl_a' WHEN 1 THEN 'plr_b' WHEN 2 THEN 'koth_c' WHEN 3 THEN 'cp_d' WHEN 4 THEN 'ctf_e' ELSE 'trade_f' END AS map,
  user_id % 4 = 0 AS official, count(*) AS players, count(*) % 3 AS bots, count(DISTINCT event_type) AS servers, 24 * count(DISTINCT event_type) AS capacity FROM {events}
  GROUP BY date_trunc('hour', ts), user_id % 9, user_id % 6, user_id % 4 = 0""",
    "handles": """SELECT o_orderkey AS key, CASE WHEN o_orderkey % 31 <> 0 THEN concat(substring(md5(cast(cast(floor(o_orderkey / 2) AS bigint) AS varchar(20))), 1, 7), CASE WHEN o_orderkey % 20 = 0 THEN ' the ' ELSE '_' END, substring(md5(cast(o_custkey AS varchar(20))), 1, 3)) END AS name FROM {orders} WHERE o_orderkey % 8 < 2""",
    "definitions": """SELECT p_partkey AS name, p_name AS title FROM {part}""",
    "builds_on": """SELECT p_partkey AS name, 0 AS position, cast(floor(p_partkey / 2) AS bigint) AS parent FROM {part} WHERE p_partkey > 1
  UNION ALL SELECT p_partkey, 1, cast(floor(p_partkey / 3) AS bigint) FROM {part} WHERE p_partkey > 2 AND p_partkey % 4 <> 1""",
    "defined": """SELECT p_partkey AS name, concat('attributes/', CASE p_size % 6 WHEN 0 THEN 'damage bonus' WHEN 1 THEN 'fire rate' WHEN 2 THEN 'clip size' WHEN 3 THEN 'is marketable' WHEN 4 THEN 'loot rarity' ELSE 'heal rate' END) AS path, cast(p_partkey % 4 AS varchar(9)) AS value FROM {part} WHERE p_partkey % 3 <> 0
  UNION ALL SELECT p_partkey, 'item_slot', CASE p_partkey % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'melee' WHEN 3 THEN 'building' ELSE 'head' END FROM {part} WHERE p_partkey % 2 = 0 OR p_partkey < 9
  UNION ALL SELECT p_partkey, 'item_class', CASE p_size % 4 WHEN 0 THEN 'tf_weapon_builder' WHEN 1 THEN 'tf_weapon_sapper' ELSE p_type END FROM {part} WHERE p_partkey % 5 < 2 OR p_partkey < 9
  UNION ALL SELECT p_partkey, concat('used_by_classes/', CASE p_size % 3 WHEN 0 THEN 'Spy' WHEN 1 THEN 'engineer' ELSE 'pyro' END), CASE p_partkey % 3 WHEN 0 THEN 'melee' ELSE '1' END FROM {part} WHERE p_partkey % 7 < 3
  UNION ALL SELECT p_partkey, 'static_attrs', 'none' FROM {part} WHERE p_partkey % 10 = 0
  UNION ALL SELECT p_partkey, concat('static_attrs/', CASE WHEN p_size % 2 = 0 THEN 'allowed in medieval mode' ELSE 'paintkit_proto_def_index' END), cast(p_size AS varchar(9)) FROM {part} WHERE p_partkey % 7 = 0""",
    "attributed": """SELECT o_custkey AS key, concat('map', cast(o_orderkey % 7 AS varchar(9))) AS map, o_orderdate - INTERVAL '10' DAY AS from_at, o_orderdate + INTERVAL '1' DAY * (o_orderkey % 40 - 9) AS to_at FROM {orders}""",
    "dim_old": """SELECT p_partkey AS defindex, p_name AS name, concat('old ', p_name) AS item_name, CASE WHEN p_size > 20 THEN p_brand END AS image_url, 'melee' AS slot, '1' AS classes, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 9 END AS reskin_group FROM {part} WHERE p_partkey % 3 <> 0""",
    "dim_pages": """SELECT p_partkey AS defindex, concat(p_name, '!') AS name, CASE p_partkey % 4 WHEN 0 THEN concat('#Tok_', cast(p_partkey % 50 AS varchar(9))) WHEN 1 THEN '' WHEN 2 THEN concat('Paint ', cast(p_partkey % 3 AS varchar(9)), ' ', p_name) END AS item_name,
  CASE WHEN p_size > 30 THEN p_type END AS image_url, CASE WHEN p_size % 2 = 0 THEN 'primary' END AS slot, cast(p_size % 9 AS varchar(9)) AS classes FROM {part} WHERE p_partkey % 7 <> 0""",
    "dim_tokens": """SELECT DISTINCT concat('tok_', cast(p_partkey % 40 AS varchar(9))) AS token, concat('The ', cast(p_partkey % 40 AS varchar(9))) AS text FROM {part}""",
    "dim_paints": """SELECT p_partkey AS defindex, concat('Paint ', cast(p_partkey % 3 AS varchar(9))) AS paint FROM {part} WHERE p_partkey % 6 < 3""",
    "queue": """SELECT o_orderkey AS steamid, CASE o_custkey % 4 WHEN 0 THEN 'seed' WHEN 1 THEN 'recrawl' WHEN 2 THEN 'friend_bfs' ELSE 'other' END AS source, o_orderkey % 5 AS priority, o_orderdate AS enqueued_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL '400' DAY END AS locked_until, o_orderkey % 9 AS attempts FROM {orders}""",
    "crawled": """SELECT c_custkey * 5 AS steamid, CASE WHEN c_custkey % 9 = 0 THEN 'private' ELSE 'ok' END AS stats_status, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 37 % 500 END AS active_min,
  cast(greatest(floor(c_acctbal), 0) AS bigint) AS lifetime_min, TIMESTAMP '1998-08-01 00:00:00' - INTERVAL '1' MINUTE * (c_custkey * c_custkey % 60000) AS last_crawled FROM {customer}""",
    "listed": """SELECT date_trunc('hour', ts) AS scanned_at, CASE WHEN user_id % 9 < 8 THEN user_id % 9 END AS region, concat(CASE event_id % 4 WHEN 0 THEN 'PL_a' WHEN 1 THEN 'koth_b' ELSE 'cp_' END, cast(event_id % 5 AS varchar(9))) AS map,
  CASE event_id % 6 WHEN 0 THEN 'valve,alltalk' WHEN 1 THEN 'nocrits,increased_maxplayers' WHEN 2 THEN 'valve' WHEN 3 THEN 'highlander' END AS gametype, user_id % 7 AS players, event_id % 5 AS bots, 24 AS max_players FROM {events}""",
    "claims": """SELECT cast(floor(event_id / 40) AS bigint) AS segment, concat('p', cast(user_id % 50 AS varchar(9))) AS name, min(user_id % 30) AS steamid, cast(max(event_id % 11) AS double) / 10 AS confidence, max(event_id % 2) = 1 AS strong FROM {events} GROUP BY cast(floor(event_id / 40) AS bigint), user_id % 50""",
    "labels_of": """SELECT p_partkey AS defindex, CASE p_partkey % 4 WHEN 0 THEN concat('#TF_Weapon_', p_type, '_', cast(p_size AS varchar(9))) WHEN 1 THEN '' WHEN 2 THEN p_name END AS item_name,
  CASE p_partkey % 7 WHEN 0 THEN concat('TF_WEAPON_', p_type) WHEN 1 THEN concat('Upgradeable TF_WEAPON_', p_type) WHEN 2 THEN 'Gold Botkiller' WHEN 3 THEN concat('Festive ', p_type) WHEN 4 THEN concat('war_', cast(p_size AS varchar(9))) WHEN 5 THEN concat(p_type, ' Australium') END AS name, p_size * 777 AS kills FROM {part}""",
    "timed": """SELECT user_id % 3 AS server, cast(floor(event_id / 200) AS bigint) AS round, TIMESTAMP '1970-01-01 00:00:00' + INTERVAL '6' HOUR * cast(floor(event_id / 200) AS bigint) AS at, concat('m', cast(cast(floor(event_id / 1000) AS bigint) % 4 AS varchar(9))) AS map,
  concat('p', cast(user_id % 25 AS varchar(9))) AS name, max(cast(floor(value) AS bigint)) AS score FROM {events} WHERE cast(floor(event_id / 200) AS bigint) % 7 <> 3 OR user_id % 3 > 0 GROUP BY user_id % 3, cast(floor(event_id / 200) AS bigint), cast(floor(event_id / 1000) AS bigint), user_id % 25""",
    "scores": """SELECT event_id, ts, user_id % 2 AS server, concat('p', cast(user_id AS varchar(20))) AS name, greatest(cast(floor(value) AS bigint), 0) AS score, event_type, user_id, value FROM {events}""",
}


#: Fact tables that many queries read; built from the large base tables once and stored.
STORED = ("equipped", "class_stats", "snapshots")
_stored: dict[tuple, tuple[str, StructType]] = {}
#: Spark's option to remove the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a domain table over base tables. STORED ones are read from where they have been written."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    built = spark.sql(text, **{t: load(spark, sf_dir, t) for t in BASE if f"{{{t}}}" in text})
    if name not in STORED:
        return built
    return kept(spark, sf_dir, name, tuple(t for t in BASE if f"{{{t}}}" in text), lambda: built)


def kept(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], build: Callable[[], DataFrame], *partitions: str) -> DataFrame:
    """What build() gives, written once for each state of the base tables it stands on and read from then on; built each time where there is no shared folder.

    A folder that has gone meanwhile is written anew.
    """
    folder = _folder(spark)
    if not folder:
        return build()
    key = (folder, sf_dir, name, *(_changed(spark, f"{sf_dir}/{t}.parquet") for t in tables))
    if key not in _stored or not _exists(spark, _stored[key][0]):
        rows, path = build(), f"{folder}/facts-{uuid.uuid4().hex}"
        _write(rows, path, *partitions)
        _stored[key] = path, rows.schema
    path, schema = _stored[key]
    return spark.read.schema(schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def shared(spark: SparkSession) -> str:
    """The folder of this application that the driver and all executors see; an error on a cluster that names none."""
    folder = _folder(spark)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    """The shuffle files of the write go when it has ended, not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(*partitions) if partitions else df.write).parquet(path)
    finally:
        conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, which ends its lineage."""
    path = f"{shared(df.sparkSession)}/step-{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders(step: DataFrame) -> list[str]:
    """Where written() wrote a step."""
    return sorted({file.rpartition("/")[0] for file in step.inputFiles()})


def dropped(*steps: DataFrame) -> None:
    """Remove what written() wrote for steps that no table read later stands on."""
    for df in steps:
        jvm = df.sparkSession._jvm
        for folder in folders(df):
            at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(folder))
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def _folder(spark: SparkSession) -> str | None:
    """Where facts are stored: the shared folder of the cluster, a temporary one of a local session, else nowhere."""
    app = spark.sparkContext.applicationId
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return f"{shared.rstrip('/')}/skirmish-{app}"
    if spark.sparkContext.master.startswith("local["):
        return _folders.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-"))
    return None


def _changed(spark: SparkSession, path: str) -> int:
    """When the table was last written, so that facts of older rows aren't read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getModificationTime()


def cte(sql: str) -> str:
    """sql, in DuckDB, with the domain tables it names as common table expressions."""
    needed = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    views = ",\n".join(f"{v} AS ({VIEWS[v].format(**{t: t for t in BASE})})" for v in needed)
    sql = sql.strip()
    return f"WITH {views},\n{sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {views}\n{sql}"
