import random
import re
from collections import Counter

from pyspark.sql import functions as F

from skirmish import registry
from skirmish.operators.observations import in_intervals

from .compare import duck, rows

SF = "/root/testdata/sf0.01"


def grams(name):
    return {f"  {w} "[i : i + 3] for w in re.split(r"[\W_]+", name.lower()) if w for i in range(len(w) + 1)}


def test_similar_names_of_the_whole_table(spark):
    """Every pair of keys, those of 300 and more too, against Jaccard by hand; counted by name."""
    keys = Counter(duck("SELECT p_name FROM part", SF)["p_name"])
    want = {}
    for a in keys:
        for b in keys:
            x, y = grams(a), grams(b)
            if len(x & y) >= 0.3 * len(x | y):
                want[a, b] = (keys[a] * keys[b], round(len(x & y) / len(x | y), 9))
    members = registry.queries()["name_classes"](spark, SF)
    assert members.count() == sum(keys.values())
    got = registry.queries()["similar_names"](spark, SF)
    rows_of = got.select("left_key", "right_key", "left_rows", "right_rows").collect()
    assert len(rows_of) == len(want)
    for side, n in (("left_key", "a"), ("right_key", "b")):
        got = got.join(members.select(F.col("class_key").alias(side), F.col("key").alias(f"{n}_member"), F.col("name").alias(n)), side)
    found = got.groupBy("a", "b", "left_rows", "right_rows").agg(F.count("*").alias("n"), F.count_distinct("a_member", "b_member").alias("pairs"), F.max("similarity").alias("s")).collect()
    assert {(r["a"], r["b"]): (r["n"], round(r["s"], 9)) for r in found} == want
    assert all(r["n"] == r["pairs"] == r["left_rows"] * r["right_rows"] for r in found)


def test_in_intervals_counts_the_intervals_of_all_events(spark):
    want = duck('WITH p AS (SELECT DISTINCT user_id AS key, ts AS "at" FROM events) SELECT p.key, p."at", count(*) AS n FROM p JOIN events e ON e.user_id = p.key AND e.ts <= p."at" AND p."at" < e.ts + INTERVAL 30 HOUR GROUP BY 1, 2', SF)
    assert rows(registry.queries()["in_intervals"](spark, SF).toPandas()) == rows(want)


def test_in_intervals_of_odd_rows_and_a_crowded_key(spark):
    """Half-open, empty, reversed, long and repeated intervals, missing keys and times; bins of 10 seconds."""
    rng = random.Random(3)
    points = [(k, rng.choice([None, *range(-50, 200)])) for k in (1, 1, 1, 1, 2, 3, None) for _ in range(60)]
    intervals = [(k, rng.randrange(-60, 200), rng.choice([None, *range(-60, 200)])) for k in (1, 1, 1, 1, 1, 2, None) for _ in range(80)] + [(2, None, 5), (2, 5, 5)]
    want = {(k, t): sum(k == i and None not in (k, t, s, e) and s <= t < e for i, s, e in intervals) for k, t in points}
    at = lambda c: F.timestamp_seconds(c).alias(c)
    p = spark.createDataFrame(points, "key int, at long").select("key", at("at"))
    i = spark.createDataFrame(intervals, "key int, start long, end long").select("key", at("start"), at("end"))
    got = in_intervals(p, i, 10).select("key", F.unix_timestamp("at").alias("at"), "n").collect()
    assert len(got) == len(want) and {(r["key"], r["at"]): r["n"] for r in got} == want
