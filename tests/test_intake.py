from pyspark.sql import functions as F

from skirmish.operators import intake as ta


def test_items_are_read_with_odd_payloads(spark):
    good = '[{"defindex": 5, "quality": 11, "attributes": [{"defindex": 214, "value": 12}], "equipped": [{"class": 1, "slot": 0}, {"class": 2, "slot": 9}]}, {"defindex": 6, "attributes": [{"defindex": 214, "value": "x", "float_value": 3.0}], "custom_name": "n"}]'
    raw = spark.createDataFrame([(1, good), (2, "no json"), (3, None), (4, "[]")], "steamid long, payload string")
    rows = {tuple(r) for r in ta.read_items(raw).collect()}
    assert (1, 0, 5, 11, 12, False, 1, 0) in rows and (1, 0, 5, 11, 12, False, 2, 9) in rows and (1, 1, 6, 6, 3, True, None, None) in rows
    assert {r[0] for r in rows} == {1, 2, 3, 4}


def test_stock_fills_empty_physical_slots(spark):
    items = [(1, 0, 500, 11, 7, False, 9, 4), (1, 1, 501, 6, 0, False, 8, 1), (1, 2, 502, 6, 0, False, 8, 3), (1, 3, 503, 6, 0, False, 1, 9), (1, 4, 500, 6, 1, True, 9, 6), (1, 5, 504, 6, 0, False, 11, 0), (2, None, None, None, None, None, None, None)]
    got = ta.worn_rows(spark.createDataFrame(items, "steamid long, position long, defindex long, quality int, kills long, renamed boolean, class_num int, place int")).collect()
    of = lambda who: {(r["class_num"], r["slot_num"], r["defindex"]) for r in got if r["steamid"] == who}
    one, two = of(1), of(2)
    assert (9, 5, 500) in one and (9, 5, 26) not in one and (9, 5, 28) not in one and (9, 5, 25) in one
    assert (8, 0, 501) in one and not any(c == 8 and s == 3 for c, s, _ in one | two) and (1, 0, 13) in one
    assert {r["kills"] for r in got if r["steamid"] == 1 and r["defindex"] == 500} == {7}
    assert len(two) == sum(i >= 0 for row in ta.STOCK_ITEMS for i in row) - 1  # all but the disguise kit
    assert ta.worn_rows(spark.createDataFrame([], "steamid long, position long, defindex long, quality int, kills long, renamed boolean, class_num int, place int")).count() == 0


def test_class_rows_of_missing_stats(spark):
    stats = spark.createDataFrame([(1, {"Spy.accum.iPlayTime": 60, "Spy.accum.iDamageDealt": 5, "Medic.accum.iDamageDealt": 9}), (2, {}), (3, None)], "steamid long, stats map<string, long>")
    got = ta.class_rows(stats).collect()
    assert [(r["steamid"], r["class_num"], r["playtime_seconds"], r["damage_dealt"], r["kills"]) for r in got] == [(1, 8, 60, 5, 0)]


def test_draws_follow_weights(spark):
    rows = spark.createDataFrame([(1, "a", 0, 1, 0), (2, "b", 0, 1, 0), (3, "b", 5, 2, 0), (4, "c", 9, 0, 3)], "steamid long, source string, priority int, queued_at int, attempts int")
    drawn = [ta.weighted_draw(rows, {"b": 8}, str(i)).first()["steamid"] for i in range(30)]
    assert set(drawn) == {1, 3} and drawn.count(3) > 18
    edges = spark.range(100).select(F.lit(1).alias("a"), F.col("id").alias("b"))
    picked = ta.drawn_friends(edges.union(edges), spark.createDataFrame([(1, 7), (2, 5)], "steamid int, k int"), "s").collect()
    assert len({r["b"] for r in picked}) == len(picked) == 7
