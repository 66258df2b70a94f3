from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skirmish.operators import explore, ratings

T = datetime(2024, 1, 1)
NOW = T + timedelta(days=2)


def test_ranks_by_hours_share_ties(spark):
    rows = [(1, "a", False, 0.1, 600), (2, "b", False, None, 9000), (3, "c", False, 0.0, 600), (4, "d", False, 0.0, 30), (5, "e", False, 0.0, None), (6, None, False, 0.0, 99_999), (7, "g", True, 0.0, 99_999), (8, "h", None, 0.0, 99_999), (9, "i", False, 0.9, 99_999)]
    players = spark.createDataFrame(rows, "steamid long, personaname string, vac_banned boolean, botness double, lifetime_min long")
    for width in (1, 100, 4096):
        got = {r["steamid"]: (r["rank"], r["participants"]) for r in explore.hours_ranks(players, width=width).collect()}
        assert got == {2: (1, 4), 1: (2, 4), 3: (2, 4), 4: (4, 4)}
    assert explore.hours_ranks(players.limit(0)).count() == 0


def loads(spark):
    return spark.createDataFrame([(1, 1, [1, 2, 3, 9], 10), (2, 1, [1, 2, 3], 90), (3, 1, [2, 3], 95), (4, 2, [2, 3], 5), (5, 1, [], 50)], "steamid long, class_num int, weapon_gids array<long>, lifetime_min long")


def test_combinations_of_a_class_compared(spark):
    page = explore.combo_page(loads(spark), loads(spark), 2, 1, 0, 60, by_delta=True, exclude=(9,))
    got = {tuple(r["members"]): (r["count_a"], r["count_b"], r["pop_a"], r["pop_b"], round(r["delta"], 6)) for r in page.collect()}
    assert got == {(1, 2): (2, 1, 4, 2, 0.0), (1, 3): (2, 1, 4, 2, 0.0), (2, 3): (3, 2, 4, 2, 0.25)}
    one = explore.combo_page(loads(spark), loads(spark), 4, offset=0, page=50, exclude=(9,)).collect()
    assert [(r["members"], r["count_a"], r["pop_a"], r["next_offset"]) for r in one] == [([1, 2, 3], 2, 5, None)]
    assert [r["next_offset"] for r in explore.combo_page(loads(spark), loads(spark), 2, page=1).collect()] == [1]
    assert explore.combo_page(loads(spark).limit(0), loads(spark).limit(0), 2).count() == 0


def test_performance_counts_players_and_caps(spark):
    stats = spark.createDataFrame([(i, 1, 36_000 if i < 6 else 35_999, 100 * i, i * 10**6 if i == 5 else i) for i in range(1, 8)], "steamid long, class_num int, playtime_seconds long, points_scored long, kills long")
    worn = spark.createDataFrame([(i, 1, 50, [1]) for i in range(1, 8)] + [(1, 1, 50, [2])], "steamid long, class_num int, lifetime_min long, members array<long>")
    got = explore.performance(worn, stats, "points_hr", least_players=5).collect()
    assert [(r["members"], r["value"], r["players"]) for r in got] == [([1], 30.0, 5)]
    assert explore.performance(worn, stats, "kills_hr", least_players=5).count() == 0  # one rate is above the cap
    assert explore.performance(worn, stats, "points_hr", 2).count() == 0


def test_trend_raw_and_hourly(spark):
    m = lambda n: T + timedelta(days=1, hours=23, minutes=n)
    rows = [(m(0), "pl_x", True, 4), (m(0), "pl_y", False, 6), (m(0), "plr_z", False, 1), (m(30), "pl_x", None, 3), (m(30), "koth_a", True, 8), (T - timedelta(days=1), "cp_a", True, 99)]
    frame = spark.createDataFrame(rows, "scanned_at timestamp, map string, official boolean, players long")
    raw = {r["t"]: r for r in explore.server_trend(frame, F.lit(NOW)).collect()}
    assert set(raw) == {m(0), m(30)} and (raw[m(0)]["payload"], raw[m(0)]["other"], raw[m(0)]["cp"], raw[m(0)]["total"], raw[m(0)]["official"]) == (10, 1, 0, 11, 4)
    (hour,) = explore.server_trend(frame, F.lit(NOW), 48).collect()
    assert (hour["payload"], hour["koth"], hour["other"], hour["total"], hour["official"]) == (7, 8, 1, 16, 10)


def test_buckets_of_a_scan(spark):
    rows = [(T, 1, "PL_A", "valve,alltalk", 0, 3, 24), (T, 1, "pl_a", "valve", 9, 3, 24), (T, 1, "x", None, 2, 5, 32), (T, 1, "y", "nocrits", 0, 0, 32), (T, None, "z" * 99, "highlander,increased_maxplayers", 7, 1, 32)]
    got = {(r["region"], r["map"], r["official"]): tuple(r)[5:] for r in explore.scan_buckets(spark.createDataFrame(rows, "scanned_at timestamp, region int, map string, gametype string, players int, bots int, max_players int")).collect()}
    assert got == {(1, "pl_a", True): (2, 6, 6, 48, 1, 0, 0, 0, 0), (1, None, False): (2, 0, 0, 64, 0, 0, 0, 0, 0), (255, "z" * 64, False): (1, 6, 1, 32, 0, 0, 0, 1, 1)}


def test_playerbase_and_names_of_segments(spark):
    scans = spark.createDataFrame([(T - timedelta(days=20), 900), (T, 50), (T + timedelta(days=1), 40)], "scanned_at timestamp, players long")
    assert tuple(explore.playerbase(scans, F.lit(NOW)).first()) == (40, 50) and tuple(explore.playerbase(scans.limit(0), F.lit(NOW)).first()) == (None, None)
    claims = spark.createDataFrame([(1, "a", 7, 0.95, True), (1, "b", 7, 0.5, False), (2, "c", 8, 0.99, True), (3, "d", 7, 1.0, True)], "segment long, name string, steamid long, confidence double, strong boolean")
    players = spark.createDataFrame([(7, "Seven")], "steamid long, personaname string")
    got = explore.attributed_names(claims, players, F.lit('["1", "1", "2", "x"]')).collect()
    assert [(r["segment"], r["name"], r["personaname"]) for r in got] == [(1, "a", "Seven")]
    assert explore.attributed_names(claims, players, F.lit("[]")).count() == 0


def test_boards_in_wide_form(spark):
    stats = spark.createDataFrame([(i, c, 36_000 * i, *([i * c] * 7)) for i in (1, 2, 3) for c in (1, 2)], "steamid long, class_num int, playtime_seconds long, " + ", ".join(f"{m} long" for m in ratings.METRICS))
    players = spark.createDataFrame([(i, "n", False, None) for i in (1, 2, 3)], "steamid long, personaname string, vac_banned boolean, botness double")
    scopes = ratings.scoped(stats, players)
    got = {r["board"]: (r["rank"], r["of"], r["value"]) for r in ratings.player_ranks(scopes, 2).collect()}
    assert got["kills:all:total"] == (2, 3, 6.0) and got["playtime:1:total"] == (2, 3, 72_000.0) and "kills:1:per_hour:50h" not in got and got["kills:2:per_hour:10h"][1] == 3
    boards = ratings.leaderboards(scopes).collect()
    assert {r["board"]: r["participants"] for r in boards}["kills:all:per_hour:50h"] == 1 and {r["participants"] for r in boards if "10h" in r["board"]} == {3}
    assert [r["steamid"] for r in sorted(boards, key=lambda r: r["rank"]) if r["board"] == "kills:all:total"] == [3, 2, 1]
    assert ratings.player_ranks(scopes, 99).count() == 0 and ratings.leaderboards(scopes.limit(0)).count() == 0
    assert ratings.distribution(ratings.board_values(stats, players), "kills:all:total").count() == 0
    with pytest.raises(KeyError):
        explore.performance(stats, stats, "nothing")


@pytest.mark.parametrize("size", [1, 2, 3])
def test_combinations_in_parts_are_those_of_one_pass(spark, size):
    rows = [(i, c, sorted({i % 3, 4 + i % 2, 6 + c, 9, 10 + i % 5}), 10) for i in range(40) for c in (1, 2)] + [(99, 1, [], 10), (98, 1, [4], 10), (0, 3, [4, 6, 10], None)]
    frame = spark.createDataFrame(rows, "steamid long, class_num int, weapon_gids array<long>, lifetime_min long")
    stats = spark.createDataFrame([(i, c, 36_000 + i, 100 * i + c) for i in (*range(40), 98, 99) for c in (1, 2, 3)], "steamid long, class_num int, playtime_seconds long, points_scored long")
    want = [tuple(r) for r in explore.performance(explore.worn_combos(frame, size, (9,)), stats).collect()]
    for at_once in (20, 1 << 26):
        assert [tuple(r) for r in explore.combo_performance(frame, stats, size, (9,), at_once=at_once).collect()] == want
    assert want and explore.combo_performance(frame.limit(0), stats, size).count() == 0
