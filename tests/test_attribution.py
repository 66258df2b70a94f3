import random
from datetime import datetime, timedelta

from skirmish.operators import attribution as at

T = datetime(2024, 1, 1)
h = lambda n: T + timedelta(hours=n)


def profiles(spark, rows):
    return spark.createDataFrame(rows, "steamid long, personaname string, recent_min int")


def logged(spark, rows):
    return spark.createDataFrame(rows, "steamid long, seen timestamp, minutes int")


def test_confidence_of_candidates(spark):
    seen = spark.createDataFrame([(1, " Grey​  Fox ", h(2)), (2, "grey fox", h(9)), (3, " ​ ", h(1)), (4, None, h(1))], "segment int, name string, started timestamp")
    known = profiles(spark, [(10, "Grey Fox", 5), (11, "grey foxes", 0), (12, None, 9), (13, "other", 3)])
    log = logged(spark, [(10, h(1), 5), (10, h(2), 9), (10, h(8), 9), (10, h(10), 9), (11, h(0), 1), (11, h(9), 3)])
    scores = {(r["segment"], r["steamid"]): r for r in at.scored(seen, known, log).collect()}
    assert set(scores) == {(1, 10), (1, 11), (2, 10), (2, 11)}
    assert scores[1, 10]["confidence"] == 1.0 and scores[1, 10]["played"]  # ends count as inside
    assert abs(scores[2, 10]["confidence"] - (0.45 + 0.15 + 0.15 + 0.15)) < 1e-12 and not scores[2, 10]["played"]
    assert scores[2, 11]["played"] and not scores[2, 11]["exact"] and 0.3 <= scores[2, 11]["similarity"] < 1
    frame = at.scored(seen, known, log)
    assert {(r["segment"], r["steamid"], r["strong"]) for r in at.attributions(frame).collect()} == {(1, 10, True), (2, 10, False)}
    assert {(r["segment"], r["steamid"]): r["tier"] for r in at.candidate_tiers(frame).collect()}[1, 10] == "strong"


def test_more_candidates_than_kept_of_one_name(spark):
    seen = spark.createDataFrame([(1, "bob", h(2))], "segment int, name string, started timestamp")
    got = at.scored(seen, profiles(spark, [(i, "Bob", 0) for i in range(120)]), logged(spark, [])).collect()
    assert sorted(r["steamid"] for r in got) == list(range(50))
    assert {round(r["confidence"], 9) for r in got} == {0.5}


def test_sightings_that_one_profile_explains(spark):
    seen = spark.createDataFrame([(1, "bob", h(2), 3, 9), (2, "bob", h(6), 9, 3), (3, "Bob", h(20), 0, 1), (4, "eve", h(2), 0, 1)], "segment int, name string, started timestamp, first_score long, last_score long")
    known = profiles(spark, [(2**60, "BOB", 0), (2**60 + 1, " bob ", 0), (5, None, 0)])
    log = logged(spark, [(2**60, h(0), 1), (2**60, h(4), 2), (2**60, h(6), 3), (2**60 + 1, h(5), 1), (2**60 + 1, h(7), 2), (5, h(0), 0), (5, h(9), 1)])
    got = {r["segment"]: (r["players"], r["steamid"], r["gain"]) for r in at.sightings(seen, known, log).collect()}
    assert got == {1: (1, 2**60, 6), 2: (2, None, 0)}
    empty = seen.limit(0)
    assert at.sightings(empty, known, log).count() == 0 and at.scored(empty, known, log).count() == 0


def test_sure_candidates_are_the_best_of_all(spark):
    rng = random.Random(5)
    words = ["grey fox", "Grey  Fox", "grey foxes", "red fox", "bob", "Bob ", "bobby", "\u200b"]
    seen = spark.createDataFrame([(i // 3, f"{rng.choice(words)}{rng.choice(['', ' 1', ' 2'])}", h(rng.randrange(200)) if i % 40 else None) for i in range(400)], "segment int, name string, started timestamp")
    known = profiles(spark, [(i, rng.choice([*words, None]) and f"{rng.choice(words)}{rng.choice(['', ' 1', ' 2'])}", rng.choice([None, 0, 9])) for i in range(90)])
    log = logged(spark, [(rng.randrange(90), h(rng.randrange(200)), rng.randrange(50)) for _ in range(600)])
    every = at.scored(seen, known, log)
    for least in (0.5, 0.9):
        want = {tuple(r) for r in at.attributions(every, least).collect()}
        assert want and {tuple(r) for r in at.attributions(at.sure(seen, known, log, least, 7200), least).collect()} == want


def test_names_meet_only_candidates_that_play(spark):
    seen = spark.createDataFrame([(i, "bob", h(2)) for i in range(30)], "segment int, name string, started timestamp")
    known = profiles(spark, [(i, "Bob", 5) for i in range(50)])
    found = at.sure(seen, known, logged(spark, [(7, h(0), 1), (7, h(4), 5)]), 0.9)
    assert {(r["steamid"], r["played"]) for r in found.collect()} == {(7, True)} and found.count() == 30
