import random
import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish import registry
from skirmish.functions.columns import account_id, display_name, holds, percent_to_top, snapped, trigrams, variant_kind
from skirmish.operators import dimension, matches, observations, percentiles, prefabs, reskins, sinks, social, versions
from skirmish.operators.similarity import near_names
from skirmish.sources import localisation
from skirmish.streaming import increments, live

T = datetime(2024, 1, 1)


def test_percentiles_of_many_shapes(spark):
    rng = np.random.default_rng(4)
    groups = {"one": [7.5], "same": [2.0] * 500, "ties": list(map(float, rng.integers(0, 5, 900))), "heavy": list(np.exp(rng.normal(0, 9, 3000))), "signed": list(-np.exp(rng.normal(0, 5, 2000))) + [0.0, 1e300], "two": [1.0, 2.0]}
    frame = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None), (None, 3.0)], "g string, x double")
    fractions = (0.0, 0.25, 0.5, 0.9, 0.999, 1.0)
    for accuracy in (100, 10_000):  # below and above the groups' sizes
        got = {(r["g"], r["step"]): r["value"] for r in percentiles.percentiles(frame, ["g"], "x", fractions, accuracy).collect()}
        assert set(got) == {(g, i) for g in groups for i in range(6)}
        for g, xs in groups.items():
            for i, f in enumerate(fractions):
                assert got[g, i] == pytest.approx(np.quantile(xs, f), rel=1e-9)
    plan = percentiles.percentiles(frame, ["g"], "x", fractions)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and percentiles.percentiles(frame.limit(0), ["g"], "x", fractions).count() == 0


def grams_of(name):
    words = [w for w in "".join(c if c.isalnum() else " " for c in name.lower()).split()]
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


@pytest.mark.parametrize(("least", "chunk"), [(0.3, 1000), (0.3, 7), (0.75, 50), (1.0, 1000)])
def test_near_names_against_all_pairs(spark, least, chunk):
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "ren", "tor", "x", "the", "vex"]
    names = list({"".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) + rng.choice(["", " the", "_9", "!"]) for _ in range(260)}) + ["", "...", "ÄÖ ü"]
    left, right = names[:170], names[100:]
    frame = lambda x: spark.createDataFrame([(n,) for n in [*x, x[0], None]], "n string")
    got = {(r["a"], r["b"]): r["similarity"] for r in near_names(frame(left), frame(right), least, chunk).collect()}
    want = {}
    for a in left:
        for b in right:
            x, y = grams_of(a), grams_of(b)
            if x and y and len(x & y) / len(x | y) >= least:
                want[a, b] = len(x & y) / len(x | y)
    assert got == pytest.approx(want) and len(want) > 60


def test_near_names_of_many_names(spark):
    """20,000 distinct names; a third end in one word. Rows of the join stay far below the pairs of a trigram."""
    names = spark.range(20_000).selectExpr("concat(substring(md5(cast(id div 2 as string)), 1, 9), case when id % 3 = 0 then ' common' else ' ' end, id % 2) as n")
    assert names.distinct().count() == 20_000
    near = near_names(names, names, 0.6)
    found = near.filter("a <> b").count()
    assert near.filter("a = b and similarity = 1").count() == 20_000
    sample = [r["n"] for r in names.orderBy("n").limit(40).collect()]
    every = [(r["n"], grams_of(r["n"])) for r in names.collect()]
    want = {(a, b) for a in sample for b, y in every if len(grams_of(a) & y) / len(grams_of(a) | y) >= 0.6}
    assert {(r["a"], r["b"]) for r in near.filter(F.col("a").isin(sample)).collect()} == want and found >= 6000


def test_prefabs_of_chains_diamonds_conflicts_and_cycles(spark):
    parents = [("c1", 0, "c0")] + [(f"c{i}", 0, f"c{i - 1}") for i in range(2, 70)] + [("d", 0, "l"), ("d", 1, "r"), ("l", 0, "top"), ("r", 0, "top"), ("x", 0, "missing"), ("e", 0, "r"), ("e", 1, "d"), ("e", 2, None)]
    values = [("c0", "a/b", "old"), ("c0", "a/c", "deep"), ("c40", "a/b", "new"), ("top", "p", "1"), ("top", "q/z", "t"), ("l", "p", "2"), ("r", "q", "plain"), ("d", "q/y", "own"), ("x", "k", "v")]
    names = [(n,) for n in {p[0] for p in parents} | {"c0", "top"}]
    frames = spark.createDataFrame(names, "name string"), spark.createDataFrame(parents, "name string, position int, parent string"), spark.createDataFrame(values, "name string, path string, value string")
    got = {}
    for r in prefabs.resolved(*frames).collect():
        got.setdefault(r["name"], {})[r["path"]] = r["value"]
    assert got["c69"] == {"a/b": "new", "a/c": "deep"} and got["c39"] == {"a/b": "old", "a/c": "deep"}
    assert got["d"] == {"p": "1", "q/y": "own"}  # the right parent, with what it builds on, comes after the left one
    assert got["r"] == {"p": "1", "q": "plain"} and got["e"] == {"p": "1", "q/y": "own"} and got["x"] == {"k": "v"}
    looped = spark.createDataFrame([("a", 0, "b"), ("b", 0, "c"), ("c", 0, "a"), ("in", 0, "a"), ("s", 0, "s")], "name string, position int, parent string")
    assert {r[0] for r in prefabs.cycles(looped).collect()} == {"a", "b", "c", "s"} and prefabs.cycles(frames[1]).count() == 0
    with pytest.raises(ValueError, match="cycles"):
        prefabs.resolved(looped.select("name"), looped, frames[2])
    empty = [f.limit(0) for f in frames]
    assert prefabs.resolved(*empty).count() == 0


def test_reskins_of_each_kind(spark):
    def weapon(i, kind, slot="primary", users=("scout",), attributes=(), statics=()):
        return [(i, "item_class", kind), (i, "item_slot", slot), *((i, f"used_by_classes/{u}", "1") for u in users), *((i, f"attributes/{n}/value", v) for n, v in attributes), *((i, f"static_attrs/{n}", v) for n, v in statics)]

    rows = weapon(13, "TF_WEAPON_SCATTERGUN") + weapon(200, "tf_weapon_scattergun", statics=[("min_viewmodel_offset", "9 0 0")])
    rows += weapon(45, "tf_weapon_scattergun", attributes=[("clip size penalty", "0.34")])  # plays otherwise
    rows += weapon(18, "tf_weapon_rocketlauncher") + weapon(205, "tf_weapon_rocketlauncher") + weapon(513, "tf_weapon_rocketlauncher", attributes=[("centerfire projectile", "1")]) + weapon(441, "tf_weapon_particle_cannon")
    rows += weapon(735, "tf_weapon_builder", "building", ["Spy"]) + weapon(933, "tf_weapon_sapper", "building", ["spy"]) + weapon(25, "tf_weapon_builder", "building", ["engineer"])
    rows += weapon(264, "saxxy", "melee", ["scout", "spy"]) + weapon(1071, "saxxy", "melee", ["scout", "spy", "pyro"], [("Turn To Gold", "1")])
    rows += weapon(526, "tf_weapon_sniperrifle", attributes=[("damage bonus", "1.15")]) + weapon(30665, "tf_weapon_sniperrifle", attributes=[("damage bonus", "1.15"), ("ragdolls become ash", "1")]) + weapon(14, "tf_weapon_sniperrifle")
    rows += weapon(42, "tf_weapon_lunchbox", "secondary") + weapon(863, "tf_weapon_lunchbox", "secondary", attributes=[("lunchbox adds minicrits", "3")]) + weapon(159, "tf_weapon_lunchbox", "secondary", attributes=[("lunchbox adds minicrits", "1")])
    rows += weapon(433, "tf_weapon_lunchbox", "secondary", attributes=[("lunchbox adds minicrits", "7")]) + weapon(311, "tf_weapon_lunchbox", "secondary", attributes=[("lunchbox adds minicrits", "2")])
    rows += weapon(9, "tf_weapon_shotgun", "secondary", ["pyro"]) + weapon(199, "tf_weapon_shotgun", "primary", ["engineer"]) + weapon(99, "hat", "head") + [(98, "item_slot", "melee")]
    values = spark.createDataFrame(rows, "defindex long, path string, value string")
    group = {r["defindex"]: r["reskin_group"] for r in reskins.reskin_groups(reskins.signatures(values)).collect()}
    together = lambda a, b: a in group and group[a] == group.get(b)
    for a, b in ((13, 200), (18, 205), (18, 513), (735, 933), (264, 1071), (526, 30665), (42, 863), (159, 433), (9, 199)):
        assert together(a, b), (a, b)
    for a, b in ((13, 45), (18, 441), (735, 25), (14, 30665), (42, 159), (42, 311)):
        assert not together(a, b), (a, b)
    assert group[513] == 18 and group[863] == 42 and not {99, 98, 45, 441, 25, 311} & set(group)
    chained = {r["defindex"]: r["reskin_group"] for r in reskins.reskin_groups(reskins.signatures(values), {513: 441, 205: 13}).collect()}
    assert {chained[i] for i in (13, 200, 18, 205)} == {13} and {chained[i] for i in (513, 441)} == {441}
    slots = {(r["defindex"], r["class_num"]): r["slot"] for r in reskins.class_slots(spark.createDataFrame([(1, "item_slot", "Secondary"), (1, "used_by_classes/Engineer", "primary"), (1, "used_by_classes/pyro", "1"), (1, "used_by_classes/nobody", "1"), (2, "used_by_classes/spy", "1"), (3, "item_slot", "head"), (3, "used_by_classes/spy", "1")], "defindex long, path string, value string")).collect()}
    assert slots == {(1, 9): 0, (1, 7): 1}
    plain = spark.createDataFrame([(1, 2, 1, 2), (3, 0, 4, 4)], "defindex int, slot_num int, class_a int, class_b int")
    assert sorted(tuple(r) for r in social.capabilities(plain, {(1, 2): 0}).collect()) == [(1, 1, 2), (1, 2, 0), (3, 4, 0)]


def _windows_without_length(spark):
    """Windows 10 (no length, inside a stay), 11 (meets a stay and one without length) and 12 (meets only one without length)."""
    at = lambda s: T + timedelta(seconds=s)
    rows = [(1, w, w - 1, at(a), at(b), [(3, 60)], False) for w, a, b in ((10, 50, 50), (11, 50, 90), (12, 90, 200))]
    windows = spark.createDataFrame(rows, "steamid int, snapshot int, before int, start timestamp, end timestamp, moved array<struct<class_num: int, delta: bigint>>, reset boolean")
    stays = spark.createDataFrame([(1, "m1", at(0), at(80)), (1, "m2", at(60), at(60)), (1, "m3", at(100), at(100))], "key int, map string, from timestamp, to timestamp")
    return matches.full_windows(windows, stays, spark.createDataFrame([(10, 3, 0, 7)], "snapshot int, class_num int, slot_num int, gid int"))


def test_windows_and_stays_without_length_have_no_map(spark):
    assert {r["snapshot"]: r["pure_map"] for r in _windows_without_length(spark).collect()} == {10: None, 11: "m1", 12: None}


def test_time_on_maps_leaves_out_windows_without_length(spark):
    assert [tuple(r) for r in matches.map_class_time(_windows_without_length(spark)).collect()] == [("m1", 3, 60, 1, 1)]


def test_time_on_maps_reads_no_kits_and_makes_windows_once(spark):
    plan = registry.queries()["map_class_time"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "slot_num" not in plan and "lag(" not in plan


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(9)
    at = lambda s: T + timedelta(seconds=s)
    windows, stays = [], []
    for i in range(400):
        a = rng.randrange(0, 4000)
        windows.append((rng.choice(["hot", "hot", "b", "c", None]), i, at(a), at(a + rng.choice([0, 1, 30, 900, -5]))))
    for _ in range(500):
        a = rng.randrange(0, 4000)
        stays.append((rng.choice(["hot", "hot", "b", "d"]), rng.choice(["m1", "m2", "m3"]), at(a), at(a + rng.choice([0, 2, 60, 500, -3]))))
    want = {(k, i, m) for k, i, s, e in windows for k2, m, f, t in stays if k == k2 and s <= e and f <= t and f < e and t > s}
    frames = spark.createDataFrame(windows, "key string, window int, start timestamp, end timestamp"), spark.createDataFrame(stays, "key string, map string, from timestamp, to timestamp")
    for seconds in (None, 7, 100_000):
        got = [tuple(r) for r in matches.overlapping(*frames, seconds).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert matches.overlapping(frames[0].limit(0), frames[1]).count() == 0


def test_durations_need_both_witnesses(spark):
    m = lambda n: T + timedelta(minutes=n)
    rows = [(1, 1, "a", 0, m(0), m(10), 5, "map_change"), (2, 1, "a", 0, m(12), m(30), 5, "score_reset"), (3, 1, "a", 0, m(39), m(50), 5, "score_reset"), (4, 1, "b", 0, m(51), m(60), 5, "server_gone"), (5, 1, "b", 0, m(61), m(70), 5, "map_change"), (6, 1, "b", 0, m(71), m(73), 1, "map_change"), (7, 1, "b", 0, m(74), m(94), 5, "map_change")]
    frame = spark.createDataFrame(rows, "segment int, server int, map string, mode int, started timestamp, ended timestamp, observations int, closed_by string")
    got = {(r["mode"], r["map"]): (r["matches"], r["median"]) for r in matches.match_durations(frame, least=1).collect()}
    assert got == {(0, "a"): (1, 18 * 60.0), (0, "b"): (1, 20 * 60.0), (0, None): (2, 19 * 60.0)}


def test_eta_and_recrawl(spark):
    now = F.lit(T).cast("timestamp")
    h = lambda n: T - timedelta(hours=n)
    queue = spark.createDataFrame([(1, "recrawl", 2, h(5), None), (2, "recrawl", 1, h(9), h(-1)), (3, "recrawl", 1, h(3), None), (4, "seed", 9, h(9), h(1)), (5, "friend_bfs", 9, h(9), h(-2))], "steamid long, source string, priority int, enqueued_at timestamp, locked_until timestamp")
    players = spark.createDataFrame([(i, "ok", i % 2, i, h(i / 10)) for i in range(1, 30)], "steamid long, stats_status string, active_min int, lifetime_min long, last_crawled timestamp")
    row = social.queue_eta(queue, players, 3, now).first()
    assert (row["present"], row["position"], row["per_hour"], row["total_weight"]) == (True, 3, 9, 13) and row["eta_seconds"] == round(3 / (9 * 5 / 13) * 3600)
    assert tuple(social.queue_eta(queue, players, 77, now).first())[:2] == (False, None)
    assert social.queue_eta(queue.limit(0), players, 3, now).first()["eta_seconds"] is None
    more = spark.createDataFrame([(100 + i, "ok", i % 2, i, h(9 + i * 40)) for i in range(20)] + [(1, "ok", 1, 99, h(400)), (200, "private", 1, 9, h(400))], players.schema)
    got = [(r["steamid"], r["priority"]) for r in social.recrawl(more, queue, now, ((2, 8, 3, True), (1, 336, 4, False))).collect()]
    assert {s for s, p in got if p == 2} == {119, 117, 115} and {s for s, p in got if p == 1} == {118, 116} and len(got) == 5


def test_a_reader_during_a_swap_sees_old_or_new(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(ValueError, match="no version"):
        versions.current(spark, root)
    sinks.replace_table(spark.range(1000).withColumn("v", F.lit(0)), "swapped", root)
    seen, errors, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                for frame in (versions.current(spark, root), spark.table("swapped")):
                    seen.append(tuple(frame.agg(F.count("*"), F.min("v"), F.max("v")).first()))
            except Exception as e:  # noqa: BLE001
                errors.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    held = versions.current(spark, root)
    for k in range(1, 5):
        sinks.replace_table(spark.range(1000 * (k + 1)).withColumn("v", F.lit(k)), "swapped", root)
    done.set()
    reader.join()
    assert not errors and seen and all(lo == hi and n == 1000 * (lo + 1) for n, lo, hi in seen)
    assert held.agg(F.max("v")).first()[0] == 0 and versions.current(spark, root, 2).agg(F.max("v")).first()[0] == 1
    assert versions.vacuum(spark, root) == 3 and versions.current(spark, root).count() == 5000 == spark.table("swapped").count()
    spark.sql("DROP VIEW swapped")


def test_a_sweep_loses_nothing_and_can_be_run_again(spark, tmp_path):
    root = str(tmp_path / "queue")
    rows = [(i, "s", i % 7 if i % 11 else None, None if i % 2 else T + timedelta(hours=i % 3 - 1)) for i in range(500)]
    waiting = spark.createDataFrame(rows, "steamid long, source string, attempts int, locked_until timestamp")
    known = spark.createDataFrame([(5,), (6,)], "steamid long")
    condition, errors = sinks.dead_letters(waiting, known, 5, F.lit(T).cast("timestamp"))
    want = {r[0] for r in rows if r[2] is not None and r[2] >= 5 and (r[3] is None or r[3] < T)}
    for _ in range(2):
        assert sinks.swept(waiting, condition, root) == (500 - len(want), len(want))
        assert {r["steamid"] for r in sinks.outcome(spark, root, "dead").collect()} == want and sinks.outcome(spark, root, "kept").count() == 500 - len(want)
    assert sinks.swept(sinks.outcome(spark, root, "kept"), condition, root) == (500 - len(want), 0)
    assert {r["steamid"] for r in errors.collect()} == want - {5, 6} and {r["items_status"] for r in errors.collect()} == {"error"}


def test_a_second_sync_writes_nothing(spark, tmp_path):
    item = "defindex int, name string, item_name string, image_url string, slot string, classes string, reskin_group int"
    old = spark.createDataFrame([(1, "a", "A", "u", "melee", "1", 1), (2, "b", "Red Fox B", None, None, "2", None), (9, "z", "Z", "u", "melee", "1", 4)], item)
    pages = spark.createDataFrame([(1, "a2", "#Tok", None, "primary", "3"), (3, "c", "#none", "w", None, "1"), (4, "d", "", "w", None, "1"), (5, "e", "Plain", None, None, None)], "defindex int, name string, item_name string, image_url string, slot string, classes string")
    tokens = spark.createDataFrame([("tok", "The Axe")], "token string, text string")
    groups = spark.createDataFrame([(3, 1), (77, 1)], "defindex int, reskin_group int")
    paints = spark.createDataFrame([(2, "Red Fox"), (5, "Red Fox"), (4, "Red Fox")], "defindex int, paint string")
    out = dimension.synced(old, pages, tokens, groups, paints)
    got = {r["defindex"]: tuple(r)[1:] for r in out.collect()}
    assert got[1] == ("a2", "The Axe", None, "primary", "3", 1) and got[2][1] == "Red Fox B" and got[3][1::4] == ("#none", 1) and got[4][1] is None and got[5][1] == "Red Fox Plain" and got[9][0] == "z"
    path = str(tmp_path / "dim")
    part = lambda df: df.withColumn("bucket", F.col("defindex") % 4)
    assert dimension.write_changed(part(out), path, "bucket") == 4
    again = dimension.synced(spark.read.parquet(path).drop("bucket").select(*out.columns), pages, tokens, groups, paints)
    assert dimension.write_changed(part(again), path, "bucket") == 0
    moved = part(again).withColumn("name", F.when(F.col("defindex") == 3, "new").otherwise(F.col("name")))
    assert dimension.write_changed(moved, path, "bucket") == 1 and spark.read.parquet(path).filter("name = 'new'").count() == 1 and spark.read.parquet(path).count() == 6


def test_localisation_of_both_encodings(spark, tmp_path):
    body = '"lang"\n{\n"Language" "English"\n"Tokens"\n{\n\t"TF_Axe"\t\t"The \\"Axe\\" é 漢"\n\t"tf_axe"\t\t"Later"\n\t"Two"\t"a\\nb"\n}\n}\n'
    for name, data in (("a.txt", b"\xff\xfe" + body.encode("utf-16-le")), ("b.txt", body.replace("Later", "Last").encode()), ("c.txt", b"\xef\xbb\xbf" + '"bom" "x"'.encode()), ("d.txt", b"\xfe\xff" + '"be" "é"'.encode("utf-16-be")), ("e.txt", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r["token"]: r["text"] for r in localisation.tokens(localisation.texts(spark, str(tmp_path / "*.txt"))).collect()}
    assert got == {"language": "English", "tf_axe": "Last", "two": "a\nb", "bom": "x", "be": "é"}
    first = localisation.texts(spark, str(tmp_path / "a.txt"))
    assert '"The \\"Axe\\" é 漢"' in first.first()["text"]
    paints = spark.createDataFrame([("p", '"9_7_field { field_number: 2 }"  "Killer Bee"\n"9_7_field { field_number: 3 }" "no"\n"8_7_field { field_number: 2 }" "no"')], "path string, text string")
    assert [tuple(r) for r in localisation.paints(paints).collect()] == [(7, "Killer Bee")]


def test_two_increments_equal_one_full_build(spark, tmp_path):
    events = spark.range(3000).selectExpr("cast(id % 7 as string) as kind", "timestamp_seconds(id * 60) as ts", "cast(id % 13 as long) as value")
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    partial = lambda rows: rows.groupBy("kind", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    want = sorted(tuple(r) for r in partial(events).collect())
    stream = lambda: spark.readStream.schema(events.schema).parquet(source)
    compacted = lambda: sorted(tuple(r) for r in increments.compact(spark, root, ["kind", "hour"], ("n",), ("low",), ("high",)).collect())
    events.filter("value < 5").write.parquet(source)
    increments.build(stream(), partial, root)
    assert compacted() != want
    events.filter("value >= 5").write.mode("append").parquet(source)
    increments.build(stream(), partial, root)
    assert compacted() == want and increments.partials(spark, root).select("batch").distinct().count() == 2
    increments.build(stream(), partial, root)  # nothing new
    partial(events.filter("value >= 5")).write.mode("overwrite").parquet(f"{root}/partial/batch=1")  # a batch that is run again
    assert compacted() == want


def test_a_server_that_never_returns_is_closed_by_a_timer(spark, tmp_path):
    rows = []
    for r in range(12):
        for p in range(6):
            for server in (1, 2):
                if server == 2 and r > 4:
                    continue  # gone for good
                if server == 1 and 6 <= r <= 8:
                    continue  # away, and back
                rows.append((server, r, T + timedelta(minutes=10 * r), "b" if server == 1 and r > 2 else "a", f"p{p}", 10 * r))
    schema = "server long, round long, at timestamp, map string, name string, score long"
    source = str(tmp_path / "in")
    batches = [rows[i : i + 9] for i in range(0, len(rows), 9)]  # rounds are split over batches
    late = [(2, 1, T + timedelta(minutes=10), "zzz", "late", 0)]
    end = [(9, 99, T + timedelta(hours=9), "a", "p", 1)], [(9, 100, T + timedelta(hours=9, minutes=1), "a", "p", 2)]
    for k, b in enumerate([*batches, late, *end]):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{source}/{k:03d}")
    stream = live.timed_segments(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source), "15 minutes", 1500)
    query = stream.writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    at = lambda r: int((T + timedelta(minutes=10 * r) - datetime(1970, 1, 1)).total_seconds())
    got = sorted(tuple(r) for r in spark.table("timed").collect())
    twin = observations.timed_segments(spark.createDataFrame(rows, schema), F.lit(T + timedelta(hours=9)), 1500)
    assert sorted(tuple(r) for r in twin.collect()) == got
    assert got == [(1, at(0), at(2), "a", 3, "map_change"), (1, at(3), at(5), "b", 3, "server_gone"), (1, at(9), at(11), "b", 3, "server_gone"), (2, at(0), at(4), "a", 5, "server_gone")]


def test_small_column_functions(spark):
    names = ["TF_WEAPON_X", "Upgradeable TF_WEAPON_X", "Silver Botkiller Axe", "Festive Axe", "Australium Axe", "warpaint_7", "The Axe", None]
    kinds = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(variant_kind(F.col("n"))).collect()]
    assert kinds == ["stock", "renamed / strange", "botkiller", "festive", "australium", "warpaint", None, None]
    shown = spark.createDataFrame([(1, "The Axe", "x"), (2, "#TF_Weapon_grenade_LAUNCHER", "x"), (3, None, "eviction-notice_b"), (4, "", None), (5, None, None)], "d int, i string, n string")
    assert [r[0] for r in shown.orderBy("d").select(display_name(F.col("i"), F.col("n"), F.col("d"))).collect()] == ["The Axe", "Grenade Launcher", "Eviction-Notice B", "4", "5"]
    links = [" 76561198000000001", "https://x/profiles/76561198000000001/", "https://x/id/bob!y/z", "al ice", "!!", "765611980000000012"]
    assert [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i int, x string").orderBy("i").select(account_id(F.col("x"))).collect()] == ["76561198000000001"] * 2 + ["boby", "alice", None, "765611980000000012"]
    got = spark.range(1).select(snapped(F.lit(137), (0, 100, 174, 300)), snapped(F.lit(50), (0, 100)), percent_to_top(F.lit(4250)), percent_to_top(F.lit(99999)), holds(" 42", F.lit(None).cast("string"), F.lit(1423)), holds("", F.lit("a")), holds("b", F.lit("a")), trigrams(F.lit("Ab-b"))).first()
    assert tuple(got)[:7] == (100, 0, 50.0, 100.0, True, True, False) and set(got[7]) == {"  a", " ab", "ab ", "  b", " b "}


def test_levels_and_pointer_jumping_agree(spark):
    parents = spark.createDataFrame([(i, p, i // k) for i in range(2, 60) for p, k in ((0, 2), (1, 3)) if i >= k] + [(100, 0, 7), (100, 0, 8), (101, 2, 100), (101, 1, 9), (200, 0, 300), (300, 0, 5)], "name long, position int, parent long")
    rows = [(i, p, f"{p} {i}") for i in (*range(60), 100, 101, 300) for k, p in enumerate(("a", "a/b", "a/c", "d/e", "d/e/f", "g")) if i % (k + 2) == 0]
    values = spark.createDataFrame(rows, "name long, path string, value string")
    names = spark.createDataFrame([(i,) for i in (*range(60), 100, 101, 200)], "name long")
    found = [sorted(tuple(r) for r in prefabs.resolved(names, parents, values, levels).collect()) for levels in (0, 1, 3, 32)]
    assert found[0] and all(x == found[0] for x in found) and {200} <= {r[0] for r in found[0]} and 300 not in {r[0] for r in found[0]}


@pytest.mark.parametrize("name", ["resolved_definitions", "class_slots", "reskin_groups", "weapon_signatures"])
def test_steps_of_definitions_hold_no_pairs(spark, name, monkeypatch):
    steps = []
    monkeypatch.setattr(prefabs, "written", lambda df, write=prefabs.written: steps.append(n := write(df)) or n)
    monkeypatch.setattr(prefabs, "dropped", lambda *steps: None, raising=False)
    registry.queries()[name](spark, "/root/testdata/sf0.01").count()
    whole = registry.queries()["resolved_definitions"](spark, "/root/testdata/sf0.01").count()
    assert max(x.count() for x in steps) <= whole


def test_signatures_move_the_values_once(spark, capsys):
    values = spark.createDataFrame([(1, "item_class", "a"), (1, "item_slot", "melee")], "defindex long, path string, value string")
    reskins.signatures(values).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_signs_are_made_once_for_all_uses(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(reskins, "written", lambda df, write=reskins.written: steps.append(n := write(df)) or n)
    signs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "defindex long, sign string")
    assert {tuple(r) for r in reskins.reskin_groups(signs, {}).collect()} == {(1, 1), (2, 1)} and steps[0].columns == ["defindex", "sign"]


def test_names_dealt_in_parts_make_the_same_pairs(spark):
    rng = random.Random(3)
    names = spark.createDataFrame([("".join(rng.choice("abc") for _ in range(6)) + rng.choice(["", " x", " the y"]),) for _ in range(300)], "name string")
    want = {tuple(r) for r in near_names(names, names, 0.3).collect()}
    for chunk, at_once in ((1000, 3000), (20, 20_000)):
        found = [tuple(r) for r in near_names(names, names.limit(300), 0.3, chunk, at_once).collect()]
        assert len(found) == len(want) and set(found) == want
