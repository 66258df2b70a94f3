from pyspark.sql import functions as F

from skirmish.functions import columns as c
from skirmish.operators.loadouts import combos, population


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_upper_median_takes_the_upper_middle(spark):
    assert spark.createDataFrame([(float(i),) for i in (4, 1, 3, 2)], "x double").agg(c.upper_median(F.col("x"))).first()[0] == 3.0


def test_names_are_normalised(spark):
    assert one(spark, c.normal_name(F.lit(" \u200bA\u200e  b\tC "))) == "a b c"


def test_degenerate_proportions_are_not_significant(spark):
    t = one(spark, c.two_proportions(F.lit(0), F.lit(0), F.lit(1), F.lit(2)))
    assert (t["z"], t["p"], t["significant"]) == (0.0, 1.0, False)
    assert one(spark, c.two_proportions(F.lit(90), F.lit(100), F.lit(10), F.lit(100)))["significant"]


def test_population_keeps_unknown_bots_and_drops_unknown_bans(spark):
    df = spark.createDataFrame([(1, "a", None, 0.1), (2, "b", False, None), (3, "c", False, 0.9), (4, None, False, 0.0)], "id int, personaname string, vac_banned boolean, botness double")
    assert [r["id"] for r in df.filter(population()).collect()] == [2]


def test_gamemode_prefixes(spark):
    got = [one(spark, c.gamemode(F.lit(m))) for m in ("plr_x", "pl_x", "koth_x", "zz")]
    assert got == ["other", "payload", "koth", "other"]


def test_combos_of_small_and_empty_loadouts(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2],), ([],)], "gids array<bigint>")
    got = {tuple(r["members"]): (r["n"], r["share"]) for r in combos(df, 2).collect()}
    assert got == {(1, 2): (2, 2 / 3)}
