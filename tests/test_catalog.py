import pytest
from pyspark.sql import functions as F

from skirmish import registry
from skirmish.operators import attribution

from .compare import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck(registry.oracle_sql()[name], SF))


def test_some_items_have_a_slot_of_their_own_for_a_class(spark):
    slots = registry.queries()["capabilities"](spark, SF).groupBy("defindex").agg(F.collect_set("slot_num").alias("slots"), F.count("*").alias("n")).collect()
    assert any(len(r["slots"]) > 1 for r in slots) and all(len(r["slots"]) <= r["n"] for r in slots)


def test_places_in_a_slot_are_the_classes_that_have_it_there(spark):
    slots = registry.queries()["capabilities"](spark, SF)
    there = {(r["defindex"], r["slot_num"]): r["n"] for r in slots.groupBy("defindex", "slot_num").agg(F.count("*").alias("n")).collect()}
    classes = {r["defindex"]: r["n"] for r in slots.groupBy("defindex").agg(F.count("*").alias("n")).collect()}
    cube = registry.queries()["usage_cube"](spark, SF).filter("NOT merged AND hours = 0 AND active = 0 AND class_num = -1 AND slot_num <> -1").collect()
    places = {(r["item"], r["slot_num"]): round(r["worn"] / r["sample"] / r["usage"]) for r in cube}
    assert all(n == there.get(k, classes[k[0]]) for k, n in places.items()) and any(n < classes[k[0]] for k, n in places.items())


@pytest.mark.parametrize("name", ["attributions", "map_regulars", "regulars_weapons"])
def test_names_are_not_paired_with_all_candidates(spark, name, monkeypatch):
    monkeypatch.setattr(attribution, "scored", None)
    assert registry.queries()[name](spark, SF).columns
