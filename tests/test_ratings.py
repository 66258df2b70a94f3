import random

from skirmish import registry
from skirmish.operators.ratings import upper_medians

SF = "/root/testdata/sf0.001"


def test_item_rates_gathers_no_group_in_one_row(spark):
    plan = registry.queries()["item_rates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_upper_medians_with_ties_and_either_parity(spark):
    rng = random.Random(4)
    values = {g: [rng.choice((rng.uniform(-3, 3), rng.uniform(0, 900), 7.25)) for _ in range(g)] for g in range(1, 41)} | {41: [7.25] * 9 + [7.5] * 9}
    got = upper_medians(spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g int, v double"), "g", "v").collect()
    assert len(got) == len(values) and {r["g"]: r["v"] for r in got} == {g: sorted(vs)[len(vs) // 2] for g, vs in values.items()}
