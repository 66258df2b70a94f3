from pyspark.sql import functions as F

from skirmish.operators import observations as ob
from skirmish.operators.sinks import daily_snapshot, rejected
from skirmish.plans.catalog import _observed
from skirmish.streaming import live

SF = "/root/testdata/sf0.001"


def drained(stream, mode):
    query = stream.writeStream.format("memory").queryName(name := f"out_{mode}").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_counters_equal_their_batch_twin(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = live.hourly_counters(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in")), "60 days")
    got = {tuple(r) for r in drained(stream, "complete").collect()}
    want = ob.outcome_rates(events).select("endpoint", "hour", "calls", "failed")
    assert got == {tuple(r) for r in want.collect()}


def test_segments_equal_their_batch_twin(spark, tmp_path):
    scores = _observed(spark, SF).select("server", "round", "map", "name", "score")
    half = scores.agg(F.expr("percentile(round, 0.5)")).first()[0]
    scores.filter(F.col("round") <= half).coalesce(1).write.parquet(str(tmp_path / "in"))
    scores.filter(F.col("round") > half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.segments(spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    got = sorted(tuple(r) for r in drained(stream, "append").collect())
    want = sorted(tuple(r) for r in ob.closed_segments(scores).collect())
    assert len(want) > 5 and {r[5] for r in want} >= {"map_change"} and got == want


def test_rejected_rows_and_daily_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2024-01-01"), ("x", "2024-01-01"), (None, "2024-01-02")], "n string, day string")
    good, bad = rejected(rows, {"n": "int"})
    assert sorted((r["n"] for r in good.collect()), key=str) == [1, None] and [r["n"] for r in bad.collect()] == ["x"]
    path = str(tmp_path / "days")
    daily_snapshot(good, path)
    daily_snapshot(spark.createDataFrame([(7, "2024-01-02")], "n int, day string"), path)
    assert {(r["n"], str(r["day"])) for r in spark.read.parquet(path).collect()} == {(1, "2024-01-01"), (7, "2024-01-02")}
