"""The item dimension: synced in ordered passes, with what changed, and written where it did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM_COLUMNS = ("name", "item_name", "image_url", "slot", "classes")


def upserted(dimension: DataFrame, pages: DataFrame, keys: str = "defindex") -> DataFrame:
    """First pass. dimension with the rows of pages; a page's value takes the old one's place, null included, in all columns that pages has."""
    old = dimension.withColumnsRenamed({c: f"old_{c}" for c in dimension.columns if c != keys}).withColumn("was", F.lit(True))
    met = old.join(pages.withColumn("now", F.lit(True)), keys, "full")
    pick = [F.when(F.col("now"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) if c in pages.columns else F.col(f"old_{c}").alias(c) for c in dimension.columns if c != keys]
    return met.select(keys, *pick)


def updated(dimension: DataFrame, changes: DataFrame, key: str, column: str, value: Column, only: Column | None = None) -> DataFrame:
    """dimension with a column set to value, where changes has a row of the key and `only` holds; other rows stay. changes has each key once."""
    met = dimension.join(changes.withColumn("_met", F.lit(True)), key, "left")
    hit = F.col("_met") & only if only is not None else F.col("_met")
    return met.withColumn(column, F.when(F.coalesce(hit, F.lit(False)), value).otherwise(F.col(column))).select(*dimension.columns)


def localised(name: Column, tokens: Column) -> Column:
    """The text of a token `#key`, from the column of its look-up; the name itself if it has none; null for null and empty names."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(None)).when(name.startswith("#"), F.coalesce(tokens, name)).otherwise(name)


def synced(dimension: DataFrame, pages: DataFrame, tokens: DataFrame, groups: DataFrame, paints: DataFrame) -> DataFrame:
    """dimension (defindex, name, item_name, image_url, slot, classes, reskin_group) after the passes over the rows, in order.

    pages: defindex, name, item_name (maybe `#token`), image_url, slot, classes: upsert with localised names. tokens: token (lower
    case), text. groups: defindex, reskin_group: update where there is one. paints: defindex, paint: prefix of the
    item's name, unless it has it already. The fourth pass, the bridge of slots, is reskins.class_slots(), made anew.
    """
    named = pages.withColumn("token", F.when(F.col("item_name").startswith("#"), F.lower(F.expr("substring(item_name, 2)"))))
    named = named.join(tokens, "token", "left").withColumn("item_name", localised(F.col("item_name"), F.col("text"))).select(*pages.columns)
    out = upserted(dimension, named)
    out = updated(out, groups.withColumnRenamed("reskin_group", "new_group"), "defindex", "reskin_group", F.col("new_group"))
    has = F.startswith(F.col("item_name"), F.concat(F.col("paint"), F.lit(" ")))
    return updated(out, paints, "defindex", "item_name", F.concat_ws(" ", "paint", "item_name"), only=~has)


def changed_partitions(before: DataFrame, after: DataFrame, partition: str) -> DataFrame:
    """The partitions whose rows differ, as multisets, with rows before and after."""

    def sums(df: DataFrame, mark: str) -> DataFrame:
        row = F.xxhash64(*(F.col(c) for c in sorted(before.columns)))
        again = F.xxhash64(F.lit(7), *(F.col(c) for c in sorted(before.columns)))
        return df.groupBy(partition).agg(F.count("*").alias(f"rows_{mark}"), F.sum(row.cast("decimal(38,0)")).alias(f"x_{mark}"), F.sum(again.cast("decimal(38,0)")).alias(f"y_{mark}"))

    met = sums(before, "before").join(sums(after, "after"), partition, "full")
    same = F.col("rows_before").eqNullSafe(F.col("rows_after")) & F.col("x_before").eqNullSafe(F.col("x_after")) & F.col("y_before").eqNullSafe(F.col("y_after"))
    return met.filter(~same).select(partition, F.coalesce("rows_before", F.lit(0)).alias("rows_before"), F.coalesce("rows_after", F.lit(0)).alias("rows_after"))


def write_changed(after: DataFrame, path: str, partition: str) -> int:
    """Bring the partitioned table at path to after; only partitions that differ are written. Returns how many; a rerun writes none.

    Rows without a counterpart only vanish where their partition still has others: dimensions never lose their items.
    """
    spark = after.sparkSession
    try:
        before = spark.read.parquet(path).select(*after.columns)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        after.repartition(partition).write.partitionBy(partition).parquet(path)
        return after.select(partition).distinct().count()
    # The list of partitions is small: a bounded number of buckets.
    todo = changed_partitions(before.withColumn(partition, F.col(partition).cast(after.schema[partition].dataType)), after, partition).filter("rows_after > 0").select(partition)
    found = [r[0] for r in todo.collect()]
    if found:
        rows = after.filter(F.col(partition).isin(found)).repartition(partition)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return len(found)
