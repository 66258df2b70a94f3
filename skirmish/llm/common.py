"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of the bitmap of possible(), which is broadcast as rows of 64 bits: 262,144 rows at most.
BITMAP = 1 << 24
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that the cluster names in spark.checkpoint.dir.

    Where none is set, a temporary folder serves a local session; on a cluster it is an error, since machines wouldn't share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/skirmish-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove all tables that cut() wrote, and tries, of this application; for when its results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, **options: str | int) -> DataFrame:
    """Write df to a table in the shared folder, with the writer's options, and read it again.

    This ends the lineage: a lost executor costs its own tasks, not the job so far. The shuffle files of
    the write are removed when it has ended, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def extended(df: DataFrame, columns: str) -> StructType:
    """The schema of df with more columns, given as DDL."""
    return StructType([*df.schema.fields, *StructType.fromDDL(columns).fields])


def possible(marked: DataFrame, key: str, found: DataFrame, doc: str, name: str) -> DataFrame:
    """marked with a boolean column: false only if found has no row of this key."""

    def place(column: str) -> tuple[str, str]:
        slot = f"pmod(`{column}`, {BITMAP})"
        return f"cast({slot} div 64 as int)", f"shiftleft(1L, cast({slot} % 64 as int))"

    word, bit = place(doc)
    bitmap = found.groupBy(F.expr(word).alias(f"{name}word")).agg(F.bit_or(F.expr(bit)).alias(f"{name}bits"))
    word, bit = place(key)
    met = marked.join(F.broadcast(bitmap), F.expr(word) == F.col(f"{name}word"), "left")
    return met.withColumn(name, F.coalesce(F.expr(f"`{name}bits` & {bit}") != 0, F.lit(False))).drop(f"{name}word", f"{name}bits")
