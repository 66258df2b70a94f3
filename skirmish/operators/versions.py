"""Tables replaced as a whole: versioned folders and one pointer, committed last."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTERS = "_pointers"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """The committed versions, (number, folder), in order."""
    fs, at = _fs(spark, f"{root}/{POINTERS}")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((int(n.split("-")[0]), n.split("-", 1)[1]) for n in names if n[0].isdigit())


def replace(df: DataFrame, root: str, partition: str | None = None, check: Callable[[DataFrame], None] | None = None) -> str:
    """Write df as the next version of the table at root, and return its folder.

    The rows go to a folder of their own. Only when they are all there one empty file is made whose name holds the number and
    the folder of the version; nothing that readers use is moved or removed. If two writers take one number, the greater
    folder name is the newer version for all readers. A writer that dies, or a check of what was written that raises,
    leaves a folder that no pointer names.
    """
    spark = df.sparkSession
    name = f"v{uuid.uuid4().hex}"
    (df.write.partitionBy(partition) if partition else df.write).parquet(f"{root}/{name}")
    if check:
        check(spark.read.parquet(f"{root}/{name}"))
    known = _pointers(spark, root)
    fs, at = _fs(spark, f"{root}/{POINTERS}/{(known[-1][0] if known else 0) + 1:012d}-{name}")
    fs.create(at, False).close()
    return name


def current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table at root in its newest version, or in that of a number. A frame keeps the version it was made of."""
    known = dict(_pointers(spark, root))
    if not known:
        raise ValueError(f"{root} has no version yet")
    return spark.read.parquet(f"{root}/{known[version or max(known)]}")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove the versions before the last `keep`, pointer first; returns how many went. For when no reader can be at them any more."""
    old = _pointers(spark, root)[:-keep]
    for number, name in old:
        for path in (f"{root}/{POINTERS}/{number:012d}-{name}", f"{root}/{name}"):
            fs, at = _fs(spark, path)
            fs.delete(at, True)
    return len(old)
