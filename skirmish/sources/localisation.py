"""Text dictionaries of games: files of either encoding, and their tokens, with Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The forms of an entry, and of a paint's name in the definitions file (9 is the kind of paints).
ENTRY = r'"((?:[^"\\]|\\.)*)"[ \t]+"((?:[^"\\]|\\.)*)"'
PAINT = r'"9_(\d+)_field \{ field_number: 2 \}"\s+"([^"\n]+)"'


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-16 of either order by its byte-order mark, else UTF-8 with or without one."""
    head2, head3 = F.hex(F.substring(content, 1, 2)), F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n, 2**31 - 1)
    return F.when(head2 == "FFFE", F.decode(rest(3), "UTF-16LE")).when(head2 == "FEFF", F.decode(rest(3), "UTF-16BE")).when(head3 == "EFBBBF", F.decode(rest(4), "UTF-8")).otherwise(F.decode(content, "UTF-8"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def _pairs(text: Column, pattern: str) -> Column:
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("key"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))


def tokens(files: DataFrame) -> DataFrame:
    """token (lower case), text of every entry `"key" "value"`; of one key in a file the last, over files the last by path.

    files: path, text. Escaped quotes, backslashes, line ends and tabs are unescaped. Sections have no value and aren't entries.
    """
    each = files.select("path", F.posexplode(_pairs(F.col("text"), ENTRY)).alias("place", "pair"))
    plain = F.col("pair.value")
    for mark, sign in ((r"\\n", "\n"), (r"\\t", "\t"), (r'\\"', '"'), (r"\\\\", r"\\")):
        plain = F.regexp_replace(plain, mark, sign)
    rows = each.select(F.lower("pair.key").alias("token"), plain.alias("text"), F.struct("path", "place").alias("at"))
    return rows.groupBy("token").agg(F.max_by("text", "at").alias("text"))


def paints(files: DataFrame) -> DataFrame:
    """paint_id, paint: the names of paints, the last of each id."""
    each = files.select("path", F.posexplode(_pairs(F.col("text"), PAINT)).alias("place", "pair"))
    return each.groupBy(F.col("pair.key").cast("long").alias("paint_id")).agg(F.max_by("pair.value", F.struct("path", "place")).alias("paint"))
