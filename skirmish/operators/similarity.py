"""Similarity join of names: trigram sets of at least a Jaccard similarity, by prefix filter."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import trigrams
from ..sources.tables import written

#: Names of one side that meet in one task for one trigram; a trigram of more is dealt to cells.
CHUNK = 1000
#: Rows of names that are moved to their cells at a time.
AT_ONCE = 1 << 23


def _needed(n: Column, least: float) -> Column:
    """The least number of common trigrams of a set of n with any similar one; a hair below, since least is a rounded number."""
    return F.ceil(F.lit(least) * n - 1e-9).cast("int")


def near_names(left: DataFrame, right: DataFrame, least: float = 0.3, chunk: int = CHUNK, at_once: int = AT_ONCE) -> DataFrame:
    """a, b, similarity: the pairs of distinct names, of the one column of left and of right, whose trigram sets have at least this Jaccard similarity.

    Trigrams are ordered by how many names have them, rare ones first, exactly. Two similar sets share one among the first
    of each: all but the overlap that their size demands, plus one. Only these are joined, between sizes that can be similar and
    at places that leave enough trigrams behind. A pair is kept where the first common trigram of both prefixes is, so it is
    verified once and no distinct is needed. A trigram of many names is dealt to cells of at most `chunk` names of either side.
    Cells are dealt in parts of about `at_once` rows, by a hash of their trigram and place, so that disk holds one part at a time.
    Names without a trigram are similar to nothing. Null names, repeated names: none, and once.
    """

    def number(gram: Column) -> Column:
        """The three code points of a trigram as one number, which compares and travels faster than text."""
        points = [F.ascii(F.substring(gram, i, 1)).cast("long") for i in (1, 2, 3)]
        return (points[0] * 2**42 + points[1] * 2**21 + points[2]).cast("long")

    def sets(df: DataFrame) -> DataFrame:
        named = df.toDF("name").filter("name is not null").distinct().withColumn("grams", F.transform(trigrams(F.col("name")), number))
        return named.filter(F.size("grams") > 0)

    sides = sets(left).withColumn("side", F.lit(0)).unionByName(sets(right).withColumn("side", F.lit(1)))
    each = sides.select("side", "name", F.explode("grams").alias("gram"))
    common = each.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = each.join(common, "gram").groupBy("side", "name").agg(F.array_sort(F.collect_list(F.struct("df", "gram")))["gram"].alias("grams"))
    ordered = ordered.withColumn("n", F.size("grams"))
    ordered = ordered.withColumn("prefix", F.slice("grams", F.lit(1), F.col("n") - _needed(F.col("n"), least) + 1))
    ordered = written(ordered)
    posted = ordered.select("side", "name", "grams", "n", "prefix", F.posexplode("prefix").alias("place", "gram"))
    counts = (F.count_if(F.col("side") == s) for s in (0, 1))
    cells = posted.groupBy("gram").agg(*(n.alias(f"n{s}") for s, n in enumerate(counts)), *(F.ceil(F.count_if(F.col("side") == s) / chunk).cast("int").alias(f"cells{s}") for s in (0, 1))).filter("cells0 > 0 and cells1 > 0")
    cells = written(cells)
    moved = cells.agg(F.sum(F.col("n0").cast("double") * F.col("cells1") + F.col("n1").cast("double") * F.col("cells0"))).first()[0] or 0
    parts = max(1, math.ceil(moved / at_once))
    own = posted.join(cells.drop("n0", "n1"), "gram").withColumn("own", F.pmod(F.xxhash64("name"), F.when(F.col("side") == 0, F.col("cells0")).otherwise(F.col("cells1"))).cast("int"))
    places = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("cells1")).otherwise(F.col("cells0")) - 1)

    def part(number: int) -> DataFrame:
        """The cells of one part, with the names dealt to them."""
        here = lambda met: F.pmod(F.when(F.col("side") == 0, F.xxhash64("gram", "own", met)).otherwise(F.xxhash64("gram", met, "own")), F.lit(parts)) == number
        return own.withColumn("met", F.explode(F.filter(places, here) if parts > 1 else places))

    def side(dealt: DataFrame, number: int, mark: str) -> DataFrame:
        x = dealt.filter(F.col("side") == number)
        first, second = ("own", "met") if number == 0 else ("met", "own")
        return x.select("gram", F.col(first).alias("cell0"), F.col(second).alias("cell1"), *(F.col(c).alias(f"{c}_{mark}") for c in ("name", "grams", "n", "prefix", "place")))

    def similar(dealt: DataFrame) -> DataFrame:
        pairs = side(dealt, 0, "a").join(side(dealt, 1, "b"), ["gram", "cell0", "cell1"])
        na, nb = F.col("n_a"), F.col("n_b")
        enough = F.ceil(F.lit(least) / (1 + least) * (na + nb) - 1e-9)
        pairs = pairs.filter((na >= _needed(nb, least)) & (nb >= _needed(na, least)) & (F.least(na - F.col("place_a"), nb - F.col("place_b")) >= enough))
        pairs = pairs.filter(F.element_at(F.array_intersect("prefix_a", "prefix_b"), 1) == F.col("gram"))
        shared = F.size(F.array_intersect("grams_a", "grams_b"))
        return pairs.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), (shared / (na + nb - shared)).alias("similarity")).filter(F.col("similarity") >= least)

    return similar(part(0)) if parts == 1 else reduce(DataFrame.unionByName, [written(similar(part(i))) for i in range(parts)])
