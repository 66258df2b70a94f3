"""Definitions that build on others: values merged in order, level by level, deep chains by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import dropped, folders, written

#: Ends the key of a definition's own place, so that it comes after all that it builds on.
OWN = 2**31 - 1
#: Levels of definitions that are resolved one after the other; what lies deeper is resolved by pointer jumping.
LEVELS = 32


def reach(names: DataFrame, parents: DataFrame) -> DataFrame:
    """name, base, place: all that a definition builds on, itself included, each once, with its last place in the order of merging.

    names: name. parents: name, position, parent; later positions override earlier ones, and a definition overrides its parents. A
    place is the positions on the way, then OWN; places compare as arrays. Each round joins ways of up to k steps to ways of up
    to 2k, so the rounds grow with the logarithm of the depth. Of several ways to one base only the last counts, so rows are
    pairs, not ways. Parents that aren't defined have no values and no parents. A definition that builds on itself is an error
    (see cycles()).
    """
    step = parents.filter("parent is not null").groupBy("name", F.col("parent").alias("base")).agg(F.max(F.array("position")).alias("way"))
    ways = written(step)
    while True:
        if not ways.filter("name = base").isEmpty():
            raise ValueError("some definitions build on themselves; cycles() tells which")
        longer = ways.select("name", F.col("base").alias("mid"), F.col("way").alias("first")).join(ways.select(F.col("name").alias("mid"), "base", F.col("way").alias("rest")), "mid")
        whole = ways.unionByName(longer.select("name", "base", F.concat("first", "rest").alias("way")))
        ended = F.concat("way", F.array(F.lit(OWN)))
        after = written(whole.groupBy("name", "base").agg(F.max_by("way", ended).alias("way")))
        # Done when no pair is new and no way has become a later one.
        if after.join(ways, ["name", "base", "way"], "left_anti").isEmpty():
            break
        ways = after
    own = names.select("name", F.col("name").alias("base"), F.array(F.lit(OWN)).alias("place")).distinct()
    return ways.select("name", "base", F.concat("way", F.array(F.lit(OWN))).alias("place")).join(names.select("name").distinct(), "name", "left_semi").unionByName(own)


def cycles(parents: DataFrame) -> DataFrame:
    """The definitions on a cycle, each once.

    Pairs (name, base) grow by jumping as in reach(), without places, so cycles end too.
    """
    pairs = written(parents.filter("parent is not null").select("name", F.col("parent").alias("base")).distinct())
    n = pairs.count()
    while True:
        longer = pairs.select("name", F.col("base").alias("mid")).join(pairs.select(F.col("name").alias("mid"), "base"), "mid").select("name", "base")
        pairs = written(pairs.unionByName(longer).distinct())
        now = pairs.count()
        if now == n:
            return pairs.filter("name = base").select("name")
        n = now


def _last(given: DataFrame) -> DataFrame:
    """name, path, place, value: of rows of one name and path the last."""
    return given.groupBy("name", "path").agg(F.max("place").alias("place"), F.max_by("value", "place").alias("value"))


def _merged(names: DataFrame, parents: DataFrame, values: DataFrame, levels: int) -> DataFrame:
    """name, path, place, value: the last value of each path that a definition or anything it builds on gives, and its place in the order of merging."""
    own = written(values.filter("name is not null").select("name", "path", F.array(F.lit(OWN).cast(dict(parents.dtypes)["position"])).alias("place"), "value"))
    edges = written(parents.filter("name is not null and parent is not null").groupBy("name", "parent").agg(F.max("position").alias("position")))
    unknown = written(own.select("name").unionByName(edges.select("name")).join(names, "name", "left_anti").distinct())
    known = [written(_last(own.join(edges, "name", "left_anti")))]
    every = lambda: own.sparkSession.read.schema(known[0].schema).parquet(*(folder for x in known for folder in folders(x)))  # noqa: E731  one scan
    waiting, table = edges, edges
    for _ in range(levels):
        blocked = waiting.join(waiting.select(F.col("name").alias("parent"), F.lit(True).alias("waits")).distinct(), "parent", "left")
        after = written(blocked.withColumn("waits", F.coalesce(F.max("waits").over(W.partitionBy("name")), F.lit(False))))
        dropped(table)
        table, waiting = after, after.filter("waits").drop("waits")
        ready = written(after.filter("not waits").drop("waits"))  # a small table of its own at first, so that nothing large is moved for it
        if ready.isEmpty():  # all are known, or what is left is on a cycle or builds on one
            break
        given = every().withColumnRenamed("name", "parent").join(ready, "parent").select("name", "path", F.concat(F.array("position"), "place").alias("place"), "value")
        known.append(written(_last(given.unionByName(own.join(ready, "name", "left_semi")))))
        dropped(ready)
    if not waiting.isEmpty():
        ways = reach(waiting.select("name"), waiting).select("name", "base", F.slice("place", F.lit(1), F.size("place") - 1).alias("way"))
        given = every().unionByName(own.join(waiting, "name", "left_semi")).withColumnRenamed("name", "base")
        known.append(written(_last(ways.join(given, "base").select("name", "path", F.concat("way", "place").alias("place"), "value"))))
    dropped(table, own)
    return every().join(unknown, "name", "left_anti")


def resolved(names: DataFrame, parents: DataFrame, values: DataFrame, levels: int = LEVELS) -> DataFrame:
    """name, path, value: what each definition holds, its parents' values included.

    values: name, path, value; a path is the keys from the top, joined by `/`, so nested objects merge key by key. Of values of
    one path the last in order counts. A plain value hides what earlier definitions hold below its path, and goes itself
    if a later one holds something below.

    A definition whose parents are known takes the last value of each path from theirs and its own. So rows are those of the result, not
    the pairs of reach(), which takes over below `levels` levels. Only paths of which one is above another are compared.
    """
    last = _merged(names, parents, values, levels)
    keys = F.split("path", "/")
    paths = values.select("path").distinct()
    above = paths.select(F.col("path").alias("below"), keys.alias("keys")).filter(F.size("keys") > 1)
    above = above.select("below", F.explode(F.transform(F.sequence(F.lit(1), F.size("keys") - 1), lambda n: F.array_join(F.slice("keys", F.lit(1), n), "/"))).alias("path"))
    nested = written(above.join(paths, "path", "left_semi"))
    touched = written(nested.select("path").unionByName(nested.select(F.col("below").alias("path"))).distinct())
    compared = last.join(touched, "path", "left_semi")
    below = compared.select("name", F.col("path").alias("below"), F.col("place").alias("at")).join(nested, "below")
    met = below.join(compared.select("name", "path", "place"), ["name", "path"])
    hidden = met.filter("place > at").select("name", F.col("below").alias("path")).unionByName(met.filter("at > place").select("name", "path"))
    shown = compared.join(hidden, ["name", "path"], "left_anti").unionByName(last.join(touched, "path", "left_anti"))
    return shown.select("name", "path", "value")
