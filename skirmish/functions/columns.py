"""Column functions: pure expressions, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width and direction marks that names are stripped of.
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{FEFF}]"


def upper_median(x: Column) -> Column:
    """The element at floor(n / 2) of the sorted values, for groups of bounded size; ratings.upper_medians() is for others."""
    s = F.array_sort(F.collect_list(x))
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def normal_name(name: Column) -> Column:
    """Without invisible characters, trimmed, lower case, runs of blanks as one."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, INVISIBLE, ""))), r"\s+", " ")


def trigrams(name: Column) -> Column:
    """The distinct trigrams of the words of a name, each word padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ramp(x: Column, start: float, end: float) -> Column:
    """0 up to start, 1 from end on, straight between."""
    return clamp((x - start) / (end - start), 0.0, 1.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by the polynomial of Abramowitz and Stegun, 26.2.17."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-a * a / 2) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def two_proportions(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """struct<z, p, significant> of the pooled two-sided test; z = 0 and p = 1 where it has no variance."""
    d = lambda c: c.cast("double")
    pooled = F.try_divide(d(x1) + d(x2), d(n1) + d(n2))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), d(n1)) + F.try_divide(F.lit(1.0), d(n2))))
    z = F.when(error > 0, (d(x1) / d(n1) - d(x2) / d(n2)) / error).otherwise(F.lit(0.0))
    p = F.when(z == 0, F.lit(1.0)).otherwise(2 * (1 - normal_cdf(F.abs(z))))
    return F.struct(z.alias("z"), p.alias("p"), (p < 0.05).alias("significant"))


def gamemode(map_name: Column) -> Column:
    """Of a map's prefix; `plr_` is tried before `pl_`."""
    out = F.when(map_name.startswith("plr_"), "other")
    for prefix, mode in (("pl_", "payload"), ("koth_", "koth"), ("ctf_", "ctf"), ("cp_", "cp"), ("mvm_", "mvm"), ("pd_", "pd")):
        out = out.when(map_name.startswith(prefix), mode)
    return out.otherwise("other")


def variant_kind(name: Column) -> Column:
    """What kind of variant an item's name tells, the first that fits; null if none."""
    renamed = name.rlike("^Upgradeable TF_WEAPON_")
    kind = F.when(name.rlike("(?i)^TF_WEAPON_"), "stock").when(renamed, "renamed / strange")
    for pattern, what in (("(?i)botkiller", "botkiller"), ("(?i)^Festive", "festive"), ("(?i)australium", "australium"), ("^[a-z0-9_]+$", "warpaint")):
        kind = kind.when(name.rlike(pattern), what)
    return kind


def display_name(item_name: Column, name: Column, defindex: Column) -> Column:
    """A localised name as it is; else a readable one from the token, the name or the id: prefix off, underscores as blanks, words capitalised."""
    token = F.when(item_name.startswith("#"), F.substring(item_name, 2, 2**31 - 1))
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(token, name, defindex.cast("string")), "(?i)^TF_WEAPON_", ""), "_", " "))
    words = F.array_join(F.transform(F.split(plain, r"(?<=[^A-Za-z0-9])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), "")
    return F.when((item_name != "") & ~item_name.startswith("#"), item_name).otherwise(words)


def account_id(text: Column) -> Column:
    """The 17-digit id of a profile link or alone; else the vanity name of a link, or the text, of word characters; null if nothing is left."""
    asked = F.trim(text)
    number = F.nullif(F.regexp_extract(asked, r"(?:^|/profiles/)(\d{17})(?:/|$)", 1), F.lit(""))
    vanity = F.coalesce(F.nullif(F.regexp_extract(asked, "/id/([^/]+)", 1), F.lit("")), asked)
    return F.coalesce(number, F.nullif(F.regexp_replace(vanity, r"[^A-Za-z0-9_-]", ""), F.lit("")))


def percent_to_top(x: Column, top: int = 8500) -> Column:
    """How far a counter is on the way to the highest tier, 100 at most."""
    return F.least(F.lit(100.0), x / F.lit(float(top)) * 100)


def holds(needle: str, *columns: Column) -> Column:
    """Whether a text is in one of the columns, whatever the case; an empty one is in all rows. Nulls hold nothing."""
    asked = needle.strip().lower()
    found = F.lit(not asked)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(asked)), F.lit(False))
    return found


def snapped(x: Column, buckets: tuple[int, ...]) -> Column:
    """The nearest bucket; the earlier one of two that are as near."""
    return F.array_min(F.array(*(F.struct(F.abs(x - b).alias("d"), F.lit(i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate(buckets))))["b"]


def tier(x: Column, floors: tuple[int, ...]) -> Column:
    """How many of the ascending floors x reaches."""
    return sum(((x >= f).cast("int") for f in floors[1:]), (x >= floors[0]).cast("int"))
