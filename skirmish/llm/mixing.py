"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Tokens are counted by cell (source, language, topic). Raking scales the cells in turn until the
marginals of source, language and topic are the targets. No cell may take more than its tokens: after
each step cells are held at that bound, so that the steps that follow move the surplus to others of the same
marginals. Documents of a cell are drawn with the probability of its raked tokens by its tokens, at a
total of the budget, or as near as the bounds allow. A document is drawn by a hash of its id and a
seed, so a rerun draws the same.

Up to MAX_CELLS cells are raked in numpy on the driver (their number depends on the categories, not
on the documents); more are raked by the same steps on DataFrames.

Defined results: a null category is the empty one; null and empty texts have no tokens; a null id is
drawn as the empty id; rows of one id are drawn alike; an empty table gives an empty result; targets
of categories that don't occur are left out and the rest scaled to one; without a target a marginal
aims at its natural shares to the power `temper`; `mixed()` returns all columns of its input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_CELLS = 100_000
DIMS = ("source", "lang", "topic")
BLANK = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    #: dimension -> {category: share}; dimensions without an entry are tempered.
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    temper: dict[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 1.0})
    budget: float = 0.6
    rounds: int = 30
    seed: int = 17


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic by form: short, table (many bars), marked (many symbols), prose."""
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return F.when(tokens < 40, "short").when(count("|") * 10 > tokens, "table").when(count("#*$%&") * 3 > tokens, "marked").otherwise("prose")


def _uniform(id: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _cells(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.withColumn(f"{prefix}tokens", F.regexp_count(value, F.lit(BLANK)).cast("long"))
    out = out.withColumn(f"{prefix}topic", topic_of(value, F.col(f"{prefix}tokens")))
    for d in DIMS[:2]:
        out = out.withColumn(f"{prefix}{d}", F.coalesce(F.col(f"`{d}`").cast("string"), F.lit("")))
    return out


def _shares(natural: dict[str, float], target: dict[str, float] | None, temper: float) -> dict[str, float]:
    raw = {k: target.get(k, 0.0) if target else v**temper if v > 0 else 0.0 for k, v in natural.items()}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total > 0 else natural


def _sides(cells: dict[tuple[str, ...], float], mix: Mix) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """By dimension: its categories, the place of each cell (in order) among them, and the shares to reach."""
    keys = sorted(cells)
    t = np.array([cells[k] for k in keys], float)
    out = []
    for i, d in enumerate(DIMS):
        names = sorted({k[i] for k in keys})
        place = {n: j for j, n in enumerate(names)}
        code = np.array([place[k[i]] for k in keys])
        shares = _shares(dict(zip(names, np.bincount(code, t, len(names)) / t.sum())), mix.targets.get(d), mix.temper.get(d, 1.0))
        out.append((names, code, np.array([shares[n] for n in names])))
    return out


def rake(cells: dict[tuple[str, ...], float], mix: Mix) -> dict[tuple[str, ...], float]:
    """Cell -> probability. cells: tokens by cell."""
    keys = sorted(cells)
    t = np.array([cells[k] for k in keys], float)
    if not t.sum():
        return dict.fromkeys(keys, min(1.0, mix.budget))
    x = t * mix.budget
    sides = _sides(cells, mix)
    for _ in range(mix.rounds):
        for _, code, shares in sides:
            target = shares * t.sum() * mix.budget
            now = np.bincount(code, x, len(target))
            x = np.minimum(x * np.divide(target, now, out=np.zeros_like(target), where=now > 0)[code], t)
    return dict(zip(keys, np.divide(x, t, out=np.zeros_like(x), where=t > 0)))


def marginals(cells: dict[tuple[str, ...], float], chances: dict[tuple[str, ...], float], mix: Mix) -> dict[tuple[str, str], tuple[float, float]]:
    """(dimension, category) -> (share wanted, share reached) of the tokens drawn."""
    kept = np.array([cells[k] * chances[k] for k in sorted(cells)])
    out = {}
    for d, (names, code, shares) in zip(DIMS, _sides(cells, mix)):
        reached = np.bincount(code, kept, len(names)) / max(kept.sum(), 1e-300)
        out |= {(d, n): (float(a), float(b)) for n, a, b in zip(names, shares, reached)}
    return out


def rake_frame(cells: DataFrame, mix: Mix) -> DataFrame:
    """rake() for any number of cells. cells: DIMS, t. Returns DIMS, t, p."""
    x = cells.withColumn("x", F.col("t").cast("double") * mix.budget)
    total = cells.agg(F.sum("t")).first()[0] or 0
    wants = {}
    for d in DIMS:
        natural = cells.groupBy(d).agg((F.sum("t") / F.lit(float(total or 1))).alias("share"))
        if target := mix.targets.get(d):
            table = F.create_map(*(F.lit(v) for kv in target.items() for v in kv))
            raw = F.coalesce(F.try_element_at(table, F.col(d)), F.lit(0.0))
        else:
            raw = F.when(F.col("share") > 0, F.pow("share", F.lit(mix.temper.get(d, 1.0)))).otherwise(0.0)
        raw = cut(natural.select(d, raw.alias("raw")))
        wants[d] = cut(raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("s")))).select(d, (F.col("raw") / F.col("s") * float(total) * mix.budget).alias("want")))
    for _ in range(mix.rounds):
        for d in DIMS:
            now = x.groupBy(d).agg(F.sum("x").alias("now"))
            scale = now.join(wants[d], d).select(d, F.coalesce(F.try_divide("want", "now"), F.lit(0.0)).alias("scale"))
            x = x.join(scale, d).withColumn("x", F.least(F.col("x") * F.col("scale"), F.col("t").cast("double"))).drop("scale")
        x = cut(x)
    return x.select(*DIMS, "t", F.coalesce(F.try_divide("x", F.col("t").cast("double")), F.lit(0.0 if total else min(1.0, mix.budget))).alias("p"))


def _probabilities(docs: DataFrame, mix: Mix, text: str, prefix: str, max_cells: int) -> DataFrame:
    tagged = _cells(docs, text, prefix)
    cells = cut(tagged.groupBy(*(F.col(f"{prefix}{d}").alias(d) for d in DIMS)).agg(F.sum(f"{prefix}tokens").alias("t")))
    if cells.count() <= max_cells:
        tokens = {tuple(r[d] for d in DIMS): float(r["t"]) for r in cells.toLocalIterator()}
        rows = [(*k, float(p)) for k, p in rake(tokens, mix).items()]
        table = F.broadcast(docs.sparkSession.createDataFrame(rows, ", ".join(f"{d} string" for d in DIMS) + ", p double"))  # at most max_cells rows
    else:
        table = rake_frame(cells, mix).select(*DIMS, "p")
    named = table.select(*(F.col(d).alias(f"{prefix}{d}_") for d in DIMS), F.col("p").alias(f"{prefix}p"))
    on = [F.col(f"{prefix}{d}") == F.col(f"{prefix}{d}_") for d in DIMS]
    return tagged.join(named, on).drop(*(f"{prefix}{d}_" for d in DIMS))


def mix_weights(docs: DataFrame, mix: Mix = Mix(), id: str = "doc_id", text: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per input row: id, n_tokens, topic, probability, kept."""
    slim = docs.select(F.col(id).alias(id), F.col(text).alias(text), *(F.col(d).alias(d) for d in DIMS[:2]))
    out = _probabilities(slim, mix, text, "_", max_cells)
    return out.select(id, F.col("_tokens").alias("n_tokens"), F.col("_topic").alias("topic"), F.col("_p").alias("probability"), (_uniform(F.col(id), mix.seed) < F.col("_p")).alias("kept"))


def mixed(docs: DataFrame, mix: Mix = Mix(), id: str = "doc_id", text: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """The drawn rows of docs with all their columns."""
    prefix = "_mixing_"
    out = _probabilities(docs, mix, text, prefix, max_cells)
    return out.filter(_uniform(F.col(f"`{id}`"), mix.seed) < F.col(f"{prefix}p")).select(*(F.col(f"`{c}`") for c in docs.columns))


def sql(docs: str = "documents", mix: Mix = Mix()) -> str:
    """DuckDB SQL for mix_weights() with tempered marginals; the rounds are written out."""
    count = lambda chars: f"(length(text) - length(translate(text, '{chars}', '')))"
    parts = [
        f"d0 AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM {docs})",
        "d1 AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM d0)",
        f"d2 AS (SELECT doc_id, source, lang, n, CASE WHEN n < 40 THEN 'short' WHEN {count('|')} * 10 > n THEN 'table' WHEN {count('#*$%&')} * 3 > n THEN 'marked' ELSE 'prose' END AS topic FROM d1)",
        f"x0 AS MATERIALIZED (SELECT source, lang, topic, sum(n)::DOUBLE AS t, sum(n)::DOUBLE * {mix.budget} AS x FROM d2 GROUP BY ALL)",
    ]
    for d in DIMS:
        parts.append(f"w_{d} AS MATERIALIZED (SELECT {d}, CASE WHEN s > 0 THEN pow(s, {mix.temper[d]}) ELSE 0 END / sum(CASE WHEN s > 0 THEN pow(s, {mix.temper[d]}) ELSE 0 END) OVER () * a * {mix.budget} AS want FROM (SELECT {d}, sum(t) / any_value(a) AS s, any_value(a) AS a FROM x0, (SELECT sum(t) AS a FROM x0) GROUP BY {d}))")
    k = 0
    for _ in range(mix.rounds):
        for d in DIMS:
            parts.append(f"x{k + 1} AS MATERIALIZED (SELECT source, lang, topic, t, least(CASE WHEN s > 0 THEN x * want / s ELSE 0 END, t) AS x FROM (SELECT *, sum(x) OVER (PARTITION BY {d}) AS s FROM x{k}) JOIN w_{d} USING ({d}))")
            k += 1
    parts.append(f"p AS (SELECT source, lang, topic, CASE WHEN t > 0 THEN x / t ELSE 0.0 END AS p FROM x{k})")
    uniform = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{mix.seed}'), 1, 13))::BIGINT::DOUBLE / {16**13}.0"
    return f"WITH {', '.join(parts)}\nSELECT doc_id, n AS n_tokens, topic, round(p, 6) AS probability, {uniform} < p AS kept FROM d2 JOIN p USING (source, lang, topic)"
