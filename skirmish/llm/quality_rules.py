"""Quality rules with host-level verdicts.

Each text is measured once; documents that break a base rule fail by themselves. The failures are
also counted by host (the `source` column), the hosts' rates are shrunk with a beta prior fitted
to all hosts, and hosts whose shrunk rate is above a limit are rejected with all their documents.

Defined results: null or empty text has no words and fails; a null host is a host of its own;
repeated rows are judged each, and each counts for its host; an empty table gives an empty result;
columns other than the id, text and host columns are never read, and `passed()` returns all columns
of its input under their names, whatever these are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut, extended

SYMBOLS = tv.byte_set(b"#*$%&|<>")
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: A host goes if its shrunk rate of failing documents is above this.
    max_host_rate: float = 0.8


def measure(column: pa.Array) -> np.ndarray:
    """The MEASURES of each text, one column each."""
    out = np.zeros((len(column), len(MEASURES)), np.int64)
    for row, data, starts in tv.chunks(column):
        n = len(starts) - 1
        part = out[row : row + n]
        begins, ends, rows = tv.tokens(data, starts, tv.BLANKS)
        part[:, 0] = np.bincount(rows, minlength=n)
        part[:, 1] = tv.per_row(~tv.BLANKS[data] & ((data & 0xC0) != 0x80), starts)
        part[:, 2] = tv.per_row(SYMBOLS[data], starts)
        part[:, 3] = _repeated_lines(data, starts, begins, n)
        part[:, 4] = _words_in_repeats(tv.span_hashes(data, begins, ends), rows, n)
    return out


def _in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that are equal only inside one row."""
    return tv.mix(hashes + rows.astype(tv.U64) * tv.U64(0xE7037ED1A0B428DB))


def _repeated_lines(data: np.ndarray, starts: np.ndarray, word_begins: np.ndarray, n: int) -> np.ndarray:
    begins, ends, rows = tv.tokens(data, starts, tv.NEWLINE)
    worded = np.searchsorted(word_begins, ends) > np.searchsorted(word_begins, begins)
    begins, ends, rows = begins[worded], ends[worded], rows[worded]
    _, first = np.unique(_in_row(tv.span_hashes(data, begins, ends), rows), return_index=True)
    return np.bincount(rows, minlength=n) - np.bincount(rows[first], minlength=n)


def _words_in_repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    found, first = tv.windows(hashes, rows, WINDOW)
    if not len(found):
        return np.zeros(n, np.int64)
    _, which, count = np.unique(_in_row(found, rows[first]), return_inverse=True, return_counts=True)
    at = first[count[which] > 1]
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return np.bincount(rows[np.cumsum(edges[:-1]) > 0], minlength=n)


def _measured(docs: DataFrame, text: str, prefix: str) -> DataFrame:
    """docs with the measures as columns named prefix + measure."""
    at = docs.columns.index(text)
    names = [*docs.columns, *(prefix + m for m in MEASURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = measure(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(values[:, i]) for i in range(len(MEASURES)))], names=names)

    return docs.mapInArrow(run, extended(docs, ", ".join(f"`{prefix}{m}` bigint" for m in MEASURES)))


def _fails(limits: Limits, prefix: str = ""):
    n, repeat = F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")
    return (n < limits.min_words) | (100 * repeat > limits.max_repeat_percent * n)


def host_rates(judged: DataFrame) -> DataFrame:
    """judged: (host, failed). Returns host, n, failures, rate: the posterior mean under a beta prior.

    The prior has the mean of all documents; its strength comes from the spread of the hosts' rates
    (method of moments, weighted by size). Without spread beyond chance every host gets the mean.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("failures"))
    n, k = F.col("n").cast("double"), F.col("failures").cast("double")
    total = hosts.agg(F.sum(n).alias("t"), F.sum(k).alias("f"), F.count("*").alias("h"), F.sum(k * k / n).alias("kk"), F.sum(n * n).alias("nn"))
    m = F.col("f") / F.col("t")
    # Weighted between-host variance of a beta-binomial (unbiased in its ANOVA form).
    between = F.col("kk") - F.col("f") * F.col("f") / F.col("t")
    within = F.col("f") - F.col("kk")
    ms_b = F.try_divide(between, F.col("h") - 1)
    ms_w = F.try_divide(within, F.col("t") - F.col("h"))
    n0 = F.try_divide(F.col("t") - F.col("nn") / F.col("t"), F.col("h") - 1)
    rho = F.try_divide(ms_b - ms_w, ms_b + (n0 - 1) * ms_w)
    strength = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(1e9))
    prior = total.select(m.alias("m"), F.coalesce(strength, F.lit(1e9)).alias("s"))
    # One row, whatever the input.
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", "failures", ((k + F.col("m") * F.col("s")) / (n + F.col("s"))).alias("rate"))


def judge(docs: DataFrame, limits: Limits = Limits(), id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per input row: id, host, the measures, base_failed, host_rate, kept."""
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(host).alias("host"))
    rows = cut(_measured(slim, "text", "").drop("text").withColumn("base_failed", _fails(limits)))
    rates = host_rates(rows.select("host", F.col("base_failed").alias("failed"))).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"))
    out = rows.join(rates, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= limits.max_host_rate))
    return out.withColumnRenamed("id", id) if id != "id" else out


def passed(docs: DataFrame, limits: Limits = Limits(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that are kept, with all their columns. Two scans; no text is shuffled unless many hosts are rejected."""
    prefix = "_quality_rules_"
    measured = _measured(docs, text, prefix)
    judged = measured.select(F.col(f"`{host}`").alias("host"), _fails(limits, prefix).alias("failed"))
    rejected = cut(host_rates(judged).filter(F.col("rate") > limits.max_host_rate).select(F.col("host").alias(f"{prefix}host")))
    good = measured.filter(~_fails(limits, prefix))
    good = good.join(rejected, F.col(f"`{host}`").eqNullSafe(F.col(f"{prefix}host")), "left_anti")
    return good.select(*(F.col(f"`{c}`") for c in docs.columns))


def sql(docs: str = "documents", limits: Limits = Limits()) -> str:
    """DuckDB SQL for judge(), without host."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, d.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
j AS (SELECT *, (n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words) AS base_failed FROM m),
h AS (SELECT source AS hs, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM j GROUP BY source),
t AS (SELECT sum(n) AS t, sum(k) AS f, count(*) AS h, sum(k * k / n) AS kk, sum(n * n) AS nn FROM h),
v AS (SELECT t.*, (kk - f * f / t) / nullif(h - 1, 0) AS b, (f - kk) / nullif(t - h, 0) AS wi, (t - nn / t) / nullif(h - 1, 0) AS n0 FROM t),
p AS (SELECT f / t AS m, coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1e9 END, 1e9) AS s
      FROM (SELECT *, (b - wi) / nullif(b + (n0 - 1) * wi, 0) AS rho FROM v)),
hr AS (SELECT hs, (k + m * s) / (n + s) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND rate <= {limits.max_host_rate}) AS kept
FROM j JOIN hr ON hs IS NOT DISTINCT FROM source"""
