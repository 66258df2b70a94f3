"""Toxicity: a convolutional text classifier, trained in numpy on a bounded sample of labelled rows.

Words are hashed to embeddings; filters of several widths slide over them, each filter's maximum over
the text is kept, and a logistic layer gives the score. All weights start at random; nothing but gradient
descent brings the labels in. Since a filter is linear before the maximum,
scoring adds one looked-up row per filter tap and word, whatever the width of the embedding.

The training rows are drawn by a hash of the id, at most `max_rows` of each label; their number is the
only bound. Scores see the text alone. Thresholds of `flagged` are calibrated by language on training
rows set aside; `predicted` is the fixed cut at one half, which calibration puts at the best F1.

Defined results: null, empty and wordless texts are scored as texts of one blank word; labels that
are null or of unknown ids are not learned from, of several labels of an id the highest holds; without
labels of both kinds every score is 0; repeated rows are scored each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv

WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    size: int = 8
    filters: int = 8
    epochs: int = 8
    rate: float = 0.1
    #: Spread of the embeddings at the start, and share of the words left out in each step.
    spread: float = 0.1
    drop: float = 0.5
    #: Labelled rows of each label that training may use.
    max_rows: int = 3000
    validation: int = 5
    seed: int = 3


@dataclass
class Model:
    embedding: np.ndarray
    taps: dict[int, np.ndarray]  # width -> (width, size, filters)
    bias: np.ndarray
    out: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> list[list[np.ndarray]]:
        return [[(self.embedding @ self.taps[w][k]).astype(np.float32) for k in range(w)] for w in WIDTHS]

    def final(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))


def word_ids(column: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, starts) of consecutive texts: each text's word buckets, at least one, then PAD zeros."""
    for _, data, starts in tv.chunks(column):
        n = len(starts) - 1
        low = tv.LOWER[data]
        begins, ends, rows = tv.tokens(low, starts, tv.NON_WORD)
        count = np.bincount(rows, minlength=n)
        size = np.maximum(count, 1) + PAD
        at = np.concatenate([[0], np.cumsum(size)])
        first = np.concatenate([[0], np.cumsum(count)])
        ids = np.zeros(at[-1], np.int64)
        ids[np.arange(len(rows)) - first[rows] + at[rows]] = (tv.span_hashes(low, begins, ends) % tv.U64(buckets - 1)).astype(np.int64) + 1
        yield ids, at


def logits(tables: list[list[np.ndarray]], model: Model, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Max pooling over each text's windows; windows begin at words only."""
    n = len(ids) - PAD
    inside = np.ones(len(ids), bool)
    for k in range(1, PAD + 1):
        inside[at[1:] - k] = False
    inside = inside[:n]
    starts = at[:-1] - np.arange(len(at) - 1) * PAD
    total = np.full(len(at) - 1, model.offset)
    for j, taps in enumerate(tables):
        x = taps[0][ids[:n][inside]]
        for k in range(1, len(taps)):
            x += taps[k][ids[k : n + k][inside]]
        best = np.maximum.reduceat(x, starts, axis=0)
        total += np.maximum(best + model.bias[j], 0) @ model.out[j]
    return total


class _Step:
    """Adagrad: gradient steps divided by the root of each parameter's squared gradients so far."""

    def __init__(self, shape: tuple[int, ...], rate: float):
        self.squares, self.rate = np.full(shape, 0.1), rate

    def __call__(self, gradient: np.ndarray, at=...) -> np.ndarray:
        self.squares[at] += gradient * gradient
        return self.rate * gradient / np.sqrt(self.squares[at])


def _logit(m: Model, ids: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
    """The logit of one text and, by width, the place and the height of each filter's maximum."""
    x = m.embedding[ids]
    n, logit, peaks = len(ids) - PAD, m.offset, []
    for j, w in enumerate(WIDTHS):
        c = x[:n] @ m.taps[w][0]
        for k in range(1, w):
            c += x[k : n + k] @ m.taps[w][k]
        at = c.argmax(0)
        height = np.maximum(c[at, np.arange(c.shape[1])] + m.bias[j], 0)
        logit += height @ m.out[j]
        peaks.append((at, height))
    return logit, peaks


def train(texts: list[np.ndarray], labels: np.ndarray, s: Settings, aside: list[np.ndarray] = (), aside_labels: np.ndarray = ()) -> Model:
    """texts: word buckets with PAD. All weights start at random and are fitted by gradient descent.

    In each step a random part of the text's words is left out, so that filters don't settle on a few of them.
    With rows set aside, training ends when their loss hasn't fallen for two epochs, and the best state is returned.
    """
    rng = np.random.default_rng(s.seed)
    embedding = rng.normal(0, s.spread, (s.buckets, s.size))
    embedding[0] = 0
    taps = {w: rng.normal(0, 1 / np.sqrt(w * s.size), (w, s.size, s.filters)) for w in WIDTHS}
    m = Model(embedding, taps, np.zeros((len(WIDTHS), s.filters)), rng.choice([-0.2, 0.2], (len(WIDTHS), s.filters)), 0.0)
    sizes = np.maximum(np.bincount(labels, minlength=2), 1)
    weight = sizes.sum() / (2 * sizes)
    of_words = _Step((s.buckets, s.size), s.rate)
    of_taps = {(w, k): _Step(taps[w][k].shape, s.rate) for w in WIDTHS for k in range(w)}
    of_bias, of_out, of_offset = _Step(m.bias.shape, s.rate), _Step(m.out.shape, s.rate), _Step((1,), s.rate)
    best, kept, since = np.inf, m, 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(texts)):
            ids, y = texts[i], labels[i]
            stays = rng.random(len(ids) - PAD) >= s.drop
            if stays.any():
                ids = np.concatenate([ids[:-PAD][stays], ids[-PAD:]])
            logit, peaks = _logit(m, ids)
            g = weight[y] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
            m.offset -= of_offset(np.array([g]))[0]
            for j, w in enumerate(WIDTHS):
                at, height = peaks[j]
                d = g * m.out[j] * (height > 0)
                m.out[j] -= of_out(g * height, j)
                m.bias[j] -= of_bias(d, j)
                live = d != 0
                for k in range(w):
                    rows = ids[at[live] + k]
                    words = (m.taps[w][k][:, live] * d[live]).T
                    m.taps[w][k] -= of_taps[w, k](m.embedding[ids[at + k]].T * d)
                    each, which = np.unique(rows, return_inverse=True)
                    total = np.zeros((len(each), s.size))
                    np.add.at(total, which, words)
                    m.embedding[each] -= of_words(total, each)
            m.embedding[0] = 0
        if len(aside):
            z = np.array([_logit(m, ids)[0] for ids in aside])
            loss = float((weight[aside_labels] * np.logaddexp(0, np.where(aside_labels == 1, -z, z))).mean())
            since += 1
            if loss < best:
                best, since = loss, 0
                kept = Model(m.embedding.copy(), {w: t.copy() for w, t in m.taps.items()}, m.bias.copy(), m.out.copy(), m.offset)
            if since == 2:
                break
    return kept


def _best_cut(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The middle of the widest-scored cut of best F1."""
    order = np.argsort(-scores)
    s, y, w = scores[order], labels[order], weights[order]
    hit, all_ = np.cumsum(y * w), np.cumsum(w)
    f1 = 2 * hit / np.maximum(all_ + (y * w).sum(), 1e-9)
    i = int(np.argmax(f1))
    return float((s[i] + s[min(i + 1, len(s) - 1)]) / 2)


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", folds: int = 5) -> Model | None:
    """A model from labelled rows outside fold 0, or None without rows of both labels."""
    own = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("y")).filter(f"y in (0, 1) and pmod(crc32(cast(id as string)), {folds}) <> 0")
    own = own.groupBy("id").agg(F.max("y").alias("y")).withColumn("draw", F.md5(F.concat(F.col("id").cast("string"), F.lit(":draw"))))
    totals = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    drawn = own.filter("y = 1").orderBy("draw").limit(s.max_rows).unionByName(own.filter("y = 0").orderBy("draw").limit(s.max_rows))

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [ids[a:b].astype(np.uint16 if s.buckets <= 1 << 16 else np.uint32).tobytes() for ids, at in word_ids(batch.column(0), s.buckets) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), *batch.columns[1:]], names=["ids", "y", "lang", "draw"])

    chosen = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang")).join(F.broadcast(drawn), "id")  # at most 2 * max_rows rows
    rows = chosen.select("text", "y", "lang", "draw").mapInArrow(ids_of, "ids binary, y int, lang string, draw string").toPandas().drop_duplicates(["draw", "ids"]).sort_values(["draw", "lang"])
    kind = np.uint16 if s.buckets <= 1 << 16 else np.uint32
    texts = [np.frombuffer(b, kind).astype(np.int64) for b in rows["ids"]]
    y, langs = rows["y"].to_numpy(), rows["lang"].to_numpy()
    aside = np.arange(len(y)) % s.validation == 0
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside[:] = False
    model = train([t for t, a in zip(texts, aside) if not a], y[~aside], s, [t for t, a in zip(texts, aside) if a], y[aside])
    held = aside if aside.any() else ~aside
    tables = model.tables()
    z = np.array([logits(tables, model, t, np.array([0, len(t)]))[0] for t, h in zip(texts, held) if h])
    counts = np.bincount(y, minlength=2)
    weights = np.array([totals[0] / max(counts[0], 1), totals[1] / max(counts[1], 1)])[y[held]]
    model.shift = -_best_cut(z, y[held], weights) * model.scale
    p = model.final(z)
    for name in sorted(set(langs[held])):
        mine = langs[held] == name
        positive = int(y[held][mine].sum())
        if positive:
            model.thresholds[name] = float((positive * _best_cut(p[mine], y[held][mine], weights[mine]) + 20 * 0.5) / (positive + 20))
    return model


def score(docs: DataFrame, model: Model | None, s: Settings = Settings(), id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, threshold (of the language), flagged."""
    slim = docs.select(F.col(id).alias(id), F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast((model, model and model.tables()))  # a fixed size, by the settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tables = shared.value
        for batch in batches:
            parts = [m.final(logits(tables, m, ids, at)) for ids, at in word_ids(batch.column(2), s.buckets)] if m else [np.zeros(batch.num_rows)]
            scores = np.concatenate([*parts, np.zeros(0)])
            cuts = [(m.thresholds.get(x, 0.5) if m else 0.5) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(cuts, pa.float64())], names=[id, "score", "threshold"])

    out = slim.mapInArrow(run, StructType([*slim.select(id).schema.fields, *StructType.fromDDL("score double, threshold double").fields]))
    held = F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(folds)) == 0, F.lit(False))
    return out.select(id, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
