"""Phrase collocation mining: n-gram counts from suffix arrays over word ids, one array for each shard of texts.

A text is cut into pieces at punctuation and line ends, and these into words; nothing crosses a piece. In a shard
(some megabytes of texts) words get ids by language, suffixes are ranked by prefix doubling up to the
phrase length, and neighbours in that order whose longest common prefix has all words form an interval: its size is
the count of one n-gram. Counts of the shards are added up by key, which is the 64-bit hashes of the words, so
a shuffle gets a row for each n-gram and shard at most.

Lengths are counted one after another. An n-gram can only be frequent if its first and last n-1 words are;
a bitmap of fixed size over these leaves out most of the rest before the shuffle. What it lets through is counted and
then filtered, so it changes the rows moved, never the result. When frequent phrases fill it, it lets more through.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count again; phrases
are compared by hashes of 64 bits for each word; empty tables give an empty result; columns other than
language and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut

LONGEST, LEAST, BEST, SHARE = 3, 10, 2000, 50
SHARD_BYTES = 5 << 20
#: Rows that a task hands over at once.
ROWS = 1 << 16
#: Bits of the bitmap of frequent phrases.
BITMAP = 1 << 26
#: Parts of a language that are ranked apart before all of it is.
SALT = 32
BREAKS = tv.byte_set([*b".,;:!?", *range(0x0A, 0x0E)])
SEPARATORS = BREAKS | tv.byte_set(b" \t")
U64 = np.uint64


def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _codes(seeds: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A 64-bit code of each row of words (hashes), apart by language."""
    total = seeds
    for k in range(words.shape[1]):
        total = tv.mix(total * U64(0xA0761D6478BD642F) + words[:, k])
    return total


def intervals(ids: np.ndarray, room: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the count of each run of n ids among those that begin at starts.

    room: ids from each place to the end of its piece. Suffixes are sorted by their first n ids.
    """
    rank, size = np.unique(ids, return_inverse=True)[1] + 1, 1
    while size < n:
        step = min(size, n - size)
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:]
        after[room <= step] = 0  # the suffix ends: before all that go on
        pair = rank * (int(rank.max(initial=0)) + 1) + after
        size += step
        if size >= n:
            rank = pair  # their order is all that is needed
        else:
            rank = np.unique(pair, return_inverse=True)[1] + 1
    order = starts[np.argsort(rank[starts], kind="stable")]
    common = np.zeros(len(order), np.int64)  # with the suffix before, n at most
    here = np.ones(len(order), bool)
    here[:1] = False
    for k in range(n):
        here[1:] &= ids[order[1:] + k] == ids[order[:-1] + k]
        common += here
    first = np.flatnonzero(common < n)
    return order[first], np.diff(np.append(first, len(order)))


def _counted(docs: DataFrame, n: int, known) -> DataFrame:
    """seed (of the language), w0 to the last word's hash, count by shard, of the phrases of n words whose parts the bitmap `known` (broadcast) has; of one word also lang and word."""
    columns = ["seed", *(f"w{k}" for k in range(n)), "count", *["lang", "word"][: 2 * (n == 1)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        held: list[tuple] = []
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            code, words, breaks, texts = (list(x) for x in zip(*held))
            sizes = [len(b) for b in breaks]
            last = np.cumsum([0, *(int(b[-1]) + 1 if len(b) else 0 for b in breaks)])
            piece = np.concatenate([b + base for b, base in zip(breaks, last)])
            code, words = np.concatenate(code), np.concatenate(words)
            seeds = np.array([_seed(x) for x in names] or [0], U64)[code]
            room = np.searchsorted(piece, piece, "right") - np.arange(len(piece))
            starts = np.flatnonzero(room >= n)
            if n > 1:
                places = max(0, len(words) - n + 2)
                slot = _codes(seeds[:places], np.stack([words[k : k + places] for k in range(n - 1)], 1)) % U64(BITMAP)
                hit = (room[:places] >= n - 1) & ((known.value[slot >> U64(6)] >> (slot & U64(63))) & U64(1)).astype(bool)
                starts = starts[hit[starts] & hit[starts + 1]]
            del piece, breaks
            at, count = intervals(tv.mix(words ^ seeds), room, starts, n)
            bounds = np.cumsum([0, *sizes])
            for i in range(0, len(at), ROWS):
                own = at[i : i + ROWS]
                out = [pa.array(seeds[own].view(np.int64)), *(pa.array(words[own + k].view(np.int64)) for k in range(n)), pa.array(count[i : i + ROWS])]
                if n == 1:
                    part = np.searchsorted(bounds, own, "right") - 1
                    found = [texts[p][0][texts[p][1][j] : texts[p][2][j]].tobytes() for p, j in zip(part.tolist(), (own - bounds[part]).tolist())]
                    out += [pa.array(list(names)).take(pa.array(code[own])), pa.array(found, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=columns)

        for batch in batches:
            langs = np.array([names.setdefault(x, len(names)) for x in batch.column(0).to_pylist()], np.int32)
            for row, data, starts in tv.chunks(batch.column(1)):
                lower = tv.LOWER[data]
                begins, ends, rows = tv.tokens(lower, starts, SEPARATORS)
                breaks = np.cumsum(BREAKS[lower], dtype=np.int32)[begins] if len(begins) else begins
                new = np.ones(len(begins), bool)
                new[1:] = (breaks[1:] != breaks[:-1]) | (rows[1:] != rows[:-1])
                held.append((langs[rows + row], tv.span_hashes(lower, begins, ends), np.cumsum(new) - 1, (lower, begins, ends) if n == 1 else None))
                size += len(data)
                if size >= SHARD_BYTES:
                    yield from shard()
                    held, size = [], 0
        if held:
            yield from shard()

    kinds = {"lang": "string", "word": "string"}
    return docs.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in columns))


def _bitmap(grams: DataFrame, n: int) -> np.ndarray:
    """The bits of all grams (seed, key) of n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITMAP // 64, U64)
        for batch in batches:
            seeds, words = batch.column(0).to_numpy().view(U64), batch.column(1).flatten().to_numpy().view(U64).reshape(-1, n)
            slot = _codes(seeds, words) % U64(BITMAP)
            np.bitwise_or.at(bits, slot >> U64(6), U64(1) << (slot & U64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], names=["at", "bits"])

    found = grams.select("seed", "key").mapInArrow(run, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, U64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(U64)
    return out


def _frequent(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """All words (lang, seed, key, a, word), and the frequent grams (seed, key, a) of each length; a key is the array of the words' hashes."""
    context = docs.sparkSession.sparkContext
    words, levels, known = None, [], None
    for n in range(1, longest + 1):
        parts = [f"w{k}" for k in range(n)]
        counts = _counted(docs, n, known).groupBy("seed", *parts, *["lang", "word"][: 2 * (n == 1)]).agg(F.sum("count").alias("a"))
        key = F.array(*parts).alias("key")
        if n == 1:
            words = cut(counts.select("lang", "seed", key, "a", "word"))
            level = words.filter(F.col("a") >= least).select("seed", "key", "a")
        else:
            level = cut(counts.filter(F.col("a") >= least).select("seed", key, "a"))
            known.unpersist()
        levels.append(level)
        if n < longest:
            known = context.broadcast(_bitmap(level, n))
    return words, levels


def _part(first: str, words: str, key: str = "key"):
    """So many words of a key, from a place counted from 0."""
    return F.expr(f"slice({key}, {first} + 1, {words})")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST, share: int = SHARE, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    a, l, r: counts of the phrase and of the two parts of its lowest-scoring cut; n: words of the language. A phrase
    goes if a longer one that holds it has at least `share` percent of its count.
    """
    slim = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    words, levels = _frequent(slim, longest, least)
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    phrases = grams.withColumn("m", F.size("key")).filter("m > 1")

    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, m - 1)")))
    cuts = cuts.withColumn("left", _part("0", "k")).withColumn("right", _part("k", "m - k"))
    cuts = cuts.join(grams.select("seed", F.col("key").alias("left"), F.col("a").alias("l")), ["seed", "left"])
    cuts = cuts.join(grams.select("seed", F.col("key").alias("right"), F.col("a").alias("r")), ["seed", "right"])
    # floor(1000000 a a / (l r)) by long division, in decimals of 38 digits; a is at most l and r.
    square, product = (F.expr(f"cast({x} as decimal(18, 0)) * cast({y} as decimal(18, 0))") for x, y in (("a", "a"), ("l", "r")))
    cuts = cuts.withColumn("square", square).withColumn("product", product)
    cuts = cuts.withColumn("rest", F.expr("cast(square % product as decimal(34, 0)) * 1000"))
    score = "(square div product) * 1000000 + (rest div product) * 1000 + (cast(rest % product as decimal(34, 0)) * 1000) div product"
    cut_of = cuts.withColumn("score", F.expr(score)).groupBy("seed", "key", "m", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = phrases.filter("m > 2").select("seed", "key", "a", "m", F.expr("explode(sequence(2, m - 1)) as size"))
    inner = inner.select("seed", "key", "a", "size", F.expr("explode(sequence(0, m - size)) as first"))
    longer = inner.groupBy("seed", _part("first", "size").alias("key")).agg(F.max("a").alias("longer"))
    kept = cut_of.join(longer, ["seed", "key"], "left").filter(F.expr(f"longer is null or 100 * longer < {share} * a"))

    spelt = kept.select("seed", "key", F.posexplode("key").alias("place", "one"))
    spelt = spelt.join(words.filter(F.col("a") >= least).select("seed", F.col("key")[0].alias("one"), "word"), ["seed", "one"])
    spelt = spelt.groupBy("seed", "key").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("spelt"))
    named = kept.join(spelt, ["seed", "key"]).select("seed", F.array_join("spelt.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALT))
    first = named.withColumn("rank", F.row_number().over(Window.partitionBy("seed", part).orderBy(*order))).filter(F.col("rank") <= best)
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(*order))).filter(F.col("rank") <= best)
    totals = words.groupBy("seed", "lang").agg(F.sum("a").alias("n"))
    return top.join(totals, "seed").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql(docs: str = "documents", least: int = LEAST, best: int = BEST, share: int = SHARE) -> str:
    """DuckDB SQL for collocations() of two and three words."""
    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM {docs}),
p AS (SELECT lang, row_number() OVER () AS q, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM d),
w AS (SELECT lang, q, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM p),
t AS (SELECT lang, w AS x, lead(w) OVER s AS y, lead(w, 2) OVER s AS z FROM w WINDOW s AS (PARTITION BY q ORDER BY i)),
g AS (SELECT lang, 1 AS m, x AS g, count(*) AS a FROM t GROUP BY ALL UNION ALL SELECT lang, 2, x || ' ' || y, count(*) FROM t WHERE y IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM t WHERE z IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT *, string_split(g, ' ') AS ws FROM g WHERE m > 1 AND a >= {least}),
h AS (SELECT *, array_to_string(ws[1:k], ' ') AS lg, array_to_string(ws[k + 1:], ' ') AS rg FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
k AS (SELECT h.lang, h.m, h.g, h.a, k, x.a AS l, y.a AS r, ((1000000::HUGEINT * h.a * h.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM h JOIN g x ON x.lang = h.lang AND x.g = h.lg JOIN g y ON y.lang = h.lang AND y.g = h.rg),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS g, a FROM c WHERE m = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE m = 3) GROUP BY ALL),
f AS (SELECT b.lang, b.g AS phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE m = 3 OR longer IS NULL OR 100 * longer < {share} * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM f) JOIN n USING (lang) WHERE rank <= {best}"""
