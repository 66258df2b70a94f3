"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

The benchmark must be small against the corpus: its windows go to the executors as one automaton.
A benchmark of more than `max_chars` characters is split into blocks of items by hash, each with its
own automaton; the documents then stream through one scan per block, and hits of all blocks add up.

Defined results: null, empty or wordless texts have no words and no hits; a null benchmark text has
no windows; a null item id reads as the empty string; items with equal texts are all reported;
repeated rows are scanned each; columns other than id and text are not read by `scan()`, and
`clean()` returns all columns of its input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import extended

WINDOW = 10
MAX_CHARS = 20_000_000
NORMAL = bytes(32 if tv.NON_WORD[tv.LOWER[b]] else int(tv.LOWER[b]) for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_built: dict[str, ahocorasick.Automaton] = {}


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def patterns(items: list[tuple[str, str | None]], width: int = WINDOW) -> dict[str, tuple[int, list[str]]]:
    """Window, between blanks -> number of its words, items that have it. Bytes read as Latin-1 keep one character a byte."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        ws = words((text or "").encode())
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            window = ws[i : i + width]
            found.setdefault(f" {b' '.join(window).decode('latin-1')} ", (len(window), set()))[1].add(item)
    return {k: (n, sorted(ids)) for k, (n, ids) in found.items()}


def build(items: list[tuple[str, str | None]], width: int = WINDOW) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for window, value in patterns(items, width).items():
        automaton.add_word(window, value)
    if len(automaton):
        automaton.make_automaton()
    return automaton


def hits(automaton: ahocorasick.Automaton, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Ranges of words inside windows, merged and in order, and the items of these windows."""
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    if not ws or not len(automaton):
        return ranges, items
    text = f" {b' '.join(ws).decode('latin-1')} "
    seen = at = 0
    for end, (n, ids) in automaton.iter(text):
        seen, at = seen + text.count(" ", at, end), end
        items.update(ids)
        ranges.append((seen - n, seen))
    return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _items(benchmark: DataFrame, item: str, text: str, max_chars: int) -> list[DataFrame]:
    """The benchmark as (item, text), in blocks of at most about max_chars characters."""
    slim = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    total = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // max_chars))
    return [slim.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def _scanned(docs: DataFrame, benchmark: DataFrame, text: str, width: int, item: str, item_text: str, max_chars: int, prefix: str) -> DataFrame:
    """docs with n_words, ranges (flat list of begin, end), items and spans (character offsets in the original), each named with the prefix."""
    at, own = docs.columns.index(text), len(docs.columns)
    schema = extended(docs, f"`{prefix}n_words` bigint, `{prefix}ranges` array<int>, `{prefix}items` array<string>, `{prefix}spans` array<int>")
    names = schema.names

    def scan_with(block: int, items, key: str, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if key not in _built:
                _built.clear()
                _built[key] = build(items.value, width)
            automaton = _built[key]
            for batch in batches:
                counts, ranges, found, spans = [], [], [], []
                before = (batch.column(own + 1).to_pylist(), batch.column(own + 2).to_pylist()) if block else None
                for i, value in enumerate(batch.column(at)):
                    value = value.as_buffer()
                    ws = words(value.to_pybytes()) if value else []
                    got, ids = hits(automaton, ws)
                    if before:
                        got = merged([*got, *zip(before[0][i][::2], before[0][i][1::2])])
                        ids |= set(before[1][i])
                    counts.append(len(ws))
                    ranges.append([x for r in got for x in r])
                    found.append(sorted(ids))
                    spans.append(original(value.to_pybytes().decode(), got) if got and last else [])
                more = [pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:own], *more], names=names)

        return run

    blocks = _items(benchmark, item, item_text, max_chars)
    for b, block in enumerate(blocks):
        rows = [(r["item"], r["text"]) for r in block.collect()]  # at most about max_chars characters
        key = hashlib.sha256(repr((sorted(rows), width)).encode()).hexdigest()
        docs = docs.mapInArrow(scan_with(b, docs.sparkSession.sparkContext.broadcast(rows), key, b == len(blocks) - 1), schema)
    return docs


def original(text: str, ranges: list[tuple[int, int]]) -> list[int]:
    """Begin and end characters, in the text as it was, of ranges of words."""
    offsets = [m.span() for m in WORD.finditer(text.translate({i: i + 32 for i in range(65, 91)}))]
    return [x for a, b in ranges for x in (offsets[a][0], offsets[b - 1][1])]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (sorted as strings), spans (character offsets: begin, end, begin, ...)."""
    slim = docs.select(F.col(id).alias(id), F.col(text).alias("_text"))
    out = _scanned(slim, benchmark, "_text", width, item, item_text, max_chars, "_")
    n_hit = F.aggregate("_ranges", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).alias("sign")), lambda a, x: F.struct((a["s"] + x * a["sign"]).alias("s"), (-a["sign"]).alias("sign")), lambda a: a["s"])
    return out.select(id, F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("_items").alias("items"), F.col("_spans").alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """The rows of docs without a hit, with all their columns."""
    prefix = "_decontaminate_"
    out = _scanned(docs, benchmark, text, width, item, item_text, max_chars, prefix)
    return out.filter(F.size(prefix + "ranges") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def digest(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """The columns of the op3 contract."""
    return scanned.select(
        id, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^ ]+')"


def sql(docs: str = "documents", benchmark: str = "benchmark", width: int = WINDOW) -> str:
    """DuckDB SQL for digest(scan())."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM {docs}),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS ws FROM {benchmark}),
bw AS (SELECT DISTINCT item, array_to_string(ws[i:i+{width - 1}], ' ') AS g, least(len(ws), {width}) AS k
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {width - 2}, 2))) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
gs AS (SELECT DISTINCT g, k FROM bw),
dw AS (SELECT r, i, k, array_to_string(ws[i:i+k-1], ' ') AS g FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT dw.* FROM dw JOIN gs USING (g, k)),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM h) GROUP BY r),
it AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM h JOIN bw USING (g, k) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN it USING (r)"""
