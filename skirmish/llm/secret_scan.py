"""Secret scans by trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived (what every match must
hold). A batch of texts gets an inverted index: for each trigram that some query names, the texts that
hold it. Queries intersect and unite these postings, and only the candidates are verified with the
regular expression. A rule whose expression has no mandatory trigram scans every text.

The index is made segment by segment where the texts lie, as a sharded search index would be; nothing
is shuffled. Texts are folded to lower-case ASCII for the index only.

Defined results: a null text is empty and has no spans; spans are code points, end exclusive; matches
are leftmost and don't overlap per kind; repeated rows are scanned each; an empty table gives an empty
result; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import extended

try:
    from re import _constants as sre, _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Least length of `group` in a match; shorter matches are dropped, but still take their place.
    least: int = 0
    group: int = 0


#: The base rules of the contract, in its order.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: What the method adds.
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("url_password", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@"),
)
RULES = (*BASE, *EXTRA)
MAX_SET = 64


# A query is True (every text), a trigram, or ("and" | "or", queries).


def _all(parts: list) -> object:
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _holding(strings: set[bytes]) -> object:
    """The query of a text that holds one of the strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _join(a: set[bytes], b: set[bytes]) -> set[bytes] | None:
    return {x + y for x, y in product(a, b)} if len(a) * len(b) <= MAX_SET else None


def _analyse(tree) -> tuple[set[bytes] | None, object]:
    """(the strings that the expression matches, folded, if they are few; the query of its matches)."""
    parts: list = []
    run: set[bytes] = {b""}
    exact = True

    def flush():
        nonlocal run, exact
        parts.append(_holding(run))
        run, exact = {b""}, False

    for op, arg in tree:
        strings, query = _one(op, arg)
        if strings is not None and (joined := _join(run, strings)) is not None:
            run = joined
            continue
        flush()
        if strings is not None:
            run = strings
        else:
            parts.append(query)
    if exact:
        return run, _holding(run)
    parts.append(_holding(run))
    return None, _all(parts)


def _one(op, arg) -> tuple[set[bytes] | None, object]:
    if op is sre.LITERAL:
        return {chr(arg).encode().lower()}, True
    if op is sre.IN:
        members = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                members.add(chr(value).encode().lower())
            elif kind is sre.RANGE and value[1] - value[0] < MAX_SET:
                members |= {chr(c).encode().lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (members, True) if len(members) <= 8 else (None, True)
    if op is sre.SUBPATTERN:
        return _analyse(arg[-1])
    if op is sre.BRANCH:
        found = [_analyse(x) for x in arg[1]]
        if all(s is not None for s, _ in found) and len(every := set().union(*(s for s, _ in found))) <= MAX_SET:
            return every, True
        return None, _any([q for _, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _analyse(inner)
        if strings is not None and high == 1:
            return ({b""} | strings if low == 0 else strings), True
        return None, True if low == 0 else _holding(strings) if strings is not None else query
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {b""}, True
    return None, True


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every text with a match satisfies; True if there is none to name."""
    strings, query = _analyse(sre_parser.parse(pattern))
    return query


def _named(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_named, query[1]))


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(i, r, re.compile(r.pattern), trigram_query(r.pattern)) for i, r in enumerate(rules)]
        self.trigrams = sorted(set().union(*(_named(q) for *_, q in self.rules)))
        self.table = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.trigrams, 1):
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i

    def postings(self, data: np.ndarray, starts: np.ndarray) -> dict[bytes, np.ndarray]:
        """Trigram -> sorted numbers of the texts that hold it."""
        if len(data) < 3:
            return {}
        low = tv.LOWER[data].astype(np.uint32)
        found = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        at = np.flatnonzero(found)
        row = np.searchsorted(starts, at, "right") - 1
        inside = at + 3 <= starts[row + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) << 32 | row[inside])
        which, cuts = np.unique(pairs >> 32, return_index=True)
        return {self.trigrams[w - 1]: rows & 0xFFFFFFFF for w, rows in zip(which, np.split(pairs, cuts[1:]))}

    def candidates(self, query, index: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if isinstance(query, bytes):
            return index.get(query, np.zeros(0, np.int64))
        out = None
        for part in query[1]:
            rows = self.candidates(part, index, n)
            out = rows if out is None else np.intersect1d(out, rows, True) if query[0] == "and" else np.union1d(out, rows)
            if query[0] == "and" and not len(out):
                break
        return out

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of each text, sorted."""
        spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        for row, data, starts in tv.chunks(column):
            n = len(starts) - 1
            index = self.postings(data, starts)
            texts: dict[int, str] = {}
            for number, rule, compiled, query in self.rules:
                for r in self.candidates(query, index, n):
                    if (text := texts.get(r)) is None:
                        text = texts[r] = data[starts[r] : starts[r + 1]].tobytes().decode()
                    for m in compiled.finditer(text):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[row + r].append((m.start(), number, m.end()))
        return [sorted(s) for s in spans]


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, spans array<struct<kind, start, end>> by start, then by the order of the rules."""
    slim = docs.select(F.col(id).alias(id), F.col(text).alias("_text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if rules not in _scanners:
            _scanners[rules] = Scanner(rules)
        for batch in batches:
            found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in _scanners[rules].scan(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[id, "spans"])

    return slim.mapInArrow(run, extended(slim.select(id), "spans array<struct<kind:string,start:bigint,end:bigint>>"))


def digest(scanned: DataFrame, base: tuple[Rule, ...] = BASE, id: str = "doc_id") -> DataFrame:
    """The columns of the op8 contract."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    kinds = [r.kind for r in base]
    return scanned.select(
        id, *(of(k).alias(f"n_{k}") for k in kinds),
        F.sha2(line(F.filter("spans", lambda s: s["kind"].isin(*kinds))), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )


def sql(docs: str = "documents") -> str:
    """DuckDB SQL for digest(scan()): the texts between matches give the matches' offsets."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("(?ai:(password|passwd|secret|token|api_?key))", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])")
        pattern = pattern.replace(r"[^\s/:@]", r"[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}/:@]")
        size = f"length(regexp_extract(m, {q(pattern)}, {r.group}))"
        parts.append(f"""SELECT r, {i} AS k, {q(r.kind)} AS kind, start, start + length(m) AS stop FROM (
  SELECT r, ms[i] AS m, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS start
  FROM (SELECT r, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, {q(pattern)}) AS ms, string_split_regex(text, {q(pattern)}) AS gaps FROM d)))
WHERE {size} >= {r.least}""")
    line = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k)"
    kinds = ", ".join(q(r.kind) for r in BASE)
    union = "\nUNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {docs}),
s AS ({union}),
g AS (SELECT r, {", ".join(f"count(*) FILTER (kind = {q(x.kind)}) AS n_{x.kind}" for x in BASE)},
  {line} FILTER (kind IN ({kinds})) AS base, {line} AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0)::BIGINT AS n_{x.kind}" for x in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""
