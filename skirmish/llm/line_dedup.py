"""Line dedup: maximal repeated runs of lines are found by distributed prefix doubling, later copies are deleted.

A text is the sequence of its lines that hold a word. The suffixes of all sequences are ranked by
prefix doubling: the rank of a prefix of 2k lines is the place of (rank of the first k, rank of the
next k) in the sorted order of the pairs that occur more than once; suffixes whose prefix is unique
drop out. Suffixes of one rank are an LCP interval: they share that prefix.

From the longest prefixes down, each suffix then descends through the intervals: to the lines that it is
known to share with an earlier suffix, 2^j more are added if the interval so narrowed has an earlier
member. What it ends with is the longest prefix that occurs earlier, by (id, text, line), and where that
occurs first. An interval is named by its first member and its length; the first member of what an
interval narrows to either stands at the same length or is the interval's own first member, so a step
compares only rows of one length, and one row for each interval.

Runs that no run of the line before holds are maximal (`maximal_runs()`); those of at least `min_words`
words are later copies, and their lines are deleted. By default that spares single words
alone on a line, and nothing else. Overlapping copies count.

Lines are told apart by two independent 64-bit hashes, so 128 bits decide before a line is deleted. Only
distinct pairs are sorted, so a line that a third of all rows share is one row there; the ranks and first places of
the commonest prefixes are broadcast (their number is bounded), so no task gathers all copies of a run. Lines of one text
meet in one task where runs are told maximal. Texts that lose no line aren't shuffled: a bitmap of fixed size over the hashes of the others tells most of them.

Defined results: null and empty texts have no lines and stay; lines without a word are not counted
and never deleted; rows that repeat both id and text are one document in the comparison, and all get
its result; null ids come first; an empty table gives an empty result; `deduped()` returns all
columns of its input, `runs()` reads no others than id and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv
from .common import cut, extended, possible

MIN_WORDS = 2
#: A key with more than this share of all rows is common; so there are at most as many common keys as its inverse.
COMMON = 1e-4


def _worded(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Begin, end, row and number of words of each line with a word."""
    begins, ends, rows = tv.tokens(data, starts, tv.NEWLINE)
    words, _, _ = tv.tokens(data, starts, tv.BLANKS)
    count = np.searchsorted(words, ends) - np.searchsorted(words, begins)
    has = count > 0
    return begins[has], ends[has], rows[has], count[has]


def _second_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, independent of textvec.span_hashes(): sums of a mixed value of each byte and its place."""
    out = np.zeros(len(begins), np.uint64)
    at = 0
    while at < len(begins):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + tv.BLOCK, "right")))
        size = ends[at:to] - begins[at:to]
        cuts = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(cuts, size)
        value = tv.mix((place.astype(np.uint64) << np.uint64(8)) + data[np.repeat(begins[at:to], size) + place] + np.uint64(0x9FB21C651E98DF25))
        out[at:to] = np.add.reduceat(value, cuts)
        at = to
    return out


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, pos, h, g (two hashes of the line), ahead: length of the shortest run of enough words that begins at the line; 0: none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, starts in tv.chunks(batch.column(1)):
                begins, ends, rows, words = _worded(data, starts)
                if not len(begins):
                    continue
                first = np.searchsorted(rows, rows)  # of the line's row
                last = np.searchsorted(rows, rows, "right")
                upto = np.cumsum(words)
                before = upto - words
                at = np.arange(len(begins))
                to = np.searchsorted(upto, before + min_words)  # the run [at, to] has enough
                take = pa.array(rows + row)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), pa.array((at - first).astype(np.int32)), pa.array(tv.span_hashes(data, begins, ends).view(np.int64)), pa.array(_second_hashes(data, begins, ends).view(np.int64)),
                    pa.array(np.where(to < last, to - at + 1, 0).astype(np.int32)),
                ], names=["doc", "pos", "h", "g", "ahead"])

    return docs.mapInArrow(run, "doc bigint, pos int, h bigint, g bigint, ahead int").distinct()


def _met(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows with the columns that groups has for their keys; c of groups counts the rows of a key, total those of all."""
    common, rest = groups.filter(F.col("c") > COMMON * total).drop("c"), groups.filter(F.col("c") <= COMMON * total).drop("c")
    often = rows.join(F.broadcast(common), keys)  # fewer than 1 / COMMON rows
    return often.unionByName(rows.join(F.broadcast(common.select(*keys)), keys, "left_anti").join(rest, keys))


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """rows with the rank of their keys among those that occur more than once, in place of the keys; others drop out."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1")
    ranks = cut(groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()))
    total = ranks.agg(F.sum("c")).first()[0]
    return _met(rows, ranks, keys, total).drop(*keys) if total else None


def _levels(lines: DataFrame, places: DataFrame) -> list[DataFrame]:
    """For each k: ord, pos, rank of the prefix of 2^k lines of each suffix, where it occurs more than once. The first has ahead too."""
    level = _ranked(lines, ["h", "g"])
    levels = []
    while level is not None:
        level = cut(level if levels else level.join(places, "doc").select("ord", "pos", "rank", "ahead"))
        levels.append(level)
        level = level.select("ord", "pos", "rank")
        after = level.select("ord", (F.col("pos") - (1 << len(levels) - 1)).alias("pos"), F.col("rank").alias("next"))
        level = _ranked(cut(level.withColumnRenamed("rank", "this").join(after, ["ord", "pos"])), ["this", "next"])
    return levels


def _earlier(levels: list[DataFrame]) -> DataFrame:
    """ord, pos, n, first_ord, first_pos: the longest prefix of a suffix that occurs earlier, and where first; suffixes without one are absent."""
    interval = ["first_ord", "first_pos", "n"]
    state = None
    for j, level in reversed(list(enumerate(levels))):
        fresh = level.select("ord", "pos", F.lit(0).alias("n"), F.lit(-1).cast("bigint").alias("first_ord"), F.lit(-1).alias("first_pos"), "rank")
        rows, origins = fresh, None
        if state is not None:
            at = level.select(F.col("ord").alias("at"), F.col("pos").alias("end"), "rank")
            known = state.join(at, (state.ord == at["at"]) & (state.pos + state.n == at.end), "left").drop("at", "end")
            rows = fresh.join(state.select("ord", "pos"), ["ord", "pos"], "left_anti").unionByName(known)
            origins = state.select(*interval).distinct()
            origins = origins.join(at, (origins.first_ord == at["at"]) & (origins.first_pos + origins.n == at.end)).drop("at", "end")
        rows = cut(rows)
        narrowed = rows.filter("rank is not null")
        members = narrowed.select(*interval, "rank", F.struct("ord", "pos").alias("least"), F.lit(1).alias("c"))
        if origins is not None:
            members = members.unionByName(origins.select(*interval, "rank", F.struct(F.col("first_ord").alias("ord"), F.col("first_pos").alias("pos")).alias("least"), F.lit(0).alias("c")))
        groups = cut(members.groupBy(*interval, "rank").agg(F.min("least").alias("least"), F.sum("c").alias("c")).filter("c > 0"))
        total = groups.agg(F.sum("c")).first()[0] or 0
        shared = F.col("least") < F.struct("ord", "pos")
        narrowed = _met(narrowed, groups, [*interval, "rank"], total).select(
            "ord", "pos", F.when(shared, F.col("n") + (1 << j)).otherwise(F.col("n")).alias("n"),
            F.when(shared, F.col("least.ord")).otherwise(F.col("first_ord")).alias("first_ord"), F.when(shared, F.col("least.pos")).otherwise(F.col("first_pos")).alias("first_pos"),
        )
        state = cut(narrowed.unionByName(rows.filter("rank is null").drop("rank")).filter("n > 0"))
    return state


def _copies(docs: DataFrame, min_words: int, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, doc, ord) of each distinct document, and (ord, pos, n, first_ord, first_pos, maximal, enough) of each line that occurs earlier."""
    slim = docs.select(F.col(id).alias("id"), F.xxhash64(id, text).alias("doc"), F.col(text).alias("text"))
    places = cut(slim.filter("text is not null").select("id", "doc").distinct().repartitionByRange("id", "doc").sortWithinPartitions("id", "doc").withColumn("ord", F.monotonically_increasing_id()))
    levels = _levels(cut(_lines(slim.select("doc", "text"), min_words)), places.select("doc", "ord"))
    if not levels:
        return places, docs.sparkSession.createDataFrame([], "ord bigint, pos int, n int, first_ord bigint, first_pos int, maximal boolean, enough boolean")
    before = F.lag(F.struct("pos", "n")).over(Window.partitionBy("ord").orderBy("pos"))
    held = (before["pos"] == F.col("pos") - 1) & (before["n"] > F.col("n"))
    found = _earlier(levels).join(levels[0].select("ord", "pos", "ahead"), ["ord", "pos"])
    found = found.withColumn("maximal", ~F.coalesce(held, F.lit(False))).withColumn("enough", F.col("ahead").between(1, F.col("n"))).drop("ahead")
    return places, found


def maximal_runs(docs: DataFrame, min_words: int = MIN_WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, start, n, first_id, first_start: each run of n lines that occurs earlier, of enough words, which no longer such run of its text holds.

    Lines with a word are numbered from 0. first_id and first_start tell where the run occurs first.
    """
    places, found = _copies(docs, min_words, id, text)
    kept = cut(found.filter("maximal and enough").join(places.select("ord", "id"), "ord"))
    origins = kept.groupBy("first_ord").agg(F.count("*").alias("c")).join(places.select(F.col("ord").alias("first_ord"), F.col("id").alias("first_id")), "first_ord")
    return _met(kept, origins, ["first_ord"], kept.count()).select("id", F.col("pos").alias("start"), "n", "first_id", F.col("first_pos").alias("first_start"))


def runs(docs: DataFrame, min_words: int = MIN_WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc (a hash of id and text), deleted: sorted array of the numbers, among lines with a word, of lines to delete: those of the maximal runs."""
    places, found = _copies(docs, min_words, id, text)
    reach = F.max(F.expr("case when maximal and enough then pos + n end")).over(Window.partitionBy("ord").orderBy("pos"))
    gone = found.withColumn("reach", reach).filter("reach > pos").groupBy("ord").agg(F.array_sort(F.collect_list("pos")).alias("deleted"))
    return gone.join(places, "ord").select("doc", "deleted")


def _without(text: bytes, deleted: list[int]) -> str:
    gone, kept, number = set(deleted), [], 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            number += 1
            if number - 1 in gone:
                continue
        kept.append(line)
    return b"\n".join(kept).decode()


def _applied(docs: DataFrame, min_words: int, id: str, text: str, prefix: str) -> DataFrame:
    """docs with the text replaced, and with the numbers of lines with a word before and of deleted ones, named with the prefix."""
    found = cut(runs(docs, min_words, id, text)).select(F.col("doc").alias(f"{prefix}doc"), F.col("deleted").alias(f"{prefix}deleted"))
    marked = docs.withColumn(f"{prefix}key", F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`")))
    marked = possible(marked, f"{prefix}key", found, f"{prefix}doc", f"{prefix}possible")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = marked.filter(~F.col(f"{prefix}possible")).select(*columns, F.lit(None).cast("array<int>").alias(f"{prefix}deleted"))
    joined = marked.filter(f"{prefix}possible").join(found, F.col(f"{prefix}key") == F.col(f"{prefix}doc"), "left").select(*columns, f"{prefix}deleted")
    joined = whole.unionByName(joined)
    at, names = docs.columns.index(text), [*docs.columns, f"{prefix}n_lines", f"{prefix}n_deleted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for row, data, starts in tv.chunks(batch.column(at)):
                counts[row : row + len(starts) - 1] = np.bincount(_worded(data, starts)[2], minlength=len(starts) - 1)
            deleted = batch.column(len(names) - 2).to_pylist()
            texts = batch.column(at)
            if any(deleted):
                texts = pa.array([_without(t.as_buffer().to_pybytes(), d) if d else t.as_py() for t, d in zip(texts, deleted)], texts.type)
            columns = batch.columns[: len(names) - 2]
            columns[at] = texts
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array([len(d or ()) for d in deleted], pa.int64())], names=names)

    return joined.mapInArrow(run, extended(docs, f"`{prefix}n_lines` bigint, `{prefix}n_deleted` bigint"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, text without the later copies, n_lines (with a word, before), n_deleted."""
    out = _applied(docs.select(F.col(id).alias(id), F.col(text).alias(text)), min_words, id, text, "_")
    return out.select(id, text, F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"))


def deduped(docs: DataFrame, min_words: int = MIN_WORDS, id: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """docs, all columns, with deduplicated texts; rows all of whose lines were later copies go. `chars` is set to the new length."""
    prefix = "_line_dedup_"
    out = _applied(docs, min_words, id, text, prefix).filter(f"{prefix}n_deleted = 0 or {prefix}n_deleted < {prefix}n_lines")
    columns = [F.when(F.col(f"{prefix}n_deleted") > 0, F.length(f"`{text}`")).otherwise(F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c) if c == chars else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)


def sql(docs: str = "documents", min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for line_dedup(); every run of enough words is compared as text."""
    return f"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r FROM (SELECT DISTINCT doc_id, text FROM {docs})),
al AS (SELECT r, unnest(ls) AS l, generate_subscripts(ls, 1) AS nr FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d)),
wl AS (SELECT r, nr, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS w, row_number() OVER (PARTITION BY r ORDER BY nr) AS p FROM al WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
cu AS (SELECT *, sum(w) OVER (PARTITION BY r ORDER BY p) AS upto FROM wl),
ag AS (SELECT r, list(l ORDER BY p) AS ls, list(upto ORDER BY p) AS us FROM cu GROUP BY r),
ah AS (SELECT r, p, upto - w AS before, upto FROM cu),
wi AS (SELECT r, s, e, array_to_string(ls[s:e], chr(10)) AS body FROM ag JOIN (
    SELECT a.r, a.p AS s, min(b.p) AS e FROM ah a JOIN ah b ON a.r = b.r AND b.p >= a.p AND b.upto >= a.before + {min_words} GROUP BY 1, 2
    UNION SELECT b.r, max(a.p), b.p FROM ah a JOIN ah b ON a.r = b.r AND b.p >= a.p AND b.upto >= a.before + {min_words} GROUP BY b.r, b.p) USING (r)),
la AS (SELECT r, s, e FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY r, s) AS k FROM wi) WHERE k > 1),
go AS (SELECT DISTINCT r, unnest(range(s, e + 1)) AS p FROM la),
ke AS (SELECT r, string_agg(l, chr(10) ORDER BY nr) AS text FROM (SELECT al.r, al.nr, al.l FROM al LEFT JOIN wl USING (r, nr) LEFT JOIN go ON go.r = wl.r AND go.p = wl.p WHERE go.p IS NULL) GROUP BY r),
nl AS (SELECT r, count(*) AS n FROM wl GROUP BY r), ng AS (SELECT r, count(*) AS n FROM go GROUP BY r)
SELECT x.doc_id, CASE WHEN x.text IS NULL THEN NULL ELSE coalesce(ke.text, '') END AS text, coalesce(nl.n, 0)::BIGINT AS n_lines, coalesce(ng.n, 0)::BIGINT AS n_deleted
FROM {docs} x JOIN d ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text IS NOT DISTINCT FROM x.text LEFT JOIN ke USING (r) LEFT JOIN nl USING (r) LEFT JOIN ng USING (r)"""
