"""Ranked lexical search: a hierarchical max tree over document ranges per term, searched best first.

`build` writes an index of all documents: one row for each segment of at most SEGMENT_DOCS rows, with its
postings by term. Rows are megabytes long, so their arrays are compressed in the tasks, and Spark writes, reads and hands
them over SEGMENTS_AT_ONCE at a time: its memory doesn't depend on how many segments a file or a task has. `search` takes the queries in blocks of bounded size; the block is broadcast, the index
isn't. For a block and a segment, each term has the exact impact of every document, and a tree of maxima
over ranges of 16, 256 and so on documents. The bound of a node, for one item, is the sum of its terms'
weighted maxima. The node of the highest bound is opened first; the search of a segment ends when no
bound reaches the item's last score. Nodes whose bound equals it are opened, since a smaller id may be there.
A task keeps an item's best results over all its segments, so that later segments begin with a high threshold,
and returns them once; a window ranks what the tasks found. All scores are integers.

Defined results: null and empty texts have no terms and are counted nowhere; an item without terms, or whose
terms no document has, has no rows; rows of one item id are one item; repeated document rows are documents of
their own and may follow each other; null ids come first among equal scores; empty tables give an empty result;
columns other than id and text are not read. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from . import textvec as tv
from .common import cut

BEST = 50
FAN = 16
#: Rows and bytes of text of a segment; it ends when it has reached either.
SEGMENT_DOCS = 2048
SEGMENT_BYTES = 8 << 20
#: Segments of a row group of the index's files and of a batch of the tasks that read them.
SEGMENTS_AT_ONCE = 2
#: How the index is written: its arrays are compressed already, and too long for dictionaries.
WRITE = {"compression": "uncompressed", "parquet.block.row.count.limit": SEGMENTS_AT_ONCE, "parquet.enable.dictionary": "false"}
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Pairs of item and term of a block of queries, about; a segment's impacts take four bytes for each of its terms and documents.
BLOCK_TERMS = 8192


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, row of each term, term hashes, and rows of each chunk of texts."""
    for row, data, starts in tv.chunks(column):
        lower = tv.LOWER[data]
        begins, ends, rows = tv.tokens(lower, starts, tv.NON_WORD)
        yield row, rows, tv.span_hashes(lower, begins, ends), len(starts) - 1


def _packed(x: np.ndarray) -> bytes:
    """An array's bytes, compressed, after their number."""
    return x.nbytes.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x), "zstd", asbytes=True)


def _unpacked(blob: pa.BinaryScalar) -> pa.Buffer:
    """The bytes of the array that _packed() was given."""
    whole = blob.as_buffer()
    return pa.decompress(whole.slice(8), int.from_bytes(whole.slice(0, 8).to_pybytes(), "little"), "zstd")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile hand SEGMENTS_AT_ONCE rows at a time to Python."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(SEGMENTS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def build(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index, written to the shared folder: ids, lens (terms of each row), terms, cuts, places, tfs, n_docs, n_terms of each segment."""
    slim = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, hashes, n, size = [], [], [], 0, 0

        def segment() -> pa.RecordBatch:
            row, term = np.concatenate(rows), np.concatenate(hashes)
            lens = np.bincount(row, minlength=n)
            order = np.argsort(term, kind="stable")  # rows stay in order within a term
            row, term = row[order], term[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            tfs = np.diff(np.append(at, len(term)))
            found, first = np.unique(term[at], return_index=True)
            blobs = [lens.astype(np.int64), found, np.append(first, len(at)).astype(np.int64), row[at].astype(np.int32), tfs.astype(np.int64)]
            own = pa.concat_arrays(ids)
            columns = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), own), *(pa.array([_packed(x)], pa.binary()) for x in blobs), pa.array([int((lens > 0).sum())]), pa.array([int(lens.sum())])]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "lens", "terms", "cuts", "places", "tfs", "n_docs", "n_terms"])

        for batch in batches:
            for at in range(0, batch.num_rows, SEGMENT_DOCS // 4):
                piece = batch.slice(at, SEGMENT_DOCS // 4)
                for first, row, term, count in _terms(piece.column(1)):
                    ids.append(piece.column(0).slice(first, count))
                    rows.append(row + n)
                    hashes.append(term)
                    n, size = n + count, size + 8 * len(term)
                    if n > SEGMENT_DOCS * 3 // 4 or size >= SEGMENT_BYTES:
                        yield segment()
                        ids, rows, hashes, n, size = [], [], [], 0, 0
        if n:
            yield segment()

    schema = StructType([StructField("ids", ArrayType(slim.schema["id"].dataType)), *StructType.fromDDL("lens binary, terms binary, cuts binary, places binary, tfs binary, n_docs bigint, n_terms bigint").fields])
    return cut(slim.mapInArrow(run, schema), **WRITE)


def _item_terms(items: DataFrame) -> DataFrame:
    """item, term (hash): each term of an item once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, row, term, _ in _terms(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + first)), pa.array(term.view(np.int64))], names=["item", "term"])

    return items.mapInArrow(run, StructType([items.schema["item"], *StructType.fromDDL("term bigint").fields])).distinct()


def _frequencies(index: DataFrame, wanted) -> DataFrame:
    """term, df of the wanted terms (a broadcast sorted array) that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, cuts in zip(batch.column(0), batch.column(1)):
                found, at, _ = np.intersect1d(np.frombuffer(_unpacked(terms), np.uint64), wanted.value, assume_unique=True, return_indices=True)
                df = np.diff(np.frombuffer(_unpacked(cuts), np.int64))[at]
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(df)], names=["term", "df"])

    return index.select("terms", "cuts").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


class _Tree:
    """Impacts of a segment's documents for the terms of a block, and their maxima over ranges, level by level."""

    def __init__(self, row: dict, wanted: np.ndarray, n_docs: int, n_terms: int):
        lens = np.frombuffer(row["lens"], np.int64)
        m = 50 + 50 * lens * n_docs // n_terms
        terms, cuts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["cuts"], np.int64)
        _, at, self.terms = np.intersect1d(terms, wanted, assume_unique=True, return_indices=True)
        size = (cuts[1:] - cuts[:-1])[at]
        posting = np.arange(size.sum()) + np.repeat(cuts[at] - np.cumsum(size) + size, size)
        place, tf = np.frombuffer(row["places"], np.int32)[posting], np.frombuffer(row["tfs"], np.int64)[posting]
        width = max(FAN, -(-len(lens) // FAN) * FAN)
        leaves = np.zeros((len(at), width), np.int32)  # an impact is below 1,000,000
        leaves[np.repeat(np.arange(len(at)), size), place] = 1_000_000_000 * tf // (1000 * tf + 20 * m[place])
        self.levels = [leaves]
        while self.levels[-1].shape[1] > FAN:
            last = self.levels[-1]
            padded = np.pad(last, ((0, 0), (0, -last.shape[1] % FAN))) if last.shape[1] % FAN else last
            self.levels.append(padded.reshape(len(at), -1, FAN).max(2))

    def search(self, rows: np.ndarray, weights: np.ndarray, ids: list, best: list, k: int) -> None:
        """Put into best, a list of (-score, id key, id) in order, what of the segment belongs to the first k."""

        def bounds(level: int, first: int) -> np.ndarray:
            return weights @ self.levels[level][rows, first : first + FAN].astype(np.int64)

        top = len(self.levels) - 1
        found = bounds(top, 0)
        heap = [(-int(b), top, i) for i, b in enumerate(found) if b > 0]
        heapify(heap)
        while heap:
            bound, level, node = heappop(heap)
            if len(best) == k and bound > best[-1][0]:
                break
            if level:
                found = bounds(level - 1, node * FAN)
                least = -best[-1][0] if len(best) == k else 1
                for i in np.flatnonzero(found >= least):
                    heappush(heap, (-int(found[i]), level - 1, node * FAN + int(i)))
            else:
                id = ids[node]
                entry = (bound, (id is not None, id), id)
                if len(best) < k or entry[:2] < best[-1][:2]:
                    insort(best, entry, key=lambda e: e[:2])
                    del best[k:]


def _searched(index: DataFrame, block, stats: tuple[int, int], k: int, schema: StructType) -> DataFrame:
    """item, id, score: the best of each task for each item of the block (broadcast: items, cuts, terms of all, weights of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, cuts, terms, weights = block.value
        wanted, code = np.unique(terms, return_inverse=True)
        best: list[list] = [[] for _ in range(len(items))]
        kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                row = {name: _unpacked(batch.column(name)[i]) for name in ("lens", "terms", "cuts", "places", "tfs")}
                ids = batch.column("ids")[i].as_py()
                tree = _Tree(row, wanted, *stats)
                place = np.full(len(wanted), -1)
                place[tree.terms] = np.arange(len(tree.terms))
                for item in range(len(items)):
                    own = slice(cuts[item], cuts[item + 1])
                    at = place[code[own]]
                    here = at >= 0
                    if here.any():
                        tree.search(at[here], weights[own][here], ids, best[item], k)
        if kind is not None:
            of = pa.array(np.repeat(np.arange(len(items)), [len(b) for b in best]))
            flat = [e for b in best for e in b]
            yield pa.RecordBatch.from_arrays([items.take(of), pa.array([e[2] for e in flat], kind), pa.array([-e[0] for e in flat], pa.int64())], names=["item", "id", "score"])

    return index.select("ids", "lens", "terms", "cuts", "places", "tfs").mapInArrow(run, schema)


def search(index: DataFrame, items: DataFrame, k: int = BEST, item: str = "item_id", text: str = "text", id: str = "doc_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item, rank (from 1), id, score: the k best documents of each item, of those with a score above 0; equal scores by id."""
    context = index.sparkSession.sparkContext
    queries = cut(_item_terms(items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text"))))
    stats = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    blocks = -(-queries.count() // block_terms)
    schema = StructType([queries.schema["item"], StructField("id", index.schema["ids"].dataType.elementType), *StructType.fromDDL("score bigint").fields])
    found = index.sparkSession.createDataFrame([], schema)
    for number in range(blocks if stats[1] else 0):
        block = queries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == number)
        wanted = context.broadcast(np.unique(block.select("term").distinct().toArrow()["term"].to_numpy().view(np.uint64)))
        weight = F.floor(1000 * F.log((2.0 * F.lit(stats[0]) + 2) / (2 * F.col("df") + 1)))
        with _small_batches(index.sparkSession):
            rows = block.join(_frequencies(index, wanted), "term").withColumn("weight", weight.cast("bigint")).orderBy("item").toArrow()
        if not rows.num_rows:
            continue
        own = rows["item"].combine_chunks()
        codes = own.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cuts = np.append(np.flatnonzero(np.append(True, codes[1:] != codes[:-1])), len(codes))
        sent = context.broadcast((own.take(pa.array(cuts[:-1])), cuts, rows["term"].to_numpy().view(np.uint64), rows["weight"].to_numpy()))
        with _small_batches(index.sparkSession):
            found = found.unionByName(cut(_searched(index, sent, tuple(stats), k, schema)))
        sent.unpersist()
        wanted.unpersist()
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score")


def sql(docs: str = "documents", items: str = "benchmark", k: int = BEST) -> str:
    """DuckDB SQL for search()."""

    def words(column: str) -> str:
        return f"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS ws FROM {docs}),
s AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({words("text")}) AS term FROM {items}),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), s),
x AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM x WHERE score > 0) WHERE rank <= {k}"""
