"""SimHash near-dedup: connected groups of documents whose fingerprints differ in few bits.

A fingerprint has one bit for each bit of a 64-bit hash: set if more than half of the text's word shingles
(repeats included) have it. All pairs of distinct fingerprints are compared exactly, in tiles, by
exclusive-or and bit counts in numpy. A tile holds fingerprints of equal population counts in both halves; two
tiles are skipped if these counts differ by more than the radius in sum, since each differing bit changes one
count by one. Within a task large tiles are cut again by the counts of quarters and bytes, with the same rule.

Tiles of more than TILE_ROWS fingerprints are cut by a hash, so a task holds two bounded tiles at most. A
task returns one link for each fingerprint that it moved to a group, never the pairs of a group. The
work still grows with the square of the distinct fingerprints, by the share that the counts don't skip.

Defined results: null, empty and wordless texts have the fingerprint 0 and link like any other; a text of
fewer words than the width is one shingle; repeated rows and rows of one id give one row each; null ids
are passed by when the smallest id is taken; an empty table gives an empty result; columns other than id
and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv
from .common import cut
from .graph import components

WIDTH, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile; pairs compared at once; pairs that a cut of a tile must save work for.
TILE_ROWS = 1 << 17
PAIRS = 1 << 20
WORTH = 1 << 12
#: Byte k of an entry is bit k of its number: eight counters in one word.
_LANES = (((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)) << (np.uint64(8) * np.arange(8, dtype=np.uint64))).sum(1, dtype=np.uint64)


def _shingles(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows with one space behind each, and begin, end and row of each shingle in it, by row."""
    begins, ends, rows = tv.tokens(data, starts, tv.BLANKS)
    size = ends - begins
    at = np.cumsum(size + 1) - size - 1
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    joined[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = data[~tv.BLANKS[data]]
    n = len(rows)
    full = np.flatnonzero(rows[: max(0, n - width + 1)] == rows[width - 1 :])
    row, first, count = np.unique(rows, return_index=True, return_counts=True)
    short = count < width
    low, high, of = np.append(full, first[short]), np.append(full + width - 1, (first + count - 1)[short]), np.append(rows[full], row[short])
    order = np.argsort(of, kind="stable")
    low, high = low[order], high[order]
    return joined.tobytes(), at[low], at[high] + size[high], of[order]


def _majority(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows, the bits that more than half of its hashes have; rows are in order."""
    out = np.zeros(n, np.uint64)
    if len(hashes):
        found, first, total = np.unique(rows, return_index=True, return_counts=True)
        place = np.arange(len(rows)) - np.repeat(first, total)
        runs = np.flatnonzero(place % 255 == 0)  # a counter of eight bits holds 255
        owner = np.searchsorted(rows[runs], found)
        octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, k]], runs).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
            bits = 2 * np.add.reduceat(lanes, owner) > total[:, None]
            out[found] |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(8 * k)
    return out


def prints_of(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of each text."""
    found = [np.zeros(0, np.uint64)]
    for _, data, starts in tv.chunks(column):
        text, begins, ends, rows = _shingles(tv.LOWER[data], starts, width)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(text[b:e], SEED) for b, e in zip(begins.tolist(), ends.tolist())), np.uint64, len(begins))
        found.append(_majority(hashes, rows, len(starts) - 1))
    return np.concatenate(found)


def _counts(x: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of so many equal parts of each fingerprint."""
    return np.bitwise_count(x.view(f"u{8 // parts}").reshape(-1, parts)).astype(np.int16)


def _tiles(x: np.ndarray, rows: np.ndarray, parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    counts, tile = np.unique(_counts(x[rows], parts), axis=0, return_inverse=True)
    order = np.argsort(tile.ravel(), kind="stable")
    return counts, np.split(rows[order], np.cumsum(np.bincount(tile.ravel()))[:-1])


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a and b, pairwise; a root is the least member, and every member points to it."""
    while len(a):
        u, v = root[a], root[b]
        apart = u != v
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while (root[root] != root).any():
            root[:] = root[root]


def _compare(x: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, radius: int, parts: int, root: np.ndarray) -> None:
    """Join in root what of the tiles left and right lies within the radius. same: they are one tile."""
    if parts <= 8 and len(left) * len(right) > PAIRS:
        of_left, lefts = _tiles(x, left, parts)
        of_right, rights = (of_left, lefts) if same else _tiles(x, right, parts)
        if len(lefts) * len(rights) * WORTH <= len(left) * len(right):
            apart = np.zeros((len(lefts), len(rights)), np.int16)
            for k in range(parts):
                apart += np.abs(of_left[:, k, None] - of_right[None, :, k])
            for i, j in np.argwhere(apart <= radius).tolist():
                if not same or i <= j:
                    _compare(x, lefts[i], rights[j], same and i == j, radius, 2 * parts, root)
            return
    step = max(1, PAIRS // max(1, len(right)))
    for first in range(0, len(left), step):
        rows = left[first : first + step]
        i, j = np.nonzero(np.bitwise_count(x[rows][:, None] ^ x[right]) <= radius)
        _unite(root, rows[i], right[j])


def links_of(x: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint, the place of the first of its group; sides 0 and 1 are compared with each other, rows of side -1 among themselves."""
    root, own = np.arange(len(x)), np.flatnonzero(side < 0)
    left, right = (own, own) if len(own) else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    _compare(x, left, right, bool(len(own)), radius, 4, root)
    return root


def fingerprints(docs: DataFrame, width: int = WIDTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, print (64 bits as bigint), one row per input row."""
    slim = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints_of(batch.column(1), width).view(np.int64))], names=["id", "print"])

    return slim.mapInArrow(run, StructType([slim.schema["id"], *StructType.fromDDL("print bigint").fields]))


def _links(prints: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """a, b: distinct fingerprints of one group, as the tasks found them."""
    upper, lower = F.bit_count(F.shiftrightunsigned("print", 32)), F.bit_count(F.col("print").bitwiseAND(0xFFFFFFFF))
    prints = prints.select("print", upper.cast("int").alias("hi"), lower.cast("int").alias("lo"))
    # A row for each pair of counts: 33 * 33 at most, each with the counts within the radius.
    sizes = prints.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    other = sizes.select(F.col("hi").alias("hi2"), F.col("lo").alias("lo2"), F.col("parts").alias("parts2"))
    near = sizes.join(F.broadcast(other), F.abs(F.col("hi") - F.col("hi2")) + F.abs(F.col("lo") - F.col("lo2")) <= radius)
    near = near.groupBy("hi", "lo", "parts").agg(F.collect_list(F.struct("hi2", "lo2", "parts2")).alias("near"))
    dealt = prints.join(F.broadcast(near), ["hi", "lo"]).withColumn("part", F.pmod(F.xxhash64("print"), "parts").cast("int"))
    dealt = dealt.select("print", "hi", "lo", "part", F.inline("near")).withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    own, met = F.struct("hi", "lo", "part"), F.struct(F.col("hi2").alias("hi"), F.col("lo2").alias("lo"), F.col("part2").alias("part"))
    side = F.when(own == met, -1).when(own < met, 0).otherwise(1).cast("int")
    dealt = dealt.select(F.xxhash64(F.least(own, met), F.greatest(own, met)).alias("task"), side.alias("side"), "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: np.ndarray) -> pa.RecordBatch:
            x = rows[2].view(np.uint64)
            root = links_of(x, rows[1], radius)
            moved = np.flatnonzero(root != np.arange(len(x)))
            return pa.RecordBatch.from_arrays([pa.array(rows[2][moved]), pa.array(rows[2][root[moved]])], names=["a", "b"])

        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            if not rows.shape[1]:
                continue
            *done, last = np.split(rows, np.flatnonzero(np.diff(rows[0])) + 1, axis=1)
            for piece in [*done, last]:
                if held and held[0][0, 0] != piece[0, 0]:
                    yield flush(np.ascontiguousarray(np.concatenate(held, 1)))
                    held = []
                held.append(piece)
        if held:
            yield flush(np.ascontiguousarray(np.concatenate(held, 1)))

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a bigint, b bigint")


def near_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, id: str = "doc_id", text: str = "text", tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    prints = cut(fingerprints(docs, width, id, text))
    classes = cut(prints.groupBy("print").agg(F.min("id").alias("id")))
    labels = components(cut(_links(classes, radius, tile_rows)))
    group = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = group.groupBy("component").agg(F.min("id").alias("component_id"))
    named = group.join(least, "component").select("print", "component_id")
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return prints.join(named, "print").select(F.col("id").alias(id), digits.alias("fingerprint"), "component_id")
