"""N-gram Jaccard join: connected groups of documents whose sets of word shingles are similar.

Documents of equal sets are one class, found by a 64-bit signature of the set. Two classes can only
reach the similarity if the first elements of their sets, in one common order, meet: the prefix
(all but the overlap that the size demands, plus one). The order puts widely shared shingles last, so
prefixes hold rare ones. Prefixes of two similar sets share a number of elements that follows from the
sizes (`_least_common`); the incidence of prefix shingles tells which classes can reach it.

What is left is compared by a blocked product of the sparse document by shingle matrix with its
transpose. Classes are dealt to blocks of bounded size, those of a common shingle together. First each
block is multiplied with itself, and the classes found similar are joined. Then a class is compared with
another block only if it shares prefix shingles with classes there that aren't in its group yet, often
enough for the size bound. Each product adds up overlaps over column slices, gives up pairs that can't
reach the overlap any more, and returns for each class one link to the group it fell in within the
product: rows grow with the classes, not with the pairs of a group. No pair of unlike groups is passed by.

Defined results: null, empty or wordless texts have an empty set and link with nothing; a text of
fewer words than the width is one shingle; repeated rows and rows of one id give one row each; null
ids are passed by when the smallest id is taken; an empty table gives an empty result; columns other
than id and text are not read. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv
from .common import cut, possible
from .graph import components

WIDTH, PERCENT = 5, 75
#: So many of the most shared shingles are put last; a fixed bound of what is broadcast. It changes speed, never results.
SHARED = 400_000
#: A shingle is a candidate for these if it occurs so often in one part of the texts of PART_BYTES.
LOCAL = 4
PART_BYTES = 24 << 20
#: Prefix elements that one task of the incidence takes.
BLOCK_KEYS = 2_000_000
#: Classes and shingles of a block of the product; classes of one key that are met at once.
BLOCK_ROWS = 256
BLOCK_SIZE = 500_000
CELL_ROWS = 2048
#: Rows that a task meets at once, and asks it holds before it adds them up.
MET_ROWS = 200_000
ASKS = 2_000_000
COLUMNS = 4096
BIG = 1 << 40
U64 = np.uint64


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, starts in tv.chunks(column):
        n = len(starts) - 1
        begins, ends, rows = tv.tokens(tv.LOWER[data], starts, tv.BLANKS)
        words = tv.span_hashes(tv.LOWER[data], begins, ends)
        found, first = tv.windows(words, rows, width)
        counts = np.bincount(rows, minlength=n)
        at = np.concatenate([[0], np.cumsum(counts)])
        cuts = np.searchsorted(rows[first], np.arange(n + 1))
        for i in range(n):
            if counts[i] >= width:
                yield np.unique(found[cuts[i] : cuts[i + 1]])
            elif counts[i]:
                total = np.full(1, counts[i], U64) * U64(0x8EBC6AF09C88C6E3)
                for h in words[at[i] : at[i + 1]]:
                    total = tv.mix(total * U64(0xA0761D6478BD642F) + h)
                yield total
            else:
                yield np.zeros(0, U64)


def signature(s: np.ndarray) -> int | None:
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        mixed = tv.mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) * U64(0xD6E8FEB86659FD93) + U64(len(s))
    return int(tv.mix(np.array([mixed], U64)).view(np.int64)[0])


def needed(n: int | np.ndarray, percent: int):
    """The least overlap of a set of n elements with any similar one."""
    return (percent * n + 99) // 100


class _Order:
    """The common order: shared shingles last, the most shared at the very end; others by hash."""

    def __init__(self, shared: np.ndarray):
        self.sorted = np.sort(shared)
        self.rank = np.argsort(shared).astype(U64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        keys = s >> U64(1)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, s), len(self.sorted) - 1)
            hit = self.sorted[at] == s
            keys[hit] = (U64(1) << U64(63)) + self.rank[at[hit]]
        return keys


def _classes(docs: DataFrame, width: int) -> DataFrame:
    """id, n and sig of each row; on some rows, the locally frequent shingles (hashes and counts) of a part of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        size = 0

        def frequent() -> bytes | None:
            if not pending:
                return None
            s, c = np.unique(np.concatenate(pending), return_counts=True)
            pending.clear()
            return np.rec.fromarrays([s[c >= LOCAL], c[c >= LOCAL]], dtype=[("s", "<u8"), ("c", "<i8")]).tobytes()

        for batch in batches:
            n, sig, hot = [], [], []
            for i, s in enumerate(shingle_sets(batch.column(1), width)):
                n.append(len(s))
                sig.append(signature(s))
                pending.append(s)
                size += len(s) * 8
                full = size >= PART_BYTES
                hot.append(frequent() if full else None)
                size = 0 if full else size
            if hot:  # the rest of this batch
                hot[-1] = hot[-1] or frequent()
                size = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(hot, pa.binary())], names=["id", "n", "sig", "hot"])

    return docs.mapInArrow(run, StructType([docs.schema["id"], *StructType.fromDDL("n bigint, sig bigint, hot binary").fields]))


def _shared(classes: DataFrame, limit: int) -> np.ndarray:
    """The most shared shingles, the least shared of them first; at most `limit`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                x = np.frombuffer(blob, [("s", "<u8"), ("c", "<i8")])
                yield pa.RecordBatch.from_arrays([pa.array(x["s"].view(np.int64)), pa.array(x["c"])], names=["s", "c"])

    counts = classes.filter("hot is not null").select("hot").mapInArrow(run, "s bigint, c bigint").groupBy("s").agg(F.sum("c").alias("c"))
    top = counts.filter(F.col("c") >= 4 * LOCAL).orderBy(F.desc("c"), "s").limit(limit).select("s").toArrow()["s"].to_numpy()
    return np.ascontiguousarray(top[::-1]).view(U64)


def _incidence(docs: DataFrame, shared: np.ndarray, blocks: int, width: int, percent: int) -> DataFrame:
    """key, sig, m: prefix shingles that at least two classes have, and how many have them. Travels as packed arrays, one row for each part and block."""
    order = docs.sparkSession.sparkContext.broadcast(shared)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _Order(order.value)
        keys, sigs, size = [], [], 0

        def packed() -> pa.RecordBatch:
            k, s = np.concatenate(keys), np.repeat(np.array([x for x, _ in sigs], np.int64), [c for _, c in sigs])
            keys.clear(), sigs.clear()
            block = (tv.mix(k) % U64(blocks)).astype(np.int64)
            at = np.lexsort((s, k, block))
            k, s, block = k[at], s[at], block[at]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            k, s, block = k[new], s[new], block[new]
            which, cuts = np.unique(block, return_index=True)
            ends = [*cuts[1:], len(k)]
            return pa.RecordBatch.from_arrays([pa.array(which), pa.array([k[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([s[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())], names=["block", "keys", "sigs"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), width):
                if len(s):
                    most = len(s) - needed(len(s), percent) + 1
                    k = by.keys(s)
                    keys.append(np.sort(np.partition(k, most - 1)[:most]))
                    sigs.append((signature(s), most))
                    size += most * 16
                    if size >= PART_BYTES:
                        yield packed()
                        size = 0
        if keys:
            yield packed()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for block, k, s in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(block, []).append((k, s))
        while parts:
            _, rows = parts.popitem()
            k = np.concatenate([np.frombuffer(x, U64) for x, _ in rows])
            s = np.concatenate([np.frombuffer(x, np.int64) for _, x in rows])
            at = np.argsort(k, kind="stable")
            k, s = k[at], s[at]
            again = np.zeros(len(k), bool)  # keys of one row are of one class
            same = k[1:] == k[:-1]
            again[1:] |= same
            again[:-1] |= same
            k, s = k[again], s[again]
            at = np.lexsort((s, k))
            k, s = k[at], s[at]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
            k, s = k[new], s[new]
            _, which, count = np.unique(k, return_inverse=True, return_counts=True)
            keep = count[which] > 1
            k, s, m = k[keep], s[keep], count[which][keep]
            for i in range(0, len(k), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 17)].view(np.int64)), pa.array(s[i : i + (1 << 17)]), pa.array(m[i : i + (1 << 17)])], names=["key", "sig", "m"])

    rows = docs.select("text").mapInArrow(pack, "block bigint, keys binary, sigs binary")
    return rows.repartition(blocks, "block").mapInArrow(unpack, "key bigint, sig bigint, m bigint")


def _least_common(n, m, percent: int):
    """How many prefix elements two similar sets of n and m elements share at least.

    Of the set whose prefix ends first in the order, every prefix element that the other set has lies
    in the other's prefix; what lies beyond is fewer than the overlap that its own size demands.
    """
    return (percent * (n + m) + 99 + percent) // (100 + percent) - needed(np.maximum(n, m), percent) + 1


def _blocks(lists: DataFrame) -> DataFrame:
    """sig, block, lives: classes that share keys lie in one block where possible.

    The home of a class is the most shared of its keys. Classes of one home are dealt to blocks by a hash;
    the least of them is a guest in all of these, so that it can join what the blocks hold.
    """
    homes = lists.groupBy("sig", "n").agg(F.max(F.struct("m", "key")).alias("home")).select("sig", "n", F.col("home.key").alias("home"))
    sizes = homes.groupBy("home").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), F.min("sig").alias("pivot"))
    sizes = sizes.select("home", "pivot", F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("size") / BLOCK_SIZE)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")
    parts = F.when(F.col("sig") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    placed = homes.join(sizes, "home").select("sig", "home", own.alias("own"), F.explode(parts).alias("part"))
    return placed.select("sig", F.xxhash64("home", "part").alias("block"), (F.col("own") == F.col("part")).alias("lives"))


def _cells(cell: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one cell within the size bound; rows are sorted by cell, then by n."""
    at, step = np.arange(len(cell)), 0
    while len(at):
        step += 1
        at = at[at + step < len(cell)]
        at = at[(cell[at] == cell[at + step]) & (100 * n[at] >= percent * n[at + step])]
        yield at, at + step


def _least(x: np.ndarray) -> np.ndarray:
    """Of the columns of x with one first value, the one of the least second value."""
    x = x[:, np.lexsort((x[1], x[0]))]
    return x[:, np.append(True, x[0, 1:] != x[0, :-1])] if x.shape[1] else x


def _met(cells: DataFrame, percent: int, within: bool) -> DataFrame:
    """sig, block, asks: classes that can be similar to some of a block; asks: they don't live there.

    cells: cell, side, n, label, weight, block, sig. Rows of a cell share a key. `within`: rows of a cell are of
    one block, and meet in it. Else rows of unlike labels and blocks meet, if their sides are unlike or below 0:
    the one of less weight asks the block of the other. A class stays if it meets others in as many keys as
    the least pair needs.
    """

    def flush(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell, side, n, label, weight, block, sig = x.T
        names, code = np.unique(block, return_inverse=True)
        least = np.full(len(x), BIG)
        asks: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
        for i, j in _cells(cell, n, percent):
            if not within:
                apart = (label[i] != label[j]) & (code[i] != code[j]) & ((side[i] != side[j]) | (side[i] < 0))
                i, j = i[apart], j[apart]
            need = _least_common(n[i], n[j], percent)
            if not within:
                turn = (weight[i] > weight[j]) | ((weight[i] == weight[j]) & (block[i] > block[j]))
                i, j = np.where(turn, j, i), np.where(turn, i, j)
                asks.append(np.stack([i * len(names) + code[j], need]))
                if sum(x.shape[1] for x in asks) > ASKS:
                    asks = [_least(np.concatenate(asks, 1))]
            else:
                np.minimum.at(least, i, need)
            np.minimum.at(least, j, need)
        at = np.flatnonzero(least < BIG)
        who, need = _least(np.concatenate(asks, 1))
        columns = np.append(sig[at], sig[who // len(names)]), np.append(block[at], names[who % len(names)]), np.append(np.zeros(len(at), bool), np.ones(len(who), bool)), np.append(least[at], need)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["sig", "block", "asks", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
            if sum(map(len, held)) >= MET_ROWS:
                x = np.concatenate(held)
                last = int(np.searchsorted(x[:, 0], x[-1, 0]))  # the last cell may go on
                yield from flush(x[:last])
                held = [x[last:]]
        if held:
            yield from flush(np.concatenate(held))

    columns = ("cell", "side", "n", "label", "weight", "block", "sig")
    met = cells.select(*(F.col(c).cast("bigint").alias(c) for c in columns)).repartition("cell").sortWithinPartitions("cell", "n").mapInArrow(run, "sig bigint, block bigint, asks boolean, least bigint")
    return met.groupBy("sig", "block", "asks").agg(F.count("*").alias("c"), F.min("least").alias("least")).filter("c >= least").select("sig", "block", "asks")


def overlaps(sets: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Overlaps of all pairs of sets, by the product of their sparse incidence with its transpose, slice by slice of columns.

    need: the overlap that each pair must reach; the product ends when what is left can't lead there for any pair
    that hasn't got it yet.
    """
    sizes = np.array([len(s) for s in sets])
    elements, rows = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(elements, kind="stable")
    elements, rows = elements[order], rows[order]
    new = np.append(True, elements[1:] != elements[:-1])[: len(elements)]
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1  # a column of one row adds nothing
    rows, column = rows[shared], column[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])[: len(column)]) - 1
    left = np.bincount(rows, minlength=len(sets))
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(sets), int(column[b - 1]) + 1 - first), np.float32)
        part[rows[a:b], column[a:b] - first] = 1
        total += part @ part.T
        left = left - np.bincount(rows[a:b], minlength=len(sets))
        if not ((total < need) & (total + np.minimum.outer(left, left) >= need)).any():
            break
    return total


def _linked(wanted: DataFrame, docs: DataFrame, first: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): classes of one group, by the products of all tasks.

    wanted: task, sig, asks, label. In a task, classes that live in a block are compared with each other, or, if some
    ask, with these; only those of unlike labels. first: sig, id of one row of each class.
    """
    sigs = wanted.select("sig").distinct()
    ids = cut(first.join(sigs, "sig").select(F.col("sig").alias("wanted_sig"), F.col("id").alias("wanted"), F.xxhash64("id").alias("wanted_key")))
    near = possible(docs.withColumn("key", F.xxhash64("id")), "key", ids, "wanted_key", "possible").filter("possible").select("id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, starts in tv.chunks(batch.column(1)):
                piece = batch.slice(row, len(starts) - 1)
                found = [(signature(s), s.tobytes()) for s in shingle_sets(piece.column(1), width)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["id", "own", "hashes"])

    def product(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(r[0], r[1]): r for r in rows}.values())  # repeated rows of one id
        sigs, asks, labels = (np.array([r[k] for r in rows]) for k in range(3))
        n = np.array([len(r[3]) // 8 for r in rows])
        may = (labels[:, None] != labels) & (100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n))
        if asks.any():
            may &= asks[:, None] != asks
        need = np.where(may, (percent * np.add.outer(n, n) + 99 + percent) // (100 + percent), BIG)
        links = np.zeros(may.shape, bool)
        if may.any():
            links = (overlaps([np.frombuffer(r[3], U64) for r in rows], need) >= need) & may
        root = np.arange(len(rows))
        while True:  # to the least row that can be reached
            now = np.minimum(root, np.where(links, root, len(rows)).min(1))
            if (now == root).all():
                break
            root = now
        moved = root < np.arange(len(rows))
        return pa.RecordBatch.from_arrays([pa.array(sigs[moved], pa.int64()), pa.array(sigs[root[moved]], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for task, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if task != now and held:
                    yield product(held)
                    held = []
                now = task
                held.append(row)
        if held:
            yield product(held)

    sets = near.mapInArrow(pack, StructType([docs.schema["id"], *StructType.fromDDL("own bigint, hashes binary").fields]))
    chosen = ids.join(wanted, F.col("wanted_sig") == F.col("sig")).select("wanted", "task", "sig", "asks", "label")
    given = chosen.join(sets, (F.col("sig") == F.col("own")) & F.col("wanted").eqNullSafe(F.col("id"))).select("task", "sig", "asks", "label", "hashes")
    return given.repartition("task").sortWithinPartitions("task").mapInArrow(run, "a bigint, b bigint")


def similar_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id: str = "doc_id", text: str = "text", shared: int = SHARED) -> DataFrame:
    """One row per input row: id, n_shingles, component_id."""
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    classes = cut(_classes(slim, width))
    first = cut(classes.filter("sig is not null").groupBy("sig", "n").agg(F.min("id").alias("id")))
    prefix = classes.agg(F.sum(F.col("n") * (100 - percent) / 100)).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = cut(_incidence(slim, _shared(classes, shared), max(least, int(prefix / BLOCK_KEYS)), width, percent).join(first.select("sig", "n"), "sig"))
    homes = cut(_blocks(lists))
    none = F.lit(0)

    # Each block with itself.
    cells = lists.join(homes, "sig").select(F.xxhash64("key", "block").alias("cell"), none.alias("side"), "n", F.col("sig").alias("label"), none.alias("weight"), "block", "sig")
    wanted = cut(_met(cells, percent, True).select(F.col("block").alias("task"), "sig", "asks", F.col("sig").alias("label")))
    links = cut(_linked(wanted, slim, first, width, percent))
    labels = components(links)
    weights = labels.groupBy("component").agg(F.count("*").alias("weight"))
    labels = cut(labels.join(weights, "component").select(F.col("node").alias("sig"), F.col("component").alias("label"), "weight"))

    # Classes with the blocks of others that aren't in their group.
    own = homes.filter("lives").select("sig", "block").join(labels, "sig", "left").select("sig", "block", F.coalesce("label", "sig").alias("label"), F.coalesce("weight", F.lit(1)).alias("weight"))
    own = cut(own)
    named = lists.join(own, "sig")
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    named = named.join(mixed, "key", "left_semi")
    # A key of many classes is dealt to cells of two parts each.
    parts = F.ceil(F.col("m") / CELL_ROWS).cast("int")
    named = named.withColumn("part", F.pmod(F.xxhash64("sig"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    side = F.when(F.col("part") == F.col("other"), -1).otherwise((F.col("part") > F.col("other")).cast("int"))
    cells = named.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), side.alias("side"), "n", "label", "weight", "block", "sig")
    met = cut(_met(cells, percent, False))
    asks = met.filter("asks")
    pieces = asks.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("pieces"))
    asks = asks.join(pieces, "block").withColumn("piece", F.pmod(F.xxhash64("sig"), "pieces").cast("int"))
    live = met.filter("not asks").join(pieces, "block").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    both = asks.unionByName(live).join(own.select("sig", "label"), "sig")
    wanted = cut(both.select(F.xxhash64("block", "piece").alias("task"), "sig", "asks", "label"))
    links = links.unionByName(cut(_linked(wanted, slim, first, width, percent)))
    labels = components(links)

    group = first.select("sig", "n", "id").join(labels.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    least = group.groupBy("component").agg(F.min("id").alias("component_id"))
    named = group.join(least, "component").select("sig", "component_id")
    linked = classes.filter("sig is not null").select("id", "n", "sig").join(named, "sig").select("id", "n", "component_id")
    alone = classes.filter("sig is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group the row of the least id and text hash, once, with all columns. Rows of a null id stay.

    Rows are told apart by id and text, so an id with texts of two groups stays with one row in each.
    """
    key, digest = F.col(f"`{id}`"), F.xxhash64(F.col(f"`{text}`"))
    own = F.when(key.isNotNull(), F.struct(key.alias("id"), digest.alias("digest"))).alias("_row")
    groups = similar_groups(docs.select(own, F.col(f"`{text}`").alias("_text")), width, percent, "_row", "_text")
    keep = groups.filter(F.col("_row") == F.col("component_id")).select("_row.id", "_row.digest").distinct().toDF("_kept_id", "_kept_digest")
    named = docs.filter(key.isNotNull()).withColumn("_digest", digest)
    kept = named.join(keep, (key == F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest")), "left_semi").dropDuplicates([id, "_digest"]).drop("_digest")
    return kept.unionByName(docs.filter(key.isNull()))


def sql(docs: str = "documents", width: int = WIDTH, percent: int = PERCENT) -> str:
    """DuckDB SQL for similar_groups()."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM {docs}),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i:i+{width - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {width - 2}, 2))) AS i FROM d WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)"""
