"""LM scoring with an Elias-Fano n-gram trie in memory-mapped levels.

The trie has three levels. An entry of level 2 is a pair of words, found by its 64-bit key. Each pair
points, by a monotone sequence, to where its range in level 3 begins, which may be empty; an entry there is
the 32-bit id of the word that follows, placed relative to the range of its context, so that the level
is one monotone sequence and a look-up is a successor search inside that range. Level 1 holds the words with exact counts. Each sequence is Elias-Fano coded:
packed low bits, unary high bits, and a sampled directory of zeros; values are 16-bit codes, counts in
level 2 and smoothed probabilities in level 3. Inside the range of a context, high parts follow the
share of its ids below, so a search reads about one entry however many words follow the context.

Counts are gathered from all training texts in packed parts, one for each shard; a shard is built by
one task that streams its parts, and written to the shared folder. A round gathers a share of the shards,
so that the shuffled counts of one round lie on disk at a time. The model knows which shards were
written; one that can't be read is an error, never an unseen n-gram. Shards are split by the hash of the
word or of the pair, so no frequent word makes a large one, and their number follows the corpus.
Words have fewer shards than pairs, since a part has fewer of them. Scoring tasks map the shards and look
up the distinct n-grams of a part of the texts at once.

Probabilities are smoothed by Dirichlet priors, each order backing off to the next lower and words to
(c + 1) / (N + V + 1): P3 = (count + MU3 * P2) / (count of the pair + MU3),
P2 = (count of the pair + MU2 * P1) / (count of the context + MU2). All triples are kept, also those that
occur once, so each distribution sums to one over the known and the unknown word.
Words and pairs are identified by hashes; a collision would merge two of them.

Defined results: a null text is empty and has the end token alone; rows are scored each, and a repeated
row is counted as often as it occurs; a null id is in no fold, and is learned from; without training
rows N, V and all counts are 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv
from .common import CLEANUP, shared_folder

U64 = np.uint64
FOLDS, HELD = 7, 2
MU2, MU3 = 40.0, 1.0
#: Rounds of training; each reads all texts and builds its share of the shards.
ROUNDS = 4
#: Shards of pairs for each one of words.
PAIR_SHARDS = 8
#: Distinct n-grams a shard should hold, and texts (bytes) that one packed part covers.
SHARD_TOKENS = 1_000_000
PART_BYTES = 8 << 20
ASK_BYTES = 6 << 20
START = U64(0x243F6A8885A308D3)
END = U64(0x13198A2E03707344)
SAMPLE = 8
#: Low bits that a sequence read by place has more than others.
STEP_BITS = 7
#: Longer words are hashed byte by byte, not in steps of 8 bytes.
LONG = 256
_LOWER = tv.LOWER.tobytes()
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _select_table() -> np.ndarray:
    """For 16 bits and k below SAMPLE, at bits * SAMPLE + k: the place behind the k-th one, or 255."""
    ones = np.cumsum(np.arange(1 << 16)[:, None] >> np.arange(16) & 1, 1)
    out = np.zeros((1 << 16, SAMPLE), np.uint8)
    for k in range(1, SAMPLE):
        out[:, k] = np.where(ones[:, -1] >= k, np.argmax(ones == k, 1) + 1, 255)
    return out.ravel()


_SELECT = _select_table()


def _every_byte(words: np.ndarray) -> np.ndarray:
    """The 64 bits from each byte on, of an array that is longer than it need be by a word."""
    return np.ndarray(max(0, words.nbytes - 7), "<u8", words, strides=(1,))


# --- Elias-Fano ---------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence. Arrays may be memory-mapped; look-ups read only what they need."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros, self.ones = n, low_bits, low, high, zeros, ones
        self._highs, self._lows = _every_byte(high), _every_byte(low)

    @classmethod
    def build(cls, values: np.ndarray, by_place: bool = False) -> EliasFano:
        """by_place: keep what get() needs, and lower parts so wide that a large step leaves a short gap in the high bits."""
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        if by_place:
            low_bits = min(63, low_bits + STEP_BITS)
        high = (values >> U64(low_bits)).astype(np.int64)
        size = n + (int(high[-1]) if n else 0) + 1
        words = np.zeros(size // 64 + 5, U64)
        at = high + np.arange(n)
        np.bitwise_or.at(words, at >> 6, U64(1) << (at & 63).astype(U64))
        # Zero number h, from 0, ends the run of high part h; directory: the place of zeros 0, SAMPLE, ... minus 1's start.
        count = np.bincount(high, minlength=(int(high[-1]) if n else 0) + 1) if n else np.zeros(1, np.int64)
        begins = np.concatenate([[0], np.cumsum(count + 1)])  # where the run of each high part begins
        zeros = begins[::SAMPLE].astype(np.uint32)  # a shard has fewer than 2**32 bits
        ones = np.append((high + np.arange(n))[::SAMPLE], 0).astype(np.uint32) if by_place else np.zeros(0, np.uint32)
        low = np.zeros(n * low_bits // 64 + 2, U64)
        if low_bits:
            part = values & ((U64(1) << U64(low_bits)) - U64(1))
            bit = np.arange(n, dtype=np.int64) * low_bits
            word, off = bit >> 6, (bit & 63).astype(U64)
            np.bitwise_or.at(low, word, part << off)
            spill = off.astype(np.int64) + low_bits > 64
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (U64(64) - off[spill]))
        return cls(n, low_bits, low, words, zeros, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U64)
        bit = i * self.low_bits
        if self.low_bits <= 57:
            part = self._lows[bit >> 3] >> (bit & 7).astype(U64)
        else:
            word, off = bit >> 6, (bit & 63).astype(U64)
            part = self.low[word] >> off | np.where(off > 0, self.low[word + 1] << ((U64(64) - off) & U64(63)), U64(0))
        return part & ((U64(1) << U64(self.low_bits)) - U64(1))

    def _walk(self, bit: np.ndarray, skip: np.ndarray, zeros: bool) -> np.ndarray:
        """The bit behind the skip-th zero (or one) from each bit on, 16 bits at a time; skip is below SAMPLE."""
        out, todo = np.empty(len(bit), np.int64), None
        while len(bit):
            w = (self._highs[bit >> 3] >> (bit & 7).astype(U64)).astype(np.uint16)
            w = ~w if zeros else w
            step = _SELECT[w.astype(np.int64) * SAMPLE + skip]
            at = bit + step
            if todo is None:
                out[:] = at
            else:
                out[todo] = at
            far = np.flatnonzero(step == 255)
            bit, skip, todo = bit[far] + 16, skip[far] - np.bitwise_count(w[far]), far if todo is None else todo[far]
        return out

    def _place(self, i: np.ndarray) -> np.ndarray:
        """The bit of each one: behind the one at the sampled place, then behind some more."""
        return self._walk(self.ones[i // SAMPLE].astype(np.int64) + 1, i % SAMPLE, False) - 1

    def _value(self, i: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return (bit - i).astype(U64) << U64(self.low_bits) | self._low(i)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        return self._value(i, self._place(i))

    def ranges(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places i and at the next ones."""
        bit = self._place(i)
        after = self._walk(bit + 1, np.ones(len(i), np.int64), False) - 1
        return self._value(i, bit), self._value(i + 1, after)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each value of x in the sequence, or -1: a successor search from the begin of its high part on."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        high = x >> U64(self.low_bits)
        ask = np.flatnonzero(high // U64(SAMPLE) < U64(len(self.zeros)))
        h = high[ask].astype(np.int64)
        bit = self._walk(self.zeros[h // SAMPLE].astype(np.int64), h % SAMPLE, True)
        place = bit - h
        want = x[ask] & ((U64(1) << U64(self.low_bits)) - U64(1))
        while len(ask):  # a zero ends a run, and one follows the last
            one = self._highs[bit >> 3] >> (bit & 7).astype(U64) & U64(1) > 0
            low = self._low(place)
            same = one & (low == want)
            out[ask[same]] = place[same]
            live = np.flatnonzero(one & (low < want))
            ask, want, bit, place = ask[live], want[live], bit[live] + 1, place[live] + 1
        return out

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], U64), self.low, self.high, self.zeros, self.ones]


# --- files --------------------------------------------------------------------------------------


def _is_local(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file")


def _save(uri: str, arrays: list[np.ndarray]) -> None:
    """A header of (code, length) for each array, then the arrays, 8-byte aligned. A retried task replaces the file whole."""
    kinds = {"uint64": 0, "uint32": 1, "uint16": 2}
    head = np.array([len(arrays), *(x for a in arrays for x in (kinds[a.dtype.name], len(a)))], U64)
    body = [head.tobytes(), *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)]
    if _is_local(uri):
        path = urlparse(uri).path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as f:
            f.writelines(body)
        os.replace(own, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(own := f"{path}.{uuid.uuid4().hex}") as f:
        for b in body:
            f.write(b)
    store.move(own, path)


def _load(uri: str) -> list[np.ndarray]:
    if _is_local(uri):
        raw = np.memmap(urlparse(uri).path, np.uint8, "r")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(path) as f, tempfile.TemporaryFile() as copy:  # has no name, so nothing is left behind
            while block := f.read(1 << 20):
                copy.write(block)
            copy.flush()
            raw = np.memmap(copy, np.uint8, "r")
    raw = np.asarray(raw)  # slices of a memmap cost more
    number = int(raw[:8].view(U64)[0])
    head = raw[8 : 8 + 16 * number].view(U64).astype(np.int64)
    at, out = 8 + 16 * number, []
    for kind, n in zip(head[::2], head[1::2]):
        dtype = np.dtype((U64, np.uint32, np.uint16)[kind])
        out.append(raw[at : at + n * dtype.itemsize].view(dtype))
        at += n * dtype.itemsize + (-n * dtype.itemsize % 8)
    return out


_open: OrderedDict[str, tuple] = OrderedDict()


def _shard(uri: str) -> tuple:
    """The arrays of a shard: sequences first. Keeps the maps of the shards that were used last."""
    if uri not in _open:
        arrays, sequences = _load(uri), []
        while len(arrays) >= 5 and len(arrays[0]) == 2:
            sequences.append(EliasFano(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:5]))
            arrays = arrays[5:]
        _open[uri] = (*sequences, *arrays)
        while len(_open) > 512:
            _open.popitem(last=False)
    _open.move_to_end(uri)
    return _open[uri]


# --- codes --------------------------------------------------------------------------------------


def count_codes(c: np.ndarray) -> np.ndarray:
    """16 bits: exact below 2**15, then 2**-11 steps of the binary logarithm."""
    c = np.asarray(c, np.float64)
    return np.where(c < 32768, c, np.minimum(65535, 32768 + np.round((np.log2(np.maximum(c, 32768)) - 15) * 2048))).astype(np.uint16)


def code_counts(q: np.ndarray) -> np.ndarray:
    q = q.astype(np.float64)
    return np.where(q < 32768, q, np.exp2(15 + (q - 32768) / 2048))


def chance_codes(p: np.ndarray) -> np.ndarray:
    """16 bits: steps of 2**-12 of the binary logarithm; 0 stands for nothing."""
    return np.where(p > 0, np.clip(np.round(65535 + np.log2(np.maximum(p, 1e-300)) * 4096), 1, 65535), 0).astype(np.uint16)


def code_chances(q: np.ndarray) -> np.ndarray:
    q = q.astype(np.float64)
    return np.where(q > 0, np.exp2((q - 65535) / 4096), 0.0)


# --- texts --------------------------------------------------------------------------------------


def token_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, starts) of consecutive texts: START, the words, END for each."""
    for _, data, starts in tv.chunks(column):
        low = np.frombuffer(data.tobytes().translate(_LOWER) + bytes(8), np.uint8)
        begins, ends = _words(low[:-8], starts)
        count = np.diff(np.searchsorted(begins, starts))
        at = np.concatenate([[0], np.cumsum(count + 2)])
        out = np.empty(at[-1], U64)
        inner = np.ones(len(out), bool)
        inner[at[:-1]] = inner[at[1:] - 1] = False
        out[at[:-1]] = START
        out[at[1:] - 1] = END
        out[inner] = _hashes(low, begins, ends)
        yield out, at


def _words(low: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of bytes that aren't 0x20 or 0x09 to 0x0D; none spans two rows."""
    blank = (low == 0x20) | (low - np.uint8(0x09) < 5)
    word = ~blank
    begin, last = word.copy(), word.copy()
    begin[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    first = starts[:-1][starts[:-1] < len(low)]
    begin[first] = word[first]
    final = starts[1:][starts[1:] > 0] - 1
    last[final] = word[final]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def _hashes(low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, 8 bytes at a time; 8 bytes follow the last word."""
    at, size = _every_byte(low), ends - begins
    out = tv.mix((at[begins] & _FIRST_BYTES[np.minimum(size, 8)]) + size.astype(U64) * U64(0xD6E8FEB86659FD93))
    done, rest = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(rest):
        out[rest] = tv.mix(out[rest] * U64(0xA0761D6478BD642F) + (at[begins[rest] + done] & _FIRST_BYTES[np.minimum(size[rest] - done, 8)]))
        done += 8
        rest = rest[size[rest] > done]
    long = np.flatnonzero(size > LONG)
    if len(long):
        out[long] = tv.span_hashes(low, begins[long], ends[long])
    return out


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tv.mix(tv.mix(a * U64(0xA0761D6478BD642F)) + b)


def _parts(column_batches: Iterator[pa.RecordBatch], at: int, size: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """(batches, hashes, starts) of consecutive texts of about `size` bytes of hashes together."""
    batches, hashes, sizes, held = [], [], [], 0
    for batch in column_batches:
        for lo, hi in _slices(batch.column(at), size // 2):
            piece = batch.slice(lo, hi - lo)
            batches.append(piece)
            for h, s in token_hashes(piece.column(at)):
                hashes.append(h)
                sizes.append(np.diff(s))
                held += h.nbytes
            if held >= size:
                yield batches, np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                batches, hashes, sizes, held = [], [], [], 0
    if batches:
        yield batches, np.concatenate(hashes or [np.zeros(0, U64)]), np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))])


def _slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    for row, _, starts in tv.chunks(column, size):
        yield row, row + len(starts) - 1


def _split(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by shard, shard numbers, first of each in the order)."""
    shard = (keys % U64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int64)  # 16 bits are sorted by radix
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(keys)])
    return order, shard[cuts].astype(np.int64), np.append(cuts, len(keys))


# --- training -----------------------------------------------------------------------------------

_PARTS = "shard bigint, keys binary, counts binary, children binary, ids binary, id_counts binary"


def _counted(texts: DataFrame, word_shards: int, shards: int, turn: int) -> DataFrame:
    """Packed counts by part and shard: of words (shards below `word_shards`), then of pairs with the words that follow.

    Only of the shards that are built in this turn.
    """

    def row(shard, *arrays):
        return (int(shard), *(a.tobytes() for a in arrays))

    def now(keys: np.ndarray, shards: int) -> np.ndarray:
        return keys % U64(shards) % U64(ROUNDS) == U64(turn)

    def count(h: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
        predicted = np.ones(len(h), bool)
        predicted[at[:-1]] = False
        words = h[predicted]
        words, c = np.unique(words[now(words, word_shards)], return_counts=True)
        order, which, cuts = _split(words, word_shards)
        for s, a, b in zip(which, cuts, cuts[1:]):
            yield row(s, words[order[a:b]], c[order[a:b]].astype(np.uint32), *(np.zeros(0, np.uint32),) * 3)
        first = np.flatnonzero(predicted[1:])  # a pair begins at every token but the end
        g = pair_keys(h[first], h[first + 1])
        mine = now(g, shards)
        g, first = g[mine], first[mine]
        follows = first + 2 < len(h)
        follows[follows] = predicted[first[follows] + 2]
        ids = np.where(follows, h[np.minimum(first + 2, len(h) - 1)] >> U64(32), U64(0))
        # Triples by pair, then by id; pairs that end a text have no follower and sort first.
        order = np.lexsort((ids, follows, g))
        g, ids, follows = g[order], ids[order].astype(np.uint32), follows[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (ids[1:] != ids[:-1]) | (follows[1:] != follows[:-1])
        start = np.flatnonzero(new)
        c3 = np.diff(np.append(start, len(g))).astype(np.uint32)
        g, ids, follows = g[start], ids[start], follows[start]
        head = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
        c2 = np.add.reduceat(c3, head) if len(head) else c3
        kids = np.add.reduceat(follows.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
        keys = g[head]
        first_kid = np.concatenate([[0], np.cumsum(kids)])
        ids, c3 = ids[follows], c3[follows]
        order, which, cuts = _split(keys, shards)
        for s, a, b in zip(which, cuts, cuts[1:]):
            mine = order[a:b]
            n = kids[mine]
            take = np.repeat(first_kid[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            yield row(s + word_shards, keys[mine], c2[mine].astype(np.uint32), kids[mine].astype(np.uint32), ids[take], c3[take])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, at in _parts(batches, 0, PART_BYTES):
            rows = list(count(h, at)) if len(h) else []
            if rows:
                kinds = [pa.int64(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["shard", "keys", "counts", "children", "ids", "id_counts"])

    return texts.mapInArrow(run, _PARTS)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _placed(begin: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The monotone values of a context's children: begin of its range plus the share of ids below, then the id."""
    return (begin.astype(U64) + (ids * size.astype(U64) >> U64(32))) << U64(32) | ids


def _build_words(parts: list[tuple], uri: str) -> tuple[int, int]:
    keys, counts = _summed(np.concatenate([np.frombuffer(p[0], U64) for p in parts]), np.concatenate([np.frombuffer(p[1], np.uint32) for p in parts]).astype(U64))
    _save(uri, [*EliasFano.build(keys).arrays(), counts])
    return int(counts.sum()), len(keys)


def _build_pairs(parts: list[tuple], uri: str) -> tuple[int, int]:
    keys = np.concatenate([np.frombuffer(p[0], U64) for p in parts])
    kids = np.concatenate([np.frombuffer(p[2], np.uint32) for p in parts]).astype(np.int64)
    unique, c2 = _summed(keys, np.concatenate([np.frombuffer(p[1], np.uint32) for p in parts]).astype(np.int64))
    parent = np.repeat(np.searchsorted(unique, keys), kids).astype(U64)
    entry, c3 = _summed(parent << U64(32) | np.concatenate([np.frombuffer(p[3], np.uint32) for p in parts]), np.concatenate([np.frombuffer(p[4], np.uint32) for p in parts]).astype(np.int64))
    parent = (entry >> U64(32)).astype(np.int64)
    size = np.bincount(parent, minlength=len(unique))
    pointers = np.concatenate([[0], np.cumsum(size)])
    placed = _placed(pointers[parent], size[parent], entry & U64(0xFFFFFFFF))
    sequences = EliasFano.build(unique), EliasFano.build(pointers.astype(U64), True), EliasFano.build(placed)
    _save(uri, [*(a for v in sequences for a in v.arrays()), count_codes(c2), chance_codes(c3 / (c2[parent] + MU3))])
    return 0, 0


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", folds: int = FOLDS, held: int = HELD) -> dict:
    """Writes the trie to the shared folder; returns where it is, the numbers of shards, N, V and the texts trained on."""
    spark = docs.sparkSession
    texts = docs.filter(F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(folds)) != held, F.lit(True))).select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(8, int((size[0] or 0) / 6 / SHARD_TOKENS))
    word_shards = max(8, shards // PAIR_SHARDS)
    every = word_shards + shards
    base = f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: int, parts: list[tuple]) -> pa.RecordBatch:
            n, v = (_build_words if shard < word_shards else _build_pairs)(parts, f"{base}/{shard % 251}/{shard}")
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, n, v)], names=["shard", "n", "v"])

        now, parts = None, []
        for batch in batches:
            for shard, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != now and parts:
                    yield done(now, parts)
                    parts = []
                now = shard
                parts.append(tuple(blobs))
        if parts:
            yield done(now, parts)

    n = v = 0
    written = np.zeros(every // 64 + 1, U64)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        for turn in range(ROUNDS):
            built = _counted(texts, word_shards, shards, turn).repartition(max(1, every // ROUNDS), "shard").sortWithinPartitions("shard").mapInArrow(build, "shard bigint, n bigint, v bigint")
            bits = F.expr("bit_or(shiftleft(1L, cast(shard % 64 as int)))").alias("bits")
            for r in built.groupBy(F.expr("shard div 64").alias("word")).agg(F.sum("n").alias("n"), F.sum("v").alias("v"), bits).collect():  # a row for 64 shards
                n, v = n + r["n"], v + r["v"]
                written[r["word"]] |= U64(r["bits"] & (1 << 64) - 1)
    finally:
        spark.conf.set(CLEANUP, before)
    return {"base": base, "word_shards": word_shards, "shards": shards, "n": n, "v": v, "texts": size[1], "written": written}


# --- scoring ------------------------------------------------------------------------------------


class Trie:
    def __init__(self, model: dict):
        self.model = model

    def _look(self, keys: np.ndarray, shards: int, skip: int) -> Iterator[tuple[np.ndarray, tuple]]:
        order, which, cuts = _split(keys, shards)
        for s, a, b in zip(which, cuts, cuts[1:]):
            shard = int(s) + skip
            if self.model["written"][shard >> 6] >> U64(shard & 63) & U64(1):
                yield order[a:b], _shard(f"{self.model['base']}/{shard % 251}/{shard}")

    def counts(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words))
        for rows, (sequence, counts) in self._look(words, self.model["word_shards"], 0):
            at = sequence.find(words[rows])
            out[rows[at >= 0]] = counts[at[at >= 0]]
        return out

    def score(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base and model log10 probabilities."""
        predicted = np.ones(len(h), bool)
        predicted[at[:-1]] = False
        words, which = np.unique(h, return_inverse=True)
        c = self.counts(words)
        one = (c + 1) / (self.model["n"] + self.model["v"] + 1)
        own = c.copy()
        own[words == START] = self.model["texts"]
        first = np.flatnonzero(predicted[1:])
        token = which[first + 1]
        keys, pair = np.unique(pair_keys(h[first], h[first + 1]), return_inverse=True)
        # The triple of a pair that ends at a text's end is never asked; others follow at the next place.
        after = np.append(first[1:] == first[:-1] + 1, False)
        asks = np.flatnonzero(after)
        wanted, asked = np.unique(pair[asks].astype(U64) << U64(32) | h[first[asks] + 2] >> U64(32), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(np.bincount((wanted >> U64(32)).astype(np.int64), minlength=len(keys)))])
        c2, chance = np.zeros(len(keys)), np.zeros(len(wanted))
        for rows, (pairs, pointers, entries, counts, chances) in self._look(keys, self.model["shards"], self.model["word_shards"]):
            place = pairs.find(keys[rows])
            known = np.flatnonzero(place >= 0)
            rows, place = rows[known], place[known]
            c2[rows] = code_counts(counts[place])
            begin, end = (x.astype(np.int64) for x in pointers.ranges(place))
            n = np.where(end > begin, bounds[rows + 1] - bounds[rows], 0)  # an empty range has no place of its own
            before = np.cumsum(n) - n
            mine = np.repeat(bounds[rows] - before, n) + np.arange(n.sum())
            spot = entries.find(_placed(np.repeat(begin, n), np.repeat(end - begin, n), wanted[mine] & U64(0xFFFFFFFF)))
            known = np.flatnonzero(spot >= 0)
            chance[mine[known]] = code_chances(chances[spot[known]])
        p = (c2[pair] + (MU2 * one)[token]) / (own + MU2)[which[first]]
        p[asks + 1] = chance[asked] + (MU3 / (c2 + MU3))[pair[asks]] * p[asks + 1]
        n = np.diff(at) - 1
        row = np.repeat(np.arange(len(n)), n)
        return n, np.bincount(row, (c > 0)[token], len(n)).astype(np.int64), np.bincount(row, np.log10(one)[token], len(n)), np.bincount(row, np.log10(p), len(n))


def score(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text", folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    slim = docs.select(F.col(id).alias(id), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        for pieces, h, at in _parts(batches, 1, ASK_BYTES):
            values = trie.score(h, at)
            lo = 0
            for piece in pieces:
                hi = lo + piece.num_rows
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(v[lo:hi], k) for v, k in zip(values, (pa.int64(), pa.int64(), pa.float64(), pa.float64())))], names=[id, "n_tokens", "n_known", "base_score", "score"])
                lo = hi

    out = slim.mapInArrow(run, StructType([*slim.select(id).schema.fields, *StructType.fromDDL("n_tokens bigint, n_known bigint, base_score double, score double").fields]))
    fold = F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(folds)) == held, F.lit(False))
    return out.select(id, fold.alias("held_out"), "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")
