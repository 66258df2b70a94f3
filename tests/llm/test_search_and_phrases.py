import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from skirmish.llm import collocations, ranked_search, simhash

from ..compare import duck, rows
from .test_llm import DOCS, LONG, ODD, PASSAGE, SF


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def odd_duck():
    return pd.DataFrame(ODD, columns=[c.split()[0] for c in DOCS.split(", ")]).astype({"n_chars": "Int64"})


def print_of(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
    found = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_of_odd_texts_and_of_sparks_own_hash(spark, odd):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_groups(odd).collect()}
    texts = {r[0]: r[1] for r in ODD}
    assert {(i, f) for i, f, _ in got} == {(i, f"{print_of(t):016x}") for i, t in texts.items()}
    assert {(1, "0" * 16, 1), (2, "0" * 16, 1)} <= got and {c for i, _, c in got if i in (3, 4)} == {3}
    short = odd.filter("doc_id = 5").select(F.lower(F.hex(F.xxhash64("text")))).first()[0]
    assert {f for i, f, _ in got if i in (5, 6)} == {short.rjust(16, "0")}
    assert simhash.near_groups(odd.limit(0)).count() == 0
    kinds = simhash.near_groups(spark.createDataFrame([(None, "a b"), (None, None), ("x", "a b")], "doc_id string, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in kinds) == [("None", "None"), ("None", "x"), ("x", "x")]


@pytest.mark.parametrize("tile_rows", [simhash.TILE_ROWS, 40])
def test_groups_against_all_pairs(spark, tile_rows):
    rng = random.Random(7)
    bases = [rng.getrandbits(64) for _ in range(40)]
    prints = []
    for _ in range(900):
        x = rng.choice(bases)
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8))):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    frame = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in enumerate(prints)], "id int, print bigint")
    links = simhash.components(simhash._links(frame.select("print").distinct(), 4, tile_rows))
    label = {r["node"]: r["component"] for r in links.collect()}
    own = [int(np.uint64(x).astype(np.int64)) for x in prints]
    found = [label.get(x, x) for x in own]
    want = groups_of(prints)
    assert len(set(zip(found, want))) == len(set(found)) == len(set(want))


def test_tiles_cut_by_counts_lose_nothing():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    x[3000:] = x[:3000] ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    whole = np.arange(len(x))
    for i in range(0, len(x), 500):
        a, b = np.nonzero(np.bitwise_count(x[i : i + 500, None] ^ x) <= 4)
        simhash._unite(whole, a + i, b)
    assert (simhash.links_of(x, np.full(len(x), -1)) == whole).all()
    one_side = simhash.links_of(x, np.repeat([0, 1], 3000))
    assert (one_side[3000:] <= np.arange(3000)).all()


def test_a_large_group_gives_links_linear_in_its_members():
    base = np.uint64(0x0123456789ABCDEF)
    x = np.unique(base ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))[:, None] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)))
    root = simhash.links_of(x, np.full(len(x), -1))
    assert len(x) > 2000 and (root == 0).all()


def test_long_counters_keep_their_sums():
    text = " ".join(["x"] * 5000 + ["y"] * 4000)
    assert simhash.prints_of(pa.array([text, None, "a"]))[0] == print_of(text)


ITEMS = [(1, PASSAGE), (2, "TWO same"), (3, None), (4, ""), (5, "nowhere-else"), (6, "x y w1x1"), (7, "same same one"), (8, "漢字 Été")]


@pytest.mark.parametrize("terms", [ranked_search.BLOCK_TERMS, 20])
def test_ranked_search_of_odd_rows(spark, odd, odd_duck, terms):
    items = spark.createDataFrame([(*x, "clash") for x in ITEMS], "item_id int, text string, score string")
    got = ranked_search.search(ranked_search.build(odd), items, block_terms=terms).toPandas()
    assert rows(got) == rows(duck(ranked_search.sql("src", "items"), SF, src=odd_duck, items=pd.DataFrame(ITEMS, columns=["item_id", "text"])))


def test_ranked_search_ties_segments_and_empty_tables(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"t{i}" for i in range(60)]
    docs = [(10_000 - i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for i in range(3000)] + [(i, "t1 t2 t3") for i in range(400)] + [(None, "t1 t2 t3")]
    items = [(i, " ".join(rng.sample(vocabulary, 5))) for i in range(12)] + [(90, "t1 t2 t3"), (None, "t5")]
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", 600)
    frame = spark.createDataFrame(docs, "doc_id int, text string").coalesce(2)
    bench = spark.createDataFrame(items, "item_id int, text string")
    index = ranked_search.build(frame)
    assert index.count() > 5
    got = ranked_search.search(index, bench).toPandas()
    as_ints = lambda d, key: pd.DataFrame(d, columns=[key, "text"]).astype({key: "Int64"})
    assert rows(got.astype({"doc_id": "Int64", "item_id": "Int64"})) == rows(duck(ranked_search.sql("src", "items"), SF, src=as_ints(docs, "doc_id"), items=as_ints(items, "item_id")).astype({"doc_id": "Int64", "item_id": "Int64"}))
    assert [int(x) for x in got[got.item_id == 90].sort_values("rank").doc_id[1:]] == list(range(49))
    assert ranked_search.search(ranked_search.build(frame.limit(0)), bench).count() == 0
    assert ranked_search.search(index, bench.limit(0)).count() == 0


def test_index_is_written_and_read_few_segments_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", 40)
    index = ranked_search.build(spark.createDataFrame([(i, f"t{i} t{i % 7}") for i in range(1000)], "doc_id int, text string").coalesce(1))
    found = index.inputFiles()
    assert len(found) == 1 and index.count() > 20
    with pq.ParquetFile(found[0].removeprefix("file://")) as file:
        groups = [file.metadata.row_group(i) for i in range(file.num_row_groups)]
    assert max(g.num_rows for g in groups) <= ranked_search.SEGMENTS_AT_ONCE and groups[0].column(1).compression == "UNCOMPRESSED"
    before = spark.conf.get(ranked_search.BATCH)
    with ranked_search._small_batches(spark):
        sizes = [r[0] for r in index.select("n_docs").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows])}) for b in batches), "n bigint").collect()]
    assert sum(sizes) == index.count() and max(sizes) <= ranked_search.SEGMENTS_AT_ONCE and spark.conf.get(ranked_search.BATCH) == before


def test_the_search_opens_fewer_leaves_than_there_are():
    rng = np.random.default_rng(5)
    n = 4096
    tf = np.ones(n, np.int64)
    tf[:8] = 9
    row = {"lens": np.full(n, 20), "terms": np.array([7], np.uint64), "cuts": np.array([0, n]), "places": rng.permutation(n).astype(np.int32), "tfs": tf}
    tree = ranked_search._Tree(row, np.array([7], np.uint64), n, 20 * n)
    opened = []
    ids = type("Ids", (), {"__getitem__": lambda _, i: opened.append(i) or i})()
    best = []
    tree.search(np.array([0]), np.array([5]), ids, best, 8)
    assert len(opened) == 8 and sorted(e[2] for e in best) == sorted(row["places"][:8])


def test_collocations_of_odd_rows(spark, odd, odd_duck):
    for least in (1, 2, 10):
        got = collocations.collocations(odd.withColumn("lang", F.when(F.col("doc_id") != 9, F.col("lang"))), least=least).toPandas()
        frame = odd_duck.assign(lang=[None if i == 9 else x for i, x in zip(odd_duck.doc_id, odd_duck.lang)])
        assert rows(got) == rows(duck(collocations.sql("src", least), SF, src=frame))
    assert collocations.collocations(odd.limit(0)).count() == 0


def test_counts_by_suffix_order_against_counting():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 4, 500)
    cut = np.sort(rng.choice(500, 60, replace=False))
    room = np.append(cut, 500)[np.searchsorted(cut, np.arange(500), "right")] - np.arange(500)
    for n in range(1, 8):
        starts = np.flatnonzero(room >= n)
        want = {}
        for i in starts:
            key = tuple(ids[i : i + n])
            want[key] = want.get(key, 0) + 1
        at, count = collocations.intervals(ids, room, starts, n)
        assert {tuple(ids[i : i + n]): c for i, c in zip(at, count)} == want and len(at) == len(want)


def test_longer_phrases_and_exact_scores(spark):
    text = " ".join(["alpha beta gamma delta"] * 12) + ". " + ". ".join(["alpha beta"] * 30) + f". {LONG[:2000]}"
    found = {r["phrase"]: r for r in collocations.collocations(spark.createDataFrame([("en", text)], "lang string, text string"), longest=4).collect()}
    assert found["alpha beta"]["a"] == 42 and found["alpha beta"]["score"] == 1_000_000
    assert "beta gamma" not in found and "beta gamma delta" not in found and found["alpha beta gamma delta"]["a"] == 12
    many = 3_000_000_000
    score = spark.createDataFrame([(many, many + 7, many + 9)], "a bigint, l bigint, r bigint").selectExpr(
        "cast(a as decimal(18,0)) * cast(a as decimal(18,0)) as square", "cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as product"
    ).selectExpr("*", "cast(square % product as decimal(34, 0)) * 1000 as rest").selectExpr(
        "(square div product) * 1000000 + (rest div product) * 1000 + (cast(rest % product as decimal(34, 0)) * 1000) div product as s"
    ).first()[0]
    assert score == 1_000_000 * many * many // ((many + 7) * (many + 9))
