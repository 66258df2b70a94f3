import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skirmish.llm import chat_format, common, decontaminate, graph, line_dedup, lm_trie, mixing, ngram_jaccard, queries, quality_rules, secret_scan, toxicity, url_filter

from ..compare import duck, rows

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, _text string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
ODD = [
    (1, None, "en", "a", None, "x", "y", "z"),
    (2, "", None, None, 0, None, None, None),
    (3, LONG, "en", "a", 1, "x", "y", "z"),
    (4, LONG + " end", "en", "a", 1, "x", "y", "z"),
    (5, "one two", "de", "b", 7, "x", "y", "z"),
    (6, "one two", "de", "b", 7, "x", "y", "z"),
    (6, "one two", "de", "b", 7, "x", "y", "z"),
    (7, PASSAGE + "\nown line of seven", "en", "a", 9, "x", "y", "z"),
    (8, "first here\n" + PASSAGE + "\n \nlast here", "en", "a", 9, "x", "y", "z"),
    (9, "same same same same same same same same same same", "en", "a", 9, "x", "y", "z"),
    (10, 'API_KEY = "abcdef0123456789abcdef" token=short', "en", "a", 9, "x", "y", "z"),
    (11, "Été ß \u00a0nbsp ünï ΣΑΣ 漢字 x\x0by", "fr", "c", 9, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def odd_duck():
    names = [c.split()[0] for c in DOCS.split(", ")]
    frame = pd.DataFrame(ODD, columns=names)
    return frame.astype({"n_chars": "Int64"})


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert rows(queries.queries()[name](spark, SF).toPandas()) == rows(duck(queries.oracle_sql()[name], SF))


def test_pipeline_equals_its_sql(spark):
    assert rows(corpus_pipeline.run(spark, SF).toPandas()) == rows(duck(corpus_pipeline.ORACLE_SQL, SF))


def test_pipeline_of_odd_rows_and_empty_tables(spark, odd, tmp_path):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id int, text string")
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        folder = str(tmp_path / name)
        docs.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == odd.columns
        kept = [r["doc_id"] for r in out.collect()]
        assert set(kept) <= {d[0] for d in ODD} - {7} and len(kept) == len(set(kept))
    common.clear(spark)


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        get = staticmethod(lambda *_: None)

    class Session:
        conf, sparkContext = Conf, type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session)


def test_quality_of_odd_rows(odd, odd_duck):
    got = quality_rules.judge(odd).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept").toPandas()
    assert rows(got) == rows(duck(quality_rules.sql("src"), SF, src=odd_duck))
    assert quality_rules.passed(odd).columns == odd.columns


def test_a_bad_host_goes_whole(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(i, "bad" if i % 20 else text, "h1") for i in range(400)] + [(1000 + i, text, f"h{2 + i % 9}") for i in range(400)], "doc_id int, text string, source string")
    assert {r["source"] for r in quality_rules.passed(docs).collect()} == {f"h{i}" for i in range(2, 11)}


def test_decontamination_of_odd_rows_and_blocks(spark, odd, odd_duck):
    items = [(1, PASSAGE), (2, "Two"), (3, None), (4, "same same"), (5, "one-two")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = rows(duck(decontaminate.sql("src", "bench"), SF, src=odd_duck, bench=pd.DataFrame(items, columns=["item_id", "text"])))
    for size in (10**6, 200):
        found = decontaminate.scan(odd, bench, max_chars=size)
        assert rows(decontaminate.digest(found).toPandas()) == want
        spans = {r["doc_id"]: r["spans"] for r in found.collect()}
        assert ODD[8][1][slice(*spans[8])] == PASSAGE
    assert decontaminate.clean(odd, bench).columns == odd.columns


def test_jaccard_of_odd_rows(odd, odd_duck):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.similar_groups(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 29996, 3), (4, 29997, 3), (5, 1, 5), (6, 1, 5)} <= got
    assert sorted(r["doc_id"] for r in ngram_jaccard.representatives(odd).collect()) == [1, 2, 3, 5, 7, 9, 10, 11]


def test_jaccard_against_brute_force(spark):
    rng = random.Random(5)
    base = [[f"v{rng.randrange(400)}" for _ in range(rng.randrange(3, 60))] for _ in range(12)]
    texts = []
    for i in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(400)}"
        texts.append(" ".join(words[: rng.randrange(max(3, len(words) - 6), len(words) + 1)]))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = ngram_jaccard.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).toPandas().set_index("doc_id").sort_index()
    assert got.component_id.tolist() == [find(i) for i in range(len(texts))]
    assert got.n_shingles.tolist() == [len(s) for s in sets]


@pytest.mark.parametrize("words,edits", [(45, 2), (1500, 40)])
def test_jaccard_of_large_groups_at_the_edge(spark, words, edits):
    """2000 near copies of one text whose similarity to each other lies on both sides of the threshold."""
    rng = random.Random(words)
    base = [f"b{i}" for i in range(words)]
    texts = []
    for i in range(2000):
        row = list(base)
        for _ in range(rng.randrange(edits // 2, edits + 1)):
            row[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(row))
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    often = {x: i for i, x in enumerate(x for x, n in Counter(x for s in sets for x in s).items() if n > 1)}
    incidence = np.zeros((len(texts), len(often)), np.float32)
    for i, s in enumerate(sets):
        incidence[i, [often[x] for x in s if x in often]] = 1
    n, both = np.array([len(s) for s in sets]), incidence @ incidence.T
    linked = 100 * both >= 75 * (n[:, None] + n - both)
    least = np.arange(len(texts))
    while (now := np.minimum(least, np.where(linked, least, len(texts)).min(1))).tolist() != least.tolist():
        least = now
    got = ngram_jaccard.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).toPandas().set_index("doc_id").sort_index()
    assert 1 < len(set(least)) < len(texts)
    assert got.component_id.tolist() == least.tolist()


def test_keys_of_many_classes_are_split(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CELL_ROWS", 7)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", 5)
    test_jaccard_against_brute_force(spark)


def test_overlaps_of_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n, dtype=np.uint64)) for n in (0, 1, 50, 9000, 9000)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    pairs = ~np.eye(5, dtype=bool)  # of a set with itself only what others have too is counted
    assert (ngram_jaccard.overlaps(sets, np.where(pairs, want, 1 << 40))[pairs] == want[pairs]).all()
    assert (ngram_jaccard.overlaps(sets, np.where(pairs, want + 1, 1 << 40))[pairs] <= want[pairs]).all()


def test_representatives_of_an_id_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows_ = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c + " end"), (4, c), (None, a), (5, None), (5, "")]
    got = ngram_jaccard.representatives(spark.createDataFrame(rows_, "doc_id bigint, text string")).collect()
    kept = Counter((r["doc_id"], r["text"]) for r in got)
    whole = {(1, a): 1, (1, b): 1, (None, a): 1, (5, None): 1, (5, ""): 1}
    of_c = [x for x in kept if x[0] == 4]
    assert len(of_c) == 1 and kept == whole | {of_c[0]: 1}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a int, b int")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_line_dedup_of_odd_rows(odd, odd_duck):
    assert rows(line_dedup.line_dedup(odd).toPandas()) == rows(duck(line_dedup.sql("src"), SF, src=odd_duck))
    out = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(odd).collect()}
    assert out[8] == "first here\n \nlast here" and out[7] == ODD[7][1]
    assert line_dedup.deduped(odd).columns == odd.columns


def _maximal_runs(docs, least):
    """By brute force: every run of lines that occurs earlier, of enough words, which no longer such run of its text holds."""
    lines = [[x for x in (t or "").split("\n") if x.split()] for _, t in docs]
    first, out = {}, set()
    for d, ls in enumerate(lines):
        for s in range(len(ls)):
            for e in range(s + 1, len(ls) + 1):
                first.setdefault(tuple(ls[s:e]), []).append((d, s))
    for d, ls in enumerate(lines):
        def earlier(s, e):
            return 0 <= s and e <= len(ls) and min(first[tuple(ls[s:e])]) < (d, s)
        for s in range(len(ls)):
            for e in range(s + 1, len(ls) + 1):
                if earlier(s, e) and not earlier(s - 1, e) and not earlier(s, e + 1) and sum(len(x.split()) for x in ls[s:e]) >= least:
                    f = min(first[tuple(ls[s:e])])
                    out.add((docs[d][0], s, e - s, docs[f[0]][0], f[1]))
    return out


@pytest.mark.parametrize("least", [1, 2, 7])
def test_maximal_runs_against_brute_force(spark, least):
    draw = random.Random(least)
    docs = [(i, "\n".join(draw.choice(["a", "b b", "c c c", " ", "d d"]) for _ in range(draw.randrange(14)))) for i in range(40)]
    block = "\n".join(f"line {i} of a block" for i in range(21))
    docs += [(100, block), (101, "own\n" + block), (102, "\n".join(["same line"] * 19)), (103, block[17:] + "\nown end"), (104, None), (105, ""), (106, block + "\n" + block)]
    frame = spark.createDataFrame(docs + [docs[-1]], "doc_id bigint, text string")
    got = line_dedup.maximal_runs(frame, least).collect()
    want = _maximal_runs(docs, least)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert line_dedup.maximal_runs(frame.limit(0)).count() == line_dedup.maximal_runs(frame.filter("doc_id in (104, 105)")).count() == 0


def test_short_lines_and_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = line_dedup.line_dedup(docs).toPandas()
    seen, later, left = Counter(), 0, 0
    for before, after in sorted(zip(docs.toPandas().itertuples(index=False), got.set_index("doc_id").loc[docs.toPandas().doc_id].text), key=lambda x: x[0].doc_id):
        lines = [x for x in (before.text or "").split("\n") if x.split()]
        later += sum(seen[x] > 0 or lines[:i].count(x) > 0 for i, x in enumerate(lines))
        seen.update(lines)
    kept = Counter(x for t in got.text for x in (t or "").split("\n") if x.split())
    left = sum(n - 1 for n in kept.values())
    assert later > 1000 and left <= 0.1 * later


def test_mixing_reaches_marginals_and_both_ways_agree(spark, odd):
    cells = {(s, l, t): float(n) for n, (s, l, t) in enumerate(((s, l, t) for s in "ab" for l in "xy" for t in "pq"), 10)}
    mix = mixing.Mix(targets={"source": {"a": 0.3, "b": 0.7}}, rounds=40)
    chances = mixing.rake(cells, mix)
    assert all(math.isclose(*x, rel_tol=1e-4) for x in mixing.marginals(cells, chances, mix).values())
    # A small source that must give more than it has: it is taken whole, and the other marginals still hold.
    scarce = mixing.Mix(targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}}, rounds=60)
    lopsided = {k: v * (0.2 if k[0] == "a" else 1) for k, v in cells.items()}
    chances = mixing.rake(lopsided, scarce)
    assert max(chances.values()) <= 1 and all(math.isclose(chances[k], 1, rel_tol=1e-6) for k in lopsided if k[0] == "a")
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, t double")
    few = mixing.Mix(targets=mix.targets, rounds=3)
    want = mixing.rake(cells, few)
    assert all(math.isclose(r["p"], want[r["source"], r["lang"], r["topic"]], rel_tol=1e-9) for r in mixing.rake_frame(frame, few).collect())
    assert mixing.mixed(odd).columns == odd.columns and mixing.mix_weights(odd).count() == len(ODD)


def test_secrets_of_odd_rows_and_queries(odd, odd_duck):
    assert rows(secret_scan.digest(secret_scan.scan(odd)).toPandas()) == rows(duck(secret_scan.sql("src"), SF, src=odd_duck))
    assert secret_scan.trigram_query(r"AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    assert secret_scan.trigram_query(r"[0-9a-f]{16,}") is True
    assert secret_scan.trigram_query(r"(cat|dogs?)x*") == ("or", (b"cat", b"dog", ("and", (b"dog", b"ogs"))))


def test_chat_escapes_and_order(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s> [\\\\INST] [ROLE] a", "", None, "<", "[/TURN]\n é 𝒳"]
    data = [(c, t, r, texts[(c + t) % len(texts)]) for c in range(6) for t, r in enumerate(("user", "assistant", "tool [/ROLE] x", None))] + [(9, 0, "user", "a"), (9, 1, "assistant", "b")]
    df = spark.createDataFrame(data, "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_chats(df)).collect()}
    for c in {d[0] for d in data}:
        own = [d for d in data if d[0] == c]
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and got[c]["n_turns"] == len(own)
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["valid"] == (c == 9)


def test_url_rules_against_brute_force(spark):
    urls = [None, "", "nourl", "http://Sub.Example.NET/en/1?x#y", "https://x.org/fr/", "https://x.org", "http://example.com/de/a", "http://notexample.com/de/a", "ftp://net/", "a://b://c/d", "http://a.net", "http://..net/#"]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()}
    for i, u in enumerate(urls):
        host, path = url_filter.split_url(u)
        fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert (got[i]["score"] is None) == bool(fits)
        assert got[i]["verdict"] == (max(fits)[2] if fits else "block" if got[i]["score"] >= 0.5 else "allow")


def test_url_model_on_names_held_out():
    model = url_filter.train(url_filter.labelled_urls(False))
    found = [(model.score(*url_filter.split_url(u)) >= 0.5, y) for u, y in url_filter.labelled_urls(True)]
    assert np.mean([f for f, y in found if y]) >= 0.9 and np.mean([f for f, y in found if not y]) <= 0.1
    assert model.score("poker-jackpot-cash.example.org", "/en/1") > 0.5 > model.score("city-library.example.org", "/en/1")
    # A word is on one side with all its names.
    words = [w for i, w in enumerate(url_filter.BAD_WORDS) if i % url_filter.HELD_WORDS == 0]
    assert not any(w in u for w in words for u, y in url_filter.labelled_urls(False) if y)


def test_url_features_against_brute_force():
    hosts, paths = ["a.example", "", "\u00e9\u00e9.org"], ["/x", "/", ""]
    rows_, buckets = url_filter.features(pa.array(hosts), pa.array(paths), 40, (3, 4))
    for i, texts in enumerate(zip(hosts, paths)):
        grams = {(k, t[j : j + n]) for k, x in enumerate(texts) for t in [b"\xff" + x.encode() + b"\xff"] for n in (3, 4) for j in range(len(t) - n + 1)}
        assert len(grams) == (rows_ == i).sum() == len(set(buckets[rows_ == i]))


def test_more_rules_than_a_map_holds(spark):
    urls = ["http://a.example.net/en/x", "http://b.net/", "http://c.org/fr/1", "http://example.com/de/", "http://none.info/", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    many = [*url_filter.RULES, *((f"host{i}.example/", "block") for i in range(url_filter.MAX_RULES))]
    few = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules=many).collect()} == few


def test_elias_fano_finds_and_gets():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (7, 4), (3000, 1 << 12), (3000, 1 << 33), (2000, 1 << 62)):
        v = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        e = lm_trie.EliasFano.build(v, True)
        assert (e.find(v) == np.arange(len(v))).all() and (e.get(np.arange(len(v))) == v).all()
        q = rng.integers(0, top + 3, 500, dtype=np.uint64)
        assert ((e.find(q) >= 0) == np.isin(q, v)).all()


def test_long_range_of_children_leaves_a_short_gap():
    """A look-up by place walks over the gap, so its work mustn't grow with the largest range."""
    size = np.random.default_rng(5).integers(0, 5, 2000)
    size[700] = 200_000
    v = np.concatenate([[0], np.cumsum(size)]).astype(np.uint64)
    e = lm_trie.EliasFano.build(v, True)
    ones = np.flatnonzero(np.unpackbits(e.high.view(np.uint8), bitorder="little"))
    assert len(ones) == len(v) and np.diff(ones).max() <= 1024
    begin, end = e.ranges(np.arange(len(size)))
    assert (begin == v[:-1]).all() and (end == v[1:]).all() and (e.get(np.arange(len(v))) == v).all()


def test_lm_hashes_tell_words_apart():
    words = [c * n for c in ("a", "\u00e9", "\x00") for n in (1, 2, 7, 8, 9, 15, 16, 17, 63, 256, 257, 900)] + ["a" * n + "b" for n in (7, 8, 15, 16, 255, 256)]
    texts = [" ".join(words), "", " \t ", "\v".join(w.upper() for w in reversed(words)), words[-1]]
    (h, at), = lm_trie.token_hashes(pa.array([*texts, None]))
    rows_ = [h[a:b].tolist() for a, b in zip(at, at[1:])]
    assert [len(r) - 2 for r in rows_] == [len(words), 0, 0, len(words), 1, 0]
    assert all(r[0] == lm_trie.START and r[-1] == lm_trie.END for r in rows_)
    plain = {w: x for w, x in zip(words, rows_[0][1:])}
    assert len(set(plain.values())) == len(set(words)) and rows_[4][1] == plain[words[-1]]
    assert [x for w, x in zip(reversed(words), rows_[3][1:]) if w.isascii()] == [plain[w] for w in reversed(words) if w.isascii()]


def test_lm_pair_without_followers_meets_no_other_range(spark):
    """Pairs that only end texts have an empty range; what follows other pairs there isn't theirs."""
    texts = [f"p{i} q{i}" for i in range(300)] + [f"r{i} s{i} t" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked = spark.createDataFrame([(i, f"p{i} q{i} t") for i in range(300)], "doc_id bigint, text string")
    model = lm_trie.train(docs)
    train = [t.split() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    for r in lm_trie.score(asked, model).collect():
        s = ["<s>", f"p{r['doc_id']}", f"q{r['doc_id']}", "t", None]
        one = [((len(train) if w is None else c[w]) + 1) / (model["n"] + model["v"] + 1) for w in s[1:]]
        seen = c[s[1]] > 0
        c2 = [1 if seen else 0, 1 if seen else 0, 0, c["t"]]
        own = [len(train), c[s[1]], c[s[2]], c["t"]]
        p = [(a + lm_trie.MU2 * b) / (o + lm_trie.MU2) for a, b, o in zip(c2, one, own)]
        p[1] = ((1 if seen else 0) + lm_trie.MU3 * p[1]) / (c2[0] + lm_trie.MU3)
        p[2] = lm_trie.MU3 * p[2] / (c2[1] + lm_trie.MU3)
        assert math.isclose(r["score"], sum(map(math.log10, p)), rel_tol=2e-3, abs_tol=2e-3)


def test_lm_against_brute_force(spark, odd):
    docs = odd.unionByName(odd.limit(0))
    got = sorted(lm_trie.score(docs, lm_trie.train(docs)).collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    toks = [(i, re.findall("[^\x20\x09-\x0d]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) + [None]) for i, t, *_ in ODD]
    train = [["<s>", *ts] for i, ts in toks if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for s in train for w in s[1:])
    c2 = Counter(p for s in train for p in zip(s, s[1:]))
    c3 = Counter(p for s in train for p in zip(s, s[1:], s[2:]))
    held = Counter()
    for (a, b, _), n in c3.items():
        held[a, b] += n
    total, own = sum(c.values()), {**c, "<s>": len(train)}
    for r, (i, ts) in zip(got, sorted(toks, key=lambda x: (x[0], len(x[1])))):
        s, base, score = ["<s>", *ts], 0.0, 0.0
        for k in range(1, len(s)):
            p1 = p = (c[s[k]] + 1) / (total + len(c) + 1)
            base += math.log10(p1)
            p = (c2[s[k - 1], s[k]] + lm_trie.MU2 * p1) / (own.get(s[k - 1], 0) + lm_trie.MU2)
            if k > 1:
                ab = (s[k - 2], s[k - 1])
                n3 = c3[(*ab, s[k])]
                p = (n3 + (c2[ab] - held[ab] + lm_trie.MU3) * p) / (c2[ab] + lm_trie.MU3)
            score += math.log10(p)
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, len(ts), sum(c[w] > 0 for w in ts), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=2e-3, abs_tol=2e-3)


def test_lm_keeps_triples_that_occur_once(spark):
    """Brute force without pruning: almost all triples here occur once."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") + rng.choice("klmno") for _ in range(rng.randrange(2, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lines = [["<s>", *t.split(), None] for t in texts]
    train = [s for i, s in enumerate(lines) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for s in train for w in s)
    c2 = Counter(p for s in train for p in zip(s, s[1:]))
    c3 = Counter(p for s in train for p in zip(s, s[1:], s[2:]))
    assert sum(n == 1 for n in c3.values()) > 0.9 * len(c3)
    total = sum(n for w, n in c.items() if w != "<s>")
    got = {r["doc_id"]: r["score"] for r in lm_trie.score(docs, lm_trie.train(docs)).collect()}
    for i, s in enumerate(lines):
        score = 0.0
        for k in range(1, len(s)):
            p = (c[s[k]] + 1) / (total + len(c))
            p = (c2[s[k - 1], s[k]] + lm_trie.MU2 * p) / (c[s[k - 1]] + lm_trie.MU2)
            if k > 1:
                p = (c3[s[k - 2], s[k - 1], s[k]] + lm_trie.MU3 * p) / (c2[s[k - 2], s[k - 1]] + lm_trie.MU3)
            score += math.log10(p)
        assert math.isclose(got[i], score, rel_tol=2e-3, abs_tol=2e-3)


def test_lm_with_a_shard_missing_raises(spark, odd):
    model = lm_trie.train(odd)
    with pytest.raises(Exception, match="nowhere"):
        lm_trie.score(odd, model | {"base": "/tmp/nowhere"}).collect()


def _auc(score: pd.Series, positive: pd.Series) -> float:
    rank = score.rank()
    return (rank[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


def test_toxicity_on_held_out_rows(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.toPandas()
    held = {}
    for epochs in (0, toxicity.Settings.epochs):
        s = toxicity.Settings(epochs=epochs)
        got = toxicity.score(docs, toxicity.fit(docs, labels, s), s).toPandas()
        held[epochs] = got[got.held_out].merge(known, on="doc_id")
        assert got.score.between(0, 1).all()
    trained = held[toxicity.Settings.epochs]
    assert _auc(trained.score, trained.toxic == 1) > 0.9 > _auc(held[0].score, held[0].toxic == 1) + 0.2
    assert ((trained.predicted == 1) == (trained.toxic == 1)).mean() > 0.9
    none = toxicity.score(odd, None).toPandas()
    assert len(none) == len(ODD) and (none.score == 0).all()
    model = toxicity.train([np.array([5, 6, 0, 0]), np.array([7, 0, 0])], np.array([1, 0]), toxicity.Settings(buckets=1 << 16, epochs=1))
    marked = toxicity.score(odd, model).toPandas()
    assert len(marked) == len(ODD) and marked.score.between(0, 1).all()


def test_toxicity_convolution_against_brute_force():
    s = toxicity.Settings(buckets=64, epochs=2)
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(1, 64, n), [0, 0]) for n in (1, 2, 3, 9)]
    m = toxicity.train(texts, np.array([0, 1, 0, 1]), s)
    ids, at = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    got = toxicity.logits(m.tables(), m, ids, at)
    for z, text in zip(got, texts):
        want = m.offset
        for j, w in enumerate(toxicity.WIDTHS):
            for f in range(s.filters):
                sums = [sum(m.embedding[text[i + k]] @ m.taps[w][k][:, f] for k in range(w)) for i in range(len(text) - 2)]
                want += max(max(sums) + m.bias[j, f], 0) * m.out[j, f]
        assert math.isclose(z, want, rel_tol=1e-3, abs_tol=1e-4)


def test_empty_tables(spark, odd):
    empty = odd.limit(0)
    bench = spark.createDataFrame([], "item_id int, text string")
    assert quality_rules.judge(empty).count() == quality_rules.passed(empty).count() == 0
    assert decontaminate.scan(empty, bench).count() == 0 and decontaminate.scan(odd, bench).filter("n_hit > 0").count() == 0
    assert ngram_jaccard.similar_groups(empty).count() == line_dedup.line_dedup(empty).count() == mixing.mix_weights(empty).count() == 0
    assert secret_scan.scan(empty).count() == toxicity.score(empty, None).count() == 0
    assert lm_trie.score(odd, lm_trie.train(empty)).filter("n_known > 0").count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id int, turn int, role string, text string")).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


CLASHES = tuple(dict.fromkeys("_text n key label labels h w a b c d k v x at by sig code size home member members gid part shard held_out score predicted kept judged rejected failed fails rate rates host topic tokens cell cells factor probability lot word words hit hits n_words n_hit n_items n_lines n_deleted line lines rank ranks head tail start end pos position component_id n_shingles shingle group cut texts found marked possible spans kind lang_ source_ row_number count base_failed contaminated item_id".split()))


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    """Stages return the columns of their input, whatever they are called, and keep rows without an id; repeated rows count as rows."""
    good = "\n".join(" ".join(f"w{i * 7 + j * 31}" for j in range(12)) for i in range(4))
    base = [(None, good + " alpha", "en", "a", 5), (None, PASSAGE + " beta", "en", "a", 5), (3, good.replace("w", "v"), None, None, None), (3, good.replace("w", "v"), None, None, None), (None, None, None, None, None), (4, "", "de", "b", 0)]
    docs = spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id int, text string")
    stages = {
        "quality": quality_rules.passed(docs), "lines": line_dedup.deduped(docs), "jaccard": ngram_jaccard.representatives(docs),
        "clean": decontaminate.clean(docs, bench), "mixed": mixing.mixed(docs),
    }
    kept = {name: df.collect() for name, df in stages.items()}
    assert all(df.columns == docs.columns for df in stages.values())
    assert all(r[c] == i for found in kept.values() for r in found for i, c in enumerate(CLASHES))
    texts = {name: sorted(r["text"] or "" for r in found) for name, found in kept.items()}
    assert good + " alpha" in texts["jaccard"] and texts["jaccard"].count(good.replace("w", "v")) == 1
    assert PASSAGE + " beta" not in texts["clean"] and len(texts["clean"]) == 5
    assert good + " alpha" in texts["lines"] and good + " alpha" in texts["quality"]
    scored = [toxicity.score(docs, None), secret_scan.digest(secret_scan.scan(docs)), lm_trie.score(docs, lm_trie.train(docs)), mixing.mix_weights(docs), ngram_jaccard.similar_groups(docs), line_dedup.line_dedup(docs)]
    assert [len(df.collect()) for df in scored] == [6] * len(scored)
    pages = spark.createDataFrame([(None, None), (1, "http://" + "a" * 100_000 + ".org/fr/x"), (1, "http://good.net/" + "p" * 100_000), (2, ""), (2, "")], "page_id long, url string").withColumns({c: F.lit(i) for i, c in enumerate(("_host", "_path", "score", "n", "kind", "features"))})
    judged = url_filter.judge(pages).collect()
    assert len(judged) == 5 and sorted(r["rule"] or "" for r in judged) == ["", "", "", "net/", "org/fr/"]


def test_chats_with_very_long_and_missing_parts(spark):
    """Rows of no conversation, turns that tie, texts of a megabyte, and columns named as the operator's own."""
    long = "</s> x" * 200_000
    chats = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", None), (None, 0, "user", "b"), (3, None, None, None)]
    frame = spark.createDataFrame(chats, "conv_id long, turn int, role string, text string").withColumns({c: F.lit(1) for c in ("formatted", "segments", "state", "valid", "loss", "turns")})
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_chats(frame)).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == len(long) and got[2]["n_turns"] == 3 and got[2]["loss_chars"] == 0
