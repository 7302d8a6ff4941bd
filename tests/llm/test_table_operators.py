"""Neighbours, URL rules, near copies, sharding, mixing, perspectives."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from testbed import compare
from tickloom.llm import mixing, perspectives, queries, sharding, trie_join, url_rules, vptree
from tickloom.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, monkeypatch, name):
    monkeypatch.setattr(compare, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(compare, "ORACLES", queries.ORACLES)
    assert compare.compare(spark, compare.oracle_connection(SF), name, SF) is None


def _vectors(n=700, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)).astype(np.float32)


def _brute(rows, k, queries_):
    out = {}
    for q, v in queries_:
        ranked = sorted((-float((v.astype(float) * x.astype(float)).cumsum()[-1]), i) for i, x in rows if i != q)
        out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


def test_vptree_is_exact_at_factor_one(spark):
    vectors = _vectors()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, vectors[5]) for i in range(60)]
    frame = spark.createDataFrame(
        [(i, [float(x) for x in v], "t") for i, v in rows]
        + [(2000, None, "t"), (2001, [0.0] * 12, "t"), (2002, [float("nan")] * 12, "t"), (2003, [1.0], "t"), (7, [float(x) for x in vectors[7]], "t")],
        "vec_id bigint, embedding array<float>, score string")
    got = defaultdict(list)
    for r in vptree.nearest(frame, F.col("id") % 20 == 0, k=6, factor=1.0, shard_rows=150, query_rows=10).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = _brute(rows, 6, [(i, v) for i, v in rows if i % 20 == 0])
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_vptree_small_tables(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id bigint, embedding array<double>")
    got = vptree.nearest(frame, F.col("id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 0.5), (2, 0.5)]
    assert vptree.nearest(frame.limit(0), F.col("id") == 0).count() == 0


def test_vptree_recall_with_relaxed_pruning(spark):
    rows = list(enumerate(_vectors(3000, 24, 8)))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>")
    got = defaultdict(set)
    for r in vptree.nearest(frame, F.col("id") % 50 == 0, shard_rows=500).collect():
        got[r.query_id].add(r.vec_id)
    want = _brute(rows, 20, [(i, v) for i, v in rows if i % 50 == 0])
    assert np.mean([len(got[q] & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.9


def _nearest(spark, rows, k, kind="double", **settings):
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"vec_id bigint, embedding array<{kind}>")
    got = defaultdict(list)
    for r in vptree.nearest(frame, F.col("id") % 20 == 0, k=k, factor=1.0, **settings).orderBy("query_id", "score", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(x)] for q, x in got.items()}


def test_vptree_own_id_under_several_vectors(spark):
    # three near vectors have the query's own id: its k nearest are other ids all the same
    vectors = _vectors(300).astype(float)
    rows = [(i, v) for i, v in enumerate(vectors) if i % 20 or i == 40] + [(40, vectors[40] * 0.99), (40, vectors[40] * 0.98)]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    found = vptree.nearest(frame, F.col("id") == 40, k=5, factor=1.0).collect()
    want = {x for _, v in rows[-2:] + [(40, vectors[40])] for x in _brute(rows, 5, [(40, v)])[40]}
    assert len(found) == 15
    assert {(r.vec_id, r.score) for r in found} == want


@pytest.mark.parametrize("name", ["ties", "closer than single precision", "large", "small"])
def test_vptree_scores_are_exact(spark, name):
    rng = np.random.default_rng(4)
    vectors = _vectors(900).astype(float)
    if name == "ties":
        vectors = rng.integers(0, 2, size=(900, 9)).astype(float)
        vectors[:, 0] = 1.0
    elif name == "closer than single precision":
        vectors = vectors[rng.integers(0, 12, size=900)] + 1e-9 * vectors
    else:
        vectors *= {"large": 1e100, "small": 1e-100}[name]
    rows = list(enumerate(vectors))
    got = _nearest(spark, rows, 7, shard_rows=40, query_rows=3)
    assert got == _brute(rows, 7, [(i, v) for i, v in rows if i % 20 == 0])


def test_vptree_plan(spark, monkeypatch):
    # one shuffle makes the entries, vectors stay floats, and the second search goes by lanes of shards
    tables = []
    monkeypatch.setattr(vptree, "stage", lambda df, keep=vptree.stage: tables.append((df, keep(df))) or tables[-1][1])
    rows = list(enumerate(_vectors(2600)))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>")
    vptree.nearest(frame, F.col("id") % 20 == 0, k=5, shard_rows=20)
    assert {dict(df.dtypes)["v"] for df, _ in tables if "v" in df.columns} == {"array<float>"}
    entries = next(df for df, _ in tables if df.columns == ["h", "v", "ids"])
    assert entries._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1
    shards = next(read for df, read in tables if "blob" in df.columns).count()
    first, second = [read.count() for df, read in tables if "blocks" in df.columns]
    assert shards >= 100 and first > second and second <= shards / 8


def _listed(url, rules=url_rules.PAGE_RULES):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    cut = min(ends, default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def test_url_rules_and_mined_rules(spark):
    urls = [None, "", "no scheme", "http://COM/", "http://a.com", "http://a.com/x://y.net/es/", "https://Example.com/en/1?x#y",
            "https://www.example.com/en/2", "https://b.www.example.com/en/2", "https://x.net/es/3", "https://x.net/de/3#a?b",
            "ftp://notexample.com/en/1", "http://net/fr/", "x://?q", "http://a.net/fr/é\n2/"]
    urls += [f"https://ads{i}.example.org/es/{i}" for i in range(5)] + [f"https://b.shop.net/es/{i}.html" for i in range(30)]
    frame = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(99, urls[6], "old")], "page_id int, url string, verdict string")
    got = {r.page_id: r for r in url_rules.judge_urls(frame).collect()}
    assert len(got) == len(urls) + 1 and got[99].verdict == got[6].verdict
    for i, u in enumerate(urls):
        host, path, rule, verdict = _listed(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert got[15].verdict == "block" and "path0=es" in got[15].mined  # learned from the listed net/es pages
    assert got[0].verdict == "allow" and url_rules.judge_urls(frame.limit(0)).count() == 0


def test_mined_rules_have_the_stated_support_and_confidence(spark):
    rng = random.Random(1)
    baskets = [(sorted({rng.choice("abcd"), rng.choice("efg"), rng.choice("hi")}), rng.choice(["allow", "block"])) for _ in range(200)]
    baskets += [(["a", "e", "z"], "block")] * 40
    frame = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    rules = url_rules.mine_rules(frame, 0.05, 0.7).collect()
    assert rules
    for r in rules:
        inside = [v for t, v in baskets if set(r.tokens) <= set(t)]
        assert r.confidence == pytest.approx(inside.count(r.verdict) / len(inside)) and r.confidence >= 0.7
        assert r.support == pytest.approx(inside.count(r.verdict) / len(baskets)) and r.support >= 0.05
    kept = [set(r.tokens) for r in rules]
    assert {"z"} in kept and not any({"z"} < k for k in kept)  # longer rules that say no more are gone


def _classes(texts):
    sets, parent = {}, {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in keys}


def _copies(seed):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 900}"
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for i in range(60):
        base = [word() for _ in range(rng.choice([3, 6, 12, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (" " + passage if rng.random() < 0.3 else ""))
    texts += ["", None, " \t", "a b", "A  B", "a b c d e", "x " * 3000, "x " * 3500]
    rng.shuffle(texts)
    return [(2 * i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("frequent, block", [(64, 256), (2, 4)])
def test_near_copies_against_all_pairs(spark, monkeypatch, frequent, block):
    monkeypatch.setattr(trie_join, "FREQUENT", frequent)
    monkeypatch.setattr(trie_join, "BLOCK", block)
    texts = _copies(frequent)
    frame = spark.createDataFrame([(i, t, "rep", 1) for i, t in texts], "doc_id bigint, text string, rep string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in trie_join.similar_classes(frame).collect()}
    assert got == _classes(texts)


def test_near_copies_odd_rows(spark):
    frame = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f")], "doc_id bigint, text string")
    got = Counter((r.doc_id, r.component_id) for r in trie_join.similar_classes(frame).collect())
    assert got[(4, 4)] == 2 and got[(9, 4)] == 1 and sum(got.values()) == 4
    assert trie_join.similar_classes(frame.limit(0)).count() == 0


def test_one_large_class_is_not_paired_with_itself(spark, monkeypatch):
    monkeypatch.setattr(trie_join, "BLOCK", 4)
    classes = {i: (1000 if i < 64 else i) for i in range(72)}  # 64 sets of one class, eight alone
    named = spark.createDataFrame([(1, i, 2 * 100 + 1, c, 72) for i, c in classes.items()], "token bigint, rep bigint, entry bigint, class bigint, c bigint")
    rows = trie_join._to_compare(named).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.g, []).append(r.rep)
    together = {(a, b) for reps in groups.values() for a in reps for b in reps if classes[a] < classes[b] or classes[a] > classes[b]}
    assert together == {(a, b) for a in classes for b in classes if classes[a] != classes[b]}
    assert len(rows) <= 400  # all pairs of blocks: near 72 * 18


def test_near_copies_of_large_groups_against_all_pairs(spark, monkeypatch):
    for name, value in (("FREQUENT", 2), ("BLOCK", 4), ("LARGE", 8), ("PROBES", 2)):
        monkeypatch.setattr(trie_join, name, value)
    texts = _copies(7)
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in trie_join.similar_classes(frame).collect()}
    assert got == _classes(texts)


def test_pairs_of_a_large_group_grow_with_its_sets(spark, monkeypatch):
    # copies of one text with few or many words replaced
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(500):
        copy = list(base)
        for _ in range(5 if i % 3 == 0 else 1):
            copy[rng.randrange(len(copy))] = f"x{rng.random()}"
        texts.append((i, " ".join(copy)))
    for name, value in (("BLOCK", 32), ("LARGE", 64)):
        monkeypatch.setattr(trie_join, name, value, raising=False)
    made, plain = [], trie_join._close_pairs

    def counted(*args):
        pairs = plain(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(trie_join, "_close_pairs", counted)
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in trie_join.similar_classes(frame).collect()}
    assert got == _classes(texts)
    assert max(Counter(c for _, c in got.values()).values()) > 250
    assert sum(made) <= 10 * len(texts), made  # eight of the likely trees and two


def test_likely_tree_joins_what_may_be_similar():
    rng = np.random.default_rng(8)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (40, 300, 1500)]
    sets = [np.sort(rng.choice(b, size=int(len(b) * rng.uniform(0.85, 1)), replace=False)) for b in base for _ in range(15)]
    n, named, maps = np.array([len(s) for s in sets]), np.arange(len(sets)) // 2, [trie_join.parity_bitmap(s) for s in sets]
    every, tree = trie_join.close_in_group(n, named, maps), trie_join.likely_tree(n, named, maps)
    assert set(tree) <= set(every) and len(tree) < len(set(named)) < len(every)

    def classes(pairs):
        label = list(range(len(sets)))
        for _ in sets:
            for a, b in [*pairs, *((i, i + 1) for i in range(0, len(sets) - 1, 2))]:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert classes(tree) == classes(every)
    assert trie_join.likely_tree(n[:1], named[:1], maps[:1]) == []


def test_frequent_shingles_are_the_commonest_and_come_last(spark, monkeypatch):
    monkeypatch.setattr(trie_join, "FREQUENT", 2)
    sketches = spark.createDataFrame([([1, 2, 3],)] * 3 + [([2, -3],)] * 30 + [([9],)] * 2, "sketch array<bigint>")
    as_hash = lambda *x: np.array(sorted(v % 2**64 for v in x), dtype=np.uint64)
    assert trie_join._frequent(sketches).tolist() == as_hash(1, 2, 3, -3).tolist()
    monkeypatch.setattr(trie_join, "MOST_FREQUENT", 2)
    assert set(trie_join._frequent(sketches).tolist()) <= set(as_hash(1, 2, 3, -3).tolist())
    assert len(trie_join._frequent(sketches.limit(0))) == 0
    items = np.arange(10, 30, dtype=np.uint64)  # a prefix of 20 - 16 + 1
    assert trie_join.ordered_prefix(items, np.array([11, 12, 40], dtype=np.uint64)).tolist() == [10, 13, 14, 15, 16]
    assert trie_join.ordered_prefix(items[:2], np.array([10], dtype=np.uint64)).tolist() == [11]
    assert trie_join.ordered_prefix(items, items[:0]).tolist() == [10, 11, 12, 13, 14]


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 10**6, n).astype(np.uint64)) for n in (1, 4, 9, 30, 80)]
    sets = [np.sort(rng.choice(b, size=max(1, int(len(b) * rng.uniform(0.7, 1))), replace=False)) for b in base for _ in range(12)]
    sets.append(np.zeros(0, np.uint64))
    got = trie_join.links(sets)
    for a, b in got:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)

    def classes(pairs):
        label = list(range(len(sets)))
        for _ in sets:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    every = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and len(sets[j])
             and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert classes(got) == classes(every)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 400), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 500: 400, 400: 400}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shards_are_exact_and_uniform(spark):
    frame = spark.range(2003).select((F.col("id") % 700).alias("doc_id"), F.lit("x").alias("shard"))
    rows = sharding.uniform_shards(frame, 7, block_rows=64).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i % 700 for i in range(2003))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(7)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    # a source partition spreads over the shards, and ids do not follow slots
    assert abs(np.corrcoef([r.doc_id for r in rows], [r.slot for r in rows])[0, 1]) < 0.1
    assert sharding.uniform_shards(frame.limit(0), 7).count() == 0
    assert len(sharding.uniform_shards(frame.limit(3), 7).collect()) == 3


def test_split_counts_keep_both_margins():
    rng = np.random.default_rng(1)
    draws = np.array([sharding.split_counts(rng, np.array([30, 20, 10]), [12, 25, 23]) for _ in range(400)])
    assert (draws.sum(axis=2) == [12, 25, 23]).all() and (draws.sum(axis=1) == [30, 20, 10]).all()
    assert np.allclose(draws.mean(axis=0)[0], [6, 4, 2], atol=0.25)  # hypergeometric means
    big = sharding.split_counts(rng, np.array([3_000_000_000, 1_000_000_000]), [1_000_000_000, 3_000_000_000])
    assert (big.sum(axis=0) == [3_000_000_000, 1_000_000_000]).all()


def test_shards_are_written_in_order(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    plan = sharding.uniform_shards(docs.select("doc_id"), 3)
    sharding.write_shards(docs, plan, "doc_id", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 3


def test_mix_water_fills_brothers_first(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 100), ("a", "y", "1", 1000), ("b", "x", "1", 1000)],
                                   "domain string, lang string, source string, supply bigint")
    got = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(leaves, {}, F.lit(800), 1).collect()}
    assert got == {("a", "x"): 100, ("a", "y"): 300, ("b", "x"): 400}  # the brother takes the shortage
    got = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(leaves, {"domain": {"a": 9}}, F.lit(2000), 1).collect()}
    assert got == {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 900}  # then the ancestor's brother


def test_mix_takes_prefixes_and_odd_rows(spark):
    rows = [(i, "d", "en", "s", 1 + i % 5, 7) for i in range(200)] + [(None, None, None, None, None, 7), (1, "d", "en", "s", 0, 7)]
    frame = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, n_tokens bigint, copies int")
    got = mixing.mix(frame, {}, (1, 2), range_rows=16).collect()
    assert len(got) == len(rows)
    taken = sum(r.copies * (r.n_tokens or 0) for r in got)
    budget = got[0].leaf_budget if got[0].domain else got[1].leaf_budget
    assert 0 <= budget - taken < 5
    twice = mixing.mix(frame.where("n_tokens > 0"), {}, (3, 2)).collect()
    assert {r.copies for r in twice} == {1, 2}
    assert mixing.mix(frame.limit(0), {}).count() == 0


def test_perspectives_render_whole_dialogues(spark, monkeypatch):
    monkeypatch.setattr(perspectives, "BLOCK_TURNS", 2)
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hé 🙂"), (1, 3, "ann", None), (1, 4, "eve", "x"),
             (1, 4, "eve", "x"), (2, 0, "system", "alone"), (None, None, None, "lost")]
    frame = spark.createDataFrame([(*t, "z") for t in turns], "conv_id bigint, turn bigint, role string, text string, speaker string")
    got = defaultdict(list)
    for r in perspectives.rotate_perspectives(frame).orderBy("conv_id", "speaker", "turn").collect():
        got[(r.conv_id, r.speaker)].append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "eve"), (None, "unknown")}
    for (conv, speaker), rows in got.items():
        whole = "".join(r.segment for r in rows)
        for r in rows:
            assert whole[r.start:].startswith(r.segment)
            assert whole[r.mask_start:r.mask_end].endswith("<|end|>\n")
            assert r.trained == (r.role == "assistant") and (r.name is None) == (r.role != "user")
    assert "".join(r.segment for r in got[(1, "bob")]) == (
        "<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi<|end|>\n<|assistant|>\nhé 🙂<|end|>\n<|user name=ann|>\n<|end|>\n<|user name=eve|>\nx<|end|>\n")
    assert perspectives.rotate_perspectives(frame.limit(0)).count() == 0


def test_bitmaps_of_all_widths_lose_no_similar_pair():
    rng = np.random.default_rng(1)
    sets = []
    for size in (3, 50, 500, 530, 1000, 3000) * 4:
        base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        sets += [np.sort(rng.choice(base, size=max(1, int(len(base) * rng.uniform(0.75, 1))), replace=False)) for _ in range(4)]
    n, named = np.array([len(s) for s in sets]), np.arange(len(sets)) % 90
    got = set(trie_join.close_in_group(n, named, [trie_join.parity_bitmap(s) for s in sets]))
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if named[i] != named[j] and 100 * both >= 80 * (n[i] + n[j] - both):
                assert (i, j) in got
    assert all(named[i] != named[j] for i, j in got) and len(got) < 0.1 * len(sets) ** 2 / 2
