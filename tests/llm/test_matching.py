"""Operators that compare documents or vectors: op3, op4, op10."""

import random

import numpy as np
import pytest
import xxhash

from pulsefleet.llm import nearcopy, simhash, topk
from pulsefleet.llm.components import connected_components
from pulsefleet.llm.decontam import MASKS, contaminated, decontaminate
from pulsefleet.llm.nearcopy import common_shingles, near_copies
from pulsefleet.llm.simhash import simhash_components
from pulsefleet.llm.topk import top_inner_products


def brute_simhash(rows, shingle, budget):
    prints = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        parts = [b" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((r[0], f"{p:016x}", rows[find(k)][0]) for k, (r, p) in enumerate(zip(rows, prints, strict=True)))


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["tide", "port", "Ship", "gull", "rope", "mast", "é", "x1", "the", "of"]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            t = (rng.choice(out)[1] or "").split()
            for _ in range(rng.randrange(3)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            out.append((i, " ".join(t)))
        else:
            out.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 60, 300])))))
    return [*out, (n, None), (n + 1, "\t \n"), (n + 2, "word " * 20_000)]


@pytest.mark.parametrize("hot", [20_000, 2])
def test_simhash_components_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)  # 2: every band value with three prints is split again
    rows = corpus(1, 160)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as fp", "1 as node", "2 as component_id")
    got = sorted(tuple(r) for r in simhash_components(df).select("doc_id", "fingerprint", "component_id").collect())
    assert got == brute_simhash(rows, 4, 4)
    assert simhash_components(df.limit(0)).count() == 0


def test_null_and_repeated_keys(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, a), (7, b), (9, b), (3, a), (None, a), (None, "alone c d e f"), (5, "other g h i j k")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, 3), (7, 3), (9, 3), (3, 3), (None, 3), (None, None), (5, 5)], key=str)


def test_trie_links_dense_group():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    fp = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))) for _ in range(3000)], np.uint64))
    label = simhash.trie_links(np.zeros(len(fp), np.int64), fp, 4)
    assert (label == 0).all()  # all hang together through the centre or near it
    far = np.array([0, 31, (1 << 64) - 1], np.uint64)
    assert list(simhash.trie_links(np.zeros(3, np.int64), far, 4)) == [0, 1, 2]
    assert list(simhash.trie_links(np.zeros(3, np.int64), far, 5)) == [0, 0, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 70: 50, 100: 50}
    assert connected_components(df.limit(0)).count() == 0


def test_common_shingles_equal_set_intersections():
    rng = np.random.default_rng(6)
    a, b = ([np.unique(rng.integers(0, 30_000, n).astype(np.uint64)) for n in sizes] for sizes in ((5, 9000, 1), (7000, 40)))
    assert (common_shingles(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


@pytest.mark.parametrize("rounds", [2, 1])
def test_near_copies_equal_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(nearcopy, "ROUNDS", rounds)
    monkeypatch.setattr(nearcopy, "HOT", 2000 if rounds == 2 else 2)
    monkeypatch.setattr(nearcopy, "ORDERED", 10_000 if rounds == 2 else 3)
    monkeypatch.setattr(nearcopy, "BLOCK", 20_000 if rounds == 2 else 500)  # few comparisons before, several blocks after
    rng = random.Random(3)
    rows = []
    for g in range(6):  # a group's texts differ in a few words: five-word similarities lie around 0.8, fingerprints far apart
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(200)]
        for _ in range(12):
            t = base[:]
            for _ in range(rng.randrange(1, 5)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    rows += [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, rows[0][1].upper() + "  "), (len(rows) + 3, "a b"), (len(rows) + 4, "a c")]

    def parts(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = [parts(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    df = spark.createDataFrame([*rows, (None, "a b")], "doc_id long, text string").selectExpr("*", "1 as node", "2 as component_id")
    got = {r["doc_id"]: r["component_id"] for r in near_copies(df).collect()}
    assert got == dict(enumerate(root))
    by_bits = {r["doc_id"]: r["component_id"] for r in simhash_components(df).collect()}
    assert sum(d != c for d, c in got.items()) > sum(d != c for d, c in by_bits.items())
    assert near_copies(df.limit(0)).count() == 0


def test_a_band_value_that_unlike_texts_share_is_split(spark):
    """20,000 nodes share one band value; 100 pairs of them share another: only these pairs are left to compare."""
    n = 20_000
    hot = spark.range(n).selectExpr("1L as k", "id as node", "200L as size", "id as c")
    own = spark.range(n).selectExpr("id as node", "if(id < 200, 10 + id div 2, 1000000 + id) as k").unionByName(hot.select("node", "k"))
    left = nearcopy.split_hot(hot, own)
    assert left.count() == 200 and left.groupBy("k").count().agg({"count": "max"}).first()[0] == 2


def test_a_frequent_band_value_loses_no_similar_pair(spark, monkeypatch):
    """Two similar texts share one band value only, which more than HOT unlike texts share too."""
    monkeypatch.setattr(nearcopy, "HOT", 5)
    rng = random.Random(5)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def own(w):
        return nearcopy.shingles(" ".join(w).encode().split(), 5)

    while True:
        a = words(154)
        b = [*a[:136], *words(18)]  # 132 of 168 shingles, 0.786, or more
        b[136:140] = a[136:140]  # 136 of 164: 0.829
        same = np.flatnonzero(nearcopy.band_values(own(a)) == nearcopy.band_values(own(b)))
        if len(same) == 1:
            break
    band, x = int(same[0]), own(a)
    mixed = (x * nearcopy.FACTORS + nearcopy.TERMS)[band * nearcopy.ROWS : (band + 1) * nearcopy.ROWS]
    least = {int(x[i]) for i in mixed.argmin(axis=1)}
    passage = [a[i : i + 5] for i in range(150) if int(own(a[i : i + 5])[0]) in least]
    texts = [a, b]
    while len(texts) < 40:  # the six shingles that make the value, and words of their own
        t = [w for five in passage for w in (*five, *words(1))] + words(20)
        if nearcopy.band_values(own(t))[band] == nearcopy.band_values(x)[band]:
            texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    both = [set(own(t).tolist()) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(both[i] & both[j]) >= 0.8 * len(both[i] | both[j])]
    assert alike == [(1, 0)]
    monkeypatch.setattr(nearcopy, "ROUNDS", 1)
    got = {r["doc_id"]: r["component_id"] for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i > 1 else 0 for i in range(len(texts))}


def test_rare_shingles_of_similar_sets_meet(spark):
    rng = random.Random(9)
    sets = []
    for _ in range(60):
        base = [rng.randrange(1 << 63) for _ in range(rng.randrange(1, 40))]
        sets += [set(base), {x for x in base if rng.random() > 0.1} | {rng.randrange(300) for _ in range(rng.randrange(3))}]
    rows = [(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in enumerate(sets)]
    kept = {}
    for r in nearcopy.rare_shingles(spark.createDataFrame(rows, "node long, own binary"), 0.8).collect():
        kept.setdefault(r["node"], set()).add(r["k"])
    alike = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) > 20 and all(kept[i] & kept[j] for i, j in alike)
    assert all(len(kept.get(i, ())) <= len(s) - -(-4 * len(s) // 5) + 1 for i, s in enumerate(sets))


def test_near_copies_of_the_given_documents(spark):
    """All pairs of the smallest table with a five-word similarity from 0.8 lie in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    got = {r["doc_id"]: r["component_id"] for r in near_copies(docs).collect()}
    ids = sorted(sets)
    alike = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(got[a] == got[b] for a, b in alike) >= 0.9 * len(alike)


def test_top_inner_products_equal_brute_force(spark):
    rng = random.Random(4)
    vecs = [[round(rng.uniform(-1, 1), 2) * rng.choice([0.1, 1, 5]) for _ in range(6)] for _ in range(120)]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(200, vecs[0]), (201, vecs[0]), (202, None), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] + [0.0] * 5), (205, [float("inf")] + [0.0] * 5), (206, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "0 as id", "1 as v")
    got = sorted(tuple(r) for r in top_inner_products(df.filter("vec_id % 20 = 0"), df, 7, block=16, query_block=3, steps=(2, 4)).select("query_id", "rank", "vec_id", "score").collect())
    whole = {i: np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, 6 - len(v))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in [i for i in whole if i % 20 == 0]:
        order = sorted(((-int(whole[q] @ whole[c]), c) for c in whole if c != q))[:7]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(order)]
    assert got == sorted(want)
    few = df.filter("vec_id < 3")
    assert top_inner_products(few.filter("vec_id = 0"), few, 20).count() == 2
    assert top_inner_products(df.limit(0), df, 5).count() == 0 and top_inner_products(few, df.limit(0), 5).count() == 0


def test_short_vectors_are_never_met(spark):
    """Norms that fall fast: later blocks cannot hold a best candidate, so their pairs are not formed."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 100 / (1 + i)]) for i in range(320)]
    df = spark.createDataFrame([*rows, (None, [1.0] * 4)], "vec_id long, embedding array<double>")
    read = spark.sparkContext.accumulator(0)
    queries = df.filter("vec_id % 20 = 0")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in top_inner_products(queries, df, 3, block=10, query_block=4, steps=(2,), pairs_read=read).collect()}
    whole = {i: np.floor(64 * np.array(v)) for i, v in rows}
    for q in [i for i in whole if i % 20 == 0]:
        order = sorted(((-int(whole[q] @ whole[c]), c) for c in whole if c != q))[:3]
        assert [got[q, n + 1] for n in range(3)] == [c for _, c in order]
    all_pairs = -(-320 // 10) * -(-16 // 4)
    assert 0 < read.value < all_pairs / 3


def test_no_side_of_a_round_is_broadcast(spark, monkeypatch):
    """Queries stand once for every step: sent to the driver they would grow with the square of the table. Steps stay small."""
    plans, kept = [], topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), kept(df, label))[1])
    monkeypatch.setattr(topk, "WIDTH", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-5, 6, 8) / 16]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_inner_products(df.filter("vec_id % 20 = 0"), df, 5, block=10, query_block=4, steps=(2,)).collect()}
    rounds = [plan for label, plan in plans if label == "top-so-far"]
    assert len(rounds) > 3 and not any("Broadcast" in plan for plan in rounds)
    whole = {i: np.floor(64 * np.array(v)) for i, v in rows}
    for q in [i for i in whole if i % 20 == 0]:
        order = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:5]
        assert [got[q, n + 1] for n in range(5)] == [(c, -s) for s, c in order]


def test_large_components_are_summed_exactly(spark):
    big = float(1 << 24)
    rows = [(0, [big, big, 1.0]), (1, [big, big, 3.0]), (2, [big, big, 2.0]), (3, [big, big, 0.0]), (4, [-big, 0.0, 1 / 64])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in top_inner_products(df.filter("vec_id = 0"), df, 9).orderBy("rank").collect()]
    whole = {i: [int(64 * x) for x in v] for i, v in rows}
    assert got == sorted(((c, sum(a * b for a, b in zip(whole[0], whole[c]))) for c in (1, 2, 3, 4)), key=lambda x: -x[1])
    far = spark.createDataFrame([(0, [1e18]), (1, [1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="range of a long"):
        top_inner_products(far, far, 1).collect()


def test_masks_keep_every_window_with_two_substitutions():
    for a in range(13):
        for b in range(13):
            assert any(not {a, b} & {o + m for m in mask} for mask in MASKS for o in range(13 - mask[-1]))


def brute_overlaps(docs, items):
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for d, t in docs:
        dw = words(t)
        for i, u in items:
            iw = words(u)
            width, least = min(13, len(iw)), 11 if len(iw) >= 13 else len(iw) - 1 if len(iw) >= 8 else len(iw)
            if not iw:
                continue
            for shift in range(-len(iw) + 1, len(dw)):
                js = range(max(0, -shift), min(len(iw), len(dw) - shift))
                eq = [dw[j + shift] == iw[j] for j in js]
                sums = [sum(eq[k : k + width]) for k in range(len(eq) - width + 1)]
                if sums and max(sums) >= least:
                    first = max(shift, 0) + next(k for k, s in enumerate(sums) if s >= least)
                    old = out.get((d, i), (0, 0, 10**9))
                    out[d, i] = (max(old[0], sum(eq)), max(old[1], max(sums)), min(old[2], first))
    return sorted((*k, *v) for k, v in out.items())


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_decontamination_equals_brute_force(spark, broadcast_rows):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([30, 20, 13, 12, 9, 8, 7, 40, 5, 3])] + [(20, None), (21, "a b"), (22, "w7"), (23, "")]
    docs = []
    for d in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 80]))]
        if d % 2:
            piece = rng.choice(items[:10])[1].split()
            lo = rng.randrange(max(1, len(piece) - 12))
            piece = piece[lo : lo + rng.choice([10, 13, 40])]
            for _ in range(rng.randrange(4)):
                piece[rng.randrange(len(piece))] = "other"
            at = rng.randrange(len(body) + 1)
            body[at:at] = piece
        docs.append((d, ", ".join(body).upper() if d % 3 else " ".join(body)))
    docs += [(100, None), (101, items[0][1]), (101, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as words")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in contaminated(df, bench, broadcast_rows=broadcast_rows).collect())
    assert got == brute_overlaps(docs, items) and got
    kept = {r["doc_id"] for r in decontaminate(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {g[0] for g in got}
    capital = spark.createDataFrame([(None, "What is the capital city of France"), (4, "of")], "item_id long, text string")
    quoted = spark.createDataFrame([(None, "He asked: what is the capital city of france? Nobody knew."), (1, "what is the capital town of france"), (2, None)], "doc_id long, text string")
    found = sorted((tuple(r) for r in contaminated(quoted, capital, broadcast_rows=broadcast_rows).collect()), key=str)
    assert found == [(1, 4, 1, 1, 5), (None, 4, 1, 1, 7), (None, None, 7, 7, 2)]
    assert [r["doc_id"] for r in decontaminate(quoted, capital).collect()] == [2]
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0
