import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

import corpus_pipeline as P
from corpweave.llm import nearby


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def print_of(text):
    """The fingerprint of five-word shingles, bit by bit."""
    words = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5]), 42) for i in range(max(len(words) - 5, 0) + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(texts):
    """For each text the index of the first of its group, by plain search over all pairs."""
    sets, prints = [shingle_set(t) for t in texts], [print_of(t) for t in texts]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if (prints[i] ^ prints[j]).bit_count() > 13:
            continue
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def wanted(rows):
    rows = sorted(rows)
    return [rows[i][0] for i, r in enumerate(groups([t for _, t in rows])) if i == r]


def changed(rnd, words, share):
    words = list(words)
    for i in rnd.sample(range(len(words)), max(1, int(len(words) * share))):
        words[i] = f"new{rnd.getrandbits(32)}"
    return words


def texts(seed, bases, copies):
    rnd = random.Random(seed)
    out = []
    for _ in range(bases):
        base = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.choice([3, 6, 40, 120, 300]))]
        for _ in range(copies):
            out.append(" ".join(changed(rnd, base, rnd.choice([0.001, 0.003, 0.01, 0.02, 0.05]))))
            if rnd.random() < 0.3:
                base = changed(rnd, base, 0.01)
    return list(enumerate(out))


def test_similar_pairs_are_all_found(spark, sf):
    rows = texts(3, 40, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, sf).collect()) == wanted(rows)
    assert len(rows) * 0.2 < len(wanted(rows)) < len(rows) * 0.9


def test_links_below_the_threshold_are_not_made(spark, sf):
    rnd = random.Random(8)
    base = [f"w{rnd.randint(0, 3000)}" for _ in range(400)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:200] + ["other"] + base[201:])), (2, " ".join(base[:200] + [f"x{i}" for i in range(44)] + base[244:]))]
    rows += [(3 + i, " ".join(base[:40] + [f"own{i}-{j}" for j in range(60)])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, sf).collect()) == wanted(rows)


def test_large_buckets_lose_nothing(spark, sf):
    rows = texts(4, 6, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, sf).collect()) == wanted(rows)


@pytest.mark.parametrize("tile", [3, 256])
def test_dense_regions_lose_nothing(spark, tile, monkeypatch):
    """Copies with a passage in common are near one another; few are similar to the nearest ones alone."""
    rnd = random.Random(6)
    base = [f"w{rnd.randint(0, 3000)}" for _ in range(300)]
    rows = list(enumerate(" ".join(changed(rnd, base, rnd.choice([0.004, 0.01, 0.015, 0.02, 0.025, 0.03]))) for _ in range(90)))
    docs = spark.createDataFrame(rows, "id long, text string")
    prints = nearby.signed(docs).cache()
    monkeypatch.setattr(nearby, "MOST", 0)
    tiled = nearby._region_links
    monkeypatch.setattr(nearby, "_region_links", lambda apart, sets: tiled(apart, sets, tile))
    called = []
    monkeypatch.setattr(nearby, "_apart", lambda *x, of=nearby._apart: called.append(of(*x)) or called[-1])
    node = {r.node: r.id for r in prints.collect()}
    root = {node[r.node]: r.root for r in nearby.roots(docs, prints, True).collect()}
    least = {}
    for i, r in sorted(root.items()):
        least.setdefault(r, i)
    assert [least[root[i]] if i in root else i for i, _ in rows] == groups([t for _, t in rows])
    assert called[0] is not None and 3 < len(least) + len(rows) - len(root) < 80


def test_tiles_join_groups_once():
    rnd = random.Random(2)
    rows = texts(5, 3, 30)
    sides = [[(i, int(np.uint64(print_of(t)).astype(np.int64)), np.sort(nearby.shingles(t.encode()).view(np.int64))) for i, t in rows] for _ in range(2)]
    rnd.shuffle(sides[0])
    found = list(nearby.tile_links(sides[0], iter(sides[1])))
    assert len(rows) - len(found) == len(set(groups([t for _, t in rows])))


def test_recall_of_the_fingerprint(spark, sf):
    """Of the pairs at 0.8 or more, without the fingerprint's condition, nine of ten share a group."""
    rnd = random.Random(11)
    pairs = []
    while len(pairs) < 300:
        base = [f"w{rnd.randint(0, 3000)}" for _ in range(300)]
        a, b = " ".join(base), " ".join(changed(rnd, base, rnd.uniform(0.001, 0.024)))
        x, y = shingle_set(a), shingle_set(b)
        if 5 * len(x & y) >= 4 * len(x | y):
            pairs.append((a, b))
    docs = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "doc_id long, text string")
    assert nearby.keep_one(docs).count() <= 300 + 30


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (4, "other words"), (None, "one two"), (6, "Ünï çode " * 40000), (7, "Ünï çode " * 40000), (8, "OTHER words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("map('k', doc_id) as region", "*", "'x' as node", "1 as fp", "2 as `a.b`")
    got = nearby.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, None), (4, "one two"), (4, "other words"), (6, "Ünï çode " * 40000)], key=str)
    assert nearby.keep_one(docs.limit(0)).count() == 0


def test_stage_on_the_table(spark, sf):
    docs = P.keep_quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, sf).collect()) == wanted(rows)
