import random

import numpy as np
import pytest
import xxhash

from corpweave.llm import simhash


def plain(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=3):
    """The component of each of [(id, fp)], by plain search over all pairs."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    fps = np.array([p for _, p in prints], np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius):
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(prints)):
        out.setdefault(root(i), []).append(prints[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in out.items()}
    return [least[root(i)] for i in range(len(prints))]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got.keys() == texts.keys()
    assert all(got[i][0] % 2**64 == plain(t) for i, t in texts.items())
    prints = [(i, plain(t)) for i, t in texts.items()]
    assert [got[i][1] for i, _ in prints] == brute_components(prints)


def test_chains_of_close_prints(spark):
    rnd = random.Random(5)
    fps = []
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 40, 80])):
            fps.append(x)
            for b in rnd.sample(range(64), rnd.choice([1, 2, 3, 3, 4])):
                x ^= 1 << b
    rows = [(i, f) for i, f in enumerate(sorted(set(fps)))]
    signed = [(int(np.uint64(f).astype(np.int64)),) for _, f in rows]
    edges = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    assert all(bin((a ^ b) % 2**64).count("1") <= 3 for a, b in edges)
    df = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    root = {r.node: r.root for r in df.collect()}
    want = brute_components(rows)
    groups = {}
    for (_, f), w in zip(rows, want):
        f = int(np.uint64(f).astype(np.int64))
        groups.setdefault(w, set()).add(root.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


LAYOUTS = [(3, ((32, 1), (32, 1))), (3, ((16, 0),) * 4), (8, ((22, 2), (21, 2), (21, 2))), (12, ((14, 2), (14, 2), (14, 2), (11, 1), (11, 1))), (7, ((32, 3), (32, 3))), (13, ((13, 2), (13, 2), (13, 2), (13, 2), (12, 1)))]


def near_prints(seed, radius):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(30)]
    return sorted({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, radius + 1))) for b in base for _ in range(12)})


@pytest.mark.parametrize("radius,segments", LAYOUTS)
@pytest.mark.parametrize("large", [4, 1 << 15])
def test_any_complete_segments_find_all(spark, radius, segments, large):
    """All pairs with few others near, none lost between tiles of a bucket, and the same components either way."""
    fps = near_prints(radius, radius)
    df = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)], "node long, fp long")
    most = 5
    found = simhash.met(df, segments, radius, most, large).collect()
    near = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= radius}
    pairs, spans = ({(r.a, r.b) for r in found if r.kind == k} for k in (simhash.PAIR, simhash.SPAN))
    assert pairs | spans <= near and len(pairs) > 50 and (large == 4 or radius == 3 or len(near) > len(pairs))
    label = list(range(len(fps)))
    for a, b in spans:
        x, y = label[a], label[b]
        label = [min(x, y) if c in (x, y) else c for c in label]
    assert all((a, b) in pairs or label[a] == label[b] for a, b in near)
    spanning = simhash.met(df, segments, radius, 0, large).collect()
    label = list(range(len(fps)))
    for r in spanning:
        x, y = label[r.a], label[r.b]
        label = [min(x, y) if c in (x, y) else c for c in label]
    assert label == brute_components(list(enumerate(fps)), radius)


def test_incomplete_segments_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.met(spark.createDataFrame([(1, 1)], "node long, fp long"), ((32, 1), (32, 1)), 4)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (None, "one two"), (6, "Ünï çode " * 40000), (7, "ünï çode " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as component_id")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    kept = {}
    for (i, t), c in zip(rows, brute_components([(i, plain(t)) for i, t in rows])):
        kept.setdefault(str((i, c)), 0)
        kept[str((i, c))] += 1
    assert sorted(map(str, got)) == sorted(x for x, n in kept.items() for _ in range(n))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
