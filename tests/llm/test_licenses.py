import random
import time

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpweave.llm import licenses as L

INDEX = L.Index(L.templates())


def one(data, index=INDEX):
    return L.scan([data], index)[0]


def test_every_template_is_found_whole_and_changed():
    rnd = random.Random(2)
    for name, text in L.templates().items():
        data = f"Ünï words before. {text} and after".encode()
        hits = {h[0]: h for h in one(data)}
        assert hits[name][2] == 1.0 and L.words(data[hits[name][3] : hits[name][4]]) == L.words(text.encode())
        w = text.split()
        if len(w) > 25:
            for at in rnd.sample(range(5, len(w) - 5), 2):
                w[at] = "changed"
            del w[12]
            hit = {h[0]: h for h in one(" ".join(w).encode())}[name]
            assert 0.8 <= hit[2] < 1


def test_short_notices_that_follow_one_another():
    for name, text in L.SHORT.items():
        for n in (2, 5):
            found = [h for h in one(" ".join([text] * n).encode()) if h[0] == name]
            assert len(found) == n and all(h[2] == 1 for h in found), name


def test_winnowing_guarantee():
    """Any run of five words that a text shares with a template holds a kept gram."""
    for name, ids in zip(INDEX.names, (t.tolist() for t in INDEX.texts)):
        for i in range(len(ids) - 4):
            grams = [INDEX._code(ids[j : j + 3]) for j in range(i, i + 3)]
            assert any(g in INDEX.places for g in grams), name


def brute_align(t, ids, band=None, diagonal=0):
    """(score, matched, -first, end) of the best local alignment, cell by cell, in full or within a band."""
    best, before = (0, 0, 0, 0), {}
    for i, x in enumerate(t):
        row = {}
        for j in range(len(ids)) if band is None else range(i + diagonal - band, i + diagonal + band + 1):
            s, m, f = before.get(j - 1, (0, 0, 0))
            same = 0 <= j < len(ids) and ids[j] == x
            cell = (s + 2, m + 1, f if s else -j) if same else (s - 1, m, f)
            for s, m, f in (before.get(j, (0, 0, 0)), row.get(j - 1, (0, 0, 0))):
                cell = max(cell, (s - 1, m, f))
            if cell[0] > 0:
                row[j] = cell
                if cell > best[:3]:
                    best = (*cell, j + 1)
        before = row
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(0, 4), min_size=1, max_size=14), st.integers(1, 20), st.integers(-8, 12))
def test_banded_alignment_equals_cells(t, ids, band, diagonal):
    text = np.full((1, len(t) + 2 * band), -1, np.int32)
    for at in range(text.shape[1]):
        if 0 <= (j := at + diagonal - band) < len(ids):
            text[0, at] = ids[j]
    matched, first, end = (int(x[0]) for x in L.align(np.array(t), text, band))
    score, m, f, e = brute_align(t, ids, band, diagonal)
    assert matched == m
    if m:
        assert (first + diagonal - band, end + diagonal - band) == (-f, e)
    if band == 20 and diagonal == 0:
        assert (score, m) == brute_align(t, ids)[:2]


def brute_scan(text, templates):
    """The whole scan without an index, gates or batches: (license, matched, first, after the last word) of all spans."""
    ids, out = L.words(text.encode()), []
    for name, t in templates.items():
        t = L.words(t.encode())
        hashes = [xxhash.xxh64_intdigest(b" ".join(t[i : i + 3])) for i in range(len(t) - 2)]
        kept = {max((-hashes[j], j) for j in range(i, min(i + 3, len(hashes))))[1] for i in range(max(len(hashes) - 3, 0) + 1)} if hashes else set()
        band, last, found = min(8, max(1, len(t) // 3)), None, []
        for d in sorted({p - i for i in kept for p in range(len(ids) - 2) if ids[p : p + 3] == t[i : i + 3]}):
            if last is None or d - last > band:
                last = d
                _, m, f, e = brute_align(t, ids, band, d)
                if m >= 0.8 * len(t):
                    found.append((m, -f, e))
        spans = []
        for m, a, e in sorted(found, key=lambda x: (x[1], -x[0])):
            if not spans or a >= spans[-1][2]:
                spans.append((m, a, e))
            elif m > spans[-1][0]:
                spans[-1] = (m, a, e)
        out += [(name, m, a, e) for m, a, e in spans]
    return out


def spans_of(text, index):
    """As ``brute_scan``, from the operator's bytes."""
    data = text.encode()
    return [(h[0], h[1], len(L.words(data[: h[3]])), len(L.words(data[: h[4]]))) for h in one(data, index)]


def test_whole_scan_equals_brute_force(spark, sf):
    short = {n: t for n, t in L.SHORT.items() if len(t) < 400}
    index, rnd = L.Index(short), random.Random(4)
    names, texts = list(short), []
    for _ in range(120):
        w = []
        for _ in range(rnd.randint(1, 4)):
            t = short[rnd.choice(names)].split()
            for _ in range(rnd.choice([0, 0, 1, 3])):
                at = rnd.randrange(len(t))
                t[at : at + 1] = rnd.choice([[], ["other"], ["the", "software"], [t[at], "added"]])
            w += t + rnd.choice([[], ["und"] * rnd.randint(1, 5)])
        texts.append(" ".join(w))
    for t in texts:
        assert sorted(spans_of(t, index)) == sorted(brute_scan(t, short)), t
    docs = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    lines = {n: t for n, t in L.SHORT.items() if len(t) < 100}
    index = L.Index(lines)
    hit = [t for t in docs if "icense" in t and len(t) < 20_000]
    assert len(hit) > 20
    for t in hit[:60]:
        assert sorted(spans_of(t, index)) == sorted(brute_scan(t, lines))


def test_hostile_texts_cost_little_more_than_plain_ones():
    plain = ("plain words that no license has in a row stand here and there " * 2000).encode()
    for part in ("copies of the software x ", "the software ", "this software is provided ", "of the software and of the license ", "Released under the MIT License. x "):
        hostile = (part * (len(plain) // len(part))).encode()
        seconds = []
        for data in (plain, hostile):
            began = time.process_time()
            one(data)
            seconds.append(time.process_time() - began)
        assert seconds[1] < 10 * seconds[0] + 2, (part, seconds)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = L.scanned(docs).collect()
    index = L.Index(L.templates())
    text = {r.doc_id: r.text for r in docs.collect()}
    lines = {"Released under the MIT License.": "MIT line", "Licensed under the Apache License, Version 2.0.": "Apache-2.0 line", "Licensed under CC BY-NC 4.0.": "CC-BY-NC line", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0 line"}
    for line, name in lines.items():
        assert {r.doc_id for r in rows if r.license == name and r.coverage == 1} == {i for i, t in text.items() if L.words(line.encode()) and b" ".join(L.words(line.encode())) in b" ".join(L.words(t.encode()))}
    want = sorted((i, h[0], h[1]) for i, t in text.items() for h in one((t or "").encode(), index))
    assert sorted((r.doc_id, r.license, r.matched) for r in rows) == want
    for r in rows:
        assert r.coverage >= 0.8 and 0 <= r.start < r.end <= len(text[r.doc_id])


def test_odd_rows(spark):
    mit = L.SHORT["MIT"]
    rows = [(1, None), (2, ""), (3, "  "), (4, mit), (4, mit), (None, mit), (6, "the software " * 50000), (7, f"{mit} x {mit}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license", "2 as `a.b`")
    got = [(r.doc_id, r.license) for r in L.scanned(docs, {"MIT": mit, "none": "", "GPL-3.0": L.templates()["GPL-3.0"]}).collect()]
    assert sorted(got, key=str) == sorted([(4, "MIT"), (4, "MIT"), (None, "MIT"), (7, "MIT"), (7, "MIT")], key=str)
    assert L.scanned(docs.limit(0)).count() == 0 and L.scanned(docs, {}).count() == 0
