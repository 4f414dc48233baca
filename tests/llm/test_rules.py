import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from corpweave.llm import queries, rules
from tests.util import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The counts of the plain rules, said another way."""
    t = text or ""
    w = WORD.findall(t)
    where = {}
    for i in range(len(w) - 4):
        where.setdefault(tuple(w[i : i + 5]), []).append(i)
    inside = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(5)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside)


def texts():
    rnd = random.Random(3)
    out = [None, "", "  \n\t ", "one", "a b c d e f g h i", "é" * 5 + " ñ x   \x1c", "a b c d e f g\na b c d e f g\n\na b c d e f g", "x " * 40, "#*$ %&|<> " * 3 + "\r\n\x0b\x0c"]
    return out + [" ".join(rnd.choice("ab cd ef\n gh".split(" ")) for _ in range(rnd.randrange(60))) for _ in range(60)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'u' as id", "5 as n_words", "false as kept", "7 as `a.b`")


def test_query_equals_its_oracle(spark, sf, duck):
    same(queries.queries()["op11_quality_rules"](spark, sf), duck.sql(queries.oracle_sql()["op11_quality_rules"]))


def test_plain_rules(spark):
    got = {r.doc_id: r for r in rules.scanned(frame(spark, [(i, t, None) for i, t in enumerate(texts())])).collect()}
    for i, t in enumerate(texts()):
        want = plain(t)
        assert tuple(got[i])[1:6] == want, t
        assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert got[i].kept == (not got[i].base_failed) and got[i].ref_lang is None  # no language to learn from


def test_long_texts_repeat_alike(monkeypatch):
    rnd = random.Random(5)
    for n in (0, 4, 5, 6, 30, 400):
        w = [rnd.choice([b"a", b"b", b"c"]) for _ in range(n)] + [b"%d" % i for i in range(n)]
        few = rules.repeated(w)
        monkeypatch.setattr(rules, "LONG", 1)
        assert rules.repeated(w) == few
        monkeypatch.undo()


def test_distance_and_chance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    m = [0.25, 0.5, 0.25]
    want = math.sqrt(sum(a * math.log2(a / c) for a, c in zip(p, m) if a) / 2 + sum(a * math.log2(a / c) for a, c in zip(q, m) if a) / 2)
    assert abs(rules.distance(p, q) - want) < 1e-12 and rules.distance(p, p) == 0 and np.allclose(rules.distance(p, np.stack([q, p])), [want, 0])
    rng = np.random.default_rng(1)
    share = np.full(50, 0.02)
    seen = np.mean([rules.distance(rng.multinomial(2000, share) / 2000, share) ** 2 for _ in range(200)])
    assert abs(seen / rules.chance(50, 2000) - 1) < 0.1


def test_references_and_verdicts(spark):
    rnd = random.Random(9)
    common = {"x": "the of and to in".split(), "y": "der und die das zu".split()}
    prose = lambda lang, n: " ".join(rnd.choice(common[lang]) if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."
    rows = [(i, prose("xy"[i % 2], 200), "xy"[i % 2]) for i in range(60)]
    odd = [(100, prose("x", 300).upper(), "x"), (101, " ".join(f"{w}***" for w in prose("y", 300).split()), None), (102, " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400)), "x")]
    short = [(200, "THE OF AND TO IN OF THE AND IN TO OF ALL", None), (201, prose("y", 300), "x"), (202, prose("x", 200), "zz")]
    every = rows + odd + short + short[:1]
    learned = rules.references(frame(spark, every))
    assert learned.langs == ["x", "y"]  # the third has too few words
    counts, classes = Counter(), np.zeros(len(rules.NAMES))
    for i, t, lang in every:
        if lang == "x":
            counts.update(rules.plain_words(t.encode()))
            classes += rules.counted(t.encode()).classes
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: rules.COMMON]
    assert list(learned.words[0]) == [w for w, _ in top] and np.allclose(learned.shares[0][:-1], [n / counts.total() for _, n in top])
    assert np.allclose(learned.classes[0], classes / classes.sum())
    got = {r.doc_id: r for r in rules.scanned(frame(spark, every)).collect()}
    assert len(rules.scanned(frame(spark, every)).collect()) == len(every)
    wrong = [got[i] for i, _, lang in rows if not got[i].kept or got[i].ref_lang != lang]
    assert not wrong
    assert not any(got[i].kept or got[i].base_failed for i in (100, 101, 102))
    assert all(got[i].kept for i in (200, 201, 202)) and got[201].ref_lang == "y" and got[202].ref_lang == "x"


def test_quality_labels(spark, sf):
    """What the plain rules leave of labelled junk goes, clean documents stay."""
    lab = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(lab[r.doc_id], r.kept) for r in queries.queries()["op11_quality_rules"](spark, sf).collect() if lab.get(r.doc_id) is not None and not r.base_failed]
    kept = {q: [k for x, k in rows if x == q] for q in (0, 1)}
    assert sum(kept[1]) >= 0.98 * len(kept[1]) and sum(kept[0]) <= 0.1 * len(kept[0])


def test_query_equals_its_oracle_with_odd_rows(spark, tmp_path):
    rows = [(i % 50, t, [None, "a", "b"][i % 3]) for i, t in enumerate(texts())] + [(None, "the of and " * 30, "a"), (7, " ".join(f"w{i % 90} the" for i in range(2500)), "a"), (8, "!! ?? " * 20, "b")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.queries()["op11_quality_rules"](spark, str(tmp_path)), c.sql(queries.oracle_sql()["op11_quality_rules"]))
    empty = rules.scanned(frame(spark, rows).limit(0))
    assert empty.collect() == [] and empty.columns[0] == "doc_id"
