import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpweave.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items):
    w = WORD.findall(lower(text))
    hit, of = set(), set()
    for item, t in items:
        b = WORD.findall(lower(t))
        n = min(10, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                of.add(item)
    return len(w), len(hit), of


TEXT = st.lists(st.sampled_from(["a", "B", "c", "é", "d1", "-", ".", "\n", "中文"]), max_size=40).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(TEXT, max_size=4))
def test_scan_equals_brute_force(text, items):
    items = [(str(i), t) for i, t in enumerate(items)]
    built = d.automaton(d.windows([(i, t.encode()) for i, t in items]))
    n, hits = d.scan(text.encode(), built)
    rows = [{"first_word": a, "last_word": b} for a, b, _ in hits]
    assert (n, d.hit_words(rows), {x for _, _, of in hits for x in of}) == brute(text, items)
    spans = d._offsets(text.encode())
    assert [lower(text[a:b]) for a, b in spans] == WORD.findall(lower(text))


def of_words(hits):
    return sorted({(h["start"], h["end"], h["first_word"], h["last_word"], x or "") for h in hits for x in h["items"]})


def test_query_equals_its_oracle_with_odd_items(spark, duck, tmp_path):
    """Null ids, repeated ids, short items and columns that clash; no table of the tests has these."""
    import duckdb

    from corpweave.llm import queries
    from tests.util import same

    items = spark.createDataFrame([("1", "one two three"), (None, "alpha beta"), (None, "gamma"), ("1", "delta"), ("2", None), ("3", "..")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x one Two, three"), (2, "ALPHA beta gamma"), (3, "delta"), (4, None), (5, "alpha")], "doc_id long, text string").selectExpr("*", "1 as hits", "2 as n_hit")
    c = duckdb.connect()
    for name, df in (("benchmark", items), ("documents", docs)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
        c.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    same(queries.queries()["op10_decontamination"](spark, str(tmp_path)), c.sql(queries.oracle_sql()["op10_decontamination"]))
    assert d.scanned(docs, items).columns == ["doc_id", "text", "n_words", "n_hit", "hits"]
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.hits, r.n_hit) for r in kept.collect()) == [(4, 1, 2), (5, 1, 2)]


def test_blocks_and_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, passage), (2, "Ünï"), (3, None), (4, "..."), (None, "alpha beta"), (1, "gamma delta")], "item_id long, text string")
    rows = [(1, f"x {passage.upper()} y"), (2, None), (3, ""), (4, "ünï Ünï"), (5, "Alpha, beta gamma"), (5, "gamma delta " * 30000), (None, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as `a.b`", "3 as c0")
    one, two = (d.scanned(docs, items, most=b).collect() for b in (d.ITEM_BYTES, 20))
    for a, b in zip(sorted(one, key=str), sorted(two, key=str)):
        assert (a.doc_id, a.text, a.n_words, a.n_hit, of_words(a.hits)) == (b.doc_id, b.text, b.n_words, b.n_hit, of_words(b.hits))
    known = [(1, passage), (2, "Ünï"), (None, "alpha beta"), (1, "gamma delta")]
    for r in one:
        n, hit, of = brute(r.text, known)
        assert (r.n_words, r.n_hit) == (n, hit) and {x for h in r.hits for x in h["items"]} == {x and str(x) for x in of}
    first = next(r for r in one if r.doc_id == 1)
    assert {first.text[h["start"] : h["end"]].lower() for h in first.hits} == {passage.rsplit(" ", 1)[0], passage.split(" ", 1)[1]}
    assert d.clean(docs, items).columns == docs.columns and sorted(r.text or "" for r in d.clean(docs, items).collect()) == ["", "", "clean"]
    assert d.scanned(docs, items.limit(0)).where("n_hit > 0").count() == 0 and d.scanned(docs.limit(0), items).count() == 0
