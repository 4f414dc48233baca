import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corpweave.llm import queries
from corpweave.llm import urls as U
from tests.util import same

CHARS = "ab/.*?\\"


def regex(glob):
    out = ""
    for kind, c in U.tokens(glob):
        out += {"is": re.escape(c), "one": "[^/]", "many": "[^/]*", "all": ".*"}[kind]
    return re.compile(out, re.S)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(CHARS, max_size=8), max_size=12), st.lists(st.text("ab/.x中", max_size=12), min_size=1, max_size=6))
def test_automaton_equals_regular_expressions(globs, urls):
    a = U.Automaton([U.Rule(g, g, True, 0) for g in globs])
    got = a.fits(urls)
    assert got.shape == (len(urls), len(globs))
    for i, u in enumerate(urls):
        assert [bool(x) for x in got[i]] == [bool(regex(g).fullmatch(u)) for g in globs]


def test_many_words():
    globs = [f"*{'ab' * (i % 9 + 1)}**{i}" for i in range(200)]
    a = U.Automaton([U.Rule(g, g, True, 0) for g in globs])
    assert a.words > 20
    u = ["x" + "ab" * 9 + "/y/137", "", "ab199"]
    for row, url in zip(a.fits(u), u):
        assert [bool(x) for x in row] == [bool(regex(g).fullmatch(url)) for g in globs]


def test_query_equals_its_oracle(spark, sf, duck):
    same(queries.queries()["op3_url_filter"](spark, sf), duck.sql(queries.oracle_sql()["op3_url_filter"]))


def test_odd_urls(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme/example.org/es/"), (4, "HTTP://WWW.Example.ORG/es/A?x=/fr/"), (5, "http://example.org"), (6, "a://b://c.com/fr/"),
        (7, "http://notexample.org/es/"), (8, "http://x.com/y.org/de/"), (9, "http://x.com/de/" + "z" * 200000), (9, "http://x.com/de/" + "z" * 200000), (None, "https://m.x.com/fr/1#f"), (11, "http://org/"), (12, "http://é.example.org/en/12\n/x"),
        (13, "http://example.org#/es/"), (14, "http://casino.net/a"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "1 as rule")
    rules = [r for t, ok in queries._RULES for r in U.prefix_rules(t, ok, 1)] + [U.Rule("g", "*casino**", False, 0)]
    got = [(r.page_id, r.host, r.path[:12], r.rule, r.verdict) for r in U.judged(pages, rules).collect()]
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "www.example.org", "/es/A", "example.org/es/", "block"),
        (5, "example.org", "", None, "allow"), (6, "b:", "//c.com/fr/", None, "allow"), (7, "notexample.org", "/es/", "org/", "allow"), (8, "x.com", "/y.org/de/", None, "allow"),
        (9, "x.com", "/de/zzzzzzzz", "com/de/", "block"), (9, "x.com", "/de/zzzzzzzz", "com/de/", "block"), (None, "m.x.com", "/fr/1", "com/fr/", "allow"), (11, "org", "/", "org/", "allow"),
        (12, "é.example.org", "/en/12\n/x", "example.org/en/1", "block"), (13, "example.org", "", None, "allow"), (14, "casino.net", "/a", "g", "block"),
    ]
    assert U.judged(pages.limit(0), rules).count() == 0 and U.judged(pages, []).where("verdict = 'allow'").count() == len(rows)
    assert [r.glob for r in U.prefix_rules("a*b.net", True)] == [r"*.a\*b.net", r"*.a\*b.net/**"]
