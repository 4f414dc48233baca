import gzip
import hashlib
import html
import re
import time

import pytest

from corpweave.llm import queries
from corpweave.llm import warc as W
from tests.util import same


def plain(text):
    for pattern, replacement in W.STEPS:
        text = re.sub(pattern.replace(r"\z", r"\Z"), replacement, text)
    return text


def test_query_equals_its_oracle(spark, sf, duck):
    same(queries.queries()["op7_warc_derivatives"](spark, sf), duck.sql(queries.oracle_sql()["op7_warc_derivatives"]))


def test_links_digests_and_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    responses = W.responses(pages)
    by_id = {r.record_id: r for r in responses.collect()}
    made = W.derivatives(responses).collect()
    assert len(by_id) == pages.count() and len(made) == 2 * len(by_id) and len({r.record_id for r in made}) == len(made)
    for r in made:
        source = by_id[r.refers_to]
        assert (r.target_uri, r.date, r.payload_digest, r.http) == (source.target_uri, source.date, source.payload_digest, source.http)
        assert r.payload_digest == "sha256:" + hashlib.sha256(source.payload.encode()).hexdigest()
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        if r.type == "conversion":
            assert r.block == plain(source.payload) and "<" not in html.unescape(r.block) or "&lt;" in source.payload
        else:
            assert re.findall(r"^outlink: (.*)$", r.block, re.M) == re.findall(r'(?i)<a\b[^>]*?\bhref="([^"]*)"', source.payload)


def test_files_round_trip(spark, sf, tmp_path):
    r = W.responses(spark.read.parquet(f"{sf}/pages.parquet"))
    d = W.derivatives(r)
    for name, records in (("r", r), ("d", d)):
        W.write(records.repartition(3), str(tmp_path / name))
        back = {x.headers["warc-record-id"]: x for x in W.read(spark, str(tmp_path / name)).collect()}
        rows = records.collect()
        assert len(back) == len(rows)
        for x in rows:
            b = back[x.record_id]
            assert b.block.decode() == (f"{x.http}\r\n\r\n{x.payload}" if name == "r" else x.block)
            assert b.headers["warc-type"] == x.type and b.headers.get("warc-refers-to") == x.refers_to and b.headers["warc-target-uri"] == x.target_uri


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "u", "<p>a<br>b<script>x<y</script><!-- c --> &amp;lt; <b>d"), (3, "u", "<p>a"), (None, "u", "t" * 200000), (5, "u\r\nX: y", "<script>open")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as type", "2 as record_id")
    made = W.derivatives(W.responses(pages)).collect()
    assert len(made) == 2 * len(rows)
    text = sorted(r.block for r in made if r.type == "conversion")
    assert text == sorted(["", "", "a\nb &lt; d", "a", "t" * 200000, ""])
    assert W.derivatives(W.responses(pages.limit(0))).count() == 0
    assert W.lines_of(W.derivatives(W.responses(pages))).where("value like '%\r\nX: y%'").count() == 0


def test_hostile_pages_take_linear_time(spark):
    """What opens again and again without an end, at twice the size, takes little more than twice the time."""
    parts = ["<!-- ", "<script ", "<script>", "<style>", "<title>", "<title ", "<p ", "<a ", '<a href="', "<", "&", " \n", "</script ", '<a href="x" ']
    seconds = {}
    for n in (500_000, 1_000_000):
        pages = spark.createDataFrame([(i, "u", p * (n // len(p))) for i, p in enumerate(parts)], "page_id long, url string, html string").repartition(len(parts)).cache()
        pages.count()
        began = time.time()
        W.derivatives(W.responses(pages)).write.format("noop").mode("overwrite").save()
        seconds[n] = time.time() - began
        pages.unpersist()
    assert seconds[1_000_000] < 3 * seconds[500_000] + 3, seconds


def test_query_equals_its_oracle_on_odd_pages(spark, tmp_path):
    import duckdb

    odd = ["a < b and c > d", "1 < 2", "<p>x<!-- open", "<title>one", "<script src=x", '<a href="u">t</a><a>no</a><a name=x href="">e', "<b", "<title>A\n B</title><TITLE>2</TITLE>", "<style>p{}</style >z", None, "<!-- a --><!-- b -->c&amp;lt;"]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(odd)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    same(queries.queries()["op7_warc_derivatives"](spark, str(tmp_path)), c.sql(queries.oracle_sql()["op7_warc_derivatives"]))


def test_files_of_other_tools(spark, tmp_path):
    """Version 1.0, a member for each record, folded headers, blocks that are no text, and a file cut short."""
    blocks = [b"\x00\xff\r\n\r\nWARC/1.0\r\n", b"", "Ünï".encode()]
    records = [b"WARC/1.0\r\nWARC-Type: resource\r\nX-Folded: one\r\n two\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in blocks]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "in" / "b.warc").write_bytes(b"".join(records))
    back = W.read(spark, str(tmp_path / "in")).collect()
    assert sorted(bytes(r.block) for r in back) == sorted(2 * blocks)
    assert all(r.headers["x-folded"] == "one two" and r.headers["warc-version"] == "1.0" for r in back)
    with pytest.raises(ValueError):
        list(W.records_of(records[0][:-8]))
