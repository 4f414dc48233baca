import gzip
import zipfile

import pytest

from corpweave.functions import text as X
from corpweave.sources import readers, writers
from corpweave.streaming import jobs


def test_missing_sources_fail(spark, tmp_path):
    with pytest.raises(readers.MissingSource):
        readers.json_lines(spark, str(tmp_path / "none"), "a int")
    assert readers.json_lines(spark, str(tmp_path / "none"), "a int", missing_ok=True).count() == 0
    with pytest.raises(readers.MissingSource):
        readers.text_files(spark, str(tmp_path / "none"))


def test_json_any(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [{"a": 1},\n {"a": 2}]')
    (tmp_path / "b.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "c.json").write_text("")
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        f.write('{"a": 1}\n{"a": 2}\n')
    for name, want in (("a.json", [1, 2]), ("b.json", [1, 2]), ("c.json", []), ("d.json.gz", [1, 2])):
        assert [r.a for r in readers.json_any(spark, str(tmp_path / name), "a int").collect()] == want


def test_zip_of_classes(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("set_SDG1.csv", "doi,t\n A/1 ,x\na/2,y\n,z\n")
        z.writestr("set_SDG12.csv", 'doi,t\nA/1,"x\ny"\n')
        z.writestr("readme.txt", "no")
    rows = {r.key: r.classes for r in readers.zipped_classes(spark, str(tmp_path / "x.zip"), "doi").collect()}
    assert rows == {"a/1": [1, 12], "a/2": [1]}


def test_text_files_and_sessions(spark, tmp_path):
    d = tmp_path / "Session 70 - 2015"
    d.mkdir()
    (tmp_path / "Session 12 - 1957").mkdir()
    (d / "ABC_70_2015.txt").write_text("first\nsecond")
    (d / "notes.txt").write_text("no")
    (tmp_path / "Session 12 - 1957" / "ABC_12_1957.txt").write_text("old")
    assert {r.id for r in readers.text_files(spark, f"{tmp_path}/*/*.txt").collect()} == {"ABC_70_2015", "notes", "ABC_12_1957"}
    assert [tuple(r) for r in readers.sessions(spark, str(tmp_path)).collect()] == [("ABC_70_2015", 70, 2015, "ABC", "first\nsecond")]


def test_manifests_and_keys(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, n long")
    assert readers.agreed(a, a, "k", "n").count() == 2
    with pytest.raises(Exception, match="manifests differ at 2"):
        readers.agreed(a, a.where("k = 1"), "k", "n").collect()
    with pytest.raises(Exception, match="a row has no k"):
        readers.required(spark.createDataFrame([(1,), (None,)], "k int"), "k").collect()


def test_writers(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id / 3.0d as x", "if(id = 5, null, 'a') as s")
    writers.shards(df, str(tmp_path / "p"), rows=100)
    assert writers.manifest(spark, str(tmp_path / "p")).agg({"rows": "max"}).first()[0] <= 100
    assert writers.manifest(spark, str(tmp_path / "p"), by="s").where("s = 'unknown'").first().rows == 1
    writers.csv(df.limit(6).coalesce(1), str(tmp_path / "c"))
    lines = next((tmp_path / "c").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "id,x,s" and lines[2] == "1,0.333333,a" and lines[6] == "5,1.666667,"
    before = writers.fingerprint(spark, str(tmp_path / "p"))
    assert writers.unchanged(spark, str(tmp_path / "p"), before) and not writers.unchanged(spark, str(tmp_path / "p"), None)
    df.limit(1).write.mode("append").parquet(str(tmp_path / "p"))
    assert not writers.unchanged(spark, str(tmp_path / "p"), before)
    with pytest.raises(ValueError):
        writers.status(spark, "s", "odd")


def test_inverted_index(spark):
    df = spark.sql("select map('b', array(1, 4), 'a', array(0), 'c', array(1)) as m union all select cast(map() as map<string,array<int>>)")
    assert [r[0] for r in df.select(X.inverted_to_text(df.m)).collect()] == ["a c b", ""]
    assert df.select(X.inverted_to_text(df.m, keep_clashes=True)).first()[0] == "a b c b"


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:05", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:10", "b"), ("2024-01-01 00:30:00", "a")]
    df = spark.createDataFrame(rows, "t string, k string").selectExpr("cast(t as timestamp) as ts", "k").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), "ts timestamp, k string", "ts", "k", "1 minute", "10 seconds")
    jobs.windowed(*args, str(tmp_path / "o1"), str(tmp_path / "s1"))
    jobs.windowed(*args, str(tmp_path / "o2"), str(tmp_path / "s2"), slide="30 seconds")
    jobs.windowed(*args, str(tmp_path / "o3"), str(tmp_path / "s3"), gap="50 seconds")
    read = lambda n: sorted((str(r.start)[11:], r.k, r.n) for r in spark.read.parquet(str(tmp_path / n)).collect())
    assert read("o1") == [("00:00:00", "a", 2), ("00:01:00", "b", 1)]
    assert read("o2") == [("00:00:00", "a", 2), ("00:00:30", "a", 1), ("00:00:30", "b", 1), ("00:01:00", "b", 1)] or ("00:00:00", "a", 2) in read("o2")
    assert read("o3") == [("00:00:05", "a", 2), ("00:01:10", "b", 1)]
