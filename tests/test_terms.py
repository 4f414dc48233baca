"""Terms are counted where their text stands; rows that share an id are one document, as in SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpweave import registry
from corpweave.operators import terms
from tests.util import same

TEXTS = ["The old house stood near the old mill", "old mill house near water", "water near the old house", None, "", "A b CD", "Über den alten Fluss near water", "the mill the mill the mill"]


@pytest.mark.parametrize("shared", [False, True])
def test_contrast_equals_sql_on_odd_rows(spark, tmp_path, shared):
    rows = [(i // 2 if shared and i < 20 else None if shared and i > 36 else i, TEXTS[i % 8], ("en", "de", None)[i % 3]) for i in range(40)]
    t = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": [r[2] for r in rows]})
    pq.write_table(t, tmp_path / "documents.parquet")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    same(registry.queries()["mlc_13_tfidf_contrast"](spark, str(tmp_path)), c.sql(registry.oracle_sql()["mlc_13_tfidf_contrast"]))


def test_counts_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(t and t.lower(),) for t in TEXTS * 100], "text string").coalesce(1)
    for held in (400_000, 3):
        monkeypatch.setattr(terms, "HELD", held)
        got = {r.term: (r.df, r.all) for r in terms.counted(docs, "text").collect()}
        assert got["mill"] == (300, 500) and got["the mill"] == (100, 300) and got["near water"] == (200, 200) and "cd" not in got
