"""Lexical categories beside letters that are not ASCII, and of missing texts, against SQL."""

import duckdb

from corpweave import registry
from tests.util import same


def test_audit_equals_its_sql_on_odd_texts(spark, tmp_path):
    texts = ["dieü", "üdie", "xthe", "the der", "THE", "and_", "and1", "die-ß", "die", None, "", "thé and", "deŕ", "ändern"]
    con = duckdb.connect()
    for name, columns, rows in (("documents", "doc_id bigint, text varchar", list(enumerate(texts))), ("labels", "doc_id bigint, quality int", [(i, i % 2 if i != 3 else None) for i in range(len(texts))])):
        con.sql(f"create table {name} ({columns})")
        con.executemany(f"insert into {name} values (?, ?)", rows)
        con.sql(f"copy {name} to '{tmp_path}/{name}.parquet'")
    same(registry.queries()["gap_14_lexical_audit"](spark, str(tmp_path)), con.sql(registry.oracle_sql()["gap_14_lexical_audit"]))
