"""Forms of queries that grow with their input, against their SQL on odd inputs."""

import duckdb

from corpweave import registry
from tests.util import same


def test_map_of_words_keeps_missing_and_repeated_rows_and_shuffles_nothing(spark, tmp_path):
    con = duckdb.connect()
    con.sql("create table documents as select * from (values (1, 'a b  a'), (1, 'c'), (2, null), (3, ''), (4, ' é é\n x ')) t(doc_id, text)")
    con.sql(f"copy (select doc_id::bigint as doc_id, text, 'en' as lang, 's' as source, 0::bigint as n_chars from documents) to '{tmp_path}/documents.parquet'")
    df = registry.queries()["src_21_inverted_index"](spark, str(tmp_path))
    same(df, con.sql(registry.oracle_sql()["src_21_inverted_index"]))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_rows_are_not_multiplied(spark, tmp_path):
    con = duckdb.connect()
    con.sql("create table events as select i::bigint as event_id, case when i % 5 = 0 then null else (i * 7 % 11)::double end as value from range(0, 40) t(i)")
    con.sql(f"copy events to '{tmp_path}/events.parquet'")
    df = registry.queries()["smp_11_pooled_bootstrap"](spark, str(tmp_path))
    same(df, con.sql(registry.oracle_sql()["smp_11_pooled_bootstrap"]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan
