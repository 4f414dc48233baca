"""Source, sink, streaming and callback queries.

A query writes what it needs in a folder of its own in the shared folder and reads it back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpweave.functions import text as X
from corpweave.plans.base import SEG, segments, table
from corpweave.registry import query
from corpweave.session import cut, shared_dir
from corpweave.sources import readers, writers
from corpweave.streaming import jobs
from corpweave.streaming.log import RecordLog

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corpweave-{uuid.uuid4().hex}"


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


_DOCS_SQL = "select doc_id, md5(text) as digest, lang from documents"


@query("src_01_json_lines", _DOCS_SQL)
def src_01(spark, sf_dir):
    """SRC-01 and SNK-01: one JSON object on each line, written in shards and read back."""
    at = folder(spark)
    writers.shards(_docs(spark, sf_dir), at, form="json")
    return readers.json_lines(spark, at, DOC).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("src_02_json_stream", _DOCS_SQL)
def src_02(spark, sf_dir):
    """SRC-02: the same as a stream; a checkpoint takes the place of a byte offset."""
    at = folder(spark)
    _docs(spark, sf_dir).write.json(f"{at}/in")
    jobs.clean(spark, f"{at}/in", DOC, lambda d: d, "doc_id", f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("doc_id", F.md5("text").alias("digest"), "lang")


@query("src_03_json_any", "select item_id, text from benchmark")
def src_03(spark, sf_dir):
    """SRC-03: a JSON array, told from lines by its first character."""
    at = folder(spark)
    b = table(spark, sf_dir, "benchmark")
    whole = b.agg(F.to_json(F.array_sort(F.collect_list(F.struct("item_id", "text")))).alias("value"))  # the benchmark is small by nature
    whole.coalesce(1).write.text(at)
    return readers.json_any(spark, at, "item_id long, text string").select("item_id", "text")


@query("src_04_tsv", "select conv_id, turn, role, md5(text) as digest from conversations")
def src_04(spark, sf_dir):
    """SRC-04: tab-separated with a header; strings are cast afterwards."""
    at = folder(spark)
    table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").write.option("sep", "\t").option("header", True).option("escape", '"').option("quoteAll", True).csv(at)
    d = readers.delimited(spark, at, "conv_id string, turn string, role string, text string", "\t", breaks=True)
    return d.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.md5("text").alias("digest"))


@query("src_05_csv", "select o_orderkey, o_orderpriority, round(o_totalprice, 2) as price from orders")
def src_05(spark, sf_dir):
    """SRC-05: comma-separated with a header."""
    at = folder(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").write.option("header", True).csv(at)
    return readers.delimited(spark, at, "o_orderkey long, o_orderpriority string, o_totalprice double").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 2).alias("price"))


@query("src_06_one_hot", "select doc_id, case when quality = 1 and toxic = 1 then '1,2' when quality = 1 then '1' else '2' end as ids from labels where quality = 1 or toxic = 1")
def src_06(spark, sf_dir):
    """SRC-06: label columns found by the prefix of their names."""
    at = folder(spark)
    table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("CLASS-1"), F.col("toxic").alias("CLASS-2")).write.option("header", True).csv(at)
    d, flags = readers.one_hot(spark, at, "CLASS-")
    return d.select(F.col("doc_id").cast("long"), X.labels_of(flags).alias("l")).where("l is not null").select("doc_id", F.array_join("l", ",").alias("ids"))


@query("src_07_nested_parquet", "select doc_id, source from documents where lang = 'fr'")
def src_07(spark, sf_dir):
    """SRC-07: Parquet with a nested struct; the predicate on its field reaches the scan."""
    at = folder(spark)
    _docs(spark, sf_dir).select("doc_id", F.struct(F.col("lang").alias("language"), "source").alias("metadata")).write.parquet(at)
    return spark.read.parquet(at).where("metadata.language = 'fr'").select("doc_id", "metadata.source")


@query("src_12_vectors", "select vec_id, label, len(embedding) as d, round(cast(embedding[1] as double), 6) as first from embeddings")
def src_12(spark, sf_dir):
    """SRC-12: a matrix as a column of vectors."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("d"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("src_13_manifest", "select 'agree' as state, lang, cast(count(*) as bigint) as rows from documents where lang is not null group by 2 union all select 'differ', 'refused', 3")
def src_13(spark, sf_dir):
    """SRC-13: a manifest is written beside its shards and read before them; one with another count, one without a shard, and one
    with a shard too many are refused."""
    at = folder(spark)
    _docs(spark, sf_dir).where("lang is not null").select("doc_id", "lang").write.partitionBy("lang").parquet(f"{at}/shards")
    found = spark.read.parquet(f"{at}/shards").groupBy("lang").agg(F.count("*").alias("rows"))
    found.write.json(f"{at}/manifest")
    said = spark.read.schema("lang string, rows long").json(f"{at}/manifest")
    good = readers.agreed(said, found, "lang", "rows")
    refused = 0
    for wrong in (said.withColumn("rows", F.col("rows") + (F.col("lang") == "en").cast("int")), said.where("lang <> 'en'"), said.unionByName(said.limit(1).withColumn("lang", F.lit("none")))):
        try:
            readers.agreed(wrong, found, "lang", "rows").write.format("noop").mode("overwrite").save()
        except Exception as e:
            if "manifests differ at" not in str(e):
                raise
            refused += 1
    return good.select(F.lit("agree").alias("state"), "lang", "rows").unionByName(spark.createDataFrame([("differ", "refused", refused)], "state string, lang string, rows long"))


@query("src_14_point_lookup", "select event_id, value from events where event_id in (select o_orderkey from orders where o_orderpriority = '5-LOW')")
def src_14(spark, sf_dir):
    """SRC-14: rows of a list of ids."""
    ids = table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").cast("long").alias("event_id"))
    return table(spark, sf_dir, "events").join(ids, "event_id", "left_semi").select("event_id", "value")


@query("src_15_required_key", "select vec_id, label from embeddings")
def src_15(spark, sf_dir):
    """SRC-15: a row without a key fails the scan."""
    return readers.required(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")


@query("src_16_gzip", _DOCS_SQL)
def src_16(spark, sf_dir):
    """SRC-16: compressed text is read like plain text."""
    at = folder(spark)
    _docs(spark, sf_dir).write.option("compression", "gzip").json(at)
    return readers.json_lines(spark, at, DOC).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("src_21_inverted_index", r"""
with w as (select doc_id, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') as w from documents)
select doc_id, md5(array_to_string(w, ' ')) as digest from w""")
def src_21(spark, sf_dir):
    """SRC-21: text from a map of words to positions. A text's map is made where the text is; nothing is shuffled."""

    @F.arrow_udf("map<string,array<int>>")
    def index(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            out: list[list | None] = []
            for words in a.to_pylist():
                at: dict[str, list[int]] = {}
                for k, w in enumerate(words or []):
                    at.setdefault(w, []).append(k)
                out.append(None if words is None else list(at.items()))
            yield pa.array(out, pa.map_(pa.string(), pa.list_(pa.int32())))

    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    d = _docs(spark, sf_dir).select("doc_id", index(words).alias("index"))
    return d.select("doc_id", F.when(F.col("index").isNotNull(), F.md5(X.inverted_to_text(F.col("index")))).alias("digest"))


@query("snk_01_shards", "select coalesce(lang, 'unknown') as lang, cast(count(*) as bigint) as rows from documents group by 1")
def snk_01(spark, sf_dir):
    """SNK-01 and SNK-03: shards of a bounded number of rows, published together, and their counts by a column."""
    at = folder(spark)
    writers.shards(_docs(spark, sf_dir), at, rows=300)
    most = writers.manifest(spark, at).agg(F.max("rows")).first()[0]
    if most and most > 300:
        raise AssertionError(f"a shard has {most} rows")
    return writers.manifest(spark, at, by="lang")


@query("snk_04_vectors", "select vec_id, label, round(cast(embedding[64] as double), 6) as last from embeddings")
def snk_04(spark, sf_dir):
    """SNK-04: vectors in a table partitioned by class; there are no batches to put together."""
    at = folder(spark)
    table(spark, sf_dir, "embeddings").write.partitionBy("label").parquet(at)
    return spark.read.parquet(at).select("vec_id", F.col("label").cast("int"), F.round(F.col("embedding")[63].cast("double"), 6).alias("last"))


@query("snk_05_csv", "select label, format('{:.6f}', avg(cast(embedding[1] as double))) as mean from embeddings group by 1")
def snk_05(spark, sf_dir):
    """SNK-05: CSV with fixed places."""
    at = folder(spark)
    m = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.avg(F.col("embedding")[0].cast("double")).alias("mean"))
    writers.csv(m, at)
    return readers.delimited(spark, at, "label int, mean string")


@query("snk_06_status")
def snk_06(spark, sf_dir):
    """SNK-06: a status row of a stage with its counters."""
    return writers.status(spark, "documents", "completed", rows=_docs(spark, sf_dir).count())


@query("snk_06_counters", "select 'documents' as stage, 'completed' as state, cast(count(*) as bigint) as rows, cast(count(text) as bigint) as texts from documents")
def snk_06_counters(spark, sf_dir):
    """SNK-06: a stage's status and counters, without the time."""
    n, texts = _docs(spark, sf_dir).agg(F.count("*"), F.count("text")).first()
    return writers.status(spark, "documents", "completed", rows=n, texts=texts).select("stage", "state", F.col("counters")["rows"].alias("rows"), F.col("counters")["texts"].alias("texts"))


@query("snk_07_fingerprint", "select true as same, false as other_version, false as more_rows")
def snk_07(spark, sf_dir):
    """SNK-07: a stage is skipped while its inputs' fingerprint is the same; another version or a further file changes it."""
    at = folder(spark)
    table(spark, sf_dir, "nation").write.parquet(at)
    before = writers.fingerprint(spark, at, "v1")
    same, other = writers.unchanged(spark, at, before, "v1"), writers.unchanged(spark, at, before, "v2")
    table(spark, sf_dir, "nation").limit(1).write.mode("append").parquet(at)
    return spark.createDataFrame([(same, other, writers.unchanged(spark, at, before, "v1"))], "same boolean, other_version boolean, more_rows boolean")


@query("snk_08_checksums")
def snk_08(spark, sf_dir):
    """SNK-08: size and SHA-256 of every file."""
    return writers.checksums(spark, f"{sf_dir}/benchmark.parquet")


@query("str_01_stream_cleaner", r"select doc_id, source from documents where length(text) >= 30")
def str_01(spark, sf_dir):
    """STR-01 to STR-04 and SNK-02: a cleaner that is stopped and started again gives each input once."""
    at = folder(spark)
    d = _docs(spark, sf_dir)
    step = lambda s: s.where(F.length("text") >= 30).select("doc_id", "source")
    d.where(F.col("lang") == "en").write.mode("append").json(f"{at}/in")
    jobs.clean(spark, f"{at}/in", DOC, step, "doc_id", f"{at}/out", f"{at}/state")
    d.write.mode("append").json(f"{at}/in")  # all rows, so English ones come again
    jobs.clean(spark, f"{at}/in", DOC, step, "doc_id", f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


@query("str_03_watermark_dedup", """
with e as (select distinct event_id from events) select event_id, cast(2 as bigint) as times, true as first, true as late from e""")
def str_03(spark, sf_dir):
    """STR-03: stateful dedup with bounded state, started again for each delivery: all events, the same ten minutes later (within
    the delay, so none comes out), a mark ten days on, and the same once more after it (the state is gone, so all come out)."""
    at = folder(spark)
    e = table(spark, sf_dir, "events").select("event_id", "ts").dropDuplicates(["event_id"])
    last = e.agg(F.max("ts")).first()[0]
    mark = lambda days: spark.createDataFrame([(-days, last)], "event_id long, ts timestamp").withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(days)))
    again = e.withColumn("ts", F.lit(last) + F.make_dt_interval(F.lit(20)))
    for delivery in (e, e.withColumn("ts", F.col("ts") + F.expr("interval 10 minutes")), mark(10), mark(11), again):
        delivery.write.mode("append").parquet(f"{at}/in")
        jobs.clean_within(spark, f"{at}/in", "event_id long, ts timestamp", "event_id", "ts", "1 hour", f"{at}/out", f"{at}/state", form="parquet")
    out = spark.read.parquet(f"{at}/out").where("event_id >= 0")
    kinds = out.join(e.withColumnRenamed("ts", "own"), "event_id").groupBy("event_id")
    return kinds.agg(F.count("*").alias("times"), F.max(F.col("ts") == F.col("own")).alias("first"), F.max(F.col("ts") > F.lit(last)).alias("late"))


@query("str_06_resume_log", "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_linenumber >= 4)")
def str_06(spark, sf_dir):
    """STR-06: keys that a log of finished work does not hold."""
    done = table(spark, sf_dir, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("str_06_record_log", """
with n as (select l_orderkey, count(*) as n from lineitem group by 1)
select o_orderkey, coalesce(n, 0) as n_lines, case when o_orderkey % 2 = 0 and o_orderkey % 10 <> 0 then 'before' else 'after' end as made from orders left join n on l_orderkey = o_orderkey""")
def str_06_record_log(spark, sf_dir):
    """STR-06 and SNK-02: counts of lines of each order, kept in a log of records. Work under another configuration is stale, a second
    run is stopped half-way, a tenth of its lines are torn; the third run repairs the log and makes what is missing."""
    at, schema = folder(spark), "o_orderkey long, n_lines long, made string"
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    work = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    made = lambda rows, name: rows.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"), F.lit(name).alias("made"))
    RecordLog(spark, at, schema, {"version": 1}).append(made(work.where("o_orderkey % 3 = 0"), "stale"))
    log = RecordLog(spark, at, schema, {"version": 2})
    log.append(made(work.where("o_orderkey % 2 = 0 and o_orderkey % 10 <> 0"), "before"))
    torn = F.concat(F.md5(F.lit("")), F.lit(" "), F.substring(F.to_json(F.struct("o_orderkey")), 1, 9))
    work.where("o_orderkey % 10 = 0").select(torn.alias("value")).write.text(f"{at}/segment-torn")  # what another writer left
    log.repair()
    log.append(made(log.left(work, "o_orderkey"), "after"))
    return log.records()


@query("str_07_draw_cache", f"with {SEG} select 'first' as state, class_id, cast(count(*) as bigint) as n from seg group by 2 union all select 'reused', class_id, count(*) from seg group by 2 union all select 'other seed', class_id, count(*) from seg where vec_id % 2 = 1 group by 2")
def str_07(spark, sf_dir):
    """STR-05 and STR-07: a draw's aggregates are kept on disk with their parameters. The second call reuses them (it could not
    compute them), and another seed computes anew."""
    at, s = folder(spark), segments(spark, sf_dir)
    counts = lambda d: d.groupBy("class_id").agg(F.count("*").alias("n"))

    def fail():
        raise AssertionError("the kept draw is not used")

    first = cut(writers.cached(spark, at, {"seed": 42}, lambda: counts(s)))
    reused = cut(writers.cached(spark, at, {"seed": 42}, fail))
    other = cut(writers.cached(spark, at, {"seed": 43}, lambda: counts(s.where("vec_id % 2 = 1"))))
    out = None
    for name, d in (("first", first), ("reused", reused), ("other seed", other)):
        d = d.select(F.lit(name).alias("state"), "class_id", "n")
        out = d if out is None else out.unionByName(d)
    return out


@query("str_08_windowed_counts", "select time_bucket(interval '1 day', ts) as start, event_type, cast(count(*) as bigint) as n from events group by 1, 2")
def str_08(spark, sf_dir):
    """STR-08 (an extension): tumbling counts by event time, as one batch."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


@query("str_08_windowed_stream")
def str_08_stream(spark, sf_dir):
    """STR-08 (an extension): the same as a stream; the windows that the watermark has not closed are not out yet."""
    at = folder(spark)
    table(spark, sf_dir, "events").select("ts", "event_type").write.parquet(f"{at}/in")
    jobs.windowed(spark, f"{at}/in", "ts timestamp, event_type string", "ts", "event_type", "1 day", "0 seconds", f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out")


def called(spark: SparkSession, read, steps: list, write) -> None:
    """UDF-01 to UDF-03: a reader (of the session), record steps and a serialiser, each a function of a DataFrame."""
    rows = read(spark)
    for s in steps:
        rows = rows.transform(s)
    write(rows)


@query("udf_01_callbacks", "select doc_id, upper(lang) as lang from documents where n_chars >= 200")
def udf_01(spark, sf_dir):
    """UDF-01 to UDF-03: a reader callback that makes rows of JSON lines, transform callbacks, and a serialiser to JSON lines."""
    at = folder(spark)
    _docs(spark, sf_dir).select(F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("value")).write.text(f"{at}/in")
    read = lambda spark: spark.read.text(f"{at}/in").select(F.from_json("value", "doc_id long, lang string, n_chars long").alias("r")).select("r.*")
    write = lambda rows: rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(f"{at}/out")
    called(spark, read, [lambda d: d.where("n_chars >= 200"), lambda d: d.select("doc_id", F.upper("lang").alias("lang"))], write)
    return readers.json_lines(spark, f"{at}/out", "doc_id long, lang string")


#: UDF-08: steps by name: (what they need, the step, of the session, the input folder and the results so far).
STEPS = {
    "count": (("orders",), lambda spark, sf_dir, done: done["orders"].agg(F.count("*").alias("n"))),
    "orders": (("customers",), lambda spark, sf_dir, done: table(spark, sf_dir, "orders").join(done["customers"], F.col("o_custkey") == F.col("c_custkey"), "left_semi")),
    "customers": ((), lambda spark, sf_dir, done: table(spark, sf_dir, "customer").where("c_nationkey = 1")),
    "regions": ((), lambda spark, sf_dir, done: table(spark, sf_dir, "region")),
}


def ran(spark: SparkSession, sf_dir: str, wanted: list[str], steps: dict = STEPS) -> dict[str, DataFrame]:
    """The results of the wanted steps and of all that they need, each after what it needs and once."""
    done: dict[str, DataFrame] = {}

    def run(name: str, above: tuple[str, ...] = ()) -> None:
        if name not in steps or name in above:
            raise ValueError(f"no such step, or a circle: {' > '.join((*above, name))}")
        if name not in done:
            needs, step = steps[name]
            for other in needs:
                run(other, (*above, name))
            done[name] = step(spark, sf_dir, done)

    for name in wanted:
        run(name)
    return done


@query("udf_08_steps", """
with o as (select count(*) as n from orders where o_custkey in (select c_custkey from customer where c_nationkey = 1))
select cast(1 as int) as place, 'customers' as step, (select count(*) from customer where c_nationkey = 1) as rows union all select 2, 'orders', (select n from o) union all select 3, 'count', 1""")
def udf_08(spark, sf_dir):
    """UDF-08: a registry of steps with what they need; one is asked for and those before it run, each once."""
    out = None
    for k, (name, d) in enumerate(ran(spark, sf_dir, ["count"]).items()):
        row = d.agg(F.count("*").alias("rows")).select(F.lit(k + 1).alias("place"), F.lit(name).alias("step"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("udf_04_table_function", "select doc_id, cast(generate_subscripts(l, 1) - 1 as int) as line, length(unnest(l)) as n from (select doc_id, string_split(text, chr(10)) as l from documents)")
def udf_04(spark, sf_dir):
    """UDF-04: one text to many rows."""
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "l")).select("doc_id", "line", F.length("l").cast("long").alias("n"))


@query("udf_05_accumulator", "select lang, cast(sum(n_chars) as bigint) as total, cast(max(n_chars) as bigint) as most from documents group by 1")
def udf_05(spark, sf_dir):
    """UDF-05: an accumulator class is a native aggregate."""
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum("n_chars").alias("total"), F.max("n_chars").alias("most"))


@query("src_09_text_files", "select item_id, md5(text) as digest from benchmark")
def src_09(spark, sf_dir):
    """SRC-09 and SRC-10: whole text files, with columns out of their paths."""
    at = folder(spark)
    table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").option("lineSep", "\u0001").text(at)
    f = readers.text_files(spark, f"{at}/*/*")
    key = F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long")
    return f.select(key.alias("item_id"), F.md5(F.rtrim("text", F.lit("\u0001"))).alias("digest"))


@query("src_08_class_archive", "select cast(doc_id as varchar) as key, case when quality = 1 and toxic = 1 then '1,2' when quality = 1 then '1' else '2' end as ids from labels where quality = 1 or toxic = 1")
def src_08(spark, sf_dir):
    """SRC-08: an archive with a CSV file for each class, to a sorted set of classes by key. The archive is made by one
    task for each class out of the labels, which is fit for a test table."""
    import io
    import zipfile

    from pyspark.sql import types as T

    labels = table(spark, sf_dir, "labels")
    long = labels.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, 1), F.when(F.col("toxic") == 1, 2)))).alias("k"))

    def zipped(key, pdf):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"labels_SDG{key[0]}.csv", "doi,rest\n" + "".join(f" {i} ,x\n" for i in pdf.doc_id))
        return pd.DataFrame({"content": [out.getvalue()]})

    made = long.groupBy("k").applyInPandas(zipped, T.StructType([T.StructField("content", T.BinaryType())]))
    return readers.unzipped(made, "doi").select("key", F.array_join("classes", ",").alias("ids"))
