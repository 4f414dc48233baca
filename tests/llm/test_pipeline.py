import zlib

from pyspark.sql import functions as F

import corpus_pipeline as P
from corpweave.llm import nearby, quality
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_nearby import wanted
from tests.llm.test_packing import check, ids


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "packing"]
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.learn(docs.where(~held), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.collect()
    want = [r for r in rows if model.score(model.margin(quality.features(r.text.encode()))) >= 0.7 - 1e-6]
    kept = P.keep_quality(spark, docs, sf)
    got = kept.collect()
    assert kept.columns == columns and {r.doc_id for r in got} == {r.doc_id for r in want}

    unique = P.drop_near_duplicates(spark, kept, sf)
    assert unique.columns == columns and sorted(r.doc_id for r in unique.collect()) == wanted([(r.doc_id, r.text) for r in got])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = P.drop_benchmark_leaks(spark, unique, sf)
    left = clean.collect()
    assert clean.columns == columns and {r.doc_id for r in left} == {r.doc_id for r in unique.collect() if not brute_hits(r.text, items)[1]}

    masked = P.pseudonymise(spark, clean, sf)
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert masked.columns == columns and texts.keys() == {r.doc_id for r in left} and any(texts[r.doc_id] != r.text for r in left)
    assert masked.where("n_chars <> length(text)").count() == 0

    packed = P.pack(spark, masked, sf).collect()
    check(packed)
    assert sum(r.length for r in packed) == sum(len(ids(t)) + 1 for t in texts.values()) and {r.doc_id for r in packed} == texts.keys()
    final = P.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in final.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)
    assert zlib.crc32(b"") == 0


def test_odd_documents(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "plain words here", "en", "s", 3), (4, "plain words there", "en", "s", 3), (4, "plain words there", "en", "s", 3), (4, "other words of the same id", "de", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as fp", "2 as score", "3 as `a.b`", "4 as __id", "5 as hits", "6 as n_hit", "7 as piece", "8 as ids", "map(1, 2) as m")
    out = docs
    scored = P.keep_quality(spark, docs, sf)
    assert scored.columns == docs.columns and scored.count() <= docs.count()
    for name, stage in P.STAGES[1:4]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns, name
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert len(kept) == out.count() and (1, None) in kept and (2, "") not in kept
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert nearby.keep_one(docs).count() == 4
