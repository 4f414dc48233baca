import zlib

import xxhash
import zstandard

from corpweave.llm import language as L
from corpweave.llm import queries as Q


def test_held_out_accuracy_and_shape(spark, sf):
    rows = Q.queries()["op2_language_id"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == lang.keys() and len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.lang_pred in {*lang.values(), "und"} for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.97


def test_equals_plain_compression(spark, sf):
    learned = {"a": b" the and of that " * 50, "b": b" der die das und " * 50}
    texts = ["of that and the other", "das und die der", "x" * 9000 + " und"]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "text string").select(L.identify(L.F.col("text"), learned).alias("f")).collect()]
    for t, f in zip(texts, got):
        data, sizes = L.folded(t), {}
        for name, d in learned.items():
            c = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[name] = sum(len(c.compress(data[i : i + L.BLOCK])) for i in range(0, len(data), L.BLOCK))
        assert f.lang == min(sizes, key=lambda n: (sizes[n], list(learned).index(n)))
        assert f.margin == max(sizes.values()) - min(sizes.values()) and f.rejected == (f.score < L.MARGIN)


def test_whole_query_equals_plain_python(spark, sf):
    """Learning and choice again, with a loop over all rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    train = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None]
    seed = xxhash.xxh64_intdigest(b"language", 42)

    def spot(r):
        h = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little", signed=True), seed)
        return xxhash.xxh64_intdigest(r.text.encode(), h)

    learned, by = {}, {}
    for r in train:
        by.setdefault(r.lang, []).append(r)
    for lang, rows in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
        size, parts = 0, []
        for k, r in enumerate(sorted(rows, key=lambda r: (spot(r) >> 11, spot(r)))[: L.SAMPLE]):
            size += len(r.text.encode())
            if size <= L.DICTIONARY or k == 0:
                parts.append(L.folded(r.text))
        learned[lang] = b"".join(reversed(parts))
    assert L.dictionaries(spark.createDataFrame(train)) == learned and list(learned) == list(L.dictionaries(spark.createDataFrame(train)))
    model = L.Languages(learned)
    got = {r.doc_id: (r.lang_pred, r.score) for r in Q.queries()["op2_language_id"](spark, sf).collect()}
    assert got == {r.doc_id: model.choose(r.text)[:2] for r in docs}


def test_missing_and_repeated_ids(spark):
    """Many rows without an id, one id for all rows, and one row very often: languages are learned, from different texts."""
    for ids in ("null", "7", "id % 3"):
        df = spark.range(40_000).selectExpr(f"cast({ids} as long) as doc_id", "concat('das ist der text nummer ', id) as text", "if(id % 4 = 0, 'de', 'nl') as lang")
        learned = L.dictionaries(df)
        assert list(learned) == ["nl", "de"] and all(d.count(b"nummer") >= 200 for d in learned.values())
    once = spark.range(20_000).selectExpr("1L as doc_id", "'immer der gleiche text' as text", "'de' as lang").unionByName(spark.createDataFrame([(2, "un autre texte", "fr"), (3, "encore un texte", "fr")], "doc_id long, text string, lang string"))
    assert L.dictionaries(once)["de"] == L.folded("immer der gleiche text") and L.dictionaries(once)["fr"].count(b"texte") == 2


def test_dictionaries_are_bounded(spark):
    long = spark.createDataFrame([(1, "wort " * 5000, "de"), (2, "mot " * 5000, "fr")], "doc_id long, text string, lang string")
    assert all(len(v) > 15_000 for v in L.dictionaries(long, size=1000).values())  # one whole document
    assert all(len(v) == 250 for v in L.dictionaries(long, total=500).values())


def test_letters():
    assert L.folded("½ ²①Ⅷ 7 \u0301 _-") == b"" and L.folded("A½b") == b" a b " and L.folded("ª") == " ª ".encode()
    model = L.Languages({"a": b" the ", "b": b" der "})
    assert [model.choose(t)[0] for t in ("½ ²", "①②", "", None, "\u0301", "the")] == ["und"] * 5 + ["a"]


def test_all_languages_are_learned(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "concat('l', id % 150) as lang", "concat('word', id % 150, ' and so on ', id) as text")
    learned = L.dictionaries(docs)
    assert len(learned) == 150 and all(d.count(b" and so on ") == 4 for d in learned.values())


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "123 $$ 4", "en"), (4, "the cat and the dog", "en"), (4, "the cat and the dog", "en"), (None, "der Hund und die Katze", "de"), (6, "the " * 100000, "en"), (7, "中文 текст", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as `a.b`")
    learned = L.dictionaries(docs)
    assert set(learned) == {"en", "de", "zz"}
    found = docs.select("doc_id", "text", L.identify(L.F.col("text"), learned).alias("f")).collect()
    assert len(found) == len(rows)
    assert [r.f.lang for r in found if not (r.text or "").strip("123 $4")] == ["und"] * 3
    assert all(r.f.lang == "en" for r in found if (r.text or "").startswith("the"))
    assert L.dictionaries(docs.limit(0)) == {}
    assert {r.f.lang for r in docs.select(L.identify(L.F.col("text"), {}).alias("f")).collect()} == {"und"}
    assert docs.limit(0).select(L.identify(L.F.col("text"), learned)).count() == 0


def test_dictionary_is_bounded_and_texts_are_whole(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('word', id, ' ', repeat('abc ', 50)) as text", "'en' as lang")
    d = L.dictionaries(docs, sample=100, size=4096)["en"]
    assert 3000 < len(d) <= 4096 and d.count(b" abc") % 50 == 0
    assert L.dictionaries(docs, sample=7, size=1 << 20)["en"].count(b" word") == 7
    assert len(L.dictionaries(docs, size=1)["en"]) > 200
