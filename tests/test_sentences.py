"""Sentence boundaries and the pieces made of them, against plain Python."""

import re
from hashlib import md5

from corpweave import registry
from corpweave.operators import segmentation as G
from corpweave.operators import sentences as S

PROSE = """Dr. Smith met Mr. Jones at the house. They spoke of fruit, e.g. apples, pears and plums. The house was old. J. R. Miller came
 later. It rained at 3.5 degrees. The house of Dr. Brown is near St. Mary. They left! Was it late? Yes. Mr. Jones saw the house. He and Dr. Smith
 went home. The fruit (e.g. plums) was good. The old man slept. It was good. They saw St. Mary. St. Mary was kind and St. Mary slept."""


def texts():
    return [PROSE.replace("\n", "")] * 6 + ["the house was old and the fruit was good, yes they said it of the man, yes."] * 5 + [None, "", "  ", "One word", "... and then?! \"Really.\" he said. No."]


def test_abbreviations_and_initials_end_no_sentence(spark):
    learned = S.learn(spark.createDataFrame([(t,) for t in texts()], "text string"))
    assert {"dr", "mr", "e.g", "st"} <= learned.abbreviations and not {"house", "old", "home", "plums"} & learned.abbreviations
    found = S.sentences_of(PROSE.replace("\n", ""), learned)
    assert found[:6] == ["Dr. Smith met Mr. Jones at the house.", "They spoke of fruit, e.g. apples, pears and plums.", "The house was old.", "J. R. Miller came later.", "It rained at 3.5 degrees.", "The house of Dr. Brown is near St. Mary."]
    assert found[6:9] == ["They left!", "Was it late?", "Yes."] and "The fruit (e.g. plums) was good." in found
    assert S.sentences_of(None, learned) == [] == S.sentences_of(" \n", learned) and S.sentences_of("One word", learned) == ["One word"]
    assert S.learn(spark.createDataFrame([], "text string")) == S.Learned()


def test_column_equals_the_function(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, text string")
    learned = S.learn(df)
    for r in df.select("text", S.sentences(df.text, learned).alias("s")).collect():
        assert r.s == S.sentences_of(r.text, learned)
        assert re.sub(r"\s+", "", "".join(r.s)) == re.sub(r"\s+", "", r.text or "")  # nothing is lost


def pieces(text, learned, budget=G.BUDGET, margin=G.MARGIN, least=G.LEAST):
    out, now, n = [], [], 0
    for s in S.sentences_of(text, learned):
        k = len(re.findall(r"[^\W_]+|[^\w\s]|_", s))
        if now and n + k + 2 > budget - margin:
            out.append(" ".join(now))
            now, n = [], 0
        now, n = [*now, s], n + k
    return [p for p in [*out, " ".join(now)] if len(p.split()) >= least]


def test_whole_pieces_equal_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    learned = S.learn(docs)
    rows = registry.queries()["mlc_01_sentences"](spark, sf).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.segment_index)):
        got.setdefault(r.doc_id, []).append((r.word_count, r.digest))
    want = {r.doc_id: [(len(p.split()), md5(p.encode()).hexdigest()) for p in pieces(r.text, learned)] for r in docs.collect()}
    plain = {k: v for k, v in want.items() if v}
    assert got.keys() == plain.keys() and sum(got[k] == plain[k] for k in got) == len(got)


def test_a_task_sends_counts_and_no_tokens(spark, monkeypatch):
    docs = spark.createDataFrame([(t,) for t in texts()], "text string")
    once, many = (S.told(d.coalesce(1), "text") for d in (docs, docs.union(docs).union(docs)))
    assert once.count() == many.count()
    of = lambda df: {(r.before, r.type): tuple(r)[2:] for r in df.groupBy("before", "type").sum().collect()}
    want = of(once)
    assert {k: tuple(3 * x for x in v) for k, v in want.items()} == of(many)
    assert want[None, "dr"][:4] == (18, 18, 0, 18) and want["mr", "jones"][0] == 12 and want[None, "the"][4] > 0 and (None, "3.5") not in want
    monkeypatch.setattr(S, "HELD", 5)
    assert of(once) == want
