"""Segmentation of texts into pieces of whole sentences within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 384
MARGIN = 10
LEAST = 20


def segments(text: Column, budget: int = BUDGET, margin: int = MARGIN, least: int = LEAST, sentences: Column | None = None) -> Column:
    """An array of pieces. Sentences are packed in order while their tokens and two more stay within the budget less a
    margin; a longer sentence stands alone; pieces under ``least`` words are dropped. Tokens are runs of letters and
    digits and single other characters, in place of a model's tokenizer. ``sentences`` are those of the text, if something
    better than a mark and a space tells them."""
    sentences = sentences if sentences is not None else F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    sized = F.transform(sentences, lambda s: F.struct(s.alias("s"), F.regexp_count(s, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).alias("n")))
    limit = budget - margin - 2
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["n"] > 0) & (a["n"] + x["n"] <= limit)
        closed = F.when(a["n"] > 0, F.array_append(a["done"], a["open"])).otherwise(a["done"])
        return F.struct(
            F.when(fits, a["done"]).otherwise(closed).alias("done"),
            F.when(fits, F.concat(a["open"], F.lit(" "), x["s"])).otherwise(x["s"]).alias("open"),
            F.when(fits, a["n"] + x["n"]).otherwise(x["n"]).alias("n"),
        )

    pieces = F.aggregate(sized, start, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["open"])).otherwise(a["done"]))
    return F.filter(pieces, lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != "")) >= least)


def segmented(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, segment_index, segment_id, text, word_count) for all kept pieces."""
    rows = docs.select(id_col, F.posexplode(segments(F.col(text_col), **options)).alias("segment_index", "text"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return rows.select(id_col, "segment_index", F.concat_ws("_seg", F.col(id_col).cast("string"), "segment_index").alias("segment_id"), "text", words.alias("word_count"))
