"""Language identification by compression.

Each text is encoded once per language with a zstandard raw-content dictionary of that language; the smallest encoding
names it. A text is folded first (lower case, letters only) and encoded in blocks, so that the dictionary keeps its
advantage over what a long text teaches the encoder about itself. A narrow margin between the two best languages
rejects the choice. All languages that the training rows name are learned, each from a bounded sample of its documents,
which are taken whole; time grows with the number of languages, memory only up to a bound.

Defined results: a null text, or one without letters, is ``und`` with score zero; equal sizes go to the language with
more training documents; languages that are null take no part in learning; with nothing to learn from, all texts are ``und``;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Training documents of each language at most, bytes that they may have together (one is taken whatever its size), and
#: bytes of all languages, of which no language gets more than an equal share.
SAMPLE = 256
DICTIONARY = 1 << 19
ALL = 1 << 26
#: Bytes encoded at once, and zstandard's level.
BLOCK = 4096
LEVEL = 9
#: Below this share of the second smallest size the margin is narrow.
MARGIN = 0.01

#: Marks belong to the letters that they stand on.
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
FIELDS = "struct<lang:string,score:double,margin:double,rejected:boolean>"


def folded(text: str | None) -> bytes:
    """Lower-cased words of letters between single spaces; empty if there is no letter."""
    return _NOT_LETTERS.sub(" ", f" {text.lower()} ").encode() if text and _LETTER.search(text) else b""


class Languages:
    """Encoders for raw-content dictionaries by language, in the order that breaks ties."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.names = list(dictionaries)
        self.encoders = []
        for n in self.names:
            d = zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.encoders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(e.compress(b)) for b in blocks) for e in self.encoders]

    def choose(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, float, bool]:
        """Language, score (share by which the best size undercuts the second), the same in bytes, and whether that is narrow."""
        data = folded(text)
        if not data or not self.names:
            return UNKNOWN, 0.0, 0.0, True
        ranked = sorted(zip(self.sizes(data), range(len(self.names))))
        best, name = ranked[0][0], self.names[ranked[0][1]]
        if len(ranked) == 1:
            return name, 1.0, float(len(data)), False
        second = ranked[1][0]
        share = (second - best) / second
        return name, share, float(second - best), share < margin


def dictionaries(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, size: int = DICTIONARY, total: int = ALL) -> dict[str, bytes]:
    """A dictionary for each language: different documents in the order of a hash of their ids and texts, at most ``sample`` of
    them, as long as they have ``size`` bytes together; the first is taken
    whatever its size, but no language gets more than its share of ``total``.

    Counts all languages first, so that only rows near the sample's share are read in full. Repeated rows count once, and rows
    without an id by their texts. Comes in the order of the languages' numbers of documents."""
    spot = F.xxhash64(F.lit("language"), "id", "text")
    rows = train.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("id"))
    rows = rows.where("lang is not null and text is not null").withColumn("spot", spot)
    each = rows.groupBy("lang", "spot").agg(F.count("*").alias("n"))
    counts = each.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("different")).orderBy(F.desc("n"), "lang").collect()  # a row for each language
    if not counts:
        return {}
    share = max(1, total // len(counts))
    size = min(size, share)
    shares = train.sparkSession.createDataFrame([(r[0], min(1.0, 1.5 * sample / r[2] + 50 / r[2])) for r in counts], "lang string, share double")
    place = F.shiftrightunsigned("spot", 11) / F.lit(float(1 << 53))
    near = rows.withColumn("place", place).join(F.broadcast(shares), "lang").where("place <= share")
    near = near.groupBy("lang", "place", "spot").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("place", "spot")  # about one and a half samples of a language
    ranked = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample)
    upto = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = ranked.withColumn("upto", upto).where((F.col("upto") <= size) | (F.col("at") == 1)).select("lang", "at", "text")
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in taken.toLocalIterator():
        parts.setdefault(r[0], []).append((r[1], folded(r[2])))
    learned = {lang: b"".join(x for _, x in sorted(some, reverse=True))[-share:] for lang, some in parts.items()}
    return {r[0]: learned[r[0]] for r in counts if learned.get(r[0])}


def identify(text: Column, learned: dict[str, bytes], margin: float = MARGIN, level: int = LEVEL) -> Column:
    """A struct of lang, score, margin in bytes and rejected for a text column.

    ``learned`` is a dictionary for each language and travels with the tasks; ``dictionaries`` bounds all of them together."""

    @F.arrow_udf(FIELDS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Languages(learned, level)
        for a in batches:
            rows = [model.choose(x.as_py(), margin) for x in a]
            lang, score, gap, rejected = zip(*rows) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang", "score", "margin", "rejected"])

    return of(text)
