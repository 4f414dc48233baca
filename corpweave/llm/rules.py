"""Quality rules: counts of a text, and how far its histograms diverge from those of a language.

Each language has two reference histograms, of character classes and of its most common words, summed over all
documents that pass the plain rules. A document's own histograms are compared with every reference by Jensen-Shannon
distance (base 2, so from 0 to 1), and the nearest language counts. A short text's histogram is far from any reference
by chance: its expected divergence, bins / (8 ln 2 n) for n draws, is allowed on top of a fixed one, and below a least
length a histogram has no say.

The first pass sends one count for each language and word of a task, the second one needs the references alone, a few
hundred numbers a language.

Defined results: a null text has no words and fails; documents without a language, or with one that has too few words in
all, give no reference of their own but are judged by the others; without any reference the plain rules decide alone;
repeated rows count as often as they are there; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpweave.session import cut, map_arrow

#: Words of a window, least words, and the share of words in repeated windows (in hundredths) that still passes.
WINDOW, LEAST, REPEATED = 5, 10, 20
SYMBOLS = b"#*$%&|<>"
#: Deleted before words are counted as common ones.
EDGES = b".,;:!?"
#: Common words of a language, and words that it needs in all to have a reference.
COMMON, LEARNED = 100, 2000
#: Least words and characters for a histogram to be judged, and the divergence that is allowed beside that by chance.
WORDS, CHARS = 50, 200
WORD_LIMIT, CHAR_LIMIT = 0.07, 0.08
#: Entries of a task's counts that are held at once.
HELD = 200_000
#: Words from which repeats are found by sorting instead of a set.
LONG = 1 << 14

#: Character classes by byte; a character beyond ASCII counts by its first byte.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "line": b"\n", "space": b" \t\r\x0b\x0c", "stop": b".,;:?", "mark": b"!", "symbol": SYMBOLS, "bracket": b"()[]{}'\"/\\-_=+@"}
NAMES = [*CLASSES, "other", "beyond"]

BASE = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long")]
FIELDS = [*BASE, ("base_failed", "boolean"), ("ref_lang", "string"), ("char_distance", "double"), ("word_distance", "double"), ("kept", "boolean")]


def _class_of() -> np.ndarray:
    of = np.full(256, NAMES.index("other"))
    for k, chars in enumerate(CLASSES.values()):
        of[list(chars)] = k
    of[0x80:0xC0] = len(NAMES)  # goes on with a character
    of[0xC0:] = NAMES.index("beyond")
    return of


_CLASS = _class_of()
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def repeated(words: list[bytes], size: int = WINDOW) -> int:
    """How many words lie in windows of ``size`` that are found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    if len(words) < LONG:
        # equal windows have equal codes, so without equal codes nothing repeats
        h = np.fromiter(map(hash, words), np.int64, len(words))
        code = h[:n].copy()
        for i in range(1, size):
            code = code * 1000003 + h[i : i + n]
        code.sort()
        if (code[1:] != code[:-1]).all():
            return 0
        windows = list(zip(*(words[i:] for i in range(size))))
        counts = Counter(windows)
        again = np.fromiter((counts[w] > 1 for w in windows), bool, n)
    else:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        code = ids[:n]
        for i in range(1, size):  # equal codes are equal windows so far
            code = np.unique(code * len(number) + ids[i : i + n], return_inverse=True)[1]
        again = np.bincount(code)[code] > 1
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(again), 1)
    np.add.at(inside, np.flatnonzero(again) + size, -1)
    return int((np.cumsum(inside)[: len(words)] > 0).sum())


@dataclass
class Counted:
    """What the plain rules need of a text, and the histogram of its character classes."""

    base: tuple[int, int, int, int, int]
    classes: np.ndarray

    @property
    def failed(self) -> bool:
        n, again = self.base[0], self.base[4]
        return n < LEAST or 100 * again > REPEATED * n


def counted(data: bytes) -> Counted:
    words = data.split()
    of_bytes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, of_bytes, len(NAMES) + 1)[: len(NAMES)].astype(np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = int(classes.sum() - of_bytes[_SPACE].sum())
    return Counted((len(words), chars, int(of_bytes[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated(words)), classes)


def plain_words(data: bytes) -> list[bytes]:
    """Lower-cased words without sentence marks."""
    return data.lower().translate(None, EDGES).split()


class References:
    """Histograms by language: shares of character classes, and of the common words with all others last."""

    def __init__(self, langs: list[str], classes: np.ndarray, words: list[dict[bytes, int]], shares: list[np.ndarray]):
        self.langs, self.classes, self.words, self.shares = langs, classes, words, shares
        self.bins = [len(s) for s in shares]
        self.matrix = np.zeros((len(langs), max(self.bins, default=1)))
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        for k, (of, s) in enumerate(zip(words, shares)):
            self.matrix[k, : len(s) - 1], self.matrix[k, -1] = s[:-1], s[-1]
            for w, i in of.items():
                self.places.setdefault(w, []).append((k, i))

    def nearest(self, c: Counted, words: Counter, n: int) -> tuple[str, float, float]:
        """(language, character distance, word distance) of the reference with the least sum, the first of equals."""
        far = distance(c.classes / c.classes.sum(), self.classes)
        if not n:
            near = np.ones(len(self.langs))
        else:
            own = np.zeros(self.matrix.shape)
            for w in words.keys() & self.places.keys():
                for k, i in self.places[w]:
                    own[k, i] = words[w]
            own[:, -1] = n - own.sum(axis=1)
            near = distance(own / n, self.matrix)
        k = int(np.argmin(np.round(far + near, 11)))
        return self.langs[k], float(far[k]), float(near[k])


def _entropy(p: np.ndarray) -> np.ndarray:
    return (p * np.log2(np.maximum(p, 1e-300))).sum(axis=-1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of histograms in the last axis, base 2."""
    return np.sqrt(np.maximum((_entropy(p) + _entropy(q)) / 2 - _entropy((p + q) / 2), 0.0))


def chance(bins: int, n: int) -> float:
    """The divergence that a histogram of ``n`` draws is expected to have from the one that it is drawn from."""
    return bins / (8 * math.log(2) * max(n, 1))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON, learned: int = LEARNED) -> References:
    """The references of all languages that documents name, from all documents that pass the plain rules."""
    plain = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def out() -> list:
            rows = [(lang, -1, w, n) for lang, of in words.items() for w, n in of.items()]
            rows += [(lang, k, b"", n) for lang, of in classes.items() for k, n in enumerate(of.tolist())]
            words.clear(), classes.clear()
            return [pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary(), pa.int64()))]

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                data = text.as_py()
                c = counted(data)
                if c.failed:
                    continue
                classes[lang] = classes[lang] + c.classes if lang in classes else c.classes
                words.setdefault(lang, Counter()).update(plain_words(data))
                if sum(map(len, words.values())) > HELD:
                    yield out()
        yield out()

    each = map_arrow(plain, run, [], [("lang", "string"), ("kind", "int"), ("word", "binary"), ("n", "long")])
    sums = each.groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    sums = cut(sums)
    # a task keeps its own most common words of each language before they are shuffled
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    totals = {(r[0], r[1]): r[2] for r in sums.groupBy("lang", "kind").agg(F.sum("n")).collect()}  # a row for each language and class
    top: dict[str, list] = {}
    for r in sums.where("kind = -1").withColumn("at", rank).where(F.col("at") <= common).select("lang", "at", "word", "n").collect():
        top.setdefault(r[0], []).append((r[1], bytes(r[2]), r[3]))
    langs = sorted(x for x in top if totals[x, -1] >= learned)
    classes, words, shares = [], [], []
    for x in langs:
        h = np.array([totals.get((x, k), 0) for k in range(len(NAMES))], float)
        classes.append(h / h.sum())
        ranked = sorted(top[x])
        words.append({w: i for i, (_, w, _) in enumerate(ranked)})
        s = np.array([n for _, _, n in ranked] + [0.0])
        s[-1] = totals[x, -1] - s.sum()
        shares.append(s / totals[x, -1])
    return References(langs, np.array(classes).reshape(len(langs), len(NAMES)), words, shares)


def judged(docs: DataFrame, learned: References, kept: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``kept`` and FIELDS for each document."""
    at = docs.columns.index(text_col)
    inner = [docs.columns.index(c) for c in kept]

    def one(data: bytes) -> tuple:
        c = counted(data)
        if c.failed or not learned.langs:
            return *c.base, c.failed, None, None, None, not c.failed
        some = plain_words(data)
        lang, far, near = learned.nearest(c, Counter(some), len(some))
        bins = learned.bins[learned.langs.index(lang)]
        chars = int(c.classes.sum())
        odd = chars >= CHARS and far * far > CHAR_LIMIT + chance(len(NAMES), chars)
        odd |= len(some) >= WORDS and near * near > WORD_LIMIT + chance(bins, len(some))
        return *c.base, False, lang, far, near, not odd

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
        for batch in batches:
            rows = [one(x.as_py() or b"") for x in batch.column(at).cast(pa.binary())]
            yield [*(batch.column(i) for i in inner), *(pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(FIELDS))]

    return map_arrow(docs, run, kept, FIELDS)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, FIELDS) of all documents, judged by the references that they give themselves."""
    learned = references(docs, text_col, lang_col)
    return judged(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), learned, ["id"]).withColumnRenamed("id", id_col)
