"""Sentence boundaries from the corpus itself, after Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006).

Counts of word types with and without a final period tell abbreviations: a type that nearly always has one, more often than
chance (log-likelihood), short and with periods inside. Counts of types after sentence ends tell frequent sentence
starters, and counts of pairs over a period tell collocations. All counts are grouped in Spark; the types that pass are
few and go out with the tasks, behind a check of their number.

A period ends a sentence unless its word is an abbreviation, a number or an initial; after an abbreviation it does if the
next word is capitalised although it is usually written small, or is a frequent starter. Question and exclamation
marks always do."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpweave.session import cut

#: Fixed values as published: scores from which a type is an abbreviation, a starter, a collocation.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: Types that go out with the tasks at most.
MOST = 1_000_000
#: Different tokens and pairs that a task counts before it sends them on.
HELD = 500_000
_GAP = re.compile(r"(\s+)")
#: Quotes and brackets around a word, and marks behind it.
_OPEN, _CLOSE = "\"'([{«“‘„", "\"')]}»”’"
#: What a token that may end a sentence ends with.
_LAST = frozenset("!?.…" + _CLOSE)


@dataclass(frozen=True)
class Learned:
    """Abbreviations (without their period), frequent starters, types that are usually written small, and collocations."""

    abbreviations: frozenset = frozenset()
    starters: frozenset = frozenset()
    small: frozenset = frozenset()
    collocations: frozenset = frozenset()


def bare(word: str) -> str:
    """Lower-cased, without quotes and brackets around it and marks other than a period behind it."""
    return word.lower().lstrip(_OPEN).rstrip(_CLOSE).rstrip(",;:").rstrip("?!")


def kind(word: str) -> str:
    """What a token's end is: a mark that ends a sentence, a period, or nothing."""
    w = word.rstrip(_CLOSE)
    return "mark" if w[-1:] in ("!", "?") else "dots" if w.endswith("..") or w.endswith("…") else "period" if w[-1:] == "." and len(w) > 1 else ""


def ends(words: list[str], learned: Learned) -> list[int]:
    """Places of the words that end a sentence, the last one always."""
    out = []
    for i in [i for i, w in enumerate(words) if w[-1] in _LAST]:
        if i + 1 == len(words):
            break
        w = words[i]
        end = kind(w)
        if not end:
            continue
        after = words[i + 1].lstrip(_OPEN)
        upper, following = after[:1].isupper(), bare(words[i + 1]).rstrip(".")
        if end == "mark":
            if not after[:1].islower():
                out.append(i)
            continue
        own = bare(w)[:-1] if end == "period" else ""
        if end == "period":
            if (own, following) in learned.collocations:
                continue
            initial = len(own) == 1 and own.isalpha() and w.lstrip(_OPEN)[:1].isupper()
            number = own.replace(".", "").replace(",", "").isdigit()
            if initial or own in learned.abbreviations or own.replace(".", "", 1) == "" or number:
                # only a word that says so itself begins a sentence after one of these
                begins = upper and (following in learned.small or (following in learned.starters and not initial))
                if number and not after[:1].islower():
                    begins = True
                if begins:
                    out.append(i)
                continue
        if not after[:1].islower():
            out.append(i)
    return [*out, len(words) - 1] if words else out


def sentences_of(text: str | None, learned: Learned) -> list[str]:
    parts = _GAP.split((text or "").strip())  # words and what is between them
    if not parts[0]:
        return []
    at, out = 0, []
    for e in ends(parts[::2], learned):
        out.append("".join(parts[2 * at : 2 * e + 1]))
        at = e + 1
    return out


def sentences(text: Column, learned: Learned) -> Column:
    """The sentences of a text column, in order, as they are written."""

    @F.arrow_udf("array<string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([sentences_of(x.as_py(), learned) for x in a], pa.list_(pa.string()))

    return of(text)


def _log(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-300)))


def likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's ratio for k1 of n1 against k2 of n2, twice the difference of the log-likelihoods."""
    part = lambda k, n, p: k * _log(p) + (n - k) * _log(1 - p)
    p1, p2, p = k1 / n1, k2 / F.greatest(n2, F.lit(1)), (k1 + k2) / (n1 + n2)
    return 2 * (part(k1, n1, p1) + part(k2, n2, p2) - part(k1, n1, p) - part(k2, n2, p))


def told(docs: DataFrame, text_col: str) -> DataFrame:
    """(before, type, n, period, small, upper, first): counts of word types, where ``before`` is null, and of pairs over a period whose
    second word is not written small.

    What a token tells follows from itself and the one before it, so a task counts tokens, and pairs behind an end of a sentence,
    and looks at different ones alone; it sends sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, pairs, ending = Counter(), Counter(), _Ending()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                w = (x or "").split()
                tokens.update(w)
                pairs.update([(w[i], w[i + 1]) for i in [i for i, t in enumerate(w) if t[-1] in _LAST] if i + 1 < len(w) and ending[w[i]]])
                if len(tokens) + len(pairs) > HELD:
                    yield sent(tokens, pairs)
                    tokens, pairs, ending = Counter(), Counter(), _Ending()
        yield sent(tokens, pairs)

    def sent(tokens: Counter, pairs: Counter) -> pa.RecordBatch:
        sums: dict[tuple, list[int]] = {}
        known = {w: typed(w) for w in tokens}
        for w, n in tokens.items():
            own, period, small, upper = known[w]
            if own:
                one = sums.setdefault((None, own), [0] * 5)
                for k, flag in enumerate((True, period, small, upper)):
                    one[k] += n * flag
        for (v, w), n in pairs.items():
            own, _, small, _ = known[w]
            if own:
                sums[None, own][4] += n
                if kind(v) == "period" and not small:
                    sums.setdefault((bare(v)[:-1] if bare(v).endswith(".") else bare(v).rstrip("."), own), [0] * 5)[0] += n
        columns = [pa.array([k[i] for k in sums], pa.string()) for i in range(2)] + [pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(5)]
        return pa.RecordBatch.from_arrays(columns, names=["before", "type", "n", "period", "small", "upper", "first"])

    return docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "before string, type string, n long, period long, small long, upper long, first long")


class _Ending(dict):
    """Whether a token's end is one that a sentence may have, for those met so far."""

    def __missing__(self, word: str) -> bool:
        self[word] = kind(word) in ("mark", "period")
        return self[word]


def typed(word: str) -> tuple[str | None, bool, bool, bool]:
    """A token's type (none if it has no letter), and whether it ends with a period, and is written small or with a capital."""
    own, period, start = bare(word), kind(word) == "period", word.lstrip(_OPEN)[:1]
    own = own[:-1] if own.endswith(".") and period else own.rstrip(".")
    return own if any(c.isalpha() for c in own) else None, period, start.islower(), start.isupper()


def learn(docs: DataFrame, text_col: str = "text") -> Learned:
    """What the documents tell about their abbreviations, starters and collocations."""
    flags = ["n", "period", "small", "upper", "first"]
    rows = cut(told(docs, text_col).repartition("before", "type").groupBy("before", "type").agg(*(F.sum(c).alias(c) for c in flags)))
    types = rows.where("before is null").drop("before")
    total, periods, firsts = types.agg(F.sum("n"), F.sum("period"), F.sum("first")).first()
    if not total:
        return Learned()
    # abbreviations: nearly always with a period (0.99), against the share of all words that have one
    letters = F.length(F.regexp_replace("type", r"\.", "")).cast("double")
    share, k, n = F.lit((periods or 0) / total), F.col("period"), F.col("n")
    score = 2 * (k * F.log(F.lit(0.99)) + (n - k) * F.log(F.lit(0.01)) - k * _log(share) - (n - k) * _log(1 - share))
    inner = F.length("type") - letters + 1
    score = score * F.exp(-letters) * inner * F.pow(letters, -(n - k).cast("double"))
    abbreviations = types.where((k > 0) & (letters > 0)).where(score >= ABBREVIATION)
    names = frozenset(_few(abbreviations.select("type")))
    # starters: more often after a period than chance, and more often there than elsewhere
    first = F.col("first")
    starters = types.where((first > 0) & (likelihood(first, F.lit(firsts or 1), n - first, F.lit(total - (firsts or 0))) >= STARTER) & (first / (firsts or 1) > n / total))
    small = types.where((F.col("upper") > 0) & (F.col("small") > F.col("upper") - first) & (F.col("small") > 0))
    # collocations over an abbreviation's, initial's or number's period
    pairs = rows.where("before is not null and n > 1").select("before", "type", F.col("n").alias("both"))
    pairs = pairs.join(types.select(F.col("type").alias("before"), F.col("n").alias("n1")), "before").join(types.select("type", F.col("n").alias("n2")), "type")
    near = likelihood(F.col("both"), F.col("n1"), F.col("n2") - F.col("both"), F.lit(total) - F.col("n1"))
    odd = F.length("before") == 1
    short = abbreviations.select(F.col("type").alias("before"), F.lit(True).alias("short"))
    pairs = pairs.join(short, "before", "left").where((odd | F.col("short")) & (near >= COLLOCATION) & (F.col("both") / F.col("n1") > F.col("n2") / total))
    return Learned(names, frozenset(_few(starters.select("type"))), frozenset(_few(small.select("type"))), frozenset((r[0], r[1]) for r in _checked(pairs.select("before", "type"))))


def _checked(df: DataFrame) -> list:
    found = df.limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} types would go out with the tasks")
    return found


def _few(df: DataFrame) -> list[str]:
    return [r[0] for r in _checked(df)]
