"""Terms of documents: counts and weights, and choices among scored terms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpweave.session import cut

#: Terms by score that a round of the greedy choice looks at for each group, for each term that it may choose.
DEPTH = 50
#: Different terms and words that a task holds before it sends their counts on.
HELD = 1_000_000
#: Bits of a word's number, and texts that are counted at once: two words and a text are one integer.
BITS, AT_ONCE = 26, 1024
_WORD = re.compile("[a-z]{3,}")


class _Numbered(dict):
    """Numbers of words from one, in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self) + 1
        return k


class _Known(dict):
    """Numbers of known words, zero for others."""

    def __missing__(self, word: str) -> int:
        return 0


def _coded(texts: list[str | None], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(words, pairs) of lower-cased texts: for each word of three letters or more, and for each pair of neighbours, the numbers of
    its words (zero for none) and of its text."""
    each = [np.fromiter(map(ids.__getitem__, w), np.int64, len(w)) for w in (_WORD.findall(t or "") for t in texts)]
    x, text = np.concatenate([np.zeros(0, np.int64), *each]), np.repeat(np.arange(len(each)), [len(e) for e in each])
    near = text[1:] == text[:-1]
    return (x << BITS) * AT_ONCE + text, ((x[:-1] << BITS | x[1:]) * AT_ONCE + text[1:])[near]


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, where each begins) of a sorted array."""
    at = np.flatnonzero(np.r_[len(x) > 0, x[1:] != x[:-1]])
    return x[at], at


def counted(docs: DataFrame, text: str) -> DataFrame:
    """(term, df, all): in how many rows each term stands and how often in all; ``text`` is lower-cased.

    A task adds up what its rows give, so that a term is sent once for many documents."""

    def merged(held: list[tuple]) -> list[tuple]:
        codes = np.concatenate([h[0] for h in held])
        order = np.argsort(codes)
        own, at = _runs(codes[order])
        return [(own, *(np.add.reduceat(np.concatenate([h[k] for h in held])[order], at) for k in (1, 2)))]

    def sent(held: list[tuple], ids: dict[str, int]) -> Iterator[pa.RecordBatch]:
        names = pa.array(["", *ids], pa.string())
        for codes, rows, every in merged(held):
            for a in range(0, len(codes), 100_000):
                first, second = (pa.array(c) for c in (codes[a : a + 100_000] >> BITS, codes[a : a + 100_000] & ((1 << BITS) - 1)))
                term = pc.utf8_rtrim_whitespace(pc.binary_join_element_wise(names.take(first), names.take(second), " "))
                yield pa.RecordBatch.from_arrays([term, pa.array(rows[a : a + 100_000]), pa.array(every[a : a + 100_000])], names=["term", "df", "all"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = _Numbered(), []
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for k in range(0, len(texts), AT_ONCE):
                all_ = np.sort(np.concatenate(_coded(texts[k : k + AT_ONCE], ids)))
                if not len(all_):
                    continue
                found, at = _runs(all_)
                codes, first = _runs(found // AT_ONCE)
                held.append((codes, np.diff(np.r_[first, len(found)]), np.diff(np.r_[at[first], len(all_)])))
                if sum(len(h[0]) for h in held) > 3 * HELD:
                    held = merged(held)
                if len(ids) > HELD or len(held[0][0]) > HELD:
                    yield from sent(held, ids)
                    ids, held = _Numbered(), []
        if held:
            yield from sent(held, ids)

    parts = docs.select(text).mapInArrow(run, "term string, df long, all long").repartition("term")  # a task has added up its own already
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("all").alias("all"))


def weights(docs: DataFrame, text: str, side: str, idf: dict[str, float]) -> DataFrame:
    """(side, term, u): sums over rows of their TF-IDF weights at length one; ``idf`` holds the terms of a bounded vocabulary.

    A row's counts are all in its text, so a task sends one sum for each side and term."""
    ids = _Known((w, k) for k, w in enumerate(dict.fromkeys(w for t in idf for w in t.split(" ")), 1))
    codes = np.array([ids[w[0]] << BITS | (ids[w[1]] if len(w) > 1 else 0) for w in (t.split(" ") for t in idf)], np.int64)
    order = np.argsort(codes)
    names, codes, weight = [list(idf)[k] for k in order], codes[order], np.array(list(idf.values()), float)[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, sides = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(texts) if len(codes) else 0, AT_ONCE):
                words, pairs = _coded(texts[a : a + AT_ONCE], ids)
                all_ = np.concatenate([words, pairs[pairs // AT_ONCE & ((1 << BITS) - 1) > 0]])  # a pair with an unknown word is no word
                k = np.minimum(np.searchsorted(codes, all_ // AT_ONCE), len(codes) - 1)
                there = codes[k] == all_ // AT_ONCE
                found, at = _runs(np.sort(all_[there] % AT_ONCE * len(codes) + k[there]))
                tf = np.diff(np.r_[at, there.sum()])
                row, k = found // len(codes), found % len(codes)
                u = tf * weight[k]
                u /= np.sqrt(np.bincount(row, u * u, AT_ONCE))[row]
                of = np.array(sides[a : a + AT_ONCE])
                for s in set(of.tolist()):
                    own = of[row] == s
                    sums[s] = sums.get(s, 0.0) + np.bincount(k[own], u[own], len(codes))
        for s, u in sums.items():
            k = np.flatnonzero(u)
            yield pa.RecordBatch.from_arrays([pa.array([s] * len(k), pa.string()), pa.array([names[i] for i in k], pa.string()), pa.array(u[k])], names=["side", "term", "u"])

    return docs.select(text, side).mapInArrow(run, "side string, term string, u double")


def greedy_terms(scored: DataFrame, by: str, most: int, depth: int = DEPTH) -> DataFrame:
    """(by, rank, term): terms by score, without those that hold a chosen term or are held by one, and none of score
    zero or less.

    A round looks at the ``depth * most`` best terms of each group that do not clash with those chosen so far; further rounds
    go on behind the last one, until all groups are full or have no terms left."""
    left = scored.where("score > 0").select(F.col(by).alias("__by"), "score", "term")
    state = cut(left.select(F.col("__by").alias("__of")).distinct().select("__of", F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("string").alias("last")))
    best = Window.partitionBy("__by").orderBy(F.desc("score"), "term")
    step = f"if(size(done) >= {most} or exists(done, d -> contains(d, t) or contains(t, d)), done, array_append(done, t))"
    while True:
        open_ = left.join(state.where(F.size("done") < most), F.col("__by").eqNullSafe(F.col("__of")))
        after = F.col("low").isNull() | (F.col("score") < F.col("low")) | ((F.col("score") == F.col("low")) & (F.col("term") > F.col("last")))
        fits = open_.where(after & ~F.expr("exists(done, d -> contains(d, term) or contains(term, d))"))
        near = fits.withColumn("at", F.row_number().over(best)).where(F.col("at") <= depth * most)
        found = near.groupBy("__by").agg(F.array_sort(F.collect_list(F.struct("at", "score", "term"))).alias("found"), F.first("done").alias("done"))
        chosen = F.expr(f"aggregate(transform(found, x -> x.term), done, (done, t) -> {step})")
        moved = cut(found.select("__by", chosen.alias("now"), F.element_at("found", -1)["score"].alias("to"), F.element_at("found", -1)["term"].alias("at")))
        if moved.isEmpty():
            break
        both = state.join(moved, F.col("__by").eqNullSafe(F.col("__of")), "left")
        state = cut(both.select("__of", F.coalesce("now", "done").alias("done"), F.coalesce("to", "low").alias("low"), F.coalesce("at", "last").alias("last")))
    return state.select(F.col("__of").alias(by), F.posexplode("done").alias("at", "term")).select(by, (F.col("at") + 1).alias("rank"), "term")
