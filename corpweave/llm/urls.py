"""URL filters: glob rules packed into one bit-parallel automaton.

All patterns are laid end to end over the bits of a few 64-bit words. A Shift-And step per character then moves every
pattern of every URL of a batch at once: literal positions advance where the character's mask allows it, wildcards
hold their position. ``*`` stands for any characters but a slash, ``**`` for any characters, ``?`` for one character
but a slash; a backslash takes the next character as it is. A pattern has to fit the whole canonical URL: a dot, the
host in lower case, and the path as far as the query or fragment.

Defined results: a null URL, or one without ``://``, has an empty host and path and is judged like any other; URLs of
any length are whole; equal URLs get equal verdicts; of patterns that fit, the one with the largest weight wins, then
the one that blocks, then the first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a batch of URLs that are held at once.
CHARS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """A glob with the verdict for URLs that it fits; ``name`` is reported, larger weights win."""

    name: str
    glob: str
    allow: bool
    weight: int


def prefix_rules(text: str, allow: bool, base: int = 0) -> list[Rule]:
    """Rules for a host with all its subdomains and a path prefix, from ``host/path``; longer texts weigh more."""
    escaped = "".join(f"\\{c}" if c in "*?\\" else c for c in text)
    globs = [f"*.{escaped}**"] if "/" in escaped else [f"*.{escaped}", f"*.{escaped}/**"]
    return [Rule(text, g, allow, base + len(text)) for g in globs]


def tokens(glob: str) -> list[tuple[str, str]]:
    """(kind, character) with kinds ``is``, ``one``, ``many`` and ``all``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out.append(("is", glob[i + 1]))
            i += 2
        elif c == "*":
            n = len(glob[i:]) - len(glob[i:].lstrip("*"))
            kind = "all" if n > 1 else "many"
            if out and out[-1][0] in ("many", "all"):
                out[-1] = ("all" if "all" in (kind, out[-1][0]) else kind, "")
            else:
                out.append((kind, ""))
            i += n
        else:
            out.append(("one", "") if c == "?" else ("is", c))
            i += 1
    return out


class Automaton:
    """Masks of all rules over 64-bit words.

    A rule of m single characters takes m + 1 bits: bit j is set while j of them are matched. Bit j of ``stay`` masks
    is set where a wildcard follows the j-th character and takes the character at hand."""

    def __init__(self, rules: list[Rule]):
        self.rules = list(rules)
        parts = [tokens(r.glob) for r in self.rules]
        alphabet = sorted({c for p in parts for k, c in p if k == "is"} | {"/"})
        self.codes = {ord(c): i + 1 for i, c in enumerate(alphabet)}  # 0: any other character
        bits = sum(1 + sum(k in ("is", "one") for k, _ in p) for p in parts)
        self.words = max(1, -(-bits // 64))
        move = np.zeros((len(alphabet) + 1, self.words), np.uint64)
        stay = np.zeros_like(move)
        self.start = np.zeros(self.words, np.uint64)
        self.final, at, slash = [], 0, self.codes[ord("/")]

        def put(masks: np.ndarray, bit: int, rows) -> None:
            masks[rows, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

        others = [i for i in range(len(alphabet) + 1) if i != slash]
        for p in parts:
            put(self.start[None], at, [0])
            for kind, c in p:
                if kind in ("is", "one"):
                    at += 1
                    put(move, at, [self.codes[ord(c)]] if kind == "is" else others)
                else:
                    put(stay, at, slice(None) if kind == "all" else others)
            self.final.append(at)
            at += 1
        self.move, self.stay = move, stay

    def fits(self, urls: list[str]) -> np.ndarray:
        """(URLs x rules) of booleans."""
        lengths = np.array([len(u) for u in urls])
        order = np.argsort(-lengths, kind="stable")
        raw = np.frombuffer("".join(urls[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.zeros(len(raw), np.int64)
        for c, i in self.codes.items():
            code[raw == c] = i
        sizes = lengths[order]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, int)
        state = np.tile(self.start, (len(urls), 1))
        ends = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        for t, n in enumerate(ends):  # the first n URLs have a character at t
            c = code[begin[:n] + t]
            d = state[:n]
            up = d << np.uint64(1)
            up[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = (up & self.move[c]) | (d & self.stay[c])
        found = np.stack([(state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) for b in self.final], axis=1) if self.final else np.zeros((len(urls), 0))
        out = np.empty_like(found, dtype=bool)
        out[order] = found.astype(bool)
        return out

    def judge(self, urls: list[str]) -> list[int | None]:
        """The rule that wins for each URL."""
        if not self.rules:
            return [None] * len(urls)
        rank = sorted(range(len(self.rules)), key=lambda i: (-self.rules[i].weight, self.rules[i].allow, i))
        fit = self.fits(urls)[:, rank]
        return [rank[k] if some else None for k, some in zip(fit.argmax(axis=1), fit.any(axis=1))]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: list[Rule], url_col: str = "url", id_col: str = "page_id", default_allow: bool = True) -> DataFrame:
    """(id, url, host, path, rule, verdict): the winning rule's name, and ``allow`` or ``block``.

    The masks grow with the rules only, and travel with the tasks."""
    built = Automaton(rules)

    @F.arrow_udf("int")
    def winner(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            urls, out, held, size = a.to_pylist(), [], [], 0
            for u in urls:
                held.append(u or "")
                size += len(held[-1])
                if size > CHARS:
                    out += built.judge(held)
                    held, size = [], 0
            yield pa.array(out + (built.judge(held) if held else []), pa.int32())

    rows = pages.select(F.col(id_col), F.col(url_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("__rule", winner(F.concat(F.lit("."), "host", "path")))
    names = F.array(*(F.lit(r.name) for r in rules)) if rules else F.array().cast("array<string>")
    allows = F.array(*(F.lit(r.allow) for r in rules)) if rules else F.array().cast("array<boolean>")
    allow = F.coalesce(F.get(allows, F.col("__rule")), F.lit(default_allow))
    return rows.select(id_col, url_col, "host", "path", F.get(names, F.col("__rule")).alias("rule"), F.when(allow, "allow").otherwise("block").alias("verdict"))
