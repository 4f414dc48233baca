"""Quality classifier: naive Bayes support vectors.

A text's features are the indicators of its byte n-grams, hashed into a fixed number of slots. Each is scaled by the
log ratio of its counts in the two classes, and a linear hinge-loss model is fitted by dual coordinate descent on a
bounded sample of labelled documents. A logistic curve fitted on held-back folds of that sample turns margins into
scores; nothing but the text is an input of a score.

Defined results: a null text counts as empty and is scored as one; labels other than 0 and 1, and null ones, take no
part; of contradicting labels of one id the lower counts, and of its texts the one with the smallest digest; without both classes every score is 0.5; an empty table
gives no rows; equal margins have equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpweave.session import cut

#: Labelled documents that are learned from, of each class at most.
SAMPLE = 2500
#: Bytes of their features at most, so that a few thousand very long documents fit the task that learns; the first ones by the hash stay.
BYTES = 1 << 28
#: N-gram sizes in bytes and the number of slots.
SIZES = (1, 2, 3, 4)
HASHED = 1 << 18
#: Slots after the hashed ones: runs of a repeated word, and of a repeated line, of 2, 4, 8 and so on.
RUNS = 16
SLOTS = HASHED + 2 * RUNS
#: Bytes whose n-grams are found at once, so that a very long text needs no more memory.
CHUNK = 1 << 20
FOLDS = 5
#: What is added to the counts of n-grams; a little, as most n-grams of one class are in no document of the other.
SMOOTH = 0.03
#: Documents with lower scores are rejected.
THRESHOLD = 0.7


def _runs(parts: list[bytes]) -> int:
    """How many of 2, 4, 8 ... times some part stands in a row."""
    longest = run = 1
    for a, b in zip(parts, parts[1:]):
        run = run + 1 if a == b else 1
        longest = run if run > longest else longest
    return min(longest.bit_length() - 1, RUNS)


def features(data: bytes) -> np.ndarray:
    """Slots of the byte n-grams of a text between spaces, and of its repeats, each once, in ascending order."""
    low = data.lower()
    words, lines = _runs(low.split()), _runs([x for x in low.split(b"\n") if x.strip()])
    repeats = np.r_[HASHED : HASHED + words, HASHED + RUNS : HASHED + RUNS + lines].astype(np.uint32)
    return np.concatenate([_grams(data), repeats])


def _grams(data: bytes) -> np.ndarray:
    whole = b" " + data + b" "
    found = None
    for at in range(0, len(whole), CHUNK):
        b = np.frombuffer(whole[at : at + CHUNK + SIZES[-1] - 1], np.uint8).astype(np.uint32)
        code, slots = np.zeros(len(b), np.uint32), []
        for n in SIZES:
            if len(b) < n:
                break
            code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
            slots.append((code * np.uint32(2654435761)) >> np.uint32(32 - 18))
        s = np.concatenate(slots)
        if found is None and len(whole) <= CHUNK:
            return np.unique(s)
        found = np.zeros(HASHED, bool) if found is None else found
        found[s] = True
    return np.flatnonzero(found).astype(np.uint32)


@dataclass
class Model:
    """Weights by slot, and the curve from margins to scores."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        return float(self.weights[slots].sum() / math.sqrt(max(len(slots), 1)) + self.bias)

    def score(self, margin: float) -> float:
        z = self.slope * margin + self.shift
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


class Rows:
    """Feature rows end to end in one array, all or some of them in an order of their own."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray, which: np.ndarray | None = None):
        self.flat, self.ends = flat, ends
        self.which = np.arange(len(ends) - 1) if which is None else which

    @classmethod
    def of(cls, parts: Iterable[bytes]) -> Rows:
        held, ends = bytearray(), [0]
        for p in parts:
            held += p
            ends.append(len(held) // 4)
        return cls(np.frombuffer(held, "<i4"), np.array(ends))

    def __len__(self) -> int:
        return len(self.which)

    def __getitem__(self, i: int) -> np.ndarray:
        k = self.which[i]
        return self.flat[self.ends[k] : self.ends[k + 1]]

    def some(self, which: np.ndarray) -> Rows:
        return Rows(self.flat, self.ends, self.which[which])


def log_ratio(rows: Rows, y: np.ndarray, smooth: float = SMOOTH) -> np.ndarray:
    """Log ratio of the smoothed shares of every slot's indicator in classes 1 and 0."""
    counts = {1: np.full(SLOTS, smooth), -1: np.full(SLOTS, smooth)}
    for i, k in enumerate(y):
        counts[int(k)][rows[i]] += 1  # a row has each slot once
    p, q = counts[1], counts[-1]
    return np.log((p / p.sum()) / (q / q.sum()))


def descend(rows: Rows, y: np.ndarray, cost: np.ndarray, ratio: np.ndarray, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model over scaled indicators by dual coordinate descent; weights by slot, and a bias.

    The weights are kept as they apply to the bare indicators: each is the model's weight times its slot's ratio."""
    w, b, alpha, square = np.zeros(SLOTS), 0.0, np.zeros(len(rows)), ratio * ratio
    size = np.array([max(len(rows[i]), 1) for i in range(len(rows))])
    norm = np.array([square[rows[i]].sum() for i in range(len(rows))]) / size + 1.0
    root = np.sqrt(size)
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            row = rows[i]
            g = y[i] * (w[row].sum() / root[i] + b) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                w[row] += step * y[i] / root[i] * square[row]
                b += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step) * norm[i])
        if moved < 1e-3:
            break
    return w, b


def logistic(margins: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the curve by Newton's method, with the targets drawn in as by Platt."""
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + c, -35, 35)))
        r, v = p - t, np.maximum(p * (1 - p), 1e-9)
        g = np.array([r @ margins, r.sum()])
        h = np.array([[v @ margins**2 + 1e-6, v @ margins], [v @ margins, v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, c = a - d[0], c - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(c)


def fit(rows: Rows, labels: list[int], prior: float | None = None, cost: float = 1.0) -> Model:
    """A model from feature rows and 0/1 labels; ``prior`` is the share of label 1 among all labelled rows, where the
    sample's differs."""
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    if len(set(labels)) < 2:
        return Model(np.zeros(SLOTS), 0.0, 0.0, 0.0)
    share = (y > 0).mean()
    costs = np.where(y > 0, cost * 0.5 / share, cost * 0.5 / (1 - share))

    def one(which: np.ndarray) -> tuple[np.ndarray, float]:
        some = rows.some(which)
        return descend(some, y[which], costs[which], log_ratio(some, y[which]))

    held = np.zeros(len(y))
    fold = np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        if len(set(y[fold != k])) < 2:
            continue
        w, b = one(np.flatnonzero(fold != k))
        m = Model(w, b, 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            held[i] = m.margin(rows[i])
    slope, shift = logistic(held, y)
    if prior:
        shift += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    w, b = one(np.arange(len(y)))
    return Model(w, b, slope, shift)


def features_column(text: Column) -> Column:
    """The slots of a text column as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([features(x.as_py() or b"").astype("<u4").tobytes() for x in a.cast(pa.binary())], pa.binary())

    return of(text)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most: int = BYTES) -> Model:
    """Fits a model on the labelled documents among ``docs``, at most ``sample`` of each class by a hash of their ids, and ``most``
    bytes of features; of several texts of one id the one with the smallest digest counts."""
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).groupBy("id").agg(F.min("label").alias("label"))
    known = plain.select("id").distinct().join(marked, "id")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    chosen: dict = {}
    spots: dict = {}
    for c in sorted(counts):
        near = known.where(F.col("label") == c).select("id", F.xxhash64(F.lit("quality"), "id").alias("at"))
        some = near.orderBy("at", "id").limit(sample).collect()
        chosen |= {r[0]: c for r in some}
        spots |= {r[0]: k for k, r in enumerate(some)}
    if len(counts) < 2:
        return fit(Rows.of([]), [])
    kind = known.schema["id"].dataType
    of = lambda rows: docs.sparkSession.createDataFrame(rows, StructType([StructField("id", kind), StructField("y", LongType())]))  # noqa: E731  at most 2 * sample ids
    text = F.coalesce("text", F.lit(""))
    one = plain.join(F.broadcast(of(list(chosen.items()))), "id").groupBy("id", "y").agg(F.min(F.struct(F.md5(text).alias("digest"), text.alias("text"))).alias("first"))
    found = cut(one.select("id", "y", features_column(F.col("first.text")).alias("slots")))
    size, fits = 0, []
    for n, i in sorted(((r[1], r[0]) for r in found.select("id", F.octet_length("slots")).collect()), key=lambda x: (spots[x[1]], chosen[x[1]])):
        size += n
        if size <= most or len(fits) < 2:
            fits.append((i, chosen[i]))
    if size > most:
        found = found.join(F.broadcast(of(fits)), ["id", "y"])
    prior = counts[1] / sum(counts.values())
    fitted = found.select(F.col("id").cast("string").alias("id"), "y", "slots").coalesce(1).mapInArrow(partial(_fitted, prior=prior), "weights binary, bias double, slope double, shift double").first()
    return Model(np.frombuffer(fitted[0]), *tuple(fitted)[1:])


def _fitted(batches: Iterator[pa.RecordBatch], prior: float) -> Iterator[pa.RecordBatch]:
    """The model of all rows (id, label, slots), of which there is a bounded number; the driver does not hold them."""
    held, ends, names, y = bytearray(), [0], [], []
    for batch in batches:
        for i, label, slots in zip(*(batch.column(k) for k in range(3))):
            names.append(i.as_py())
            y.append(label.as_py())
            held += memoryview(slots.as_buffer())
            ends.append(len(held) // 4)
    rows = Rows(np.frombuffer(held, "<i4"), np.array(ends))
    order = sorted(range(len(names)), key=lambda i: names[i])
    m = fit(rows.some(np.array(order, np.int64)), [y[i] for i in order], prior=prior)
    yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype(float).tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (m.bias, m.slope, m.shift))], names=["weights", "bias", "slope", "shift"])


def score_column(text: Column, model: Model) -> Column:
    """Scores from 0 to 1 of a text column; higher: label 1 is likelier. Missing texts count as empty."""
    weights = model.weights.astype(np.float32)
    light = Model(weights, model.bias, model.slope, model.shift)

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([light.score(light.margin(features(x.as_py() or b""))) for x in a.cast(pa.binary())], pa.float64())

    return of(text)
