"""Classifiers that are fitted on the executors, many at a time: multi-label networks and multinomial logistic models.

Rows are packed once in blocks of some 256 by a hash of their key. A network's step takes one block or several; each
block normalises by its own mean and variance, as the workers of data-parallel training do, and with one block a step
this is plain mini-batch training. A scan is an epoch: a task takes the steps (AdamW) of a shard of a bounded number of blocks
with some of the models and sends one vector for each of them; Spark adds these up, and the driver, which holds nothing but
the models, sends their means out again. So one scan serves every setting and fold of a grid. Logistic models are fitted in lockstep: each asks for loss and gradient at a point
of its own, and a scan answers all with one matrix product.

Which blocks a step has and which units drop out are hashes of epoch, block, row and unit, so neither a retried task nor
another partitioning changes a result but for the order of sums.
"""

from __future__ import annotations

import functools
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpweave.session import cut

#: Rows of a block, and what keeps a variance above zero.
BLOCK, EPS = 256, 1e-5
#: Share of the newest step in the running mean and variance.
MOMENTUM = 0.1
#: Blocks that a task goes through in an epoch at most, and units of work for each core.
SHARD, UNITS = 64, 3
#: Numbers that the driver adds up by itself.
SMALL = 1 << 20


@dataclass(frozen=True)
class Setting:
    """A network's shape and training; rows of ``fold`` are left out of it."""

    layers: int = 4
    hidden: int = 384
    lr: float = 1e-3
    weight_decay: float = 0.0
    dropout: float = 0.3
    fold: int = -1


@dataclass
class Network:
    """Weights end to end in one vector, and the running means and variances of all layers in another one."""

    setting: Setting
    d: int
    classes: int
    weights: np.ndarray
    running: np.ndarray

    @staticmethod
    def shapes(s: Setting, d: int, classes: int) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = []
        for k in range(s.layers):
            out += [(d if k == 0 else s.hidden, s.hidden), (s.hidden,), (s.hidden,), (s.hidden,)]  # weights, bias, scale, shift
        return [*out, (s.hidden, classes), (classes,)]

    @classmethod
    def fresh(cls, s: Setting, d: int, classes: int, seed: int) -> Network:
        """Weights and biases even within one over the root of a unit's inputs, scales of one, shifts of zero."""
        rng, parts = np.random.default_rng(seed), []
        for k, shape in enumerate(cls.shapes(s, d, classes)):
            if k % 4 in (2, 3) and k < 4 * s.layers:
                parts.append(np.full(shape, 1.0 if k % 4 == 2 else 0.0))
            else:
                inputs = shape[0] if len(shape) == 2 else inputs
                parts.append(rng.uniform(-1, 1, shape) / np.sqrt(inputs))
        return cls(s, d, classes, np.concatenate([p.ravel() for p in parts]), np.r_[np.zeros(s.layers * s.hidden), np.ones(s.layers * s.hidden)])

    def copy(self) -> Network:
        return Network(self.setting, self.d, self.classes, self.weights.copy(), self.running.copy())

    def parts(self, flat: np.ndarray | None = None) -> list[np.ndarray]:
        flat = self.weights if flat is None else flat
        return [flat[at:to].reshape(shape) for at, to, shape in _places(self.setting, self.d, self.classes)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of trained networks: running statistics, no dropout."""
        p, s = self.parts(), self.setting
        mean, var = self.running.reshape(2, s.layers, s.hidden)
        for k in range(s.layers):
            w, b, scale, shift = p[4 * k : 4 * k + 4]
            x = np.maximum((x @ w + b - mean[k]) / np.sqrt(var[k] + EPS) * scale + shift, 0.0)
        return x @ p[-2] + p[-1]

    def gradient(self, x: np.ndarray, y: np.ndarray, keys: np.ndarray, step: int, keep: list[np.ndarray] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """(loss, gradient, means and variances of all layers) of one block; the loss is the mean binary cross-entropy. ``keep`` are the
        units that stay in each layer, if they are known."""
        p, s, n = self.parts(), self.setting, len(x)
        held, stats = [], np.zeros((2, s.layers, s.hidden))
        for k in range(s.layers):
            w, b, scale, shift = p[4 * k : 4 * k + 4]
            z = x @ w + b
            mean = z.mean(axis=0)
            unit = z - mean
            var = (unit * unit).mean(axis=0)
            stats[0, k], stats[1, k] = mean, var * n / max(n - 1, 1)
            root = np.sqrt(var + EPS)
            unit /= root
            a = unit * scale + shift
            stay = (kept(keys, step, k, s.hidden, s.dropout) if keep is None else keep[k]) / (1 - s.dropout) * (a > 0)
            held.append((x, unit, root, stay))
            x = a * stay
        z = x @ p[-2] + p[-1]
        loss = (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))).mean()
        back = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / y.size
        grads = [x.T @ back, back.sum(axis=0)]
        back = back @ p[-2].T
        for k in range(s.layers - 1, -1, -1):
            x, unit, root, stay = held[k]
            w, _, scale, _ = p[4 * k : 4 * k + 4]
            back = back * stay
            of_scale, of_shift = (back * unit).sum(axis=0), back.sum(axis=0)
            u = back * scale
            u = (u - u.mean(axis=0) - unit * (u * unit).mean(axis=0)) / root
            grads = [x.T @ u, u.sum(axis=0), of_scale, of_shift, *grads]
            back = u @ w.T
        return float(loss), np.concatenate([g.ravel() for g in grads]), stats.ravel()


@functools.cache
def _places(s: Setting, d: int, classes: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """Where each part of a network lies in its vector, as a step asks for it."""
    shapes = Network.shapes(s, d, classes)
    ends = np.cumsum([np.prod(x) for x in shapes]).tolist()
    return list(zip([0, *ends], ends, shapes))


def kept(keys: np.ndarray, step: int, layer: int, hidden: int, dropout: float) -> np.ndarray:
    """Which units of each row stay: a hash of row, step, layer and unit, mixed until its bits are even."""
    if dropout <= 0:
        return np.ones((len(keys), hidden))
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(((step * 64 + layer) << 20) % (1 << 63)) + np.arange(hidden, dtype=np.uint64)[None]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(float) / (1 << 53) >= dropout).astype(float)


@dataclass
class Adam:
    """Moments of a network's gradients; the decay of weights is apart from them."""

    m: np.ndarray
    v: np.ndarray
    t: float = 0

    def step(self, net: Network, g: np.ndarray) -> None:
        s, self.t = net.setting, self.t + 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        ahead = (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
        net.weights = net.weights * (1 - s.lr * s.weight_decay) - s.lr * ahead


def packed(df: DataFrame, classes: int, vector: str = "v", labels: str = "labels", key: str = "vec_id", fold: str | None = None, inner: str | None = None, size: int = BLOCK, once: bool = False) -> tuple[DataFrame, int]:
    """Rows in blocks of near ``size`` by a hash of their key, and the number of blocks.

    ``labels`` are arrays of class numbers from zero; ``fold`` is a number and ``inner`` says which rows early stopping holds out.
    Rows without a vector or labels take no part. The rows are made once, as their labels may be costly; blocks that are read
    ``once`` are not stored."""
    row = F.struct(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"), F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.array_contains(labels, k.cast(dict(df.dtypes)[labels].removeprefix("array<").removesuffix(">"))).cast("double")).alias("y"), (F.col(fold) if fold else F.lit(-2)).cast("int").alias("fold"), (F.col(inner) if inner else F.lit(False)).alias("inner"))
    d = cut(df.where(F.col(vector).isNotNull() & F.col(labels).isNotNull()).select(F.xxhash64(F.lit(1), F.col(key)).alias("h"), row.alias("r")))
    n = d.count()
    blocks = max(1, -(-n // size))
    rows = d.select(F.pmod("h", F.lit(blocks)).cast("int").alias("block"), "r").groupBy("block").agg(F.array_sort(F.collect_list("r")).alias("r"))
    flat = lambda c: F.flatten(F.transform("r", lambda x: x[c]))
    each = lambda c: F.transform("r", lambda x: x[c])
    out = rows.select("block", each("key").alias("keys"), flat("v").alias("x"), flat("y").alias("y"), each("fold").alias("folds"), each("inner").alias("inner"))
    return out if once else cut(out, n), blocks


def _block(batch: pa.RecordBatch, k: int, classes: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's (number, keys, x, y, folds, inner)."""
    block, keys, x, y, fold, inner = (batch.column(i)[k] for i in range(6))
    n = len(keys)
    array = lambda a: a.values.to_numpy(zero_copy_only=False)
    return block.as_py(), array(keys), array(x).reshape(n, -1), array(y).reshape(n, classes), array(fold), array(inner)


def summed(blocks: DataFrame, classes: int, of, models: int, small: bool = False, whole: bool = False) -> list[np.ndarray | None]:
    """For each model the sum of its vectors over all blocks; ``of`` takes a block, or with ``whole`` the number and the blocks of
    a unit of ``dealt``, and gives (model, vector) pairs.

    A task sends one vector for each model, whatever the number of its blocks; Spark adds them up, or, if the caller knows that
    all of them are ``small``, the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        units: dict[int, list] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                if whole:
                    units.setdefault(batch.column(6)[k].as_py(), []).append(_block(batch, k, classes))
                    continue
                for model, v in of(*_block(batch, k, classes)):
                    held[model] = held[model] + v if model in held else v
        for unit, own in units.items():
            for model, v in of(unit, own):
                held[model] = held[model] + v if model in held else v
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["model", "s"])

    part = blocks.mapInArrow(run, "model int, s array<double>")
    out: list[np.ndarray | None] = [None] * models
    if small:
        for batch in part.toArrow().to_batches():  # not collect(), which makes an object of each number
            for model, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy()
                out[model] = v if out[model] is None else out[model] + v
        return out
    total = part.groupBy("model").agg(Summarizer.metrics("sum").summary(array_to_vector("s")).alias("s"))
    for r in total.select("model", vector_to_array("s.sum").alias("s")).collect():  # a vector for each model
        out[r[0]] = np.array(r[1])
    return out


def hits(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each class how often its score is the greatest where it is true, where it is not, and how often it is true."""
    top = z.argmax(axis=1) if len(z) else np.zeros(0, int)
    right = y[np.arange(len(y)), top] > 0
    classes = y.shape[1]
    return np.r_[np.bincount(top[right], minlength=classes), np.bincount(top[~right], minlength=classes), y.sum(axis=0)]


def f1(h: np.ndarray, macro: bool = True):
    """F1 of every class from ``hits``, zero where nothing is there, or their mean."""
    right, wrong, true = h.reshape(3, -1)
    each = 2 * right / np.maximum(right + wrong + true, 1)
    return float(each.mean()) if macro else each


@dataclass
class Fitted:
    """A network after training: the epoch that was best on held-out rows, and their macro-F1 there; ``again`` is the network that was
    learned from all rows for as many epochs, if there is one."""

    network: Network
    epochs: int
    held: float
    history: list[float] = field(default_factory=list)
    again: Network | None = None


def dealt(blocks: DataFrame, n_blocks: int, models: int, shard: int = 0) -> tuple[DataFrame, int, list[list[int]]]:
    """(units, shards, chunks): blocks in ``shards`` of at most ``shard`` (SHARD if it is not given) by their number, each once for every
    chunk of models, so that few blocks and many models are many tasks too. All blocks of a unit are one partition.

    Shards follow from the number of blocks alone; chunks, which no result depends on, from the cores."""
    shards = max(1, -(-n_blocks // (shard or SHARD)))
    n = min(models, max(1, -(-UNITS * blocks.sparkSession.sparkContext.defaultParallelism // shards)))
    chunks = [list(range(k, models, n)) for k in range(n)]
    units = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chunk"))
    unit = (F.pmod(F.col("block"), F.lit(shards)) * n + F.col("chunk")).cast("int")
    return cut(units.withColumn("unit", unit).repartitionById(shards * n, "unit").drop("chunk")), shards, chunks


def trained(blocks: DataFrame, n_blocks: int, settings: list[Setting], d: int, classes: int, epochs: int = 100, patience: int | None = 7, per_step: int = 1, seed: int = 42, shard: int = 0, again: bool = False) -> list[Fitted]:
    """Trains a network for each setting, all of them in the same scans, one for each epoch.

    A step takes some ``per_step`` blocks. A task goes through the steps of one shard with some of the models; up to ``shard`` blocks
    (SHARD if it is not given) are one shard, and this is plain mini-batch training. More are several shards, each of which goes on
    from the same weights and moments; their means by rows are those of the next epoch (iterative parameter mixing). So neither the
    jobs nor what a task holds grow with the rows.

    With ``patience`` each network stops once macro-F1 on the inner held-out rows has not risen for so many epochs, and is
    returned as it was best; without, all rows but those of its fold are learned from, and it goes on to the last epoch.

    With ``patience`` and ``again`` each network has a twin that learns from those rows as well, in the same tasks. It is kept as it was
    after the best epoch, which is what a fit from the start for so many epochs gives, so that needs no scans of its own."""
    m, lonely = len(settings), patience is None
    twins = again and not lonely
    nets = [Network.fresh(s, d, classes, seed) for s in settings * (1 + twins)]
    adams = [Adam(np.zeros_like(n.weights), np.zeros_like(n.weights)) for n in nets]
    best = [Fitted(nets[k].copy(), 0, -1.0, again=nets[m + k].copy() if twins else None) for k in range(m)]
    live, alone = set(range(len(nets))), set(range(0 if lonely else m, len(nets)))  # all, and those that hold no rows out
    units, shards, chunks = dealt(blocks, n_blocks, m, shard)
    steps = max(1, -(-n_blocks // (per_step * shards)))
    for epoch in range(epochs + (not lonely)):
        # the weights so far are judged in the scan of the next epoch
        judge, learn = epoch > 0 and not lonely, epoch < epochs
        models = {k: (nets[k], adams[k]) for k in sorted(live)}

        def of(unit, held, epoch=epoch, judge=judge, learn=learn, models=models):
            ours = {k: models[k] for k in models if k % m in chunks[unit % len(chunks)]}
            by_step: dict[int, list] = {}
            for b in sorted(held, key=lambda b: b[0]):
                by_step.setdefault(_step(epoch, b[0], steps), []).append(b)
            out = {k: np.zeros(2 + 3 * len(n.weights) + len(n.running) + 3 * classes) for k, (n, _) in ours.items()}
            if judge:
                for _, _, x, y, fold, inner in held:
                    for k, (net, _) in ours.items():
                        rows = (fold != net.setting.fold) & inner
                        if k not in alone and rows.any():
                            out[k][-3 * classes :] += hits(net.logits(x[rows]), y[rows])
            if learn:
                now = {k: (Network(n.setting, d, classes, n.weights, n.running), Adam(a.m, a.v, a.t)) for k, (n, a) in ours.items()}
                for step in sorted(by_step):
                    _learned(now, out, by_step[step], epoch * steps + step, alone)
                for k, (net, adam) in now.items():
                    at, n = out[k][0], len(net.weights)
                    out[k][1 : 2 + 3 * n + len(net.running)] = np.r_[adam.t, net.weights, adam.m, adam.v, net.running] * at
            return ((k, v) for k, v in out.items() if v.any())

        # a vector for each shard and model
        small = shards * sum(3 * len(m.weights) + len(m.running) for m, _ in models.values()) <= SMALL
        sums = summed(units, classes, of, len(nets), small, whole=True)
        for k in sorted(live):
            net, s = nets[k], sums[k]
            if judge and k not in alone:
                score = f1(s[-3 * classes :]) if s is not None else 0.0
                best[k].history.append(score)
                if score > best[k].held:
                    best[k] = Fitted(net.copy(), epoch, score, best[k].history, nets[m + k].copy() if twins else None)
                elif epoch - best[k].epochs >= patience:
                    live -= {k, m + k}
            if k not in live:
                continue
            if learn and s is not None and s[0]:
                n, mean = len(net.weights), s[1 : -3 * classes] / s[0]
                adams[k] = Adam(mean[1 + n : 1 + 2 * n], mean[1 + 2 * n : 1 + 3 * n], float(mean[0]))
                net.weights, net.running = mean[1 : 1 + n], mean[1 + 3 * n :]
        if not live:
            break
    return [Fitted(n, epochs, float("nan")) for n in nets] if lonely else best


def _learned(now: dict[int, tuple[Network, Adam]], out: dict[int, np.ndarray], held: list, at: int, alone: set[int]) -> None:
    """One step of each network over its blocks, ``alone`` from inner rows too; ``out`` counts the rows that each has learned from."""
    sums: dict[int, list] = {}
    for _, keys, x, y, fold, inner in held:
        masks: dict[tuple, np.ndarray] = {}  # for all models, as units drop out by number
        most = max((n.setting.hidden for n, _ in now.values()), default=0)
        parts: dict[tuple, tuple] = {}  # by fold, and whether inner rows are in it
        for k, (net, _) in now.items():
            s = net.setting
            of = s.fold, k in alone
            if of not in parts:
                rows = (fold != s.fold) & (True if k in alone else ~inner)
                parts[of] = rows, x[rows], y[rows], keys[rows]
            rows, *mine = parts[of]
            if not rows.any():
                continue
            keep = []
            for layer in range(s.layers):
                if (layer, s.dropout) not in masks:
                    masks[layer, s.dropout] = kept(keys, at, layer, most, s.dropout)
                keep.append(masks[layer, s.dropout][rows, : s.hidden])
            _, g, stats = net.gradient(*mine, at, keep)
            n = rows.sum()
            one = sums.setdefault(k, [0, 0.0, 0.0])
            one[0], one[1], one[2] = one[0] + n, one[1] + g * n, one[2] + stats * n
    for k, (n, g, stats) in sums.items():
        net, adam = now[k]
        adam.step(net, g / n)
        net.running = (1 - MOMENTUM) * net.running + MOMENTUM * stats / n
        out[k][0] += n


def _mixed(epoch: int, block: int) -> int:
    return (block * 2654435761 + epoch * 40503 * 65537) % (1 << 32)


def _step(epoch: int, block: int, steps: int) -> int:
    """Which step of an epoch a block belongs to."""
    return _mixed(epoch, block) * steps >> 32

def refitted(df: DataFrame, setting: Setting, d: int, classes: int, most: int = 100, patience: int = 7, per_step: int = 1, seed: int = 42, **columns) -> Fitted:
    """Early stopping on the rows that ``inner`` marks, and a fit from the start on all rows for the best number of epochs, in the
    same scans."""
    blocks, n = packed(df, classes, once=True, **columns)
    found = trained(blocks, n, [setting], d, classes, max(most, 1), patience, per_step, seed, again=True)[0]
    return Fitted(found.again, found.epochs, found.held, found.history)


def probabilities(v: Column, net: Network) -> Column:
    """A probability for each class of a vector column."""

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            ok = np.flatnonzero(~np.asarray(a.is_null()))
            x = a.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(len(ok), net.d)
            p = iter((1 / (1 + np.exp(-net.logits(x)))).tolist()) if len(ok) else iter(())
            there = set(ok.tolist())
            yield pa.array([next(p) if k in there else None for k in range(len(a))], pa.list_(pa.float64()))

    return of(v)


def fold_scores(blocks: DataFrame, nets: list[Network], classes: int) -> list[np.ndarray]:
    """``hits`` of each network on the rows of its fold, all in one scan."""

    def of(block, keys, x, y, fold, inner):
        for k, net in enumerate(nets):
            rows = fold == net.setting.fold
            if rows.any():
                yield k, hits(net.logits(x[rows]), y[rows]).astype(float)

    return [np.zeros(3 * classes) if h is None else h for h in summed(blocks, classes, of, len(nets))]


@dataclass(frozen=True)
class Logistic:
    """A multinomial model's penalty (inverse strength), weights of classes, and the fold that it leaves out."""

    c: float = 1.0
    balanced: bool = False
    fold: int = -1


def lbfgs(x: np.ndarray, most: int = 1000, tolerance: float = 1e-4, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Minimises a function whose value and gradient the caller sends for each point that is yielded; returns the last point.

    Quasi-Newton steps of limited memory with halving until the value falls enough; ends where no component of the
    gradient is beyond ``tolerance``."""
    f, g = yield x
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        if np.abs(g).max() <= tolerance:
            break
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), alpha in zip(past, reversed(alphas)):
            q += (alpha - (y @ q) / (s @ y)) * s
        slope, t = -(g @ q), 1.0 if past else min(1.0, 1.0 / np.abs(g).sum())
        for _ in range(30):
            ahead = x - t * q
            value, grad = yield ahead
            if value <= f + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = ahead - x, grad - g
        if s @ y > 1e-12 * (y @ y):
            past = [*past, (s, y)][-memory:]
        x, f, g = ahead, value, grad
    return x


def logistic_models(blocks: DataFrame, settings: list[Logistic], d: int, classes: int, most: int = 1000, tolerance: float = 1e-4) -> list[np.ndarray]:
    """(d + 1) x classes weights for each setting, the intercept last and without penalty; the class of a row is its first label.

    Minimises the weighted mean log loss plus the squared weights over 2 C n, for all settings at once."""
    m = len(settings)

    def counts(block, keys, x, y, fold, inner):
        for k, s in enumerate(settings):
            yield k, np.bincount(y[fold != s.fold].argmax(axis=1), minlength=classes).astype(float)

    seen = [np.zeros(classes) if c is None else c for c in summed(blocks, classes, counts, m)]
    weight = np.array([n.sum() / (np.maximum((n > 0).sum(), 1) * np.maximum(n, 1)) if s.balanced else np.ones(classes) for s, n in zip(settings, seen)])
    total = np.array([max((w * n).sum(), 1.0) for w, n in zip(weight, seen)])
    asks = [lbfgs(np.zeros((d + 1) * classes), most, tolerance) for _ in settings]
    points: dict[int, np.ndarray] = {k: next(a) for k, a in enumerate(asks)}
    out: list[np.ndarray] = [np.zeros(0)] * m
    while points:
        at = sorted(points)
        w = np.stack([points[k].reshape(d + 1, classes) for k in at])
        folds = np.array([settings[k].fold for k in at])

        def of(block, keys, x, y, fold, inner, w=w, folds=folds, at=at):
            # one product for all models; its rows weigh nothing in a model that leaves them out
            one = np.c_[x, np.ones(len(x))]
            z = (one @ w.transpose(1, 0, 2).reshape(w.shape[1], -1)).reshape(len(x), len(at), classes)
            z -= z.max(axis=2, keepdims=True)
            logs = z - np.log(np.exp(z).sum(axis=2, keepdims=True))
            true = y.argmax(axis=1)
            share = weight[at][:, true].T * (fold[:, None] != folds)
            loss = -(share * logs[np.arange(len(x)), :, true]).sum(axis=0)
            r = np.exp(logs)
            r[np.arange(len(x)), :, true] -= 1
            g = (one.T @ (r * share[:, :, None]).reshape(len(x), -1)).reshape(w.shape[1], len(at), classes).transpose(1, 0, 2)
            yield 0, np.concatenate([loss, g.ravel()])

        s = summed(blocks, classes, of, 1)[0]
        s = np.zeros(len(at) * (1 + (d + 1) * classes)) if s is None else s
        for i, k in enumerate(at):
            n = (d + 1) * classes
            flat = points[k].reshape(d + 1, classes).copy()
            flat[-1] = 0
            penalty = 1 / (settings[k].c * total[k])
            value = s[i] / total[k] + 0.5 * penalty * (flat**2).sum()
            grad = s[len(at) + i * n : len(at) + (i + 1) * n] / total[k] + penalty * flat.ravel()
            try:
                points[k] = asks[k].send((float(value), grad))
            except StopIteration as e:
                out[k] = e.value.reshape(d + 1, classes)
                del points[k]
    return out


def logistic_scores(blocks: DataFrame, settings: list[Logistic], weights: list[np.ndarray], classes: int) -> list[np.ndarray]:
    """``hits`` of each model on the rows of its fold, all in one scan."""

    def of(block, keys, x, y, fold, inner):
        for k, (s, w) in enumerate(zip(settings, weights)):
            rows = fold == s.fold
            if rows.any():
                yield k, hits(np.c_[x[rows], np.ones(rows.sum())] @ w, y[rows]).astype(float)

    return [np.zeros(3 * classes) if h is None else h for h in summed(blocks, classes, of, len(settings))]
