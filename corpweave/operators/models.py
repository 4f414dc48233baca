"""Classifiers over vector columns with pyspark.ml, grouped cross-validation and removal of separating directions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpweave.functions import vectors as V
from corpweave.operators.relational import balanced, grouped_split, one_vs_rest, smallest


def featured(df: DataFrame, vector: str = "v", label: str = "class_id") -> DataFrame:
    return df.select("*", array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"))


def logistic(train: DataFrame, c: float = 3.0, iterations: int = 100, n: int | None = None, family: str = "auto") -> LogisticRegressionModel:
    """Logistic regression with the penalty of inverse strength ``c``: regParam = 1 / (c n), features as they are."""
    n = n or train.count()
    return LogisticRegression(maxIter=iterations, regParam=1.0 / (c * max(n, 1)), standardization=False, family=family).fit(train)


def perceptron(train: DataFrame, layers: list[int], iterations: int = 50, seed: int = 42):
    """A feed-forward classifier with one output for each class."""
    return MultilayerPerceptronClassifier(layers=layers, maxIter=iterations, seed=seed).fit(train)


def stopped_perceptron(df: DataFrame, layers: list[int], classes: list[int], test: str, step: int = 5, patience: int = 7, most: int = 40, seed: int = 42):
    """(model, rounds): a feed-forward classifier whose rounds of ``step`` iterations go on from one another's weights until macro-F1
    on the rows that ``test`` marks has not risen for ``patience`` rounds, and then once more on all rows, for the best number of
    rounds."""
    train, held = df.where(f"not {test}"), df.where(test)
    weights, best, rounds = None, -1.0, 1
    for k in range(1, most + 1):
        one = MultilayerPerceptronClassifier(layers=layers, maxIter=step, seed=seed)
        model = (one.setInitialWeights(weights) if weights is not None else one).fit(train)
        weights, score = model.weights, macro_f1(scored(model, held), classes)
        if score > best:
            best, rounds = score, k
        elif k - rounds >= patience:
            break
    return perceptron(df, layers, rounds * step, seed), rounds


def checked(model: LogisticRegressionModel, width: int) -> LogisticRegressionModel:
    """The model, if it takes vectors of this width."""
    if model.numFeatures != width:
        raise ValueError(f"the model takes {model.numFeatures} features, the vectors have {width}")
    return model


def scored(model, df: DataFrame) -> DataFrame:
    """Adds scores (a probability for each class), the assigned class and its probability."""
    out = model.transform(df).withColumn("scores", vector_to_array("probability"))
    return out.withColumn("assigned", F.col("prediction").cast("int")).withColumn("top", F.array_max("scores")).drop("rawPrediction", "probability", "prediction", "features")


def macro_f1(df: DataFrame, classes: list[int], truth: str = "label", pred: str = "assigned") -> float:
    f = one_vs_rest(df.select(F.col(truth).cast("int").alias("t"), F.col(pred).cast("int").alias("p")), "t", "p", classes)
    return float(f.agg(F.avg("f1")).first()[0] or 0.0)


def cross_validated(df: DataFrame, configs: list[dict], classes: list[int], fit, fold: str = "fold", done: set | None = None) -> list[tuple]:
    """(config, mean, sd) of macro-F1 over the folds of ``fold``; configs in ``done`` are skipped. ``fit`` takes rows and a config."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    out = []
    for config in configs:
        if done and str(config) in done:
            continue
        f1 = []
        for k in folds:
            model = fit(df.where(F.col(fold) != k), config)
            f1.append(macro_f1(scored(model, df.where(F.col(fold) == k)), classes))
        out.append((str(config), float(np.mean(f1)), float(np.std(f1))))
    return out


def searched(spark, df: DataFrame, configs: list[dict], classes: list[int], fit, log: str, fold: str = "fold") -> DataFrame:
    """(config, mean, sd) of macro-F1 for all configs, each appended to a table at ``log`` as soon as it is known; those
    that the table has already are not fitted again."""
    schema = "config string, mean double, sd double"
    p = spark._jvm.org.apache.hadoop.fs.Path(log)
    known = {r[0] for r in spark.read.schema(schema).parquet(log).collect()} if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else set()
    for config in configs:
        for row in cross_validated(df, [config], classes, fit, fold, known):
            spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(log)
    return spark.read.schema(schema).parquet(log)


@dataclass
class Projection:
    """Orthonormal directions that separate two corpora, and the hold-out accuracy before each was removed."""

    directions: np.ndarray
    accuracy: list[float] = field(default_factory=list)


def separating_directions(df: DataFrame, order, most: int = 200, stop: float = 0.5, by: str = "class_id", corpus: str = "corpus", key: str = "vec_id", doc: str = "doc", iterations: int = 50, start: Projection | None = None) -> Projection:
    """Removes the direction of a classifier between the corpora, again and again.

    Each step draws a balanced sample with a seed of its own, removes the directions so far, measures accuracy on 15 %
    of the documents, and stops when it is at ``stop`` or less, or when no new direction is left. ``order`` gives the
    order of rows for a seed and a key; ``start`` goes on from directions that were stored.

    What all steps have in common is made once; a step's vectors are made once for the split and the classifiers, by one Python
    worker for each task."""
    df = df.select(*dict.fromkeys((by, corpus, key, doc, "v"))).persist()
    try:
        return _separating(df, order, most, stop, by, corpus, key, doc, iterations, start)
    finally:
        df.unpersist()


def _separating(df: DataFrame, order, most: int, stop: float, by: str, corpus: str, key: str, doc: str, iterations: int, start: Projection | None) -> Projection:
    d, least = df.select(F.size("v")).first()[0], smallest(df, [by, corpus])
    found = start.directions if start else np.zeros((0, d))
    accuracy = list(start.accuracy) if start else []
    while len(found) < most:
        sample = balanced(df, [by, corpus], order(42 + len(found), key), key, least)
        # kept before it is filtered, or the filter would compute the vectors once more
        left = (sample.withColumn("v", V.without(F.col("v"), found)) if len(found) else sample).persist()
        split = grouped_split(left.where("v is not null"), doc, [corpus], by, key, order(42 + len(found), doc), 0.85)
        rows = featured(split, label=corpus).cache()
        try:
            train, test = rows.where("not test"), rows.where("test")
            model = logistic(train, iterations=iterations)
            accuracy.append(float(scored(model, test).agg(F.avg((F.col("assigned") == F.col("label")).cast("double"))).first()[0] or 0.0))
            if accuracy[-1] <= stop:
                break
            w = logistic(rows, iterations=iterations).coefficients.toArray()
        finally:
            rows.unpersist()
            left.unpersist()
        grown = V.orthonormal(np.vstack([found, w]))
        if len(grown) == len(found):
            break
        found = grown
    return Projection(found, accuracy)


def nullspace_directions(df: DataFrame, order, count: int, by: str = "class_id", corpus: str = "corpus", key: str = "vec_id", iterations: int = 50) -> np.ndarray:
    """An orthonormal basis of ``count`` directions found anew, on the samples of ``separating_directions`` but in the other published way.

    Projections on the row space of each classifier are kept; what goes before the next one is one matrix, the projection on the
    intersection of their null spaces, so nothing is orthogonalised direction by direction. Fewer are returned if a classifier has none."""
    df = df.select(*dict.fromkeys((by, corpus, key, "v"))).persist()
    try:
        d, least = df.select(F.size("v")).first()[0], smallest(df, [by, corpus])
        spaces, basis = np.zeros((d, d)), np.zeros((0, d))
        for k in range(count):
            sample = balanced(df, [by, corpus], order(42 + k, key), key, least)
            left = sample.withColumn("v", V.products(F.col("v"), np.eye(d) - basis.T @ basis)).persist()  # kept, or the filter would make it again
            rows = featured(left.withColumn("v", V.unit(F.col("v"))).where("v is not null"), label=corpus).cache()
            try:
                w = logistic(rows, iterations=iterations).coefficients.toArray()
            finally:
                rows.unpersist()
                left.unpersist()
            if np.linalg.norm(w) < V.ZERO:
                break
            spaces += np.outer(w, w) / (w @ w)
            values, vectors = np.linalg.eigh(spaces)
            basis = vectors[:, values > V.ZERO].T
        return basis
    finally:
        df.unpersist()


def stored(spark, projection: Projection, path: str) -> None:
    """Writes directions as a table (k, g, accuracy)."""
    rows = [(k, g.tolist(), projection.accuracy[k] if k < len(projection.accuracy) else None) for k, g in enumerate(projection.directions)]
    spark.createDataFrame(rows, "k int, g array<double>, accuracy double").coalesce(1).write.mode("overwrite").parquet(path)


def loaded(spark, path: str, count: int | None = None) -> Projection:
    """Reads directions; raises if there are not as many as expected, or they are not orthonormal."""
    rows = sorted(spark.read.parquet(path).collect())
    g = np.array([r["g"] for r in rows])
    if count is not None and len(g) != count:
        raise ValueError(f"{len(g)} directions are stored, {count} are expected")
    if len(g) and np.abs(g @ g.T - np.eye(len(g))).max() > 1e-6:
        raise ValueError("the directions are not orthonormal")
    return Projection(g, [r["accuracy"] for r in rows if r["accuracy"] is not None])


def two_sample_auc(df: DataFrame, fold: str = "fold") -> tuple[float, float]:
    """Mean and deviation over folds of the area under the curve of a classifier between the corpora."""
    rows = featured(df, label="corpus").cache()
    auc = []
    for k in sorted(r[0] for r in rows.select(fold).distinct().collect()):
        model = logistic(rows.where(F.col(fold) != k), iterations=30)
        auc.append(BinaryClassificationEvaluator().evaluate(model.transform(rows.where(F.col(fold) == k))))
    rows.unpersist()
    return float(np.mean(auc)), float(np.std(auc))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the principal angles between the row spans of two orthonormal bases."""
    return np.linalg.svd(a @ b.T, compute_uv=False)


def parity(a: np.ndarray, b: np.ndarray, least: float = 0.999) -> np.ndarray:
    """The same cosines, if the spans have as many dimensions and every cosine is greater than ``least``."""
    c = cosines(a, b)
    if len(a) != len(b) or not (c > least).all():
        raise ArithmeticError(f"subspaces of {len(a)} and {len(b)} dimensions differ, least cosine {c.min(initial=1.0)}")
    return c


def alignment(w: np.ndarray, basis: np.ndarray) -> float:
    """The share of a vector's length that lies in the span of orthonormal rows; zero for a zero vector."""
    n = float(np.linalg.norm(w))
    return float(np.linalg.norm(basis @ w)) / n if n >= 1e-12 else 0.0


def principal_components(df: DataFrame, k: int, d: int, vector: str = "v") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, explained shares) from the covariance that Spark aggregates; the sign of a component makes its
    largest loading positive."""
    from corpweave.operators.distances import moments

    m = moments(df, d=d, vector=vector).first()
    cov = np.array(m["cov"]).reshape(d, d)
    w, q = np.linalg.eigh(cov)
    q, w = q[:, ::-1][:, :k].T, w[::-1]
    q = q * np.sign(q[np.arange(k), np.abs(q).argmax(axis=1)])[:, None]
    return np.array(m["mean"]), q, w[:k] / w.sum()
