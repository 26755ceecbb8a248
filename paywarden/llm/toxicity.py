"""Toxicity by a linear classifier over character n-grams.

A feature is the presence of a byte n-gram in the lower-cased words of a text;
its value is the naive Bayes log-count ratio of the two classes, and logistic
regression weighs these values. Ratios come from counts over the labelled
texts, pre-aggregated in every task. Only features that are unlikely to differ
between the classes by chance are kept, at most ``FEATURES`` of them.

The model is fitted on at most ``SAMPLE`` labelled rows, chosen by the hash of
their id; it is a fixed-size list of n-grams and weights, which scoring tasks
receive. Every whole text is scored.

Defined cases: a null or empty text has no features and gets the score of the
intercept; rows without a label are not learned from; a document with several
labels is learned from once for each; without rows of both classes the score is
the share of toxic labels (0 without labels); repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F, types as T

from paywarden.llm.common import utf8, written
from paywarden.llm.grams import blocks

#: Lengths of the n-grams in bytes.
ORDERS = (4, 5, 6)
#: Bounds of the fit: labelled rows, features, and the least chi-square of a feature.
SAMPLE, FEATURES, CHANCE = 30_000, 20_000, 20.0
#: Smoothing of the counts, and the ridge penalty of the regression.
SMOOTHING, RIDGE = 1.0, 0.002
FILTER_BITS = 22
#: N-grams that a counting task holds before it sums them.
HELD = 1 << 20


def stream(text: str | None) -> bytes:
    """Lower-cased words between single spaces."""
    words = utf8(text).lower().split()
    return b" " + b" ".join(words) + b" " if words else b""


def features(streams: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram, index of the text), a block at a time; the length is kept in the topmost byte."""
    for order in ORDERS:
        for keys, owner in blocks(streams, order):
            yield keys | np.int64(order << 56), owner


def presence(text: str | None) -> np.ndarray:
    """The distinct n-grams of a text, in order."""
    found = [np.unique(keys) for keys, _ in features([stream(text)])]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class by n-gram, summed over some thousand texts at a time."""
    held: tuple[list[np.ndarray], list[np.ndarray]] = [], []
    size = 0

    def summed() -> pa.RecordBatch:
        counts = [np.unique(np.concatenate(one or [np.empty(0, np.int64)]), return_counts=True) for one in held]
        keys = np.union1d(counts[0][0], counts[1][0])
        columns = []
        for known, n in counts:
            column = np.zeros(len(keys), np.int64)
            column[np.searchsorted(keys, known)] = n
            columns.append(pa.array(column))
        return pa.RecordBatch.from_arrays([pa.array(keys), *columns], ["gram", "clean", "toxic"])

    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic")):
            keys = presence(text.as_py())
            held[label.as_py()].append(keys)
            size += len(keys)
            if size > HELD:
                yield summed()
                held, size = ([], []), 0
    yield summed()


class Model:
    """N-grams in order, the score that each adds, and the score of a text without any."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, intercept: float):
        self.grams, self.weights, self.intercept = grams, weights, intercept
        # Tells most n-grams outside the model from those inside.
        self.marked = np.zeros(1 << FILTER_BITS, bool)
        self.marked[slots(grams)] = True

    def hits(self, streams: list[bytes]) -> Iterator[np.ndarray]:
        """text * size of the model + place in the model, for every n-gram of the model."""
        size = len(self.grams)
        for keys, owner in features(streams) if size else ():
            likely = np.flatnonzero(self.marked[slots(keys)])
            keys, owner = keys[likely], owner[likely]
            at = np.minimum(np.searchsorted(self.grams, keys), size - 1)
            same = self.grams[at] == keys
            yield owner[same] * size + at[same]

    def scores(self, streams: list[bytes]) -> np.ndarray:
        sums = np.full(len(streams), self.intercept)
        if found := list(self.hits(streams)):
            text, place = np.divmod(np.unique(np.concatenate(found)), len(self.grams))
            np.add.at(sums, text, self.weights[place])
        return 1.0 / (1.0 + np.exp(-np.clip(sums, -500, 500)))


def slots(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).view(np.int64)


def sample(labels: DataFrame) -> DataFrame:
    """(id, toxic) of at most SAMPLE labels, by the hash of their id: the same ones in every run."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    share = min(1.0, 1.1 * SAMPLE / max(known.count(), 1))
    chosen = known.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    return written(chosen.where(draw < int(share * (1 << 30))).orderBy(draw, "id", "toxic").limit(SAMPLE), "labels")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from texts (doc_id, text) and labels (doc_id, toxic 0 or 1). Only the bounded sample of labels is broadcast."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample(labels)), F.col("doc_id") == F.col("id"))
    rows = written(rows.select("doc_id", "text", "toxic"), "labelled")
    n_toxic, n_clean = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    nothing = np.empty(0, np.int64), np.empty(0)
    if not n_toxic or not n_clean:
        return Model(*nothing, 500.0 if n_toxic else -500.0)
    counts = rows.select("text", "toxic").mapInArrow(class_counts, "gram bigint, clean bigint, toxic bigint")
    counts = counts.groupBy("gram").agg(F.sum("toxic").cast("double").alias("p"), F.sum("clean").cast("double").alias("q"))
    ratio = F.log(((F.col("p") + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) / ((F.col("q") + SMOOTHING) / (n_clean + 2 * SMOOTHING)))
    absent = F.lit(float(n_toxic)) - F.col("p"), F.lit(float(n_clean)) - F.col("q")
    total = float(n_toxic + n_clean)
    chi = total * F.pow(F.col("p") * absent[1] - F.col("q") * absent[0], 2) / (
        F.lit(float(n_toxic) * n_clean) * (F.col("p") + F.col("q")) * (absent[0] + absent[1])
    )
    chosen = (
        counts.where(absent[0] + absent[1] > 0).select("gram", ratio.alias("ratio"), chi.alias("chi"))
        .where(F.col("chi") >= CHANCE).orderBy(F.desc("chi"), "gram").limit(FEATURES).toPandas().sort_values("gram")
    )
    if not len(chosen):
        return Model(*nothing, float(np.log(n_toxic / n_clean)))
    grams, ratios = chosen["gram"].to_numpy(), chosen["ratio"].to_numpy()
    size = len(grams)

    @F.udf(VectorUDT())
    def scaled(text):
        at = np.flatnonzero(np.isin(grams, presence(text), assume_unique=True))
        return Vectors.sparse(size, at.tolist(), ratios[at].tolist())

    vectors = written(rows.select(F.col("toxic").cast("double").alias("label"), scaled("text").alias("features")), "vectors")
    regression = LogisticRegression(regParam=RIDGE, standardization=False, maxIter=60).fit(vectors)
    return Model(grams, regression.coefficients.toArray() * ratios, float(regression.intercept))


def scorer(model: Model):
    """text -> score from 0 to 1."""
    shipped = model.grams, model.weights, model.intercept

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        own, out, held, size = Model(*shipped), [], [], 0
        for text in texts:
            held.append(stream(text.as_py()))
            size += len(held[-1])
            if size > 1 << 20:
                out.append(own.scores(held))
                held, size = [], 0
        out.append(own.scores(held))
        return pa.array(np.concatenate(out), pa.float64())

    return score


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every document."""
    return docs.select("doc_id", scorer(model)("text").alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)
    )
