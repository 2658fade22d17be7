"""Toxicity by non-negative positive-unlabelled learning.

Features are hashes of words, A-Z lower-cased, and of the words' first 4 to 7 bytes. Those that set confirmed toxic texts
apart from unlabelled ones most surely (by a two-sample z of the texts that have them) are chosen by counts over the sample
of toxic texts and over all documents that are not held out; a feature's value is the logarithm of its share of the text's words. A linear classifier is trained in numpy on the
risk

    prior * E_toxic[loss(+)] + max(0, E_unlabelled[loss(-)] - prior * E_toxic[loss(-)])

with the sigmoid loss and the class prior taken from the training labels. Where the second part falls below zero it has no
gradient, which keeps the classifier from explaining away the toxic texts among the unlabelled.

The classifier is fitted on at most about `positives` toxic and `unlabelled` other texts, chosen by a hash of id and text; both
bounds are parameters and hold for rows, not ids. All texts are scored whole. Labels serve in training alone.

Edge cases: a null or empty text has no features and gets the score of the bias; without toxic labels, or documents, the score
is the prior (0 if unknown); a null id is held out if crc32's fold says so, else not (null counts as not held out); rows
that repeat an id and text train once, and each get their row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyframe.llm.labelled import bounded, fold, sample, training_labels
from policyframe.llm.shared import FOLDED_ALNUM, cut, mix, table, text_groups, word_prefixes

POSITIVES, UNLABELLED, FEATURES = 8_000, 16_000, 384
PREFIXES = (4, 5, 6, 7)
#: Features of fewer toxic texts, or of a smaller z, may stand out by chance among so many.
LEAST_DOCUMENTS, LEAST_Z = 5, 5.0
#: A text of fewer words counts as one of so many.
LEAST_WORDS = 20
#: Training values travel as bytes, in units of 1 / 50 (the largest value is log 101).
UNIT = 50


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) for every word and prefix, repeats included; and how many words each text has."""
    words, starts = word_prefixes(texts, FOLDED_ALNUM, PREFIXES)
    owner = words.owners()
    rows, values = [owner], [words.hashes]
    for n, (has, h) in zip(PREFIXES, starts, strict=True):
        rows.append(owner[has])
        values.append(mix(h + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(values), words.counts


class Model:
    """Sorted feature hashes with their weights, and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.hashes >> np.uint64(48)] = True

    def values(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number of the feature, value), once each."""
        row, value, words = features(texts)
        some = np.flatnonzero(self.maybe[value >> np.uint64(48)])
        row, value = row[some], value[some]
        if not len(self.hashes):
            return row[:0], row[:0], np.zeros(0)
        at = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
        hit = self.hashes[at] == value
        pairs, n = np.unique(row[hit] * len(self.hashes) + at[hit], return_counts=True)
        row = pairs // len(self.hashes)
        return row, pairs % len(self.hashes), np.log1p(100 * n / np.maximum(words[row], LEAST_WORDS))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        row, at, value = self.values(texts)
        f = self.bias + np.bincount(row, self.weights[at] * value, len(texts))
        return 1 / (1 + np.exp(-np.clip(f, -50, 50)))


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 500, rate: float = 0.05, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias. x: values, a row a text; positive: whether it is of the confirmed or of the unlabelled ones."""
    x = np.c_[x, np.ones(len(x), x.dtype)]
    p, u, w = x[positive], x[~positive], np.zeros(x.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    w[:-1], w[-1] = 1, np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        narrow = w.astype(x.dtype)
        sp, su = 1 / (1 + np.exp(-np.clip(p @ narrow, -50, 50))), 1 / (1 + np.exp(-np.clip(u @ narrow, -50, 50)))
        # loss(+) = 1 - s and loss(-) = s; ds/df = s (1 - s).
        up, down = prior * ((sp * (1 - sp)) @ p) / len(p), ((su * (1 - su)) @ u) / len(u)
        g = down - 2 * up if su.mean() >= prior * sp.mean() else -up
        g[:-1] += l2 * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (1 - t / steps) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, n_features: int = FEATURES) -> Model:
    known = training_labels(labels, id_col, label_col)
    n, toxic = known.agg(F.count("*"), F.sum("y")).first()
    prior = (toxic or 0) / n if n else 0.0
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    if not toxic:
        return nothing
    chosen = sample(known.filter("y = 1"), "id", positives, 3).select("id")  # at most about `positives` ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & (fold("id") != 0))
    size = texts.count()
    confirmed = bounded(texts.join(F.broadcast(chosen), "id"), positives, 3).select("text", F.lit(True).alias("positive"))
    others = bounded(texts, unlabelled, 4).select("text", F.lit(False).alias("positive"))
    both = cut(confirmed.union(others), "training")
    counts = {r["positive"]: r["n"] for r in both.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = counts.get(True, 0), counts.get(False, 0)
    if not n_p or not n_u:
        return nothing

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_groups(batch.column(0)):
                row, value, _ = features(texts)
                order = np.lexsort((row, value))
                row, value = row[order], value[order]
                once = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])) if len(row) else np.zeros(0, bool)
                found, n = np.unique(value[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["f", "p"])

    toxic_texts = both.filter("positive").select("text")
    often = toxic_texts.mapInArrow(counted, "f long, p long").groupBy("f").agg(F.sum("p").alias("p")).filter(F.col("p") >= LEAST_DOCUMENTS).toPandas()  # of a bounded sample
    often = often.assign(f=often["f"].to_numpy(np.int64).view(np.uint64)).sort_values("f")
    hashes, p = often["f"].to_numpy(np.uint64), often["p"].to_numpy(np.int64)
    if not len(hashes):
        return nothing
    wanted = docs.sparkSession.sparkContext.broadcast(Model(hashes, np.zeros(len(hashes)), 0.0))

    def counted_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value.hashes), np.int64)
        for batch in batches:
            for _, texts in text_groups(batch.column(0)):
                total += np.bincount(wanted.value.values(texts)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["k", "u"])

    u = np.zeros(len(hashes), np.int64)
    every = texts.select("text").mapInArrow(counted_all, "k long, u long").groupBy("k").agg(F.sum("u").alias("u")).toPandas()  # as many as hashes
    u[every["k"].to_numpy(np.int64)] = every["u"].to_numpy(np.int64)
    a, b = p / n_p, u / size
    mean = (p + u) / (n_p + size)
    z = (a - b) / np.sqrt(mean * (1 - mean) * (1 / n_p + 1 / size) + 1e-12)
    sure = np.flatnonzero((a > 2 * b) & (z >= LEAST_Z))
    hashes = hashes[sure[np.lexsort((hashes[sure].view(np.int64), -z[sure]))][:n_features]]
    if not len(hashes):
        return nothing
    model = Model(hashes, np.zeros(len(hashes)), 0.0)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, texts in text_groups(batch.column(0)):
                x = np.zeros((len(texts), len(sent.value.hashes)), np.uint8)
                row, at, v = sent.value.values(texts)
                x[row, at] = np.rint(UNIT * v)
                yield pa.RecordBatch.from_arrays([pa.array([bytes(r) for r in x], pa.binary()), batch.column(1).slice(k, len(texts))], names=["x", "positive"])

    rows = both.mapInArrow(packed, "x binary, positive boolean").toPandas().sort_values(["positive", "x"])  # a byte for each text and feature
    x = np.frombuffer(b"".join(map(bytes, rows["x"])), np.uint8).reshape(len(rows), -1).astype(np.float32) / UNIT
    weights, bias = fit_nnpu(x, rows["positive"].to_numpy(bool), min(max(prior, 1e-3), 0.999))
    return Model(model.hashes, weights, bias)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row of docs."""
    out = _scored(docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("own0"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("own1")), model)
    out = out.select(F.col("own0").alias(id_col), F.col("own1").alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _scored(docs: DataFrame, model: Model, with_text: bool = False) -> DataFrame:
    """docs has the text as `text`, first, and other columns as own0, own1, ...; they stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.scores(texts) for _, texts in text_groups(batch.column(0))]
            first = 0 if with_text else 1
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*batch.schema.names[first:], "score"])

    out = docs if with_text else docs.drop("text")
    return docs.mapInArrow(step, out.withColumn("score", F.lit(0.0).cast("double")).schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not predicted to be toxic. Trained on the stage's own documents."""
    model = train(docs, table(spark, sf_dir, "labels"))
    names = [c for c in docs.columns if c != "text"]
    own = docs.select("text", *[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(names)])
    kept = {c: F.col(f"own{i}") for i, c in enumerate(names)} | {"text": F.col("text")}
    return _scored(own, model, True).filter("score < 0.5").select(*[kept[c].alias(c) for c in docs.columns])
