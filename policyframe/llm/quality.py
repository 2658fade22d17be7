"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text (sizes, shares of kinds of characters and words, repetition, and the same for its worst line)
are standardized and mapped to `n_fourier` random Fourier features, whose inner products approximate a Gaussian kernel. Each partition
of the training rows sums its part of the normal equations; the sums are solved once. Scores of a fold that the
ridge has not seen are calibrated by isotonic regression (pool adjacent violators, linear between the pools).

Training reads at most about `bound` labelled texts, chosen by a hash of id and text; the bound is a parameter and holds for rows,
not ids. Sums are taken in an order that the values give, and equal scores are calibrated as one, so that scores are a function of
the tables' rows alone. All texts are scored whole.

Edge cases: null and empty texts have the statistics of an empty text; without labels of both kinds all scores are the share of
label 1 (0.5 if unknown); a null id is held out if crc32's fold says so, else not (null counts as not held out); rows that
repeat an id and text train once, and each get their row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyframe.llm.labelled import FOLDS, bounded, fold, sample, training_labels
from policyframe.llm.shared import BLANK_SEPARATED, cut, hash_words, table, text_groups

BOUND, FOURIER, RIDGE, THRESHOLD = 20_000, 512, 1e-3, 0.3
CALIBRATION_FOLD = FOLDS - 1
#: Parts in which the training rows' normal equations are summed; each sends one matrix.
PARTS = 8

_KINDS = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "high": [*range(128, 256)],
    "stop": [ord(c) for c in ".,;:"],
    "loud": [ord(c) for c in "!?"],
    "bar": [ord(c) for c in "|\t"],
    "sign": [ord(c) for c in "#$%&*+<=>@[\\]^_`{}~/"],
    "quote": [ord(c) for c in "\"'()-"],
    "space": [32],
    "line": [10],
}
_TABLES = {k: np.isin(np.arange(256), v) for k, v in _KINDS.items()}
_LINE_KINDS = ("upper", "digit", "loud", "bar", "sign")


def statistics(texts: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) + 1 for t in texts]
    size = (ends - starts - 1).astype(np.float64)
    least = np.maximum(size, 1)
    sums = {k: np.add.reduceat(t[data], starts, dtype=np.int64) for k, t in _TABLES.items()}
    sums["line"] = sums["line"] - 1  # the joining line feed
    out = [np.log1p(size)] + [v / least for v in sums.values()]
    out.append(np.log1p(sums["line"]))
    out.append(sums["upper"] / np.maximum(sums["upper"] + sums["lower"], 1))
    words = hash_words(texts, BLANK_SEPARATED)
    owner, n = words.owners(), words.counts
    least_n = np.maximum(n, 1)
    out += [np.log1p(n), size / least_n]
    pairs = _distinct(owner, words.hashes)
    out.append(np.bincount(pairs, minlength=len(texts)) / least_n)
    same = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    out.append(np.bincount(owner[1:][same], minlength=len(texts)) / least_n)
    # The worst line, and the share of repeated lines.
    feeds = np.flatnonzero(data == 10)
    line_start = np.concatenate([[0], feeds[:-1] + 1])
    line_size = (feeds - line_start).astype(np.float64)
    line_text = np.searchsorted(ends, line_start, "right")
    first_line = np.searchsorted(line_text, np.arange(len(texts)))
    for k in _LINE_KINDS:
        share = np.add.reduceat(_TABLES[k][data], line_start, dtype=np.int64) / np.maximum(line_size, 1)
        heavy = np.where(line_size >= 20, share, 0)
        out.append(np.maximum.reduceat(heavy, first_line))
        out.append(np.add.reduceat((heavy > 0.08) * line_size, first_line) / least)
    return np.nan_to_num(np.stack(out, 1))


def _distinct(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The owner of each distinct (owner, hash)."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    return o[np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1]))]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x by pooling adjacent violators. Rows of one x are one pool from the start, so
    that their order counts for nothing."""
    values, at = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b, rows in zip(values, np.bincount(at, y), np.bincount(at), strict=True):
        pools.append([b, rows, a * rows])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, t = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + t]
    s, n, t = np.array(pools, float).T
    return t / n, s / n


class Model:
    def __init__(self, mean: np.ndarray, deviation: np.ndarray, n_fourier: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.w = rng.normal(0, 1 / np.sqrt(2 * len(mean)), (len(mean), n_fourier)).astype(np.float32)
        self.b = rng.uniform(0, 2 * np.pi, n_fourier).astype(np.float32)
        self.weights = np.zeros(n_fourier + 1)
        self.knots: tuple[np.ndarray, np.ndarray] | None = None

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8).astype(np.float32)
        return np.c_[np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones(len(z), np.float32)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        # Rounded: how products of matrices round depends on how many rows a batch has.
        return np.round(self.fourier(x).astype(np.float64) @ self.weights, 5)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.knots is None:
            return np.full(len(texts), self.weights[-1])
        return np.clip(np.interp(self.raw(statistics(texts)), *self.knots), 0, 1)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = BOUND, n_fourier: int = FOURIER, ridge: float = RIDGE) -> Model:
    chosen = sample(training_labels(labels, id_col, label_col), "id", bound, 5)  # at most about `bound` rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for _, t in text_groups(batch.column(0))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).tolist(), pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "y", "fold"])

    texts = bounded(texts, bound, 5)
    rows = texts.select("text", "y", fold("id").cast("int").alias("fold")).mapInArrow(measured, "x array<double>, y int, fold int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(PARTS)).cast("int"))
    rows = cut(rows.repartition(PARTS, "part").sortWithinPartitions("part", "x", "y"), "statistics")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    ones = ones / n if n else 0.5
    if not n or not 0 < ones < 1:
        model = Model(np.zeros(1), np.ones(1), 1)
        model.weights[-1] = ones
        return model

    def parts(of: DataFrame, summed: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        """Sums over PARTS parts, added up in order. A part's rows are told by their values and lie sorted, so that sums of
        floating-point numbers are the same whenever they are taken."""

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[pa.RecordBatch]] = {}
            for batch in batches:
                for part in np.unique(batch.column(2).to_numpy()).tolist():
                    held.setdefault(part, []).append(batch.filter(pa.compute.equal(batch.column(2), part)))
            for part, own in held.items():  # of at most about `bound` rows
                rows = pa.Table.from_batches(own).combine_chunks()
                sums = summed(np.array(rows.column(0).to_pylist()), rows.column(1).to_numpy().astype(float))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([[t.astype(float).tobytes() for t in sums]], pa.list_(pa.binary()))], names=["part", "sums"])

        found = sorted(of.select("x", "y", "part").mapInArrow(step, "part int, sums array<binary>").collect())  # some PARTS rows of 2 MB
        return [sum(np.frombuffer(v) for v in vs) for vs in zip(*[p["sums"] for p in found], strict=True)]

    total, count = parts(rows, lambda x, y: (x.sum(axis=0), np.array([len(x)])))
    mean = total / count
    (spread,) = parts(rows, lambda x, y: (((x - mean) ** 2).sum(axis=0),))
    model = Model(mean, np.maximum(np.sqrt(spread / count), 1e-6), n_fourier)

    def equations(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = model.fourier(x).astype(np.float64)
        return (z.T @ z).ravel(), z.T @ y

    fitted = rows.filter(F.col("fold") != CALIBRATION_FOLD)
    a, b = parts(fitted if fitted.limit(1).count() else rows, equations)
    a = a.reshape(n_fourier + 1, -1)
    model.weights = np.linalg.solve(a + ridge * n * np.eye(len(a)) / len(a), b)
    rest = rows.filter(F.col("fold") == CALIBRATION_FOLD).select("x", "y").toPandas()  # of at most about `bound` rows
    if not len(rest):
        rest = rows.select("x", "y").toPandas()
    model.knots = isotonic(model.raw(np.array(rest["x"].tolist())), rest["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.scores(texts) for _, texts in text_groups(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.concatenate(found) if found else np.zeros(0))], names=[id_col, "held_out", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(step, f"`{id_col}` {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
