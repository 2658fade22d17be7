"""Approximate nearest neighbours with a hierarchical k-means tree.

1. The tree is fitted on a bounded sample (`sample` vectors, by a hash of the id): each node's vectors are split into
   `branches` clusters until a leaf stands for about `leaf` of all vectors. Every vector is then put into its leaf.
2. A search goes best bin first: it descends to the nearest child, keeps the others in a priority queue by their distance,
   and takes the nearest of them next, leaf after leaf.
3. How many leaves a search visits is calibrated: for `calibration` vectors (by a hash of the id) the true neighbours among
   all vectors are found by brute force, and visits are widened until `recall` of them lie in visited leaves.
4. Leaves of more than `part` vectors are split by a hash of the id into parts; queries meet each part of their
   leaves, distances are exact (double precision, original vectors), and the best of each part are merged.

Nothing but the sample, the calibration and the tree is on the driver; each is bounded. No leaf or part is cut off.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do vectors of another
length than the most common one (the smaller of two equally common ones); a query's own row is left out by its id, so rows that
repeat an id are not each other's neighbours; ties go to the smaller id; with fewer candidates than `k`, leaves are visited
until all are found; vectors so large or small that squares leave the range of doubles are scaled for the search, and a
distance beyond that range is infinite; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyframe.llm.shared import cut, table

K, BRANCHES, LEAF, PART, SAMPLE, CALIBRATION, RECALL = 10, 8, 96, 4096, 20_000, 100, 0.95
#: Squares of components within these bounds neither overflow nor vanish.
SMALL, LARGE = 1e-100, 1e100
#: Rows found that a task holds before it keeps the best of each query.
HELD = 400_000
_SPAN = 1 << 40


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    out = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    out = out.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))
    top = out.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return out.filter(F.size("v") == (top["n"] if top else 0))


def _share(id_col: str, share: float, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), id_col), F.lit(_SPAN)) < int(min(1.0, share) * _SPAN)


class Tree:
    """centres[n]: of n's children; children[n]: their numbers, leaves as -1 - leaf."""

    def __init__(self, x: np.ndarray, population: int, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(x, max(1.0, leaf * len(x) / max(1, population)), branches, rng)

    def _grow(self, x: np.ndarray, enough: float, branches: int, rng: np.random.Generator, depth: int = 0) -> int:
        if len(x) > max(enough, 4) and depth < 24:
            centres, label = _clusters(x, min(branches, max(2, int(len(x) / enough))), rng)
            if len(centres) > 1:
                node = len(self.centres)
                self.centres.append(centres)
                self.children.append([])
                for c in range(len(centres)):
                    self.children[node].append(self._grow(x[label == c], enough, branches, rng, depth + 1))
                return node
        self.leaves += 1
        return -self.leaves

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int32)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                near = _distances(x[rows], self.centres[node]).argmin(axis=1)
                stack += [(child, rows[near == c]) for c, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0, self.root)]
        pushed = 0
        while queue:
            _, _, node = heapq.heappop(queue)
            while node >= 0:
                d = ((self.centres[node] - q) ** 2).sum(axis=1)
                best = int(d.argmin())
                for c, child in enumerate(self.children[node]):
                    if c != best:
                        pushed += 1
                        heapq.heappush(queue, (float(d[c]), pushed, child))
                node = self.children[node][best]
            yield -1 - node


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1) - 2 * x @ centres.T


def _clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from distinct vectors; clusters that stay empty are left out."""
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(8):
        label = _distances(x, centres).argmin(axis=1)
        used = np.unique(label)
        centres = np.stack([x[label == c].mean(axis=0) for c in used])
    label = _distances(x, centres).argmin(axis=1)
    used = np.unique(label)
    return centres[used], np.searchsorted(used, label)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k smallest (score, id) of each query, each id once."""
    order = np.lexsort((score, ids, query))
    order = order[np.append(True, (np.diff(query[order]) != 0) | (np.diff(ids[order]) != 0))] if len(order) else order
    order = order[np.lexsort((ids[order], score[order], query[order]))]
    q = query[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def _scale(largest: float) -> float:
    """A power of two that brings components near one, where their squares would leave the range of doubles; else one."""
    return 1.0 if not largest or SMALL < largest < LARGE else float(2.0 ** -np.floor(np.log2(largest)))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows; beyond the range of doubles they are infinite."""
    with np.errstate(over="ignore", invalid="ignore"):
        diff = x - y
        out = np.sqrt((diff**2).sum(axis=1))
        most = np.abs(diff).max(axis=1, initial=0.0)
        odd = np.flatnonzero((most > LARGE) | ((most < SMALL) & (most > 0)))
        if len(odd):
            # Halves cannot overflow in the difference.
            half = x[odd] / 2 - y[odd] / 2
            most = np.maximum(np.abs(half).max(axis=1, keepdims=True), np.finfo(float).tiny)
            out[odd] = np.sqrt(((half / most) ** 2).sum(axis=1)) * most[:, 0] * 2
    return out


def _nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of x, the k best for each query at least: (query's row, row, distance); rows of the query's own id are left out.
    Products of matrices choose the rows, with room for their rounding; distances are taken from the vectors themselves."""
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    scale = _scale(max(np.abs(x).max(initial=0.0), np.abs(q).max(initial=0.0)))
    near = (x, q) if scale == 1 else (x * scale, q * scale)
    for a in range(0, len(x), 4096):
        part, part_ids = near[0][a : a + 4096], ids[a : a + 4096]
        sizes = (part**2).sum(axis=1)
        for b in range(0, len(q), 256):
            some = near[1][b : b + 256]
            d = sizes - 2 * some @ part.T
            room = 1e-9 * (sizes.max() + (some**2).sum(axis=1)[:, None])
            d[part_ids[None, :] == query_ids[b : b + 256, None]] = np.inf
            top = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.full((len(some), 1), np.inf)
            i, rows = np.nonzero((d <= top + room) & np.isfinite(d))
            out.append((i + b, rows + a, _exact(x[rows + a], q[i + b])))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _brute(assigned: DataFrame, query_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries: (query, id, leaf, score)."""
    sent = assigned.sparkSession.sparkContext.broadcast((query_ids, q))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, leaf, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            i, rows, d = _nearest(ids, x, *sent.value, k)
            keep = _best(i, ids[rows], d, k)
            i, rows, d = i[keep], rows[keep], d[keep]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(ids[rows]), pa.array(leaf[rows]), pa.array(d)], names=["query", "id", "leaf", "score"])

    found = assigned.select("id", "leaf", "v").mapInArrow(step, "query long, id long, leaf int, score double")
    best = Window.partitionBy("query").orderBy("score", "id")
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def calibrated(tree: Tree, assigned: DataFrame, n: int, k: int, calibration: int, recall: float, scale: float) -> int:
    """The least number of visits at which `recall` of the calibration's true neighbours are found."""
    rows = assigned.filter(_share("id", calibration / n, 2)).select("id", "v").toPandas().sort_values("id")
    if not len(rows):
        return tree.leaves
    q = np.array(rows["v"].tolist(), np.float64)
    truth = _brute(assigned, rows["id"].to_numpy(), q, k).select("query", "leaf").toPandas()
    at = []
    for i, leaves in truth.groupby("query")["leaf"]:
        rank = {leaf: r for r, leaf in enumerate(tree.visits(scale * q[i]), 1)}
        at += [rank[leaf] for leaf in leaves]
    at.sort()
    return at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)] if at else tree.leaves


def neighbours(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, branches: int = BRANCHES, leaf: int = LEAF, part: int = PART, sample: int = SAMPLE, calibration: int = CALIBRATION, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query; is_query is a condition on `id`."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    n, largest = rows.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    n, scale = max(1, n), _scale(largest or 0.0)
    fitted = rows.filter(_share("id", sample / n, 1)).select("id", "v").toPandas().sort_values("id")
    if not len(fitted):  # no rows, or so few that the hash chose none
        fitted = rows.limit(1).toPandas()
    if not len(fitted):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(scale * np.array(fitted["v"].tolist(), np.float64).reshape(len(fitted), -1), n, branches, leaf)
    sent = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = sent.value.assign(scale * _matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaves), batch.column(1)], names=["id", "leaf", "v"])

    assigned = cut(rows.mapInArrow(assign, "id long, leaf int, v array<double>"), "assigned")
    visits = calibrated(tree, assigned, n, k, calibration, recall, scale)
    sizes = {r["leaf"]: r["n"] for r in assigned.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # as many as leaves
    parts = {x: -(-size // part) for x, size in sizes.items()}
    split = spark.sparkContext.broadcast((sizes, parts))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to all parts of the leaves that it visits."""
        sizes, parts = split.value
        for batch in batches:
            x, rows = _matrix(batch.column(1)) if batch.num_rows else (), []
            for i, q in enumerate(x):
                found = 0
                for r, at in enumerate(sent.value.visits(scale * q), 1):
                    rows += [(i, at, p) for p in range(parts.get(at, 0))]
                    found += sizes.get(at, 0)
                    if r >= visits and found > k:
                        break
            i, at, p = zip(*rows, strict=True) if rows else ((), (), ())
            i = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(p, pa.int32()), pa.array(np.ones(len(at), np.int32)), batch.column(0).take(i), batch.column(1).take(i)], names=["leaf", "part", "side", "id", "v"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its part of its leaf."""
        own = np.array([split.value[1].get(x, 1) for x in range(sent.value.leaves)], np.int64)
        for batch in batches:
            part = batch.column(1).to_numpy() % own[batch.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), np.int32)), *batch.columns[2:]], names=["leaf", "part", "side", "id", "v"])

    members = assigned.select("leaf", F.xxhash64("id"), "id", "v").mapInArrow(placed, "leaf int, part int, side int, id long, v array<double>")
    asked = assigned.filter(is_query).select("id", "v").mapInArrow(spread, "leaf int, part int, side int, id long, v array<double>")
    work = members.union(asked).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "side")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, xs, held, size = None, [], [], [], 0

        def best() -> tuple[np.ndarray, ...]:
            """Of all that this task has found so far, the best of each query."""
            found = tuple(np.concatenate(v) for v in zip(*held, strict=True))
            keep = _best(*found, k)
            return tuple(v[keep] for v in found)

        for batch in batches:
            leaf_, part, side, own = (batch.column(c).to_numpy() for c in range(4))
            x = _matrix(batch.column(4)) if batch.num_rows else np.zeros((0, 0))
            edges = [0, *(np.flatnonzero((np.diff(leaf_) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(own)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if place != (leaf_[a], part[a]):
                    place, ids, xs = (leaf_[a], part[a]), [], []
                if side[a] == 0:
                    ids.append(own[a:b])
                    xs.append(x[a:b])
                elif ids:
                    if len(ids) > 1:
                        ids, xs = [np.concatenate(ids)], [np.concatenate(xs)]
                    i, rows, d = _nearest(ids[0], xs[0], own[a:b], x[a:b], k)
                    held.append((own[a:b][i], ids[0][rows], d))
                    size += len(d)
                    if size > HELD:
                        held = [best()]
                        size = len(held[0][0])
                        if size > HELD // 2:
                            yield pa.RecordBatch.from_arrays([pa.array(v) for v in held[0]], names=["query_id", "vec_id", "score"])
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in best()], names=["query_id", "vec_id", "score"])

    found = work.mapInArrow(search, "query_id long, vec_id long, score double")
    # Rows that repeat a query's id ask the same question; the answer is given once.
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
