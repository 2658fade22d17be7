r"""Benchmark decontamination by winnowing.

A document and a benchmark item share a passage if `window` consecutive item words occur in the document; an item with
fewer words is one passage as a whole. Both sides keep the smallest hash of each sliding window of k-grams (k = 5 and
window - k + 1 = 9 k-grams by default), which guarantees that every shared run of `window` words has a fingerprint in
common at the same place of the run. Fingerprints are joined, and each hit is extended to all windows around it that are an
item's, word by word; hit windows that meet or overlap form a run. Items shorter than `window` keep one hash of the whole item,
which is looked up among all runs of that length. Windows that repeat, in a text or in items, are one passage with one list of
its items, so that texts and items of one word over and over cost no more than others.

The benchmark is split by item hash into blocks of at most `block_words` words (one block if it is small, which is
checked); each block is broadcast, and documents stream through one narrow step a block. No document is shuffled.

Edge cases: null or empty texts have no words, no hits and are not contaminated; items without words match nothing;
repeated items with one item_id count once; items without an item_id count for n_hit and contaminated, but not for n_items
and items_sha256; repeated document rows each get their row; an empty benchmark hits nothing;
an empty document table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policyframe.llm.shared import FOLDED_ALNUM, grams, hash_words, mix, table, text_groups

WINDOW, GRAM = 13, 5
#: Words of one broadcast block: some 100 MB in each Python worker.
BLOCK_WORDS = 4_000_000
_BASE, _GOLD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
#: A document is contaminated if 20 * hit words >= words.
SHARE = 20


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Places of values that are the smallest of some window of `span` consecutive values (ties: all)."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    span = min(span, n)
    lows = _sliding(hashes, span, np.minimum)
    # A place is kept if the largest of its windows' minima is its own value.
    padded = np.concatenate([np.zeros(span - 1, np.uint64), lows, np.zeros(span - 1, np.uint64)])
    return np.flatnonzero(_sliding(padded, span, np.maximum) == hashes)


def _sliding(x: np.ndarray, span: int, best) -> np.ndarray:
    have = 1
    out = x
    while have * 2 <= span:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < span:
        out = best(out[: len(out) - (span - have)], out[span - have :])
    return out


def _runs_hash(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on."""
    out = np.full(len(at), n, np.uint64)
    for k in range(n):
        out = mix((out + _GOLD) * _BASE + words[at + k])
    return out


def _lists(groups: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct groups, and of each an id of its set of members: groups with the same members share it. Groups are sorted."""
    edges = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, np.int64)
    known: dict[bytes, int] = {}
    ends = np.append(edges[1:], len(groups))
    return edges, np.array([known.setdefault(members[a:b].tobytes(), len(known)) for a, b in zip(edges.tolist(), ends.tolist(), strict=True)], np.int64)


class Block:
    """Some items: the fingerprints of the long ones, and all distinct passages (windows, and items shorter than one), by their
    length, as arrays sorted by hash. A passage has one place of its words, and the number of the set of items that hold it."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int, gram: int):
        self.window, self.gram = window, gram
        same: dict[bytes, int] = {}
        self.ids: list[set[str]] = []
        sequences: list[np.ndarray] = []
        words = hash_words([t for _, t in items], FOLDED_ALNUM)
        for (item_id, _), a, b in zip(items, words.first[:-1], words.first[1:], strict=True):
            if a < b:
                key = words.hashes[a:b].tobytes()
                if key not in same:
                    same[key] = len(sequences)
                    sequences.append(words.hashes[a:b])
                    self.ids.append(set())
                if item_id is not None:
                    self.ids[same[key]].add(item_id)
        first = np.cumsum([0, *map(len, sequences)])
        self.words = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
        prints = [np.zeros(0, np.uint64)]
        places: dict[int, tuple[list, list]] = {}
        for i, s in enumerate(sequences):
            n = min(len(s), window)
            at, of = places.setdefault(n, ([], []))
            at.append(first[i] + np.arange(len(s) - n + 1))
            of.append(np.full(len(s) - n + 1, i))
            if n == window:
                h = grams(s, gram)
                prints.append(h[winnow(h, window - gram + 1)])
        self.prints = np.unique(np.concatenate(prints))
        self.passages = {}
        self.sets: list[np.ndarray] = []
        for n, (at, of) in places.items():
            at, of = np.concatenate(at), np.concatenate(of)
            hashes = _runs_hash(self.words, at, n)
            order = np.lexsort((at, of, hashes))
            hashes, at, of = hashes[order], at[order], of[order]
            # An item that holds a passage several times holds it once.
            once = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1]))
            hashes, at, of = hashes[once], at[once], of[once]
            edges, sets = _lists(hashes, of)
            base = len(self.sets)
            ends = np.append(edges[1:], len(of))
            known: dict[int, np.ndarray] = {}
            for k, a, b in zip(sets.tolist(), edges.tolist(), ends.tolist(), strict=True):
                known.setdefault(k, of[a:b])
            self.sets += [known[k] for k in range(len(known))]
            self.passages[n] = (hashes[edges], at[edges], sets + base)

    def passage(self, n: int, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the places `at` begin a passage of n words, by the words themselves, and its set of items."""
        keys, places, sets = self.passages[n]
        hashes = _runs_hash(words, at, n)
        k = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        some = np.flatnonzero(keys[k] == hashes)
        k = k[some]
        for step in range(n):
            same = words[at[some] + step] == self.words[places[k] + step]
            some, k = some[same], k[same]
        return some, sets[k]


def find(texts: list[bytes], block: Block) -> tuple[np.ndarray, list[tuple[int, int, int]], list[set[str]]]:
    """Words of each text; runs of hit words as (text, first word, end); for each text, the ids of the items found.

    Work is in proportion to the words, however often they repeat: fingerprints name the places whose windows are looked up,
    each place is looked up once, and of each text every set of items is taken once."""
    words = hash_words(texts, FOLDED_ALNUM)
    first, hashes = words.first, words.hashes
    runs, found = [], [set() for _ in texts]
    if not len(hashes):
        return words.counts, runs, found
    owners = words.owners()
    steps = np.zeros(len(hashes) + 1, np.int64)
    doc_sets = []

    def hit(n: int, at: np.ndarray) -> None:
        at = at[at + n <= first[owners[at] + 1]] if len(at) else at
        some, sets = block.passage(n, hashes, at)
        np.add.at(steps, at[some], 1)
        np.add.at(steps, at[some] + n, -1)
        doc_sets.append(np.stack([owners[at[some]], sets], 1))

    for n in block.passages:
        if n > len(hashes):
            continue
        if n < block.window:
            hit(n, np.arange(len(hashes) - n + 1))
            continue
        h = grams(hashes, block.gram)
        at = winnow(h, n - block.gram + 1)
        k = np.minimum(np.searchsorted(block.prints, h[at]), len(block.prints) - 1)
        at = at[block.prints[k] == h[at]]
        # Every window around a fingerprint in common.
        near = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(near, np.maximum(at - (n - block.gram), 0), 1)
        np.add.at(near, at + 1, -1)
        hit(n, np.flatnonzero(np.cumsum(near[:-1])[: len(hashes) - n + 1] > 0))
    covered = np.cumsum(steps[:-1]) > 0
    if not covered.any():
        return words.counts, runs, found
    begins = covered & ~np.append(False, covered[:-1] & (owners[1:] == owners[:-1]))
    ends = covered & ~np.append(covered[1:] & (owners[1:] == owners[:-1]), False)
    for a, b in zip(np.flatnonzero(begins).tolist(), (np.flatnonzero(ends) + 1).tolist(), strict=True):
        d = int(owners[a])
        runs.append((d, int(a - first[d]), int(b - first[d])))
    for d, k in np.unique(np.concatenate(doc_sets), axis=0).tolist():
        for i in block.sets[k].tolist():
            found[d] |= block.ids[i]
    return words.counts, runs, found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[DataFrame]:
    """The benchmark in parts whose size has been checked: a text has at most half as many words as bytes, and one."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1).alias("n")).first()["n"] or 0
    n = max(1, -(-int(size) // block_words))
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document row: id, n_words, runs (list of [first word, end)), items (ids found, sorted as strings),
    n_hit, n_items, items_sha256, contaminated."""
    out = _found(docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("own0")), benchmark, item_col, item_text_col, window, gram, block_words)
    return out.drop("text").withColumnRenamed("own0", id_col).select(id_col, "n_words", "runs", "items", "n_hit", "n_items", "items_sha256", "contaminated")


def _found(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, gram: int, block_words: int) -> DataFrame:
    """docs has the text as `text`, and other columns as own0, own1, ...; they stay."""
    spark: SparkSession = docs.sparkSession
    text_col, run_type = "text", "array<struct<a:long,b:long>>"
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "runs": F.array().cast(run_type), "items": F.array().cast("array<string>")})
    for part in _blocks(benchmark, item_col, item_text_col, block_words):
        block = Block([(r["item"], r["text"].encode()) for r in part.toLocalIterator()], window, gram)
        sent = spark.sparkContext.broadcast(block)

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.names.index
                counts, runs = [], [[tuple(r.values()) for r in v] for v in batch.column(at("runs")).to_pylist()]
                items = [set(v) for v in batch.column(at("items")).to_pylist()]
                for k, texts in text_groups(batch.column(at(text_col))):
                    n, new, found = find(texts, sent.value)
                    counts += n.tolist()
                    for d, a, b in new:
                        runs[k + d].append((a, b))
                    for d, ids in enumerate(found):
                        items[k + d] |= ids
                columns = list(batch.columns)
                columns[at("n_words")] = pa.array(counts, pa.int64())
                columns[at("runs")] = pa.array([[{"a": a, "b": b} for a, b in sorted(set(v))] for v in runs], batch.schema.field("runs").type)
                columns[at("items")] = pa.array([sorted(v) for v in items], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        out = out.mapInArrow(step, out.schema)

    # Runs are sorted: each adds what lies beyond the end so far.
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
    hit = F.aggregate(
        "runs",
        start,
        lambda s, r: F.struct((s["total"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"]))).alias("total"), F.greatest(s["end"], r["b"]).alias("end")),
        lambda s: s["total"],
    )
    return (
        out.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
        .withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: The same, by joining all windows of both sides as texts.
OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), passages AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0
), runs AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM docs, (SELECT DISTINCT size FROM passages) AS s, unnest(range(1, len(w) - size + 2)) AS u(i)
), found AS (SELECT doc_id, i, size, item FROM runs JOIN passages USING (size, words)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM found), unnest(range(i, i + size)) AS u(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not contaminated."""
    names = [c for c in docs.columns if c != "text"]
    own = docs.select("text", *[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(names)])
    found = _found(own, table(spark, sf_dir, "benchmark"), "item_id", "text", WINDOW, GRAM, BLOCK_WORDS)
    kept = {c: F.col(f"own{i}") for i, c in enumerate(names)} | {"text": F.col("text")}
    return found.filter("not contaminated").select(*[kept[c].alias(c) for c in docs.columns])
