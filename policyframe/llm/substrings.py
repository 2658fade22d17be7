r"""Substring deduplication with fixed-block anchors.

Words are [^\x20\x09-\x0D]+ and a window is `window` (20) consecutive words of one document. A word goes if it lies in a
window whose words also start earlier: in a document of smaller id, or earlier in the same one.

1. Anchors. Each text's non-overlapping blocks of window / 2 words are the index; every window of repeated words holds at
   least one of its own text's blocks. Every rolling run of that many words probes the index. Blocks and probes travel
   as packed 32-bit hash fragments, dealt by hash range into buckets; a batch sends each fragment once, and what it can tell by
   itself to be an anchor doesn't go through a bucket, so a passage in a third of all documents is one fragment a batch.
   A block is an anchor if it occurs anywhere besides its own place in exact copies of its text.
2. Extension. Around the anchors of each text (of exact copies, the one with the smallest id), every window that holds
   the anchor is compared by its 128-bit hash; windows that repeat are merged into maximal exact repeats. Within
   each batch all but the earliest of equal windows are known to go, so that only one a batch meets the others: a
   passage in a third of all documents gives no large group.
3. Later exact copies of a text of at least `window` words go as a whole.

No pairs are formed, and the answer does not depend on hash fragments: they only choose which windows are compared.

Edge cases: null and empty texts have no words; texts of fewer than `window` words stay whole; rows that repeat an id and
text are one document; rows with one id and other texts are ordered by the place of the window; a null id counts as larger
than any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyframe.llm.shared import BLANK_SEPARATED, cut, done, grams, hash_words, inside_one_text, mix, partitions, table, text_groups

WINDOW = 20
_LAST = (1 << 63) - 1


def _bytes(values: np.ndarray, edges: np.ndarray) -> list[bytes]:
    data, width = memoryview(np.ascontiguousarray(values)).cast("B"), values.dtype.itemsize
    return [bytes(data[a * width : b * width]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _probes(texts: DataFrame, block: int, bits: int) -> DataFrame:
    """Of each batch, a row a bucket of hashes: `probes`, fragments that occur outside the blocks named or in several of them;
    `blocks`, fragments that the batch has in one block alone, with its text's key (`owners`) and number. Each fragment is in a
    row once, however often the batch has it. Blocks that the batch itself shows to be anchors are rows of buckets below zero."""
    n_buckets = 1 << bits
    names = ["bucket", "probes", "blocks", "owners", "numbers"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            rolled, places, owner, number, size = [], [], [], [], 0
            for k, group in text_groups(batch.column(1)):
                words = hash_words(group, BLANK_SEPARATED)
                hashes, whole = grams(words.hashes, block), inside_one_text(words, block)
                text = words.owners()[: len(hashes)]
                place = np.arange(len(hashes)) - words.first[text]
                aligned = whole & (place % block == 0)
                rolled.append(hashes[whole])
                places.append(size + np.flatnonzero(aligned[whole]))
                owner.append(keys[k + text[aligned]])
                number.append((place[aligned] // block).astype(np.int32))
                size += len(rolled[-1])
            hashes, places, owner, number = (np.concatenate(v) for v in (rolled, places, owner, number))
            order = np.argsort(hashes)
            new = np.append(True, hashes[order[1:]] != hashes[order[:-1]]) if len(order) else np.zeros(0, bool)
            values = hashes[order[new]]
            group = np.empty(len(hashes), np.int64)
            group[order] = np.cumsum(new) - 1
            # Of each value: how often it occurs, in blocks and at all, and in how many different blocks.
            named = group[places]
            once = np.lexsort((number, owner, named))
            g, o, m = named[once], owner[once], number[once]
            single = np.append(True, (g[1:] != g[:-1]) | (o[1:] != o[:-1]) | (m[1:] != m[:-1])) if len(g) else np.zeros(0, bool)
            g, o, m = g[single], o[single], m[single]
            elsewhere = np.bincount(group, minlength=len(values)) > np.bincount(named, minlength=len(values))
            sure = elsewhere | (np.bincount(g, minlength=len(values)) > 1)
            probes, rest = values[sure], ~sure[g]
            shift = np.uint64(64 - bits)
            columns = [pa.array(np.arange(n_buckets, dtype=np.int32))]
            for hashed, carried in ((probes, [probes.astype(np.uint32)]), (values[g[rest]], [values[g[rest]].astype(np.uint32), o[rest], m[rest]])):
                edges = np.searchsorted(hashed >> shift, np.arange(n_buckets + 1, dtype=np.uint64))
                columns += [pa.array(_bytes(v, edges), pa.binary()) for v in carried]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            for a in range(0, n_buckets, 512):
                yield out.slice(a, 512)
            o, m = o[~rest], m[~rest]
            for a in range(0, len(o), 50_000):
                part = [b"", b"", o[a : a + 50_000].tobytes(), m[a : a + 50_000].tobytes()]
                spread = -1 - (int(o[a]) + a) % n_buckets
                yield pa.RecordBatch.from_arrays([pa.array([spread], pa.int32()), *(pa.array([v], pa.binary()) for v in part)], names=names)

    found = texts.select("key", "text").mapInArrow(step, "bucket int, probes binary, blocks binary, owners binary, numbers binary")
    return found.filter((F.length("probes") > 0) | (F.length("owners") > 0))


def _anchors_of(probes: np.ndarray, blocks: np.ndarray, owners: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket, (owner, number) of the blocks that occur elsewhere too."""
    if not len(blocks):
        return owners, numbers
    order = np.lexsort((numbers, owners, blocks))
    blocks, owners, numbers = blocks[order], owners[order], numbers[order]
    new_value = np.append(True, blocks[1:] != blocks[:-1])
    new_block = new_value | np.append(True, (owners[1:] != owners[:-1]) | (numbers[1:] != numbers[:-1]))
    value = np.cumsum(new_value) - 1
    known = blocks[new_value]
    repeated = np.bincount(value, new_block, len(known)) > 1
    at = np.minimum(np.searchsorted(known, probes), len(known) - 1)
    repeated[at[known[at] == probes]] = True
    chosen = new_block & repeated[value]
    return owners[chosen], numbers[chosen]


def _anchors(probes: DataFrame) -> DataFrame:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], [], [], []]
        kinds = (np.uint32, np.uint32, np.int64, np.int32)

        def found() -> pa.RecordBatch:
            owner, number = _anchors_of(*(np.frombuffer(b"".join(v), k) for v, k in zip(held, kinds, strict=True)))
            for v in held:
                v.clear()
            return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(number, pa.int32())], names=["key", "number"])

        last = None
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None and (bucket != last or bucket < 0):  # sure ones aren't held
                    yield found()
                last = bucket
                for v, part in zip(held, row, strict=True):
                    v.append(part)
        if last is not None:
            yield found()

    return probes.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(step, "key long, number int")


def _windows(texts: DataFrame, window: int, block: int) -> DataFrame:
    """Runs of words (id, key, start, words): `sure` ones go; the others are the earliest of their batch with hash (h1, h2)."""
    names = ["h1", "h2", "id", "key", "start", "words", "sure"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, keys, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            parts = []
            for k, group in text_groups(batch.column(3)):
                words = hash_words(group, BLANK_SEPARATED)
                near = np.zeros(len(words.hashes) + window, np.int32)
                for i, numbers in enumerate(lists[k : k + len(group)]):
                    at = words.first[i] + numbers.values.to_numpy().astype(np.int64) * block
                    np.add.at(near, np.maximum(at + block - window, words.first[i]), 1)
                    np.add.at(near, at + 1, -1)
                places = np.flatnonzero((np.cumsum(near)[: max(0, len(words.hashes) - window + 1)] > 0) & inside_one_text(words, window))
                text = words.owners()[places]
                parts.append([grams(words.hashes, window, salt)[places] for salt in (0, 1)] + [k + text, places - words.first[text]])
            h1, h2, row, start = (np.concatenate(v) for v in zip(*parts, strict=True))
            order = np.lexsort((start, ids[row], h2, h1))
            h1, h2, row, start = (v[order] for v in (h1, h2, row, start))
            if not len(row):
                continue
            new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            # Rows that repeat an id and text are one document: equal places are not earlier ones.
            later = (ids[row] != ids[row[first]]) | (start != start[first])
            sure = np.flatnonzero(later)
            sure = sure[np.lexsort((start[sure], row[sure]))]
            r, s = row[sure], start[sure]
            begins = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (s[1:] > s[:-1] + window))) if len(sure) else sure
            ends = np.append(begins[1:], len(sure)) - 1 if len(sure) else sure
            own = mix(ids[r[begins]].astype(np.uint64) ^ mix(s[begins].astype(np.uint64)))  # spreads the sure ones evenly
            one = ~later & new
            for a, b, rr, ss, n, known in ((h1[one], h2[one], row[one], start[one], np.full(one.sum(), window), False), (own, own, r[begins], s[begins], s[ends] + window - s[begins], True)):
                out = pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(ids[rr]), pa.array(keys[rr]), pa.array(ss.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(np.full(len(a), known))], names=names)
                for k in range(0, len(a), 50_000):
                    yield out.slice(k, 50_000)

    return texts.select("id", "key", "numbers", "text").mapInArrow(step, "h1 long, h2 long, id long, key long, start int, words int, sure boolean")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Runs of words to remove, of (id, key) with key = xxhash64(text): start and words; words is -1 for a whole text."""
    spark = docs.sparkSession
    block = window // 2
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    bits = max(8, (16 * partitions(spark) - 1).bit_length())
    anchors = cut(_anchors(_probes(texts, block, bits)), "anchors")
    named = texts.select("id", "key", F.md5("text").alias("same"))
    firsts = cut(named.groupBy("same", "key").agg(F.min("id").alias("first")), "firsts")
    lists = anchors.groupBy("key").agg(F.collect_set("number").alias("numbers"))
    chosen = cut(firsts.join(lists, "key").select(F.col("first").alias("id"), "key", "numbers"), "chosen")
    done(anchors)
    windows = _windows(texts.join(chosen, ["id", "key"]), window, block)
    order = Window.partitionBy("h1", "h2").orderBy("id", "start").rowsBetween(Window.unboundedPreceding, 0)
    earliest = F.first(F.struct("id", "start")).over(order)
    going = windows.withColumn("earliest", earliest).filter("sure or id != earliest.id or start != earliest.start")
    copies = named.join(firsts, ["same", "key"]).filter("id > first").select("id", "key", F.lit(0).alias("start"), F.lit(-1).alias("words"))
    return going.select("id", "key", "start", "words").union(copies.distinct())


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every row of docs: id, n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256."""
    runs = cut(repeats(docs, id_col=id_col, text_col=text_col, window=window), "repeats")
    by_text = cut(runs.groupBy("id", "key").agg(F.collect_list(F.struct("start", "words")).alias("runs")), "runs")
    done(runs)
    texts = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    joined = texts.join(by_text, ["id", "key"], "left").select("own", "text", F.col("runs.start").alias("starts"), F.col("runs.words").alias("lengths"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text, starts, lengths = (batch.column(k) for k in (1, 2, 3))
            rows = []
            for value, a, n in zip(text.cast(pa.large_binary()), starts, lengths, strict=True):
                words = (value.as_py() or b"").split()
                removed = 0
                if a.is_valid:
                    begin, size = a.values.to_numpy(), n.values.to_numpy()
                    if (size < 0).any():
                        mask = np.full(len(words), len(words) < window)
                    else:
                        steps = np.zeros(len(words) + 1, np.int64)
                        np.add.at(steps, begin, 1)
                        np.add.at(steps, begin + size, -1)
                        mask = np.cumsum(steps[:-1]) == 0
                    removed = len(words) - int(mask.sum())
                    kept = b" ".join(compress(words, mask.tolist()))
                else:
                    kept = b" ".join(words)
                rows.append((len(words), removed, kept.decode(), hashlib.sha256(kept).hexdigest()))
            n, removed, kept, digest = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())], names=[id_col, "n_words", "n_removed", "kept", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(step, f"`{id_col}` {kind}, n_words long, n_removed long, kept string, kept_sha256 string")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: The same, with all windows as texts.
OP5_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words FROM docs, unnest(range(1, len(w) - 18)) AS u(i)
), later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY words) AS f FROM windows) WHERE (doc_id, i) <> f),
removed AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(i, i + 20)) AS u(p)),
kept AS (
  SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS words, count(*) AS n
  FROM docs, unnest(range(1, len(w) + 1)) AS u(p) WHERE NOT EXISTS (FROM removed r WHERE r.doc_id = docs.doc_id AND r.p = u.p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""
