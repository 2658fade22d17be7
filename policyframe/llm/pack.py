"""Best-two-fit packing of tokenized documents into sequences of bounded length.

A document is its token ids and an end id; only longer ones are cut, into pieces of the capacity. Packing depends on the
lengths alone, and there are at most `capacity` different lengths: their counts (a bounded table) are packed on the
driver, a whole pattern of lengths at a time. A bin is filled greedily with the longest document that still fits; then its
smallest document is replaced with the two unpacked ones that fill the widened gap most tightly, if they fill it better.
Every piece then finds its place from its rank among the pieces of its length; ranks come from counts of (bucket,
length), so no length's pieces meet in one task, however many rows are alike. The patterns' places are broadcast: some 6,000
for a capacity of 2,048, for a hundred thousand documents as for a hundred million; their number is checked.

Words that consist of common Latin characters are tokenized once each and remembered (the tokenizer splits texts into
words first); any other text goes through the tokenizer as a whole.

Edge cases: null and empty texts are one end id; repeated rows are packed each; pieces of the capacity fill a sequence
alone; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyframe.llm.shared import cut, partitions, table

CAPACITY, END_ID, VOCABULARY = 2048, 0, "word_bpe_49k.json"
#: Words a Python worker remembers; then it starts anew.
REMEMBERED = 700_000
#: Of 32 bytes each. Their number is bounded by the capacity, not by the documents: a pattern is used until one of its lengths
#: has fewer pieces left than a bin of it holds, which can happen to a length only as often as that number shrinks.
MOST_PLACES = 2_000_000

#: Characters for which Python's classes and lower-casing agree with the tokenizer's, and which have no decompositions.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xffĀ-įı-ž]")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


class Encoder:
    """Token ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Each word's ids. Many words are tokenized as one text, whose ids are cut after each end of a word."""
        out = []
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) != len(part):
                out += self._whole(part)
                continue
            data, at = ids.tobytes(), [0, *cuts.tolist()]
            out += [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [None if _OTHER.search(t) or "<|" in t else _WORD.findall(t.lower()) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set(chain.from_iterable(words for words in plain if words)).difference(self.known))
        self.known.update(zip(new, self._words(new), strict=True))
        rest = iter(self._whole([t for t, words in zip(texts, plain, strict=True) if words is None]))
        return [next(rest) if words is None else b"".join(map(self.known.__getitem__, words)) for words in plain]


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str | None) -> DataFrame:
    """Pieces without their places; `row` numbers the rows of a batch, and so tells rows apart that are alike."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, END_ID.to_bytes(4, "little")
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                ids, rows = batch.column(0).slice(k, 500), []
                for i, found in enumerate(encode([t or "" for t in batch.column(1).slice(k, 500).to_pylist()])):
                    found += end
                    for n, a in enumerate(range(0, len(found), 4 * capacity)):
                        part = found[a : a + 4 * capacity]
                        rows.append((i, n, a // 4, len(part) // 4, zlib.crc32(part)))
                i, n, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(n, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc, [k + x for x in i]))], names=["id", "piece", "start", "length", "ids_crc32", "row"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(step, f"id {kind}, piece int, start long, length long, ids_crc32 long, row long")


def _best_two(left: np.ndarray, room: int, over: int) -> tuple[int, int] | None:
    """Two lengths left, of the largest sum in (over, room]."""
    some = np.flatnonzero(left[: room + 1])
    if not len(some):
        return None
    at = np.searchsorted(some, room - some, "right") - 1
    pairs = np.minimum(at, np.arange(len(some)))  # the second is no longer than the first
    alone = (pairs == np.arange(len(some))) & (left[some] < 2)
    pairs = np.where(alone, pairs - 1, pairs)
    sums = np.where(pairs >= 0, some + some[pairs], 0)
    k = int(sums.argmax())
    return (int(some[k]), int(some[pairs[k]])) if sums[k] > over else None


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths, longest first, and how many bins each fills."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            return out
        pool, chosen, gap = left.copy(), [], capacity
        while len(fit := np.flatnonzero(pool[: gap + 1])):
            longest = int(fit[-1])
            # As many of it as there are and fit.
            n = min(int(pool[longest]), gap // longest)
            chosen += [longest] * n
            pool[longest] -= n
            gap -= n * longest
        if gap and len(chosen) > 1:
            smallest = chosen[-1]
            if two := _best_two(pool, gap + smallest, smallest):
                chosen = [*chosen[:-1], *two]
        chosen.sort(reverse=True)
        lengths, used = np.unique(chosen, return_counts=True)
        times = max(1, int((left[lengths] // used).min()))
        left[lengths] -= used * times
        out.append((chosen, times))


def _places(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, pieces a sequence, offset of the first)."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    base = 0
    for lengths, times in patterns:
        at = 0
        for length, n in zip(*np.unique(lengths, return_counts=True), strict=True):
            length, n = int(length), int(n)
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, base, n, at))
            ranks[length] = rank + n * times
            at += n * length
        base += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece."""
    spark = docs.sparkSession
    cuts = cut(pieces(docs, id_col, text_col, capacity, tokenizer_path), "pieces")
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = _places(best_two_fit(counts, capacity))
    if (n := sum(map(len, places.values()))) > MOST_PLACES:  # not met by any table: they depend on the capacity alone
        raise ValueError(f"{n} places for patterns of {capacity} tokens are too many to broadcast; take a smaller capacity")
    sent = spark.sparkContext.broadcast(places)
    buckets = max(64, partitions(spark))
    dealt = cuts.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32", "row"), F.lit(buckets)))
    sizes = dealt.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("bucket", "length").orderBy("id", "piece", "ids_crc32")
    # Ranks are dealt by bucket and length anyway: the sizes come to them.
    ranked = dealt.withColumn("own", F.row_number().over(own)).join(cut(sizes, "sizes").hint("merge"), ["bucket", "length"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own") - 1).alias("rank"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length):
                mine = np.flatnonzero(length == value)
                rows = sent.value[int(value)]
                first, base, n, at = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1].T
                sequence[mine] = base + (rank[mine] - first) // n
                offset[mine] = at + (rank[mine] - first) % n * value
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(step, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents' pieces and their places."""
    return pack(docs)
