"""Helpers that several training-data operators share: tables, cut lineage, word hashes.

Words are found on UTF-8 bytes with numpy, for whole Arrow batches at once, so a text of any length is
read once and never as a Python list of characters.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are hashed in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1_000_000

_own_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without that setting gets
    a temporary folder; on a cluster a missing setting is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="policyframe-")
    return _own_folders[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session is gone at exit; the folder's owner clears what is left
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet in the shared folder and read again: its lineage ends there, and a lost executor costs
    no more than the step that was running. Shuffle files of the steps before are released."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/policyframe/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    schema = df.schema
    del df
    # The only way to have the shuffle files of finished steps deleted from executors' disks: Spark does it when the driver's JVM
    # finds their plans unreachable, and by itself looks every half an hour.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def done(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote and that nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, df._cut_path)


#: A key is hot if it has more than one in so many rows; there are fewer hot keys than that, whatever the rows.
HOT = 1024


def joined(rows: DataFrame, one: DataFrame, key: str, total: int, times: str = "times") -> DataFrame:
    """rows.join(one, key). `one` has each key once, and how many rows have it as `times` (which goes). Hot keys are fewer than
    HOT, so that their part of `one` is broadcast; the others meet by shuffle, where no key gives a task more than its share."""
    hot = one.filter(F.col(times) > total / HOT).drop(times)
    cold = one.filter(F.col(times) <= total / HOT).drop(times)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- words and hashes -----------------------------------------------------------------------------------------------

_MIX1, _MIX2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 4096), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def byte_table(word: bool, separators: bytes = b"", fold: bool = False) -> np.ndarray:
    """For each byte, the byte that a word has there, or 0 between words. `word`: ASCII digits, letters and all bytes
    from 0x80 are of words; else all but `separators`."""
    out = np.arange(256, dtype=np.uint8)
    if word:
        keep = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
    else:
        keep = np.array([b not in separators for b in range(256)])
    if fold:
        out[65:91] += 32
    # A zero byte can itself be a word's; words are told by `keep`, values by `out` + 1 below.
    return np.where(keep, out.astype(np.uint16) + 1, 0).astype(np.uint16)


#: Maximal runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased.
FOLDED_ALNUM = byte_table(True, fold=True)
#: Maximal runs of [^\x20\x09-\x0D].
BLANK_SEPARATED = byte_table(False, b" \t\n\x0b\x0c\r")


class Words:
    """The words of several texts. hashes: one 64-bit value a word; first: where each text's words begin (and the end)."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.hashes, self.first = hashes, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _spans(texts: list[bytes], kinds: np.ndarray) -> tuple:
    """Of all words: values of their bytes, their places in the word, and the words' first values, starts and lengths."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    values = kinds[data]
    inside = values != 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]
    lengths = ends - starts
    first_of = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first_of, lengths)
    return values[inside].astype(np.uint64), place, first_of, lengths, np.searchsorted(starts, begins)


def hash_words(texts: list[bytes], kinds: np.ndarray) -> Words:
    return word_prefixes(texts, kinds, ())[0]


def word_prefixes(texts: list[bytes], kinds: np.ndarray, sizes: tuple[int, ...]) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words, and for each of `sizes` the words that have so many bytes and the hashes of their first bytes."""
    flat, place, first_of, lengths, first = _spans(texts, kinds)
    if not len(lengths):
        return Words(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)), [(np.zeros(0, np.int64), np.zeros(0, np.uint64))] * len(sizes)
    powers = _powers_to(int(lengths.max()))
    flat *= powers[place]
    words = Words(mix(np.add.reduceat(flat, first_of) ^ (lengths.astype(np.uint64) * _GOLD)), first)
    starts = []
    for n in sizes:
        has = np.flatnonzero(lengths >= n)
        at, total = first_of[has], np.zeros(len(has), np.uint64)
        for k in range(n):
            total += flat[at + k]
        starts.append((has, mix(total)))
    return words, starts


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The hash of each run of n words, by doubling. Runs across texts are in it too: the caller leaves them out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out, have, power, span = None, 0, mix(hashes + np.uint64(salt) * _GOLD), 1
    while True:
        if n & span:
            if out is None:
                out, have = power, span
            else:
                size = len(hashes) - have - span + 1
                out = mix(out[:size] * _BASE + power[have : have + size] + _GOLD)
                have += span
        if have == n:
            return out[: len(hashes) - n + 1]
        size = len(power) - span
        power = mix(power[:size] * _BASE + power[span : span + size] + _GOLD)
        span *= 2


def inside_one_text(words: Words, n: int) -> np.ndarray:
    """For each place of a run of n words: whether the run ends in the text where it begins."""
    size = max(0, len(words.hashes) - n + 1)
    owner = words.owners()
    return owner[:size] == owner[n - 1 :][:size] if size else np.zeros(0, bool)


#: XXH64's five primes.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rolled(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


class Bytes:
    """Bytes that are read 1, 4 or 8 at a time from any place."""

    def __init__(self, data: bytes):
        data += b"\0" * 8
        self.one = np.frombuffer(data, np.uint8)
        self.four = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
        self.eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def xxh64(data: Bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each span of data, all spans at once."""
    whole, four, eight = data.one, data.four, data.eight
    size, at, seed = (ends - starts).astype(np.uint64), starts.astype(np.int64), np.uint64(seed)
    with np.errstate(over="ignore"):
        out = np.full(len(at), seed + _P5, np.uint64)
        long = np.flatnonzero(size >= 32)
        if len(long):
            lanes = [np.full(len(long), v, np.uint64) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            left, where = ends[long] - starts[long], at[long]
            alive = np.arange(len(long))
            while len(alive):
                for k, lane in enumerate(lanes):
                    lane[alive] = _rolled(lane[alive] + eight[where[alive] + 8 * k] * _P2, 31) * _P1
                where[alive] += 32
                left[alive] -= 32
                alive = alive[left[alive] >= 32]
            total = sum(_rolled(lane, n) for lane, n in zip(lanes, (1, 7, 12, 18), strict=True))
            for lane in lanes:
                total = (total ^ (_rolled(lane * _P2, 31) * _P1)) * _P1 + _P4
            out[long], at[long] = total, where
        out += size
        while len(some := np.flatnonzero(ends - at >= 8)):
            out[some] = _rolled(out[some] ^ (_rolled(eight[at[some]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[some] += 8
        some = np.flatnonzero(ends - at >= 4)
        out[some] = _rolled(out[some] ^ (four[at[some]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[some] += 4
        while len(some := np.flatnonzero(ends > at)):
            out[some] = _rolled(out[some] ^ (whole[at[some]].astype(np.uint64) * _P5), 11) * _P1
            at[some] += 1
        out = (out ^ (out >> np.uint64(33))) * _P2
        out = (out ^ (out >> np.uint64(29))) * _P3
        return out ^ (out >> np.uint64(32))


def text_groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes; a null as b""), in groups of about `limit` bytes."""
    column = column.cast(pa.large_binary())
    group, first, size = [], 0, 0
    for i, value in enumerate(column):
        text = value.as_py() or b""
        if group and size + len(text) > limit:
            yield first, group
            group, first, size = [], i, 0
        group.append(text)
        size += len(text)
    if group:
        yield first, group
