r"""Near-duplicate detection with 64-bit SimHash fingerprints, compared exactly in tiles.

A text, A-Z lower-cased, is cut into words [^\x20\x09-\x0D]+ and shingles of four; a fingerprint bit is 1 if it is set in
over half of the shingles' XXH64 values (seed 42). Fingerprints that differ in at most `radius` bits are linked, and
linked documents form components.

Equal fingerprints are one node. The grid of tiles is laid out by population count, in bands of radius + 1 counts: counts of
bands that are not neighbours differ beyond the radius, so only a band's tiles with each other and with those of the next band
are paired, and all other tile pairs are skipped. That alone leaves about half of all pairs, which grows with the square of the
documents; so, as a second filter, tiles are cut by bit blocks too: two fingerprints within the radius agree in at least
m - radius of any m blocks (m = radius + 1 at first, more when there are more fingerprints), so a tile holds those of one band
with one value of m - radius blocks. Tiles of more than `tile` fingerprints are split by a hash, and every pair of the parts is
a piece of work of its own: hot values spread over many tasks in this way. Inside, fingerprints are sorted by population
count, parts whose counts differ beyond the radius are skipped, and the others are compared with numpy exclusive-or and bit
counts. A task emits a spanning star for each group it finds, not all pairs; no link between different fingerprints is lost.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; texts of one to three words are one
shingle; repeated rows each get their row, with the same component; an empty table gives an empty result; rows with a null
id get a fingerprint and take part, but never name a component unless all of its ids are null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from policyframe.llm.components import components
from policyframe.llm.shared import Bytes, cut, done, joined, table, text_groups, xxh64

SHINGLE, RADIUS, SEED = 4, 4, 42
TILE, PART = 1024, 256
#: Shingles that are hashed at once.
MANY = 1 << 17
_LOWEST = np.uint64(0x0101010101010101)


def prints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text. Shingles are hashed where they lie, many at once, from words with one space between them."""
    raw = np.frombuffer((b"\n".join(texts) + b"\n").lower(), np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
    after = np.zeros(len(raw), bool)
    after[edges[1::2]] = True
    data = Bytes(np.where(inside, raw, 32).astype(np.uint8)[inside | after].tobytes())
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    counts = np.diff(np.searchsorted(starts, begins))
    ends = np.cumsum(sizes + 1) - 1  # of the words, in data
    some = np.flatnonzero(counts)
    first, n = (np.cumsum(counts) - counts)[some], np.maximum(counts[some] - shingle + 1, 1)
    reach, before = np.minimum(counts[some], shingle) - 1, np.cumsum(n) - n
    ones = np.zeros((len(some), 64), np.int64)
    for k in range(0, int(n.sum()), MANY):
        number = np.arange(k, min(k + MANY, int(n.sum())))
        owner = np.searchsorted(before, number, "right") - 1
        at = first[owner] + number - before[owner]
        hashes = xxh64(data, ends[at] - sizes[at], ends[at + reach[owner]], seed)
        # Bits are counted in bytes, eight of them in a word, over runs of at most 255 shingles of one text.
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
        runs = np.flatnonzero(place % 255 == 0)
        counted = np.empty((len(runs), 8, 8), np.uint8)
        for bit in range(8):
            counted[:, :, bit] = np.add.reduceat((hashes >> np.uint64(bit)) & _LOWEST, runs).view(np.uint8).reshape(-1, 8)
        np.add.at(ones, owner[runs], counted.reshape(-1, 64))
    out = np.zeros(len(texts), np.uint64)
    out[some] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prints(texts) for _, texts in text_groups(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64), pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(step, f"id {kind}, fp long")


def layout(n: int, radius: int, tile: int) -> list[tuple[int, ...]]:
    """Sets of bits, one of which any two fingerprints within the radius have in common: so long that values have at
    most about `tile` of n fingerprints each."""
    for m in range(radius + 1, radius + 5):
        blocks = [tuple(range(64 * i // m, 64 * (i + 1) // m)) for i in range(m)]
        sets = [sum(c, ()) for c in combinations(blocks, m - radius)]
        if n / 2 ** min(map(len, sets)) <= tile:
            break
    return sets


def _stars(fp: np.ndarray, other: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within fp, or between fp and other, as stars (member, smallest member)."""
    values = fp if other is None else np.concatenate([fp, other])
    sides = [fp, fp if other is None else other]
    order = [np.argsort(c := np.bitwise_count(s), kind="stable") for s in sides]
    x, y = (s[o] for s, o in zip(sides, order, strict=True))
    cx, cy = np.bitwise_count(x).astype(np.int16), np.bitwise_count(y).astype(np.int16)
    shift = 0 if other is None else len(fp)
    us, vs = [], []
    for i in range(0, len(x), PART):
        low, high = cx[i] - radius, cx[min(i + PART, len(x)) - 1] + radius
        begin = max(i, 0) if other is None else np.searchsorted(cy, low)
        begin = max(begin, np.searchsorted(cy, low))
        for j in range(begin, np.searchsorted(cy, high, "right"), PART):
            u, v = np.nonzero(np.bitwise_count(x[i : i + PART, None] ^ y[None, j : j + PART]) <= radius)
            us.append(order[0][u + i])
            vs.append(order[1][v + j] + shift)
    if not us:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    u, v = np.concatenate(us), np.concatenate(vs)
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(values)))
    return values[member], values[label[member]]


def links(nodes: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct `fp` of `nodes` that connect all fingerprints within the radius."""
    sets = layout(n, radius, tile)
    keys = []
    for k, bits in enumerate(sets):
        mask = sum(1 << b for b in bits)
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))))
    own = F.floor(F.bit_count("fp") / (radius + 1)).cast("int")
    spread = nodes.select("fp", own.alias("band"), F.explode(F.array(*keys)).alias("key"))
    # Tiles beyond `tile` fingerprints, which are fewer than 1 in `tile` of the rows, and how many parts each has.
    hot = cut(spread.groupBy("key", "band").agg(F.count("*").alias("n")).filter(F.col("n") > tile), "hot")
    hot = hot.select("key", "band", F.ceil(F.col("n") / tile).cast("int").alias("s"))
    below = hot.select("key", (F.col("band") + 1).alias("band"), F.col("s").alias("s_below"))
    above = hot.select("key", (F.col("band") - 1).alias("band"), F.col("s").alias("s_above"))
    parts = spread
    for other in (hot, below, above):
        parts = parts.join(other, ["key", "band"], "left")
    s = {c: F.coalesce(F.col(c), F.lit(1)) for c in ("s", "s_below", "s_above")}
    parts = parts.select("key", "band", "fp", F.pmod(F.xxhash64("fp"), s["s"]).cast("int").alias("mine"), s["s"].alias("s"), s["s_below"].alias("s_below"), s["s_above"].alias("s_above"))
    # Of each piece of work (key, band, i, j): side 0 is part i of the band; side 1 is part j of the same band, or, with j
    # below zero, part -1 - j of the next.
    within = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda k: F.struct(F.col("band").alias("band"), F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j"), (F.col("mine") > k).cast("int").alias("side")))
    upward = F.transform(F.sequence(F.lit(0), F.col("s_above") - 1), lambda k: F.struct(F.col("band").alias("band"), F.col("mine").alias("i"), (-1 - k).alias("j"), F.lit(0).alias("side")))
    downward = F.transform(F.sequence(F.lit(0), F.col("s_below") - 1), lambda k: F.struct((F.col("band") - 1).alias("band"), k.alias("i"), (-1 - F.col("mine")).alias("j"), F.lit(1).alias("side")))
    work = parts.select("key", "fp", F.explode(F.concat(within, upward, downward)).alias("w")).select("key", "w.*", "fp")
    work = work.repartition("key", "band", "i", "j").sortWithinPartitions("key", "band", "i", "j", "side")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(job: list[np.ndarray]) -> pa.RecordBatch | None:
            i, j, side, fp = job
            if len(fp) < 2:
                return None
            fp = np.ascontiguousarray(fp).view(np.uint64)
            if i[0] == j[0]:
                a, b = _stars(fp, None, radius)
            elif side[0] == side[-1]:
                return None
            else:
                a, b = _stars(fp[side == 0], fp[side == 1], radius)
            return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (a, b)], names=["a", "b"]) if len(a) else None

        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if held is not None:
                columns = [np.concatenate(p) for p in zip(held, columns, strict=True)]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:4]])) + 1
            edges = [0, *new.tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if out := compared([c[a:b] for c in columns[2:]]) if b - a > 1 else None:
                    yield out
            held = [c[edges[-1] :] for c in columns]
        if held is not None and (out := compared(held[2:])):
            yield out

    return work.mapInArrow(step, "a long, b long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, tile: int) -> DataFrame:
    """(id, fp, root, component_id) for every row of docs; root is a component's own fingerprint."""
    prints = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("times")), "nodes")
    n, rows = nodes.agg(F.count("*"), F.coalesce(F.sum("times"), F.lit(0))).first()
    roots = cut(components(links(nodes.select("fp"), n, radius, tile)), "roots")
    rooted = cut(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "times", F.coalesce("root", "fp").alias("root")), "rooted")
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")), "components")
    named = cut(joined(rooted.select("fp", "root", F.col("times").alias("copies")), least, "root", n, "members"), "named")
    done(nodes, roots, rooted, least)
    # A fingerprint that a large part of all rows has meets them by broadcast.
    return joined(prints, named, "fp", rows, "copies").select("id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs."""
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return _grouped(docs, id_col, text_col, radius, tile).select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row, with its smallest id (of several such rows, the first by text, then by the
    other columns as JSON); rows without an id stay. Where rows of one id are in several components, each row counts in its own."""
    rows = cut(_grouped(docs, "doc_id", "text", RADIUS, TILE).filter("id is not null"), "grouped")
    ids = rows.groupBy("id").agg((F.min("root") != F.max("root")).alias("mixed"), F.max(F.col("id") == F.col("component_id")).alias("first")).filter("first")
    ids = cut(ids.select("id", "mixed"), "ids")
    # Of rows whose id doesn't tell the component, the text's fingerprint does.
    mixed = ids.filter("mixed").select("id")
    told = cut(rows.filter("id = component_id").join(mixed, "id").select("id", "fp", "root").distinct(), "told")
    done(rows)

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        found = [prints(group) for _, group in text_groups(pa.array(texts, pa.string()))]
        return pd.Series(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))

    # Own columns go by number: no name of theirs can meet one of ours.
    names = {c: {"doc_id": "id", "text": "text"}.get(c, f"own{i}") for i, c in enumerate(docs.columns)}
    once = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in names.items()]).filter("id is not null").join(ids, "id")
    once = once.withColumn("fp", F.when(F.col("mixed"), print_of(F.when(F.col("mixed"), F.col("text")))))
    once = once.join(told, ["id", "fp"], "left").filter("not mixed or root is not null")
    rest = [F.col(o).alias(c) for c, o in names.items() if c not in ("doc_id", "text")]
    order = Window.partitionBy("id", "root").orderBy("text", *([F.to_json(F.struct(*rest))] if rest else []))
    once = once.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return once.select(*[F.col(o).alias(c) for c, o in names.items()]).unionByName(docs.filter("doc_id is null"))
