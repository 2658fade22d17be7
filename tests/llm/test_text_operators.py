"""Operators on texts against brute force, with nulls, repeated rows, clashing columns and empty tables."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from policyframe.llm import decontaminate, lines, pack, simhash, substrings
from tests.llm.conftest import DOCS, found, frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b).hexdigest()


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def blank(t):
    return (t or "").encode().split()


def by_windows(rows, items):
    index = {}
    for i, t in items:
        w = alnum(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else ():
            index.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, ids = alnum(t), set(), set()
        for n in {len(k) for k in index}:
            for k in range(len(w) - n + 1):
                if f := index.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= f
        out.append((i, len(w), len(hit), len(ids), sha(",".join(sorted(ids)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [4_000_000, 150])
def test_decontaminate(spark, corpus, block_words):
    full = [t for _, t in corpus if t and len(alnum(t)) > 40]
    items = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, " ".join(alnum(full[0])[:12])), (5, full[1]), (6, full[2].upper()), (7, full[1]), (10, " ".join(alnum(full[3])[5:18]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [*corpus, corpus[5]]
    got = decontaminate.decontaminate(frame(spark, rows, True), bench, block_words=block_words)
    assert found(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == by_windows(rows, items)
    none = decontaminate.decontaminate(frame(spark, rows), bench.limit(0))
    assert not [r for r in none.collect() if r["n_hit"] or r["contaminated"]]


def test_winnow_guarantees_shared_runs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(0, 50, 13).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 50, 20).astype(np.uint64), shared, rng.integers(0, 50, 20).astype(np.uint64)]) for _ in range(2))
        from policyframe.llm.shared import grams

        x, y = (grams(v, 5) for v in (a, b))
        assert set(decontaminate.winnow(x, 9).tolist()) & {*range(20, 29)}
        at = [{int(i) - 20 for i in decontaminate.winnow(v, 9) if 20 <= i < 29} for v in (x, y)]
        assert at[0] & at[1]


def test_substrings(spark, corpus):
    seen, expected = set(), []
    for i, t in corpus:
        w = blank(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected.append((i, len(w), sum(gone), sha(kept)))
    got = substrings.remove_repeats(frame(spark, corpus, True)).drop("kept")
    assert found(got) == sorted(expected, key=repr)
    twice = substrings.remove_repeats(frame(spark, [*corpus, *corpus])).drop("kept")
    assert found(twice) == sorted([*expected, *expected], key=repr)
    assert sum(e[2] > 0 for e in expected) > 40


def test_lines(spark, corpus):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in corpus if r[1] is not None])
    expected = sorted(c.execute(lines.OP6_SQL).fetchall(), key=repr)
    out = lines.dedup_lines(frame(spark, corpus, True))
    got = [(r["doc_id"], r["n_lines"], r["n_removed"], sha(r["text"].encode())) for r in out.filter("text is not null").collect()]
    assert sorted(got, key=repr) == expected
    assert sum(e[2] for e in expected) > 60
    assert out.filter("text is null").select("n_lines", "n_removed").first() == (0, 0)
    assert set(frame(spark, corpus, True).columns) | {"n_removed"} == set(out.columns)


def test_line_edits(spark):
    base = "the quick brown fox jumps over it"
    rows = [(1, base), (2, base.replace("quick", "slow")), (3, base + " again"), (4, "quick brown fox jumps over it"), (5, "over the quick brown fox jumps it"), (6, "a b c d"), (7, "a b c e"), (8, "a b a b a c"), (9, "a b a b a"), (10, base.replace("quick", "slow").replace("fox", "cat"))]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0, 8: 0, 9: 1, 10: 1}


@pytest.mark.parametrize("tile", [1024, 5])
def test_simhash(spark, corpus, tile):
    rows = [*corpus, corpus[7]]
    import xxhash

    def print_of(t):
        w = blank((t or "").translate(FOLD))
        s = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = np.array([print_of(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 4
    label = np.array([i for i, _ in rows])
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    got = simhash.near_duplicates(frame(spark, rows, True), tile=tile)
    assert found(got) == sorted(((i, f"{int(p):016x}", int(c)) for (i, _), p, c in zip(rows, prints, label, strict=True)), key=repr)
    assert len(set(label.tolist())) < len(corpus) - 30


def test_many_near_fingerprints(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    values = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in centres for _ in range(120)] + [int(v) for v in rng.integers(0, 2**63, 200, dtype=np.uint64)]
    prints = np.unique(np.array(values, np.uint64))
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 4
    label = np.arange(len(prints))
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    nodes = spark.createDataFrame([(int(p.view(np.int64)),) for p in prints], "fp long")
    from policyframe.llm.components import components

    root = {r["node"]: r["root"] for r in components(simhash.links(nodes, len(prints), tile=16)).collect()}
    groups = {}
    for p, g in zip(prints.view(np.int64).tolist(), label.tolist(), strict=True):
        groups.setdefault(g, set()).add(root.get(p, p))
    assert all(len(v) == 1 for v in groups.values())
    assert len({min(v) for v in groups.values()}) == len(groups)


def test_pack(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["It's ÀÉ don't  _x_ 12 3.4 <|endoftext|>", "Ωσ ΟΔΟΣ 你好 ́é İ ²½ \x1c\x85 a b", "ß" * 50, "a'S 'll'd #$%^ ___ 中", "word " * 5000]
    rows = [*corpus, *[(1000 + k, x) for k, x in enumerate(odd)], corpus[9]]
    expected = []
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = pack.pack(frame(spark, rows, True))
    assert found(got.select("doc_id", "piece", "start", "length", "ids_crc32")) == sorted(expected, key=repr)
    bins = {}
    for r in got.collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in bins.values():
        end = 0
        for offset, length in sorted(v):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= -(-sum(e[3] for e in expected) // 2048) + 1


def test_best_two_fit_replaces_the_smallest():
    # 6 and then 3 fit greedily and leave 1; 2 + 2 fill the widened gap of 4 whole.
    patterns = pack.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(map(sorted, (p for p, _ in patterns))) == [[2, 2, 6], [3]]
    counts = {k: 100 + k for k in range(1, 200)}
    used = {}
    for p, n in pack.best_two_fit(counts, 500):
        assert sum(p) <= 500
        for x in p:
            used[x] = used.get(x, 0) + n
    assert used == counts


def test_stages_keep_columns_and_empty_tables_work(spark, corpus, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, corpus[40][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, i % 9 == 0) for i, _ in corpus[:100]], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "CAST(toxic AS int) AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (frame(spark, corpus, True), frame(spark, corpus).limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
    empty = spark.createDataFrame([], DOCS)
    for made in (substrings.remove_repeats(empty), lines.dedup_lines(empty), simhash.near_duplicates(empty), pack.pack(empty), decontaminate.decontaminate(empty, spark.createDataFrame([], "item_id long, text string"))):
        assert made.count() == 0


def test_one_row_of_each_component(spark):
    long = lambda w: " ".join(f"{w}{k}" for k in range(60))
    rows = [(1, long("a")), (2, long("a")), (2, long("b")), (3, long("b")), (5, long("c")), (5, long("d")), (5, long("d")), (7, long("e")), (7, long("e")), (9, None), (9, long("f")), (None, long("a")), (None, long("g"))]
    got = found(simhash.one_of_each_group(spark, frame(spark, rows), "").select("doc_id", "text"))
    assert got == sorted([(1, long("a")), (2, long("b")), (5, long("c")), (5, long("d")), (7, long("e")), (9, None), (9, long("f")), (None, long("a")), (None, long("g"))], key=repr)


def test_items_without_an_id_contaminate(spark):
    passage = " ".join(f"w{k}" for k in range(15))
    bench = spark.createDataFrame([(None, passage), (None, "one"), (4, None)], "item_id long, text string")
    docs = frame(spark, [(1, f"a {passage} b"), (2, "x one"), (3, "nothing of it")])
    got = found(decontaminate.decontaminate(docs, bench).select("doc_id", "n_hit", "n_items", "items_sha256", "contaminated"))
    assert got == [(1, 15, 0, sha(b""), True), (2, 1, 0, sha(b""), True), (3, 0, 0, sha(b""), False)]
