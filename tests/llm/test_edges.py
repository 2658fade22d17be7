"""Edge cases by operator: nulls in any column, long and repetitive texts, ties, clashing names, hot keys, brute force."""

import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from policyframe.llm import decontaminate, html, lines, neighbours, pack, quality, registry, shared, simhash, substrings, toxicity, urls
from policyframe.llm.components import components
from tests.llm.conftest import frame
from tests.llm.test_text_operators import by_windows, sha
from tests.oracle import differences

CLASHES = "_id _key _lines _removed _url _at _best _first _n _fp _root u at pattern best own0 own1 id key text2 ref line bucket row rank part fold x y band side w mixed place told removed n_removed score held_out predicted leaf v slot wrapper host".split()


def clashing(df):
    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASHES if c not in df.columns})


# --- op1 ------------------------------------------------------------------------------------------------------------------
def test_repetitive_texts_match_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        letters = "abc"[: rnd.randint(1, 3)]
        make = lambda n: " ".join(rnd.choices(letters, k=n))  # noqa: E731, B023
        items = [(i, make(rnd.randint(0, 40))) for i in range(5)]
        docs = [(i, make(rnd.randint(0, 80))) for i in range(6)]
        block = decontaminate.Block([(str(i), t.encode()) for i, t in items], 13, 5)
        n, runs, found = decontaminate.find([t.encode() for _, t in docs], block)
        hit = [sum(b - a for d, a, b in runs if d == k) for k in range(len(docs))]
        got = [(i, int(n[k]), hit[k], len(found[k]), sha(",".join(sorted(found[k])).encode()), hit[k] > 0 and 20 * hit[k] >= n[k]) for k, (i, _) in enumerate(docs)]
        assert sorted(got, key=repr) == by_windows(docs, items)


def test_one_word_over_and_over_is_fast():
    began = time.perf_counter()
    block = decontaminate.Block([("1", b"a " * 10_000)], 13, 5)
    n, runs, found = decontaminate.find([b"a " * 100_000], block)
    assert (int(n[0]), runs, found) == (100_000, [(0, 0, 100_000)], [{"1"}])
    assert time.perf_counter() - began < 20


# --- op6 ------------------------------------------------------------------------------------------------------------------
def test_lines_without_ids_and_of_one_id(spark):
    for own in (None, 7):
        docs = spark.range(3000).select(F.lit(own).cast("long").alias("doc_id"), F.concat(F.lit("the quick brown fox number "), "id", F.lit(" jumps over it\nown line of "), "id").alias("text"))
        out = lines.dedup_lines(clashing(docs))
        assert out.agg(F.sum("n_removed")).first()[0] == 2999
        first = out.select("_id", "_key", "_lines", "_removed", "removed").first()
        assert tuple(first) == ("mine _id", "mine _key", "mine _lines", "mine _removed", "mine removed")


def test_lines_in_another_order_are_no_near_lines(spark):
    rnd = random.Random(1)
    cells = [f"c{k}" for k in range(9)]
    rows = [(i, " | ".join(["|", *rnd.sample(cells, 9), "|"])) for i in range(400)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    expected = {i: n for i, _, n, _ in c.execute(lines.OP6_SQL).fetchall()}
    assert {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(frame(spark, rows)).collect()} == expected
    # Their keys differ as well: no line is looked at again for each line of its key.
    words = spark.createDataFrame([(k, t.split(), len(t.split())) for k, t in enumerate(sorted({t for _, t in rows}))], "ref long, words array<string>, n int")
    most = lines._neighbourhood(words).groupBy("variant").count().agg(F.max("count")).first()[0]
    assert most <= 12


def test_edits_bound(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e g"), (3, "a b c d e f")]
    none = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(frame(spark, rows), edits=0).collect()}
    assert none == {1: 0, 2: 0, 3: 1}
    with pytest.raises(ValueError):
        lines.dedup_lines(frame(spark, rows), edits=2)


# --- op7 ------------------------------------------------------------------------------------------------------------------
def test_urls_with_clashing_columns_nulls_and_a_hot_domain(spark):
    day = lambda c: F.expr(f"timestamp'2024-01-01 00:00:00' + make_dt_interval({c})")
    captures = spark.range(3000).select(F.concat(F.lit("http://h"), F.col("id") % 700, F.lit(".org/p/"), "id").alias("url"), day("id % 10").alias("fetched_at"))
    captures = clashing(captures.unionByName(spark.createDataFrame([(None, None), ("http://h1.org", None)], "url string, fetched_at timestamp")))
    events = spark.range(1).select(F.lit("org").alias("pattern"), F.lit(None).cast("string").alias("category"), F.lit("add").alias("action"), day("3").alias("effective_at"))
    out = urls.filter_urls(captures, events.unionByName(spark.createDataFrame([(None, None, None, None)], "pattern string, category string, action string, effective_at timestamp")))
    assert out.filter("blocked").count() == 2100 and out.count() == 3002
    assert out.filter("blocked and entry = 'org' and category is null").count() == 2100
    assert tuple(out.select("_url", "_at", "_best", "u", "pattern").first()) == ("mine _url", "mine _at", "mine _best", "mine u", "mine pattern")
    assert urls.filter_urls(captures.limit(0), events).count() == 0
    assert urls.filter_urls(captures, events.limit(0)).filter("blocked").count() == 0


def test_very_long_urls(spark):
    captures = spark.createDataFrame([("http://a.org/" + "x/" * 40_000, "2024-01-05"), ("http://" + "s." * 40_000 + "a.org/x/y", "2024-01-05"), ("http://a.org/" + "z" * 300_000, "2024-01-05"), ("http://b.org/p", None)], "url string, day string")
    captures = captures.withColumn("fetched_at", F.to_timestamp("day"))
    events = spark.createDataFrame([("a.org/x/x", "c", "add", "2024-01-01"), ("s.s.a.org", "d", "add", "2024-01-01")], "pattern string, category string, action string, day string").withColumn("effective_at", F.to_timestamp("day"))
    assert [r["entry"] for r in urls.filter_urls(captures, events).orderBy(F.length("url")).collect()] == [None, "a.org/x/x", "s.s.a.org", None]


# --- op8 ------------------------------------------------------------------------------------------------------------------
def _stream(node):
    out, text = [], False
    for x in node.items:
        if isinstance(x, str) and x.strip() and not text:
            out.append("#;")
        if isinstance(x, html.Node):
            out.append(f"<{x.label}>;{_stream(x)}</{x.label}>;")
        text = (text or isinstance(x, str) and bool(x.strip())) and not isinstance(x, html.Node)
    return "".join(out)


def _expression(w, top=True):
    label, optional, repeated, children = w
    inner = "".join(_expression(c, False) for c in children)
    if top:
        return inner
    body = "#;" if label == "#" else inner if label[0] == "(" else re.escape(f"<{label}>;") + inner + re.escape(f"</{label}>;")
    return f"(?:{body})" + {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[optional, repeated]


def test_wrappers_as_regular_expressions_match_all_their_pages():
    rnd = random.Random(5)

    def page(depth=0):
        out = []
        for _ in range(rnd.randint(0, 6)):
            kind = rnd.random()
            if kind < 0.3:
                out.append("t ")
            elif kind < 0.5:
                out.append("<h2>a</h2><p>b</p>" * rnd.randint(1, 3))
            elif depth < 3:
                t = rnd.choice(["div", "section", "div class=a", "ul"])
                out.append(f"<{t}>{page(depth + 1)}</{t.split()[0]}>")
            else:
                out.append("<hr>")
        return "".join(out)

    for _ in range(150):
        roots = [html.parse(page()) for _ in range(rnd.randint(1, 6))]
        w = None
        for root in roots:
            own = html.wrapper_of(root)
            assert html.flat(html.unflat(html.flat(own))) == html.flat(own)
            w = own if w is None else html.merged(w, own)
        reading = html.Reading(html.flat(w))
        for root in roots:
            assert re.fullmatch(_expression(w), _stream(root))
            reading.start()
            stack = [(root, 0)]
            while stack:  # every token has its node
                node, k = stack.pop()
                at = (0, 0)
                for x in node.items:
                    if isinstance(x, html.Node) or isinstance(x, str) and x.strip():
                        c, at = reading.next(k, at, x)
                        assert c >= 0
                        if isinstance(x, html.Node):
                            stack.append((x, c))


def test_several_nodes_fold_into_a_repeated_group():
    w = html.wrapper_of(html.parse("<div><h1>t</h1>" + "<h2>a</h2><p>b</p>" * 2000 + "</div>"))
    (div,) = w[3]
    assert [(c[0], c[2]) for c in div[3]] == [("h1", 0), ("(h2 p)", 1)]
    once = html.wrapper_of(html.parse("<div><h1>t</h1><h2>a</h2><p>b</p><hr></div>"))
    (div,) = html.merged(w, once)[3]
    assert [(c[0], c[1], c[2]) for c in div[3]] == [("h1", 0, 0), ("(h2 p)", 0, 1), ("hr", 1, 0)]


@pytest.mark.parametrize("page", ["<a " * 100_000, "<a " * 100_000 + ">", '<a ">"' * 50_000, "<center>" * 30_000 + "</dl>" * 30_000, "<p><td>" + "<center>" * 30_000, "<title>" * 50_000, "a < b " * 50_000, "<!--" * 50_000])
def test_odd_pages_parse_in_linear_time(page):
    began = time.perf_counter()
    html.wrapper_of(html.parse(page))
    assert time.perf_counter() - began < 10


def test_wrappers_stay_bounded(spark):
    # Each page brings names of its own.
    name = lambda i, k: "".join(random.Random(1000 * i + k).choices("abcdefghijkl", k=6))
    page = lambda i: "<body><div class=menu>Menu</div>" + "".join(f"<div class={name(i, k)}><p>Text {i} of {k} that is long enough to be read</p></div>" for k in range(300)) + "</body>"
    w = None
    for i in range(40):
        own = html.wrapper_of(html.parse(page(i)))
        w = own if w is None else html.merged(w, own)
        assert html._size(w) <= html._MOST
    df = spark.createDataFrame([(i, "http://h.org/", page(i)) for i in range(40)], "page_id long, url string, html string")
    for r in html.extract_main(df).collect():
        assert r["text"] == "\n".join(f"Text {r['page_id']} of {k} that is long enough to be read" for k in range(300))


def test_inline_elements_on_the_lists_end_where_they_end():
    page = "<article><p>One <b class=ad>buy</b> two <span class=share><span>x</span> y</span> three</p></article>"
    assert html.extract(page, None) == "One two three"


def test_pages_with_nulls_and_clashing_columns(spark):
    df = clashing(spark.createDataFrame([(None, None, None), (None, "http://a.org", "<p>x</p>"), (1, None, "<p>y</p>"), (1, "::", "")], "page_id long, url string, html string"))
    assert sorted(r["text"] for r in html.extract_main(df).collect()) == ["", "", "x", "y"]


# --- op3 ------------------------------------------------------------------------------------------------------------------
def test_isotonic_pools_equal_values_whatever_their_order():
    for y in ([0, 1], [1, 0]):
        a, b = quality.isotonic(np.array([1.0, 1.0]), np.array(y, float))
        assert (a.tolist(), b.tolist()) == ([1.0], [0.5])
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 20, 300).astype(float), rng.integers(0, 2, 300).astype(float)
    first = quality.isotonic(x, y)
    for _ in range(5):
        p = rng.permutation(300)
        assert all((u == v).all() for u, v in zip(first, quality.isotonic(x[p], y[p]), strict=True))
    # Against brute force: the best non-decreasing fit is max over starts of min over ends of the means.
    values = np.unique(x)
    best = [max(min(y[(x >= s) & (x <= e)].mean() for e in values[values >= v]) for s in values[values <= v]) for v in values]
    fit = {}
    for v in values:
        k = np.searchsorted(first[0], v, "left")
        fit[v] = min(((abs(b - t), b) for b in first[1] for t in [best[values.tolist().index(v)]]), key=lambda z: z[0])[1] if k >= 0 else None
    assert np.allclose([fit[v] for v in values], best)


def _labelled(spark, n=400):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(["good", "fine", "word", "text"] if i % 3 else ["BAD!!", "##", "99", "word"], k=rnd.randint(1, 60)))) for i in range(n)]
    return rows, spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_depend_on_rows_alone(spark, module):
    rows, labels = _labelled(spark)
    repeated = rows + [rows[1]] * 500 + [(None, "x"), (None, None), (5, None), (5, "z " * 30_000)]
    docs = clashing(frame(spark, repeated).drop("n_chars"))
    a = module.score(docs, module.train(docs, labels)).collect()
    shuffled = docs.orderBy(F.rand(3)).repartition(7)
    b = module.score(shuffled, module.train(shuffled.coalesce(3), labels)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(a, key=key) == sorted(b, key=key) and len(a) == len(repeated)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_bounds_hold_for_rows_of_one_id(spark, module):
    from policyframe.llm.labelled import bounded

    many = spark.range(5000).select(F.lit(3).cast("long").alias("id"), F.concat(F.lit("text "), F.col("id") % 4000).alias("text"))
    kept = bounded(many, 500, 1)
    assert 250 < kept.count() < 650 and kept.distinct().count() == kept.count()
    assert bounded(many, 10_000, 1).count() == 4000


def test_ridge_equals_the_closed_form(spark):
    """Partition-summed normal equations against numpy on all rows at once."""
    rows, labels = _labelled(spark, 300)
    docs = frame(spark, rows)
    model = quality.train(docs, labels, n_fourier=16)
    import zlib

    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = [(t, int(i % 3 > 0), fold(i)) for i, t in rows if fold(i)]
    x = quality.statistics([t.encode() for t, _, _ in known])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.deviation, np.maximum(x.std(axis=0), 1e-6))
    some = np.array([f != quality.CALIBRATION_FOLD for _, _, f in known])
    z, y = model.fourier(x[some]).astype(float), np.array([v for _, v, _ in known], float)[some]
    a = z.T @ z + quality.RIDGE * len(known) * np.eye(17) / 17
    assert np.allclose(model.weights, np.linalg.solve(a, z.T @ y), atol=1e-6)


def test_risk_gradient_equals_differences():
    """One step of the fit goes along the numerical gradient of the non-negative risk."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 3))
    positive = np.arange(400) < 120
    x[positive] += 1.0
    prior = 0.3

    def risk(w):
        s = 1 / (1 + np.exp(-(np.c_[x, np.ones(400)] @ w)))
        return prior * (1 - s[positive]).mean() + max(0.0, s[~positive].mean() - prior * s[positive].mean())

    start = np.array([1, 1, 1, np.log(prior / (1 - prior))])
    w, b = toxicity.fit_nnpu(x, positive, prior)
    end = np.array([*w, b])
    assert risk(end) < risk(start)
    slope = np.array([(risk(end + d) - risk(end - d)) / 2e-5 for d in 1e-5 * np.eye(4)])
    assert np.abs(slope).max() < 0.02
    for d in 0.3 * np.vstack([np.eye(4), -np.eye(4)]):
        assert risk(end + d) > risk(end) - 5e-3


# --- op4 ------------------------------------------------------------------------------------------------------------------
def test_distances_beyond_the_range_of_squares(spark):
    rng = np.random.default_rng(6)
    for factor in (1e200, 1e-200):
        x = rng.normal(0, 1, (250, 6))
        df = spark.createDataFrame([(i, (v * factor).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in neighbours.neighbours(df, F.col("id") % 100 == 0, leaf=300).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        for q, rows in got.items():
            d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            d[q] = np.inf
            assert [v for _, v, _ in sorted(rows)] == np.argsort(d, kind="stable")[:10].tolist()
            assert np.allclose([s / factor for _, _, s in sorted(rows)], np.sort(d)[:10])


def test_neighbours_with_null_ids_and_small_parts(spark):
    rng = np.random.default_rng(7)
    rows = [(i if i % 7 else None, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 4)))]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    a, b = (sorted(map(tuple, neighbours.neighbours(df, F.col("id") % 100 == 0, part=n, leaf=300).collect())) for n in (4096, 16))
    assert a == b and len(a) == 20


# --- op5, op9, op10: hot keys -----------------------------------------------------------------------------------------------
def _hot(n, third):
    """n documents, a third of which hold `third`."""
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(500)]
    return [(i, third if i % 3 == 0 else " ".join(rnd.choices(words, k=40))) for i in range(n)]


def test_a_passage_in_a_third_of_all_documents_is_one_fragment_a_batch(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"{passage} end{i}" if i % 3 == 0 else f"own{i} " * 45) for i in range(3000)]
    texts = frame(spark, rows).select("doc_id", "text").coalesce(1).select(F.xxhash64("text").alias("key"), "text")
    sizes = substrings._probes(texts, 10, 8).filter("bucket >= 0").agg(F.max(F.length("probes") / 4 + F.length("blocks") / 4), F.sum(F.length("probes") / 4 + F.length("blocks") / 4)).first()
    # Some 3,000 distinct fragments at most a batch, whatever repeats; 50,000 words of the passage otherwise.
    assert sizes[1] < 12_000
    seen, expected = set(), {}
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        expected[i] = sum(gone)
    assert {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(frame(spark, rows)).collect()} == expected


def test_hot_fingerprints_and_stars(spark):
    rows = _hot(3000, "the same text in a third of all the documents")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert len({got[i] for i in range(0, 3000, 3)}) == 1 and got[0][1] == 0
    star = spark.range(1, 4000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(5000, 5001), (None, 1)], "a long, b long"))
    found = {r["node"]: r["root"] for r in components(star).collect()}
    assert found == {**dict.fromkeys(range(4000), 0), 5000: 5000, 5001: 5000}


def test_joined_is_a_join(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    one = rows.groupBy("k").agg(F.max("id").alias("m"), F.count("*").alias("times")).filter("k % 5 < 4")
    a = sorted(map(tuple, shared.joined(rows, one, "k", 5000).select("k", "id", "m").collect()))
    assert a == sorted(map(tuple, rows.join(one, "k").select("k", "id", "m").collect()))


def test_pieces_that_are_alike_spread(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    cuts = pack.pieces(docs, "doc_id", "text", 2048, None).withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32", "row"), F.lit(64)))
    assert cuts.groupBy("bucket").count().agg(F.max("count")).first()[0] < 300
    out = pack.pack(docs)
    assert out.count() == 4000 and out.select("sequence_id").distinct().count() == 2
    assert out.select("sequence_id", "offset").distinct().count() == 4000


def test_places_of_patterns_depend_on_the_capacity_alone():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.clip(rng.lognormal(5, 1.2, 300_000).astype(int), 1, 2048), minlength=2049)
    few, many = (sum(map(len, pack._places(pack.best_two_fit({k: int(v) * times for k, v in enumerate(counts) if v}, 2048)).values())) for times in (1, 100_000))
    assert many < 2 * few < 40_000


# --- the pipeline -----------------------------------------------------------------------------------------------------------
def test_stages_with_clashing_and_odd_columns(spark, tmp_path):
    import corpus_pipeline

    long = lambda w: " ".join(f"{w}{k}" for k in range(60))
    rows = [(1, long("a")), (2, long("a")), (3, None), (4, ""), (None, long("b")), (None, None), (5, long("c") + "\n" + long("a")), (5, long("c") + "\n" + long("a"))]
    docs = clashing(frame(spark, rows)).withColumns({"map": F.create_map(F.lit("a"), F.lit(1)), "list": F.array(F.struct(F.lit(1).alias("z")))})
    spark.createDataFrame([(1, long("zz"))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names, name
        for r in out.select("_id", "_first", "_n", "map", "n_removed").collect():
            assert tuple(r) == ("mine _id", "mine _first", "mine _n", {"a": 1}, "mine n_removed"), name


def test_run_equals_its_stages_by_brute_force(spark, tmp_path):
    """The whole run on a small corpus: what stays, by rules in plain Python."""
    import corpus_pipeline

    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(900)]
    text = lambda n: " ".join(rnd.choices(words, k=n))
    item = text(40)
    toxic = [(i, text(50) + " zzvile zzbad zzmean zzvile zzbad zzmean zzvile") for i in range(1000, 1120)]
    clean = [(i, text(60)) for i in range(200)]
    copies = [(500 + i, t) for i, t in clean[:30]]
    with_item = [(700 + i, f"{text(20)} {item} {text(10)}") for i in range(20)]
    shared_line = "this line stands in many of the documents here"
    lined = [(800 + i, f"{text(30)}\n{shared_line}\n{text(30)}") for i in range(20)]
    rows = toxic + clean + copies + with_item + lined
    rnd.shuffle(rows)
    path = str(tmp_path)
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in toxic + clean], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    out = corpus_pipeline.run(spark, path)
    kept = {r["doc_id"] for r in out.collect()}
    # An exact copy loses its lines and is then an empty document, of which one stays: the one with the smallest id.
    assert kept == {i for i, _ in clean} | {500} | {i for i, _ in lined}
    ends = {r["doc_id"]: r["length"] for r in out.collect()}
    assert ends[500] == 1


def test_places_of_lines_tell_what_they_are_made_of(spark):
    rows = [(i, k, n) for i in (None, 0, -5, 2**63 - 1, -(2**63)) for k in (-1, 7, 2**62 + 5) for n in (0, 255, 256, 70_000, 2**24, 2**31 - 2)]
    df = spark.createDataFrame(rows, "own long, key long, line int").select(lines._id("own", "key").alias("id"), "key", "line")
    out = df.withColumn("ref", lines._ref()).select("id", "key", "line", "ref", F.struct(*lines._place("ref")).alias("p")).collect()
    assert all((r["p"]["id"], r["p"]["line"], r["p"]["last"]) == (r["id"], r["line"], r["key"] & lines._LAST) for r in out)
    assert len({r["ref"] for r in out}) == len(rows)
    assert [r["ref"] for r in sorted(out, key=lambda r: (r["id"], r["line"], r["ref"]))] == sorted(r["ref"] for r in out)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    assert differences(registry.queries()[name](spark, sf_dir), sf_dir, registry.oracle_sql()[name]) is None


# --- very long texts, nulls, ties and repeated rows in all operators on texts --------------------------------------------------
def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    edited = long.replace("w30000 ", "other ")
    many = "\n".join(f"line {k} of a text with so many lines" for k in range(30_000))
    docs = frame(spark, [(1, long), (2, edited), (3, many), (4, many)])
    gone = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(docs).collect()}
    # All lines of a text but the first are one edit from it; the copy loses all.
    assert gone == {1: 0, 2: 1, 3: 29_999, 4: 30_000}
    cutoff = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(docs).collect()}
    assert cutoff[1] == 0 and cutoff[2] == 60_000 - 1 and cutoff[4] == 30_000 * 9
    prints = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert prints == {1: 1, 2: 1, 3: 3, 4: 3}
    found = decontaminate.decontaminate(docs, spark.createDataFrame([(1, long)], "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in found} == {1: (60_000, 60_000), 2: (60_000, 59_999), 3: (270_000, 0), 4: (270_000, 0)}
    out = pack.pack(docs.filter("doc_id < 3")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("m")).collect()
    assert len(out) == 2 and all(r["n"] > 60_000 and r["m"] == 2048 for r in out)


def test_null_ids_and_texts_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, None), (None, None), (None, text), (None, text), (None, text + " more"), (1, None), (1, text), (1, text), (1, ""), (2, " \n ")]
    docs = clashing(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    bench = spark.createDataFrame([(None, None), (None, text), (7, ""), (8, text)], "item_id long, text string")
    found = decontaminate.decontaminate(docs, bench).collect()
    assert len(found) == len(rows) and sum(r["contaminated"] for r in found) == 5 and all(r["n_items"] == r["contaminated"] for r in found)
    kept = substrings.remove_repeats(docs).collect()
    # Ids that are there come before those that are not; rows that repeat an id and text are one document.
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in kept) == sorted([(0, 0, 0)] * 2 + [(0, 40, 40)] * 2 + [(0, 41, 40), (1, 0, 0), (1, 40, 0), (1, 40, 0), (1, 0, 0), (2, 0, 0)])
    gone = lines.dedup_lines(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in gone) == sorted([(0, 0)] * 2 + [(0, 1)] * 3 + [(1, 0)] * 4 + [(2, 0)])
    near = simhash.near_duplicates(docs).collect()
    assert len(near) == len(rows) and {r["component_id"] for r in near if r["fingerprint"] == "0" * 16} == {1}
    assert {r["component_id"] for r in near} == {1}
    packed = pack.pack(docs).collect()
    assert len(packed) == len(rows) and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(rows)
    for module in (toxicity, quality):
        labels = spark.createDataFrame([(None, None, None), (1, 1, 1), (1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
        assert module.score(docs, module.train(docs, labels)).count() == len(rows)
