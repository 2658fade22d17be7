"""Classifiers by held-out accuracy, neighbours and URLs by brute force, pages by hand."""

import datetime
import math
import random
import zlib

import numpy as np
import pytest

from policyframe.llm import html, neighbours, quality, toxicity, urls
from policyframe.llm.toxicity import fit_nnpu
from tests.llm.conftest import DOCS


def labelled(spark, n=600):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefg", k=4)) for _ in range(400)]
    docs, labels = [(-1, None), (-2, ""), (-2, "")], []
    for i in range(n):
        w = rnd.choices(words, k=rnd.randint(20, 120))
        toxic, good = i % 6 == 0, i % 4 != 0
        if toxic:
            for _ in range(max(3, len(w) // 15)):
                w.insert(rnd.randrange(len(w)), rnd.choice(["zzbad", "ZZvile", "zzmean"]))
        text = " ".join(w)
        docs.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "cut"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_held_out_accuracy(spark, module, label, cut):
    docs, labels = labelled(spark)
    out = module.score(docs, module.train(docs, labels)).collect()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert len(out) == 603
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] >= 0]
    assert len(held) > 80 and sum(p == y for p, y in held) >= 0.95 * len(held)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_documents(spark, module):
    docs, labels = labelled(spark, 30)
    for d, l in ((docs, labels.limit(0)), (docs.limit(0), labels), (docs.limit(0), labels.limit(0))):
        assert module.score(d, module.train(d, l)).count() == d.count()


def test_nnpu_finds_toxic_among_unlabelled():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.2
    x = rng.normal(0, 1, (3000, 5)) + 2.0 * y[:, None]
    known = np.flatnonzero(y)[:150]
    both = np.concatenate([x[known], x])
    w, b = fit_nnpu(both, np.arange(len(both)) < len(known), 0.2)
    assert ((x @ w + b > 0) == y).mean() > 0.95


def test_isotonic_is_monotone_and_fits():
    rng = np.random.default_rng(2)
    x = rng.random(500)
    a, b = quality.isotonic(x, (rng.random(500) < x).astype(float))
    assert (np.diff(a) > 0).all() and (np.diff(b) > 0).all() and abs(np.interp(0.5, a, b) - 0.5) < 0.15


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 12)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2100, [0.0] * 12), (2200, [float("nan")] * 12), (2300, [1.0] * 3), (2400, [None] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    got = {}
    for r in neighbours.neighbours(df.withColumns({"id": F.lit(1), "leaf": F.lit(2)}), F.col("id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(900), d))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(math.isclose(s, d[v], abs_tol=1e-12) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(true.tolist()))
        if q in (100, 200, 300):
            assert [v for _, v, _ in found] == true.tolist()
    assert hit >= 81
    few = neighbours.neighbours(df.filter("vec_id in (0, 1, 2, 3)"), F.col("id") % 100 == 0)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] and few.count() == 3
    assert neighbours.neighbours(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_urls(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    events = spark.createDataFrame([("bad.org", "x", "add", day(3)), ("bad.org", "x", "remove", day(5)), ("bad.org", "x", "add", day(7)), ("ok.org/p", "y", "add", day(1)), ("tie.org", "z", "add", day(2)), ("tie.org", "z", "remove", day(2)), (None, "x", "add", day(1)), ("org", "w", "odd", day(1))], "pattern string, category string, action string, effective_at timestamp")
    rows = [("http://Bad.org/1", 2, None), ("http://a.bad.org:80/1", 3, "bad.org"), ("http://bad.org", 4, "bad.org"), ("http://bad.org", 5, None), ("https://u@bad.org?x", 9, "bad.org"), ("http://notbad.org/", 4, None), ("http://ok.org/p/q", 2, "ok.org/p"), ("http://ok.org/pq", 2, None), ("http://tie.org/", 3, None), (None, 3, None), ("nonsense", 3, None), ("http://bad.org", 4, "bad.org")]
    captures = spark.createDataFrame([(u, day(d), e, "own") for u, d, e in rows], "url string, fetched_at timestamp, expected string, pattern string")
    out = urls.filter_urls(captures, events).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["entry"], r["blocked"]) == (r["expected"], r["expected"] is not None), r
        assert r["pattern"] == "own"


PAGE = """<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a><li><a href=/b>B</a></ul></nav>
<!-- c --><div class="ad">Buy</div><article><h1>{0} &amp; more</h1><p><b>First&nbsp; {0}<br>and so on<p>Second {0}</p><aside>side</aside><form>f</form></article><section id="comments"><article><p>reader says</p></article></section><footer>&copy;</footer>"""
PLAIN = """<html><body><div id="header"><a href="/">Home</a></div><div class="menu"><a href="/1">one</a></div><div id="wrap"><div class="content"><h2>{0}</h2><p>Text of {0} that goes on for a while, long enough.</p><p>Fixed words.</p></div><div class="sidebar">Side {0}</div></div><div class="cookie-notice">We use cookies</div></body></html>"""


def test_pages(spark):
    names = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, f"http://a.org/{i}", PAGE.format(n)) for i, n in enumerate(names)] + [(10 + i, f"http://b.org/{i}", PLAIN.format(n)) for i, n in enumerate(names)]
    rows += [(20, None, None), (21, "http://a.org/x", ""), (22, "http://a.org/1", rows[1][2]), (23, "odd", "<p>a<p>b &lt; c"), (24, "http://a.org/y", "<article><p>cut off & ended")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract_main(df).collect()}
    assert len(got) == len(rows)
    for i, n in enumerate(names):
        assert got[i][0] == f"{n} & more\nFirst {n} and so on\nSecond {n}"
        assert got[10 + i][0] == f"{n}\nText of {n} that goes on for a while, long enough.\nFixed words."
    assert got[20] == got[21] == ("", 0) and got[22] == got[1]
    assert got[23][0] == "a\nb < c" and got[24][0] == "cut off & ended"
    assert all(len(t) == n for t, n in got.values())
    assert html.extract_main(df.limit(0)).count() == 0


def test_wrappers_align():
    a, b = (html.wrapper_of(html.parse(p)) for p in ("<div><p>x</p><p>y</p><hr></div>", "<div><h1>t</h1><p>z</p></div>"))
    w = html.aligned(a, b)
    (div,) = w[3]
    assert [(c[0], c[1], c[2]) for c in div[3]] == [("h1", 1, 0), ("p", 0, 1), ("hr", 1, 0)]
    assert html.aligned(w, a) == w and html.aligned(w, b) == w


def texts_of(spark, *pages):
    df = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in html.extract_main(df).orderBy("page_id").collect()]


def test_pages_are_read_against_the_aligned_wrapper(spark):
    names = ["alpha", "beta", "gamma", "delta"]
    # The marked element is a teaser: the text that varies is elsewhere.
    teaser = "<body><article><p>See {0}</p></article><div class=body><h2>{0}</h2><p>Of {0} there is a lot to be said, and all of it is said here, at length and in {0} words.</p></div></body>"
    assert texts_of(spark, *[teaser.format(n) for n in names]) == [f"{n}\nOf {n} there is a lot to be said, and all of it is said here, at length and in {n} words." for n in names]
    # Of two groups of one label, the place in the wrapper tells which is the main one; optional groups are passed over.
    twice = "<body><div><b>{0}</b></div>{1}<hr><div><h2>{0}</h2><p>Of {0} there is a lot to be said, and all of it is said here, at length and in {0} words.</p></div></body>"
    found = texts_of(spark, *[twice.format(n, "<section>new</section>" * (k % 2)) for k, n in enumerate(names)])
    assert found == [f"{n}\nOf {n} there is a lot to be said, and all of it is said here, at length and in {n} words." for n in names]
    # Both kinds of fixed and varying slots of an article stay, whatever its host's other pages lack.
    marked = "<body><div>{0}</div><article><p>{0}</p>{1}<p>Fixed</p></article></body>"
    assert texts_of(spark, *[marked.format(n, "<hr><p>More</p>" * (k % 2)) for k, n in enumerate(names)]) == [f"{n}\n" + "More\n" * (k % 2) + "Fixed" for k, n in enumerate(names)]


def test_words_do_not_leave_the_article_out(spark):
    article = "<div class=menu>Menu</div><{1}><h1>{0}</h1><p>Of {0} there is a lot to be said, and all of it is said here.</p><div class=share>Share {0}</div></{2}><div class=sidebar>Side {0}</div>"
    names = ["alpha", "beta", "gamma"]
    expected = [f"{n}\nOf {n} there is a lot to be said, and all of it is said here." for n in names]
    for around, tag in [
        ("<body class='page has-sidebar'>", "article"),
        ("<body class='page has-sidebar'>", "div class=text"),
        ("<body class='cookie-banner-open'>", "div class=text"),
        ("<body>", "article class=social-story"),
        ("<body><div class='content with-sidebar'>", "article"),
        ("<body><div class='content with-sidebar'>", "div class=text"),
        ("<body><div class='page cookie-banner-open'>", "article"),
        ("<body><div class='page cookie-banner-open'>", "div class=text"),
        ("<body><form id=aspnetForm>", "article"),
    ]:
        assert texts_of(spark, *[f"<html>{around}{article.format(n, tag, tag.split()[0])}" for n in names]) == expected, (around, tag)
    # Comments stay out, even if they are marked as articles; so do teasers.
    page = "<body><div class=text><h1>{0}</h1><p>Of {0} there is a lot to be said, and all of it is said here.</p></div><section id=comments><article>{0}? No.</article><article>Yes.</article></section>"
    assert texts_of(spark, *[page.format(n) for n in names]) == expected
    page = "<body><article class=related>See {0}</article><hr><article><h1>{0}</h1><p>Of {0} there is a lot to be said, and all of it is said here.</p></article>"
    assert texts_of(spark, *[page.format(n) for n in names]) == expected
    # A page with nothing else has no main part.
    assert texts_of(spark, *["<body><div class=ad><p>Buy {0}</p></div><footer>By {0}</footer>".format(n) for n in names]) == [""] * 3


def test_pages_of_any_depth(spark):
    for depth in (70, 3000):
        page = "<body><div class=tagline>Of {0} and so on</div>" + "<div>" * depth + "<article><h1>{0}</h1><p>Of {0}<p>End</article>"
        assert texts_of(spark, *[page.format(n) for n in ("alpha", "beta")]) == [f"{n}\nOf {n}\nEnd" for n in ("alpha", "beta")]
    a, b = (html.wrapper_of(html.parse("<div>" * 5000 + x)) for x in ("<p>x</p>", "<hr>"))
    assert html.flat(html.unflat(html.flat(a))) == html.flat(a) and len(html.flat(html.aligned(a, b))) > 5000


def test_features_are_chosen_over_all_documents(spark):
    # Words of all toxic texts and of about half of the others: counts alone tell which are in over half of all.
    rnd = random.Random(5)
    words = [f"{chr(97 + k)}zq" for k in range(20)]
    rows = [(i, " ".join(words if i < 40 else [w for w in words if rnd.random() < 0.43] or ["x"]), "en", "s", 0) for i in range(600)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 0, int(i < 40)) for i in range(80)], "doc_id long, quality int, toxic int")
    full, few = (toxicity.train(docs, labels, unlabelled=n).hashes.tolist() for n in (10_000, 60))
    assert full and full == few
