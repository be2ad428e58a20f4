import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from climekin.llm.scratch import stage
from climekin.llm import html_extract, mixing, packing, quality, queries, topk_search
from tests.llm.common import DATA, DOCS, EDGE, HAVE_DATA, LONG, frame
from tests.llm.test_dedup import brute


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Water-filling by plain repetition."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: cap * sizes[s] for s in over})


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    r = np.random.default_rng(seed)
    names = ["b", "a", None, "é", "Z", "zero"]
    rows = [(i, None if r.random() < 0.05 else "w " * int(r.integers(0, 200)) if s != "zero" else "", [s]) for i, s in enumerate(r.choice(names, 600, p=[0.5, 0.3, 0.1, 0.05, 0.03, 0.02]).tolist())]
    docs = spark.createDataFrame([(i, t, "en", s[0], 0) for i, t, s in rows], DOCS).selectExpr("*", "1 AS size", "2 AS h", "3 AS target")
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s[0] for i, _, s in rows}
    sizes = {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    want = fill(sizes)
    taken = {}
    for x in got:
        s = source[x["doc_id"]]
        assert (x["size"], x["source_size"]) == (size[x["doc_id"]], sizes[s]) and x["target"] == pytest.approx(want[s])
        assert x["taken"] <= 3 * x["size"]
        taken[s] = taken.get(s, 0) + x["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 200
    again = {x["doc_id"]: x["taken"] for x in mixing.mix_report(docs).collect()}
    assert again == {x["doc_id"]: x["taken"] for x in got}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(times.get(i, 0) * size[i] == again[i] for i in size)


def test_mixing_edges(spark):
    assert mixing.mix_report(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix_report(frame(spark, EDGE)).count() == len(EDGE)
    assert [r["taken"] for r in mixing.mix_report(frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_topk(spark):
    r = np.random.default_rng(0)
    v = [(i, r.normal(0, 1, 8).round(2).tolist()) for i in range(400)]
    v += [(i, [0.5] * 8) for i in range(400, 700)]  # a hot vector: ties
    v += [(700, None), (701, [1.0] * 7 + [float("nan")]), (702, [None] + [1.0] * 7), (703, [float("inf")] * 8), (704, [1.0, 2.0]), (706, [1.0, 1.0]), (750, [2.0, 0.0]), (None, [1.0] * 8), (750, [2.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").selectExpr("*", "1 AS k", "2 AS shard")
    got = topk_search.search(df.withColumn("vector", topk_search.integers(df["embedding"])), df["vec_id"] % 50 == 0)
    have = {}
    for x in got.collect():
        have.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    points = [(i, np.floor(256 * np.array(e, np.float32).astype(float)).astype(np.int64)) for i, e in v if i is not None and e is not None and all(y is not None and np.isfinite(y) for y in e)]
    want = {}
    for i, q in points:
        if i % 50 == 0 and i not in want:
            best = sorted((-int(q @ p), j) for j, p in points if j != i and len(p) == len(q))[:5]
            want[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert {i: sorted(x) for i, x in have.items()} == {i: x for i, x in want.items() if x}


def test_topk_blocks_and_shards(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = [(i, r.integers(-300, 300, 6).tolist()) for i in range(500)]
    df = spark.createDataFrame(v, "vec_id long, vector array<long>")
    a = sorted(topk_search.search(df, df["vec_id"] % 5 == 0).collect())
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 60)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 20)
    assert sorted(topk_search.search(df, df["vec_id"] % 5 == 0).collect()) == a
    assert topk_search.search(df.limit(0), df["vec_id"] % 5 == 0).count() == 0


def test_trees_are_built_once_for_all_blocks(spark, monkeypatch):
    labels = []
    stage = topk_search.Tables.stage
    monkeypatch.setattr(topk_search.Tables, "stage", lambda self, df, label: (labels.append(label), stage(self, df, label))[1])
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 5)
    df = spark.createDataFrame([(i, [i, -i]) for i in range(40)], "vec_id long, vector array<long>")
    assert topk_search.search(df, df["vec_id"] % 2 == 0).count() == 100
    assert labels.count("topk-trees") == 1


def test_topk_of_large_numbers(spark):
    """Scores past 64 bits rank by their true value and are given as the nearest 64-bit number."""
    top = 2**63 - 1
    df = spark.createDataFrame([(0, [top, top]), (1, [top, top]), (2, [top, 1]), (3, [-top, 0]), (4, [1, 0])], "vec_id long, vector array<long>")
    got = [(r["vec_id"], r["score"]) for r in topk_search.search(df, df["vec_id"] == 0).orderBy("rank").collect()]
    assert got == [(1, top), (2, top), (4, top), (3, -top - 1)]


def test_tree_bounds_and_pruning():
    r = np.random.default_rng(3)
    points = r.integers(-100, 100, (2000, 3))
    tree = topk_search.KDTree(np.arange(2000), points, 32)
    for q in r.integers(-100, 100, (20, 3)):
        bound = tree.bounds(q[None])[0]
        for node, (a, b) in enumerate(tree.span):
            assert (tree.points[a:b] @ q).max() <= bound[node]
        best = sorted((-int(p @ q), i) for i, p in enumerate(points))[:5]
        assert [(int(s), i) for s, i in tree.search(q, -1, bound, 5, None)] == best
        assert [(int(s), i) for s, i in tree.search(q, -1, bound, 5, -best[-1][0])] == best


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><div class="logo">Site</div><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies to improve this site.</p><button>OK</button></div>
<div class="ad">Buy this now.</div><!-- <p>hidden</p> -->
<article><h1>A   title&nbsp;here</h1><p>First <b>bold</b>text &lt;tag&gt; caf&eacute; &#8364;<br>next line.<p>Second paragraph with more words, and <a href=x>a link</a> too.
<ul><li>one item of some length<li>another item of it</ul><aside class="related"><a href=/r>Related story</a></aside></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this very much, thank you for writing such a long text.</p></div></section>
<form class="search"><label>Search</label><input></form><footer>&copy; Site. All rights reserved.</footer>"""


def test_page():
    text = html_extract.default_model().extract(PAGE)
    assert text == "A title here\n\nFirst boldtext <tag> café € next line.\n\nSecond paragraph with more words, and a link too.\n\none item of some length\n\nanother item of it"


def pages_text(body):
    return html_extract.default_model().extract(f"<html><body><article>{body}</article></body></html>")


@pytest.mark.parametrize("tag", ["script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "xmp", "noframes"])
def test_text_after_raw_elements(tag):
    """What follows a raw element stays, to the letter; what follows its end tag is no part of it."""
    assert pages_text(f"<p>One two <{tag} id=x>x() < 3</{tag}>three words of text <b>bold</b> tail.</p>") == "One two three words of text bold tail."
    assert pages_text(f"<p>Some text of the page.</p><{tag}>x</{tag} >Loose text here<p>And more.</p>") == "Some text of the page.\n\nLoose text here\n\nAnd more."
    assert pages_text(f"<p>Some text of the page.</p><{tag}>x</{tag}><div class=\"ad\">Buy this now.</div>") == "Some text of the page."
    assert pages_text(f"<p>Some text of the page, <{tag}>cut") == "Some text of the page,"


def test_inline_elements_keep_their_text():
    assert pages_text("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> in units, and <object>a drawing</object> <canvas>of it</canvas>.</p>") == "Energy is E=m in units, and a drawing of it."


def test_labels_of_cells_are_no_labels():
    text = pages_text('<p>A table of prices for the year.</p><table><tr><td data-label="Price">12 pounds</td><td data-label="0">a year</td></tr></table>')
    assert text == "A table of prices for the year.\n\n12 pounds\n\na year"


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "<p>the text</p>", "<table><tr><td>" * 20_000 + "<p>the text", "<p>x<table><tr><td>" + "<div>" * 50_000 + "the text", "<ul><li>" * 30_000 + "the text"])
def test_deep_pages_take_seconds(page):
    import time

    t = time.time()
    nodes, runs = html_extract.parse(page)
    assert runs[-1][1] == "the text" and time.time() - t < 20


class Plain(HTMLParser):
    """All text outside elements that hold none, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.deep, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.deep += tag in ("script", "style", "title")
        self.out.append(" " if tag == "br" or tag in html_extract._BLOCK else "")

    def handle_endtag(self, tag):
        self.deep -= tag in ("script", "style", "title") and self.deep > 0
        self.out.append(" " if tag in html_extract._BLOCK else "")

    def handle_data(self, data):
        self.out.append("" if self.deep else data)


MARKUP = ["<p>", "</p>", "<div class='x y'>", "</div>", "<ul>", "<li>", "</li>", "</ul>", "<b>", "</b>", "<a href='/q?a=1&b=2'>", "</a>", "<br>", "<br/>", "<!-- no <p> -->", "<script>if (a < b) { '<p>' }</script>", "<style>p > b {}</style>", "<table><tr><td>", "</td></tr></table>", "<img src=x>", "<h2>", "</h2>", "one", "two words", " ", "\n\t", "&amp;", "&eacute;", "&#8364;", "x", "caf\u00e9"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(MARKUP), max_size=40))
def test_parsing_loses_and_adds_no_text(parts):
    page = "".join(parts)
    plain = Plain()
    plain.feed(page)
    plain.close()
    _, runs = html_extract.parse(page)
    assert "".join("".join(r for _, r in runs).split()) == "".join("".join(plain.out).split())


class Article(HTMLParser):
    """Blocks of the article element, for pages of one known layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.mark.skipif(not HAVE_DATA, reason="needs the driver's tables")
def test_pages_by_another_extractor(spark):
    path = DATA.replace("0.001", "0.01")
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op5_html_text"](spark, path).collect()}
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        plain = Article()
        plain.feed(page or "")
        plain.close()
        assert got[k] == "\n\n".join(b for b in (" ".join(x.split()) for x in plain.blocks) if b), k


#: Pages in mark-up that the training pages don't have: (html, text).
STRANGE = [
    ("""<body><div id="top"><a href="/">Gazette</a> <a href="/a">World</a> <a href="/b">Sport</a></div><main><h1>Rain at last</h1><div class="byline">By A. Writer</div>
<p>It rained all day in the valley, and the farmers were glad of it.</p><figure><img src="a.jpg"><figcaption>A wet field near the river.</figcaption></figure>
<p>More is expected on Sunday, the office said.</p></main><div class="footer-links"><a href="/c">Contact</a> | <a href="/p">Privacy</a></div></body>""",
     ["It rained all day in the valley, and the farmers were glad of it.", "More is expected on Sunday, the office said.", "Rain at last"], ["Privacy", "Sport"]),
    ("""<body><table><tr><td class="leftnav"><ul><li><a href="1">One</a><li><a href="2">Two</a><li><a href="3">Three</a></ul></td><td><h2>Old pages</h2>
<p>This page was made with a table, as pages were in those days, and still is read.</p><p>It has a second paragraph that is long enough to be text.</p></td></tr></table></body>""",
     ["This page was made with a table, as pages were in those days, and still is read.", "It has a second paragraph that is long enough to be text."], ["Three"]),
    ("""<body><section class="hero"><h1>How to bake bread</h1></section><section class="recipe"><p>Mix the flour with water and salt, and knead it for ten minutes.</p><ol><li>Let it rise for an hour in a warm place.</li><li>Bake it until the crust is brown.</li></ol></section>
<section class="reader-comments"><div class="comment"><p>Mine did not rise at all, what did I do wrong with it?</p></div></section><div class="cookie-bar" role="dialog"><p>We use cookies.</p></div></body>""",
     ["Mix the flour with water and salt, and knead it for ten minutes.", "Let it rise for an hour in a warm place.", "How to bake bread"], ["cookies", "Mine did not rise"]),
]


@pytest.mark.parametrize(("page", "there", "gone"), STRANGE)
def test_strange_pages(page, there, gone):
    text = html_extract.default_model().extract(page)
    assert all(x in text.split("\n\n") for x in there), text
    assert not any(x in text for x in gone), text


def test_marginals_equal_enumeration():
    model = html_extract.train(html_extract.labelled_pages(60))
    nodes, _ = html_extract.parse("<body><nav><a>x</a></nav><div><p>some text of it</p><p>more</p></div><footer>c</footer></body>")
    odds = html_extract.unary(nodes) @ model.weights
    total, on = 0.0, np.zeros(len(nodes))
    for state in range(1 << len(nodes)):
        y = [(state >> i) & 1 for i in range(len(nodes))]
        e = sum(o for o, b in zip(odds, y) if b) + sum(model.both if y[i] else model.neither for i in range(1, len(nodes)) if y[i] == y[nodes[i].parent])
        p = np.exp(e)
        total += p
        on += p * np.array(y)
    assert model.marginals(nodes) == pytest.approx((on / total).tolist(), abs=1e-9)


def test_held_out_pages():
    model, wrong, runs_seen = html_extract.default_model(), 0, 0
    for page in html_extract.labelled_pages(80, seed=99):
        nodes, runs = html_extract.parse(page, labelled=True)
        y = []
        for i, n in enumerate(nodes):
            y.append(n.label if n.label is not None else (y[n.parent] if i else 1))
        p = model.marginals(nodes)
        wrong += sum((p[n] >= 0.5) != y[n] for n, _ in runs)
        runs_seen += len(runs)
    assert wrong / runs_seen < 0.03


def test_pages(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", "<article><p>cut &am"), (None, "u", "no tags at all, just a sentence"), (5, "u", "<p>" * 400 + "deep" + "<div" + "<"), (6, "u", "<article><p>" + LONG + "</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS k")
    got = {(r["page_id"], r["n_chars"]): r for r in html_extract.extract(df).collect()}
    assert len(got) == len(pages)
    assert all(n == len(r["text"]) for (_, n), r in got.items())
    assert (2, 0) in got and (3, 0) in got and (6, len(LONG.strip())) in got and any(r["text"] == "cut &am" for r in got.values())
    assert html_extract.extract(df.limit(0)).count() == 0


def labelled(r, n):
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        text = " ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(int(r.integers(5, 80))))
        rows.append((i, text.capitalize() + "." if good else (text.upper() if r.random() < 0.5 else text.replace(" ", "*** "))))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled(np.random.default_rng(6), 400)
    docs = frame(spark, [*rows, *[(1000 + n, t) for n, (_, t) in enumerate(EDGE)], (None, "abc")]).selectExpr("*", "1 AS k", "2 AS score", "3 AS y")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_on(docs, marks.where(~quality.held_out()))
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    test = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i] >= quality.THRESHOLD) == bool(labels[i][1]) for i in test])
    assert right > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, s in got.items() if s >= quality.THRESHOLD}


def test_quality_of_repeated_ids(spark):
    """The model doesn't depend on the order of rows: ids with contradicting labels aren't used, every different text is."""
    rows, labels = labelled(np.random.default_rng(6), 120)
    rows += [(3, "Another text of it."), (3, "Another text of it."), rows[5]]
    labels += [(7, 1 - labels[7][1], 0), labels[9]]
    scores = []
    for order in (1, -1):
        docs, marks = frame(spark, rows[::order]).repartition(3), spark.createDataFrame(labels[::order], "doc_id long, quality int, toxic int")
        model = quality.fit_on(docs, marks)
        scores.append(sorted((r["doc_id"], r["score"]) for r in quality.score_documents(docs, model).collect()))
    assert scores[0] == scores[1] and len(scores[0]) == len(rows)


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows, labels = labelled(np.random.default_rng(8), 60)
    odd = [*EDGE, (1, "a b c d e f g"), (500, None), (None, None), (2, "Another text under an id that is taken. It is quite good.")]
    for name, some, marks in (("odd", [*rows, *[(None if i is None else 1000 + i, t) for i, t in odd]], labels), ("empty", [], []), ("bare", odd, [])):
        path = f"file://{tmp_path}/{name}"
        docs = frame(spark, some).withColumn("node", F.lit(1)) if some else spark.createDataFrame([], DOCS)
        docs.repartition(2).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        got = corpus_pipeline.run(spark, path).collect()
        assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got[0].asDict() if got else corpus_pipeline.run(spark, path).columns)
        assert (not some) == (not got)
        if name == "bare":
            # Without labels all pass the classifier; one of each group of copies goes on, the rest by the mix.
            texts = {}
            for i, t in odd:
                texts.setdefault(t or "", set()).add(i)
            kept = {max((i for i in ids if i is not None), default=None) for ids in texts.values()}
            assert {r["doc_id"] for r in got} <= kept


def test_quality_without_labels(spark):
    docs = frame(spark, EDGE)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    same = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for marks in (none, same):
        model = quality.fit_on(docs, marks)
        assert {r["score"] for r in quality.score_documents(docs, model).collect()} == {0.5}
    assert quality.score_documents(spark.createDataFrame([], DOCS), model).count() == 0


@pytest.mark.skipif(not HAVE_DATA, reason="needs the driver's tables")
def test_quality_held_out_accuracy(spark):
    got = queries.QUERIES["op8_quality"](spark, DATA.replace("0.001", "0.01"))
    marks = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet")
    rows = got.join(marks, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


@pytest.mark.skipif(not HAVE_DATA, reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    import glob
    import os

    import duckdb
    import pandas as pd

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), c.execute(queries.ORACLE_SQL[name]).fetchdf()
    cols = sorted(got.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


@pytest.mark.skipif(not HAVE_DATA, reason="needs the driver's tables")
def test_pipeline(spark):
    """Each stage against a plain version of it, on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.toPandas()
    columns = list(before.columns)
    for name, function in corpus_pipeline.STAGES:
        after_df = stage(function(spark, docs, DATA), "test-stage")
        after = after_df.toPandas()
        ids, kept = before["doc_id"].tolist(), after["doc_id"].tolist()
        if name != "packing":
            assert list(after.columns) == columns and set(kept) <= set(ids)
        texts = dict(zip(before["doc_id"], before["text"]))
        if name == "quality classifier":
            marks = spark.read.parquet(f"{DATA}/labels.parquet").toPandas().set_index("doc_id")["quality"]
            right = [(i in set(kept)) == bool(marks[i]) for i in ids if i in marks.index]
            assert np.mean(right) > 0.95
        elif name == "exact dedup":
            assert sorted(kept) == sorted({t: max(i for i in ids if texts[i] == t) for t in set(texts.values())}.values())
        elif name == "near dedup":
            np.seterr(over="ignore")
            want = brute(list(texts.items()), 80)
            assert sorted(kept) == sorted(i for i, (_, c) in want.items() if i == c)
        elif name == "source mixing":
            report = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_report(docs).collect()}
            times = after["doc_id"].value_counts().to_dict()
            assert all(times.get(i, 0) * n == taken for i, (n, taken) in report.items())
        else:
            assert set(kept) == set(ids)
            used = after.groupby("sequence_id")["length"].sum()
            assert used.max() <= packing.CAPACITY and after["length"].sum() >= len(before)
        docs, before = after_df, after
    assert re.fullmatch("[a-z ]+", name)


def test_topk_different_vectors_of_one_query(spark):
    rows = [(0, [1, 0]), (0, [0, 1]), (0, [0, 1]), (1, [9, 0]), (2, [0, 8]), (3, [7, 7]), (4, [1, 1])]
    docs = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = sorted(tuple(x) for x in topk_search.search(docs, F.col("vec_id") == 0, k=4).select("rank", "vec_id", "score").collect())
    assert got == [(1, 1, 9), (2, 2, 8), (3, 3, 7), (4, 3, 7)]
