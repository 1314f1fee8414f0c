"""HTML extraction, quality classifier, language model, decontamination."""

import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from edge_fixtures import edge_docs, empty_docs, sentence  # noqa: F401
from quiver.llm import decontam as D, html_tree as H, lbl, quality as Q, textops as T, tokens
from quiver.llm.labelled_pages import PAGES
from quiver.llm.registry import QUERIES
from quiver.session import BATCH_BYTES, ship_package, small_batches

MODEL = H.default_model()


# ---- HTML -------------------------------------------------------------------------------------------

def article(source):
    """The article of the given pages' template, without a parser."""
    inner = source[source.find("<article>") + 9 :]
    inner = inner[: inner.find("</article>")] if "</article>" in inner else inner
    parts = re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts)
    return " ".join(t for t in texts if t)


def test_given_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    rows = QUERIES["op2_html_tree"](spark, SF001).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_marginals_equal_enumeration():
    """Sum-product against the sum over all labellings of small trees."""
    rng = np.random.default_rng(1)
    pages = [H.Page(s) for s in ("<div><p>a</p><nav><a>b</a></nav></div>", "<p>x<p>y", "", "<ul><li>1<li>2</ul>t")]
    forest = H.Forest(pages)
    w, edges = rng.normal(size=H.N_FEATURES), rng.normal(size=(2, 2, 2))
    p, pair, log_z = H.marginals(forest, w, edges)
    total_z, bounds = 0.0, [*forest.base, len(forest.kind)]
    for a, b in zip(bounds, bounds[1:]):
        z, on, both = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for label in itertools.product((0, 1), repeat=b - a):
            s = sum(forest.x[a + i] @ w for i, v in enumerate(label) if v)
            s += sum(edges[forest.edge[a + i], label[forest.parent[a + i] - a], v] for i, v in enumerate(label) if not forest.root[a + i])
            e = math.exp(s)
            z += e
            on += e * np.array(label)
            for i, v in enumerate(label):
                if not forest.root[a + i]:
                    both[i, label[forest.parent[a + i] - a], v] += e
        total_z += math.log(z)
        assert np.allclose(p[a:b, 1], on / z) and np.allclose(pair[a:b], both / z)
    assert math.isclose(total_z, log_z)


@pytest.mark.parametrize("source, text", [
    (None, ""), ("", ""), ("   ", ""), ("<article><p>a&amp;b &lt;c&gt; &eacute;&#233;&#xe9; &amp</p></article>", "a&b <c> ééé &"),
    ("<article><h1>T</h1><p>one <b>t</b>wo\n three<br>four<p>five</article>", "T one two three four five"),
    ("<article><p>kept</p><script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>too</p></article><footer>no</footer>", "kept too"),
    ("<article><p>cut in a tag</p><p cla", "cut in a tag"),
    ("<article><p>1 < 2 and a<b</p></article>", "1 < 2 and a"),
    ('<article><p title="a > b">quoted</p></article>', "quoted"),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
])
def test_text_rules(source, text):
    assert H.main_texts([source], MODEL) == [text]


@pytest.mark.parametrize("tag", [
    "<p data-x='" + "<i>x</i></article>" * 30 + "'>", '<p onclick="' + "a > b;" * 500 + '">', "<p title=it's>", '<p a = "' + ">" * 21 + '"b=\'>\'>', '<p a=b="c>', '<p a="never closed>',
])
def test_a_tag_ends_outside_quoted_values(tag):
    closing = tag.count('"') % 2 == 0
    assert H.main_texts([f"<article><p>one two.</p>{tag}kept too</p><p{' id="z"' if closing else ''}>last</p></article>"], MODEL) == ["one two. kept too last"]
    many = "<p " + "a='>' " * 300_000 + ">"
    assert H._tag_end(many, 2) == len(many) - 1 and H._tag_end("<p " + 'a="b" ' * 300_000, 2) == -1


@pytest.mark.parametrize("inside, text", [
    ("<p>so <math><mi>x</mi><mo>+</mo><mi>y</mi></math> is one</p><p>last words</p>", "so x+y is one last words"),
    ('<p>in <svg><title>no</title><path d="M0"/><text>red</text><text>blue</text></svg> ink</p>', "in red blue ink"),
    ("<p>open <svg><path d='M0'>drawing</p><p>last words</p>", "open drawing last words"),
    ("<p>open <math><mi>x</p><p>last words</p>", "open x last words"),
    ("<p>see <object data='a'>the other form</object> here</p>", "see the other form here"),
    ("<p>one two.</p><canvas><p>last words</p>", "one two. last words"),
    ("<p>one two.</p><script>var a;<p>last words</p>", "one two."),
])
def test_text_of_inline_elements_is_kept(inside, text):
    assert H.main_texts([f"<article><p>Some words of it. More.</p>{inside}</article>"], MODEL) == ["Some words of it. More. " + text]


def test_options_are_read():
    page = H.Page("<article><p>Pick <select><option>red<option>blue</select> now</p></article>")
    assert [t for _, t in page.runs] == ["Pick", "red", "blue", "now"] and page.runs[0][0] == page.runs[3][0]


LAYOUTS = {
    "divs": '<body><div id="top-nav"><a href="/">Home</a></div><div class="content"><h1>Head</h1><p>The main text has a first sentence. And a second.</p><div class="comments"><p>Nice post, thank you all. Really.</p></div></div><div class="sidebar"><p>Side words here.</p></div><div class="footer">Foot.</div></body>',
    "semantic": '<body><header>Site</header><main><h1>Head</h1><p>The main text has a first sentence. And a second.</p></main><aside><p>Side words here. Side words.</p></aside><section id="comments"><h2>Comments</h2><p>Nice post, thank you all. Really.</p></section><form><p>Name</p></form><footer>Foot.</footer></body>',
    "notice": '<body><div class="cookie-notice"><p>We use cookies. Accept them now.</p></div><article><h1>Head</h1><p>The main text has a first sentence. And a second.</p><div class="ad"><p>Buy this. Buy that.</p></div></article></body>',
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_other_layouts(name):
    assert H.main_texts([LAYOUTS[name]], MODEL) == ["Head The main text has a first sentence. And a second."]


def test_labelled_pages_are_learned_and_mostly_generalise():
    forest = H.Forest([H.Page(p, marks=True) for p in PAGES])
    wrong = (H.marginals(forest, *MODEL)[0][:, 1] > 0.5) != forest.label
    assert wrong.mean() < 0.02
    errors = total = 0
    for k in range(0, len(PAGES), 13):
        own = H.Forest([H.Page(PAGES[k], marks=True)])
        p = H.marginals(own, *H.train(PAGES[:k] + PAGES[k + 1 :]))[0][:, 1]
        errors, total = errors + ((p > 0.5) != own.label).sum(), total + len(p)
    assert errors / total < 0.1


_PARTS = [f"Paragraph {k} of the text runs on for a while, with clauses and a stop. And one more sentence." for k in range(4)]
_NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'


@pytest.mark.parametrize("layout, title", [
    ('<body class="page has-sidebar">{nav}<article>{text}</article>{foot}</body>', ""),
    ('<body><div class="layout with-sidebar">{nav}<article>{text}</article></div>{foot}</body>', ""),
    ('<body><div class="layout with-sidebar">{nav}<div class="content">{text}</div></div>{foot}</body>', ""),
    ('<body>{nav}<article>{one}<section class="social-policy">{two}</section></article>{foot}</body>', ""),
    ('<body>{nav}<article><header><h1>Title</h1></header>{text}</article>{foot}</body>', "Title "),
    ('<body>{nav}<article class="post featured-related">{text}</article>{foot}</body>', ""),
    ('<body>{nav}<article>{text}</article><div class="comments"><article class="comment"><p>Someone says so.</p></article></div>{foot}</body>', ""),
    ('<body>{nav}<article>{text}</article><div class="footer"><div class="content"><p>Foot words.</p></div></div></body>', "")])
def test_words_of_parts_on_wrappers_lose_no_article(layout, title):
    ps = [f"<p>{p}</p>" for p in _PARTS]
    page = layout.format(nav=_NAV, text="".join(ps), one="".join(ps[:2]), two="".join(ps[2:]), foot="<footer>Copyright of the site.</footer>")
    assert H.main_texts([page], H.default_model()) == [title + " ".join(_PARTS)]


def test_a_short_article_of_a_named_post():
    page = f'<body>{_NAV}<article class="post featured-related"><p>{_PARTS[0]}</p></article><footer>Copyright.</footer></body>'
    assert H.main_texts([page], H.default_model()) == [_PARTS[0]]


@pytest.mark.parametrize("piece", ["<div><p>x</p>", "<div>", "<b><i>", "<p>", "<ul><li>", "<table><tr><td>x</b>", "</p></div>"])
def test_nested_pages_take_linear_time(piece):
    import time

    H.default_model()
    began = time.time()
    H.main_texts([piece * 20_000], H.default_model())
    assert time.time() - began < 4  # about half a second on an idle core


def test_pages_with_nulls_repeats_and_extra_columns(spark):
    deep = "<div>" * 3000 + "<p>deep</p>"
    page = "<article><p>Some words of it. More.</p></article>"
    rows = [(1, "u", page, "x", 1), (1, "u", page, "x", 1), (None, None, page, None, 2), (2, "v", None, "x", 3), (3, "w", "", "x", 4), (4, "z", deep, "x", 5), (5, "q", "<article>" + "<p>word</p>" * 20000, "x", 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = H.extract(df).collect()
    assert len(out) == 7 and out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    by = {(r["page_id"], r["url"]): r for r in out}
    assert by[1, "u"]["text"] == by[None, None]["text"] == "Some words of it. More." and by[2, "v"]["text"] == by[3, "w"]["text"] == ""
    assert by[5, "q"]["n_chars"] == 20000 * 5 - 1
    assert H.extract(df.limit(0)).collect() == []


# ---- quality ----------------------------------------------------------------------------------------

def test_density_equals_the_formula():
    rng = np.random.default_rng(0)
    d = len(Q.FEATURES)
    x = {0: rng.normal(size=(40, d)), 1: rng.normal(1, 2, size=(160, d))}
    sums = {c: np.concatenate(([len(v)], v.sum(0), (v.T @ v).ravel())) for c, v in x.items()}
    model = Q.Discriminant.fit(sums, 0.2)
    pooled = np.diag(np.diag(sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in x.values())) / 200 + 1e-4)
    test = rng.normal(size=(5, d))
    logs = {}
    for c, v in x.items():
        weight = 0.2 + 0.8 * d / (len(v) + d)
        cov = (1 - weight) * np.cov(v.T, bias=True) + weight * pooled
        diff = test - v.mean(0)
        logs[c] = -0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1] + math.log(len(v) / 200)
    assert np.allclose(model.score(test), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))


def test_held_out_accuracy(spark):
    from conftest import SF01

    rows = {r["doc_id"]: r for r in QUERIES["op7_quality"](spark, SF01).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1
    held = [i for i in labels if rows[i]["held_out"]]
    assert sum(rows[i]["predicted"] == labels[i] for i in held) / len(held) > 0.97


def test_scores_use_nothing_but_the_text(edge_docs, spark):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (6, 0, 0), (7, 0, 0), (10, 1, 0), (11, 1, 1), (8, None, 0), (None, 1, 0), (12, 7, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = Q.scores(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    texts = {}
    for r, (i, t) in zip(sorted(rows, key=lambda r: (str(r["doc_id"]), r["score"])), sorted(((r["doc_id"], r["text"]) for r in edge_docs.collect()), key=lambda r: str(r[0]))):
        texts.setdefault(t or "", set()).add(round(r["score"], 12))
    assert all(len(v) == 1 for v in texts.values())
    assert Q.scores(edge_docs.limit(0), labels).collect() == []
    assert {r["score"] for r in Q.scores(edge_docs, labels.limit(0)).collect()} == {0.5}


def test_keep_good_keeps_columns(spark, edge_docs):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    known = [(i in ids) == bool(q) for i, q in quality.items()]
    assert sum(known) / len(known) > 0.95
    assert Q.keep_good(edge_docs, labels.limit(0)).count() == edge_docs.count()
    assert Q.keep_good(edge_docs.limit(0), labels).collect() == []


def test_rows_that_cannot_train_do_not_use_up_the_sample(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF001}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    strangers = spark.range(10**9, 10**9 + 2000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    unknown = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(labels, "doc_id", "left_anti").crossJoin(spark.createDataFrame([(None,), (7,)], "quality int"))
    kept = lambda labels: sorted(r["doc_id"] for r in Q.keep_good(docs, labels, sample=40).collect())
    alone = kept(labels)
    assert 0 < len(alone) < docs.count()
    assert kept(labels.unionByName(strangers).unionByName(unknown)) == alone


def test_keep_good_has_one_python_step_a_task(spark, monkeypatch):
    """Two in one stage take two Python workers a task, which stay in the executor's memory."""
    rows = [(i, sentence(i, 40)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    given, train = [], Q.train
    monkeypatch.setattr(Q, "train", lambda vectors, *rest: given.append(vectors) or train(vectors, *rest))
    assert Q.keep_good(docs, labels, threshold=0.0).count() == 40
    plans = [v._jdf.queryExecution().executedPlan().toString() for v in given]
    assert plans and all("Exchange" in p.partition("MapInArrow")[0] for p in plans)


def test_lean_tasks_drop_what_others_left_in_the_worker(spark):
    ship_package(spark)
    count = T.lean(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(tokens.Encoder.held)])], ["n"]) for _ in batches))

    def after_another(batches):
        tokens.Encoder.held["left"] = None
        yield from count(batches)

    assert [r["n"] for r in spark.range(0, 5, 1, 1).mapInArrow(after_another, "n long").collect()] == [0]


def test_small_batches(spark):
    key, rows = "spark.sql.execution.arrow.maxBytesPerBatch", 60
    before = spark.conf.get(key)
    docs = spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('abcdefg ', 25000)").alias("text"))  # 200 kB each
    widths = lambda: [r["n"] for r in docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"]) for b in batches), "n long").collect()]
    try:
        spark.conf.set(key, "64m")
        assert widths() == [rows]
        Q.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
        assert sum(widths()) == rows and max(widths()) <= BATCH_BYTES // 200_000 + 1
        spark.conf.set(key, "1m")  # a smaller one stays
        small_batches(spark)
        assert spark.conf.get(key) in ("1m", str(1 << 20), f"{1 << 20}b") and max(widths()) <= 6
    finally:
        spark.conf.set(key, before)


# ---- language model -----------------------------------------------------------------------------------

def brute_base(docs):
    """(n_tokens, n_known, N, base score) per row from the definition."""
    def words(t):
        return (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split() + [None]

    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    count = {}
    for (_, t), h in zip(docs, held):
        if not h:
            for w in words(t):
                count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()), len(count)
    out = []
    for (i, t), h in zip(docs, held):
        ws = words(t)
        out.append((str(i), h, len(ws), sum(w in count for w in ws), total, round(sum(math.log10((count.get(w, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws), 5)))
    return sorted(out)


@pytest.mark.parametrize("heavy, vocab", [(1 << 17, 1023), (40, 15)])
def test_base_scores_equal_the_definition(spark, edge_docs, heavy, vocab):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    rows = lbl.score(edge_docs, vocab=vocab, heavy=heavy, dims=4).collect()
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows)
    assert [g[:5] for g in got] == [b[:5] for b in brute_base(docs)]
    assert all(abs(g[5] - b[5]) < 1e-3 for g, b in zip(got, brute_base(docs)))
    assert all(math.isfinite(r["score"]) for r in rows)


def test_normalisers_of_a_context_are_computed_once_a_worker(monkeypatch):
    rng = np.random.default_rng(4)
    heavy = rng.integers(0, 1 << 62, 30).astype(np.uint64)
    shared = lbl.Shared(heavy, rng.integers(1, 50, 30), 2000, 80, 12)
    w1, w2, target = (rng.integers(0, n, 200) for n in (shared.start + 1, shared.start + 1, shared.targets))
    sizes, plain = [], lbl.log_sums
    monkeypatch.setattr(lbl, "log_sums", lambda q, t, *more: sizes.append((len(q), len(t))) or plain(q, t, *more))
    model = lbl.Model.start(shared, 5, 1)
    first = lbl.log_probabilities(shared, model, w1, w2, target)
    assert len(sizes) > 2
    before = len(sizes)
    again = lbl.log_probabilities(shared, model, w1, w2, target)
    assert (again == first).all()
    assert all(t <= shared.per_class for _, t in sizes[before:])  # neither the head's nor the classes' sums
    monkeypatch.setattr(lbl, "KNOWN_PAIRS", 0)
    assert np.allclose(lbl.log_probabilities(shared, lbl.Model.start(shared, 5, 1), w1, w2, target), first, atol=1e-5)


def test_sums_of_extreme_scores_stay_finite():
    q, t = np.array([[30.0, 1], [-30, 1], [0, 1]], np.float32), np.array([[10.0, -3], [0, 2], [-10, -300]], np.float32)
    exact = [math.log(sum(math.exp(a - max(r)) for a in r)) + max(r) for r in (q.astype(float) @ t.astype(float).T).tolist()]
    assert np.allclose(lbl.log_sums(q, t), exact, rtol=1e-6)


def test_an_epoch_equals_plain_steps():
    """One batch: gradients of all levels by plain loops over rows and noise words, then AdaGrad."""
    rng = np.random.default_rng(6)
    heavy = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    shared = lbl.Shared(heavy, rng.integers(1, 50, 40), 2000, 120, 8)
    n, noise, rate, dims = 60, 16, 0.1, 4
    w1, w2, w = (rng.integers(0, k, n) for k in (shared.start + 1, shared.start + 1, shared.targets - 1))
    w += w >= 0
    weight = rng.integers(1, 5, n)
    model, plain = lbl.Model.start(shared, dims, 3), lbl.Model.start(shared, dims, 3)
    squares = [np.full(a.shape, 1e-6, np.float32) for a in model.arrays()]
    lbl.nce_epoch(model, squares, shared, w1, w2, w, weight, np.random.default_rng(9), noise, rate, n)
    draw = np.random.default_rng(9)
    draw.permutation(n)
    grads = [np.zeros(a.shape) for a in plain.arrays()]
    q, gq = plain.context(w1, w2).astype(float), np.zeros((n, dims))
    for (some, target), counts, kt, kb in zip(shared.levels(w), (shared.vocab_counts, shared.class_counts, shared.tail_counts), (1, 5, 7), (4, 6, 8)):
        p = counts / counts.sum()
        cumulative = np.cumsum(p)
        cumulative[-1] = 1.0
        drawn = np.searchsorted(cumulative, draw.random(noise))
        t, b = plain.arrays()[kt].astype(float), plain.arrays()[kb].astype(float)
        for i, j in zip(np.arange(n)[some], target):
            for word, real in [(j, True), *((d, False) for d in drawn)]:
                share = 1 / (1 + math.exp(-(q[i] @ t[word] + b[word] - math.log(noise * p[word]))))
                g = weight[i] * (1 - share if real else -share)
                grads[kt][word] += g * q[i]
                grads[kb][word] += g
                gq[i] += g * t[word]
    for i in range(n):
        grads[0][w1[i]] += gq[i] * plain.c1
        grads[0][w2[i]] += gq[i] * plain.c2
        grads[2] += gq[i] * plain.r[w1[i]]
        grads[3] += gq[i] * plain.r[w2[i]]
    for got, start, g in zip(model.arrays(), plain.arrays(), grads):
        g /= weight.sum()
        assert np.allclose(got, start + rate * g / np.sqrt(1e-6 + g * g), atol=1e-3)


class CountedDraws:
    """A generator of random numbers that counts how often it is asked."""

    def __init__(self, seed):
        self.rng, self.permutation, self.calls = np.random.default_rng(seed), np.random.default_rng(seed + 1).permutation, 0

    def random(self, size):
        self.calls += 1
        return self.rng.random(size)


def test_many_batches_are_laid_out_at_once(monkeypatch):
    """The steps are the same however many batches are laid out together, with odd sizes and batches without a level."""
    rng = np.random.default_rng(8)
    heavy = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    shared = lbl.Shared(heavy, rng.integers(1, 50, 40), 2000, 120, 8)
    n, batch = 205, 10
    w1, w2, w = (rng.integers(0, k, n) for k in (shared.start + 1, shared.start + 1, shared.targets - 1))
    w[rng.random(n) < 0.9] = 3  # most batches lack words of the tail
    weight, found = rng.integers(1, 5, n), []
    for planned in (1, 4, 32):
        monkeypatch.setattr(lbl, "PLANNED", planned)
        for dims in (4, 5):
            model, draws = lbl.Model.start(shared, dims, 3), CountedDraws(9)
            squares = [np.full(a.shape, 1e-6, np.float32) for a in model.arrays()]
            lbl.nce_epoch(model, squares, shared, w1, w2, w, weight, draws, 16, 0.1, batch)
            assert draws.calls == -(-21 // planned)
            found.append(np.concatenate([model.pack(), *(a.ravel() for a in squares)]))
    assert np.isfinite(found[0]).all() and not np.allclose(found[0][: found[0].size // 2], lbl.Model.start(shared, 4, 3).pack(), atol=1e-3)
    for one, other in zip(found, found[2:]):
        assert np.allclose(one, other, atol=1e-6)


def test_frequent_words_are_found_among_hashes_that_begin_alike():
    rng = np.random.default_rng(5)
    heavy = np.unique(np.concatenate((rng.integers(0, 1 << 64, 300, dtype=np.uint64), np.arange(40, dtype=np.uint64), np.uint64((1 << 64) - 1) - np.arange(9, dtype=np.uint64))))
    shared = lbl.Shared(rng.permutation(heavy), np.full(heavy.size, 5), 9000, 900, 20)
    words = rng.permutation(np.concatenate((heavy, heavy + np.uint64(1), rng.integers(0, 1 << 64, 300, dtype=np.uint64))))
    place, ids = shared.look_up(words)
    where = {int(h): i for i, h in enumerate(shared.heavy)}
    assert place.tolist() == [where.get(int(x), -1) for x in words]
    assert ids.tolist() == [shared.ids[p] if p >= 0 else 0 for p in place]
    assert lbl.Shared(heavy[:0], np.zeros(0, int), 0, 0, 5).look_up(words)[0].max() == -1


def test_endings_are_read_once_a_word(monkeypatch):
    """The count reads them for distinct words, scoring for those that are not frequent; the classes are those of all words."""
    texts = pa.array(["Running, runs \x00 ran." * 50, None, "", "  seldom words, runs  "])
    words, _, is_word = lbl.tokens(texts)
    every = np.zeros(len(words), np.int64)
    every[is_word] = lbl.T.word_ends(texts, lbl.ENDINGS)
    read, plain = [], lbl.T.word_ends
    monkeypatch.setattr(lbl.T, "word_ends", lambda *given: read.append(plain(*given)) or read[-1])
    rows = list(lbl._count([pa.record_batch([pa.array([2, 3, 4, 5]), texts], ["doc_id", "text"])]))
    assert all(lbl.trains(pa.array([2, 3, 4, 5])))
    got = {w % (1 << 64): (e, c) for r in rows for w, e, c in zip(*(r.column(i).to_pylist() for i in range(3)))}
    assert got == {int(w): (e, (words == w).sum()) for w, e in zip(words, every)}
    assert sum(len(r) for r in read) == len(got) - 1  # all but the end token
    heavy = np.unique(words)[::2]
    shared = lbl.Shared(heavy, np.full(heavy.size, 3), 500, 9, 2, np.array([got[int(w)][0] for w in heavy]))
    place, _ = shared.look_up(words)
    read.clear()
    assert shared.endings_of(texts, is_word, place).tolist() == every.tolist()
    assert sum(len(r) for r in read) == (is_word & (place < 0)).sum() < is_word.sum()


def test_words_have_the_same_hash_in_short_and_long_slices():
    t = lbl.T
    long = ["x" * 4096 + "y", "x" * 9000, "ab" * t.PIECE_BYTES, " " * 5000 + "ab"]
    texts = ["Ab cd \tef", None, "", *long, "cd", " ".join(f"w{i}" for i in range(30000))]
    whole = t.word_table(pa.array(texts))
    parts = [t.word_table(pa.array([x], pa.string())) for x in texts]
    assert np.array_equal(whole.hash, np.concatenate([p.hash for p in parts]))
    assert whole.per_doc.tolist() == [p.per_doc[0] for p in parts] == [len((x or "").split()) for x in texts]
    assert len(set(whole.hash.tolist())) == len({w for x in texts for w in (x or "").lower().split()})
    words, per_doc, is_word = lbl.tokens(pa.array(texts))
    assert np.array_equal(words[is_word], whole.hash) and per_doc.tolist() == (whole.per_doc + 1).tolist()


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(2)
    heavy = rng.integers(0, 1 << 62, 30).astype(np.uint64)
    shared = lbl.Shared(heavy, rng.integers(1, 50, 30), 2000, 80, 12)
    model = lbl.Model.start(shared, 5, 1)
    for w1, w2 in ((0, 3), (shared.start, shared.start), (12, 0)):
        z = model.log_normalisers(np.array([w1]), np.array([w2]))[0]
        p = np.exp(model.context(np.array([w1]), np.array([w2]))[0] @ model.t.T + model.b - z)
        assert abs(p.sum() - 1) < 1e-5
    counts = [c for c, i in zip(shared.counts, shared.ids) if i == 0]
    rest = shared.other_tokens - sum(counts)  # held by words that are not frequent
    words = shared.other_words - len(counts)
    share = (sum(c + 0.1 for c in counts) + rest + 0.1 * words + 0.1) / (shared.other_tokens + 0.1 * (shared.other_words + 1))
    assert abs(share - 1) < 1e-9


def test_words_beyond_the_head_have_scores_by_context():
    rng = np.random.default_rng(3)
    heavy = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    rest = np.array([rng.integers(0, 9, lbl.ENDINGS), rng.integers(0, 4, lbl.ENDINGS)])
    counts = rng.integers(2, 50, 60)
    shared = lbl.Shared(heavy, counts, int(counts.sum() + rest[0].sum()), 60 + int(rest[1].sum()), 12, rng.integers(0, lbl.ENDINGS, 60), rest)
    model = lbl.Model.start(shared, 5, 1)
    every = np.append(np.arange(1, shared.size), np.arange(shared.size, shared.targets))  # all words and classes, without the entry "other"
    logs = [lbl.log_probabilities(shared, model, np.full(len(every), w1), np.full(len(every), w2), every) for w1, w2 in ((0, 3), (shared.start, shared.start), (12, 0))]
    for p in logs:
        assert abs(np.exp(p).sum() - 1) < 1e-5
    tail = (every >= shared.size) & (every < shared.size + shared.n_tail)
    assert shared.n_tail == 48 and shared.tail_classes > 1
    # the ratio of two words outside the head is not the same in all contexts
    change = logs[0] - logs[1]
    assert np.ptp(change[tail]) > 1e-3 and np.ptp(change[every >= shared.size + shared.n_tail]) > 1e-3
    words = heavy[np.argsort(-counts, kind="stable")]
    place, ids = shared.look_up(words)
    target = shared.target(place, ids, np.zeros(60, np.int8))
    assert sorted(target) == list(range(1, shared.size + shared.n_tail))


def test_model_beats_the_base_on_held_out_texts(spark):
    from conftest import SF01

    rows = [r for r in QUERIES["op8_lbl"](spark, SF01).collect() if r["held_out"]]
    assert len(rows) > 50 and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_of_nothing(empty_docs):
    assert lbl.score(empty_docs, dims=4).collect() == []


# ---- decontamination ------------------------------------------------------------------------------------

def best_substring_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_matches_equal_brute_force():
    rng = random.Random(9)
    for _ in range(400):
        item = D.normal("".join(rng.choice("ab c") for _ in range(rng.randrange(1, 30)))) or "a"
        body = list(item)
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(body) + 1)
            body[k : k + rng.randrange(2)] = [rng.choice("abcd")] if rng.random() < 0.6 else []
        text = D.normal("".join(rng.choice("abcde ") for _ in range(15)) + "".join(body) + "".join(rng.choice("abcde ") for _ in range(15)))
        least = best_substring_distance(item, text)
        got = list(D.Matcher([(1, item)], 0.2).matches(text))
        assert bool(got) == (least <= int(0.2 * len(item)))
        if got:
            _, edits, a, b = got[0]
            assert edits == least and 0 <= a <= b <= len(text)


def test_table_matches_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    items = [(r["item_id"], D.normal(r["text"])) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): r["errors"] for r in QUERIES["op9_decontam"](spark, SF001).collect()}
    for r in docs.limit(60).collect():
        text = D.normal(r["text"])[:4000]
        if len(D.normal(r["text"])) <= 1500:
            for i, item in items[::4]:
                least = best_substring_distance(item, text) if set(text) else len(item)
                assert got.get((r["doc_id"], i)) == (least if least <= int(D.RATE * len(item)) else None)
    exact = {(r["doc_id"], i) for r in docs.collect() for i, item in items if item in D.normal(r["text"])}
    assert exact == {k for k, e in got.items() if e == 0}


def test_decontamination_edge_cases(spark, edge_docs):
    item = " ".join(f"secretquestion{i}" for i in range(8))
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (None, item.upper(), "x"), (4, "w3x3 w4x4 w5x5 w6x6 w7x7 w8x8", "x")], "item_id long, text string, doc_id string")
    held = edge_docs.unionByName(edge_docs.sparkSession.createDataFrame(
        [(50, "pre " + item.replace("question3", "qestion3") + " post", None, None, None, 1, 0.1, None)], edge_docs.schema))
    rows = D.matches(held, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(50, 1), (50, None), (6, 4), (7, 4)}
    assert {r["errors"] for r in rows if r["doc_id"] == 50} == {1}
    small = D.matches(held, bench, block_chars=40).collect()
    assert sorted(map(str, small)) == sorted(map(str, rows))
    left = D.clean(held, bench)
    assert left.columns == held.columns and left.count() == held.count() - 3
    assert D.clean(held, bench, block_chars=40).count() == held.count() - 3
    assert D.matches(held, bench.limit(0)).collect() == [] and D.matches(held.limit(0), bench).collect() == []
    assert D.clean(held, bench.limit(0)).count() == held.count()
