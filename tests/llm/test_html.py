import html as H
import re
import time

import numpy as np
import pytest

from salesengine.llm import html_extract as X
from salesengine.llm import queries
from salesengine.llm.html_training import training_page
from tests.llm.helpers import SF001, read


@pytest.fixture(scope="module")
def model():
    return X.model()


def test_registered_query_on_whole_pages(spark):
    got = {r["page_id"]: r for r in queries.op7_html(spark, SF001).collect()}
    pages = read("pages")
    assert len(got) == len(pages)
    for i, url, html in zip(pages["page_id"], pages["url"], pages["html"], strict=True):
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (url, want, len(want))


def test_layouts_not_seen_in_training(model):
    rng = np.random.default_rng(12345)
    right = runs = wrong = 0
    for _ in range(120):
        page = training_page(rng)
        t = X.tree(page)
        want = [x.replace(X.MARK, "") for x in t.text if X.MARK in x]
        got = [x for x in X.texts([page.replace(X.MARK, "")], model)[0].split("\n") if x]
        right += got == want
        runs += len(want)
        wrong += len(set(got) ^ set(want))
    assert right >= 0.8 * 120 and wrong <= 0.06 * runs


def test_decoding_is_the_best_closed_set():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        parent = [-1, *(int(rng.integers(k)) for k in range(1, n))]
        odds = rng.normal(0, 1, n)
        best = max((sum(odds[k] for k in range(n) if m >> k & 1) for m in range(1 << n) if all(not m >> k & 1 or k == 0 or m >> parent[k] & 1 for k in range(n))))
        kept = X.decode(parent, odds)
        assert all(not kept[k] or k == 0 or kept[parent[k]] for k in range(n))
        assert abs(odds[kept].sum() - best) < 1e-9


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = X.Boosted(trees=40, depth=4, share=1.0).fit(x[:2000], y[:2000])
    assert ((m.odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_tree_repairs_markup():
    t = X.tree("<div>a<p>b<p><b>c<br>d<ul><li>e<li>f</ul></b></div>g<table><tr><td>h<td>i<tr><td>j</table><script>x<p></script>&amp;&eacute;&nbsp;k")
    assert [x for x in t.text if x] == ["a", "b", "c d", "e", "f", "g", "h", "i", "j", "&é k"]
    assert all(p < k for k, p in enumerate(t.parent))


def test_edges(spark, model):
    pages = [None, "", "   ", "no markup at all, just words.", "<![weird[ <p>x", "</div></p><<>>&#xZZ;", "<div>" * 3000 + "x" + "</div>" * 3000, "<p>" + "word " * 100_000]
    assert len(X.texts(pages, model)) == len(pages)
    assert X.texts(pages[:3], model) == ["", "", ""]
    df = spark.createDataFrame([(k, "u", p, "kept") for k, p in enumerate(pages)] + [(0, "u", None, "kept")], "page_id long, url string, html string, `odd name` string")
    out = X.extract(df, "page_id", "odd name")
    assert out.columns == ["page_id", "odd name", "text", "n_chars"] and out.count() == len(pages) + 1
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert X.extract(df.limit(0), "page_id").count() == 0
    with pytest.raises(ValueError):
        X.extract(df.withColumnRenamed("odd name", "text"), "text")


def test_notices_comments_forms_and_sidebars(model):
    body = "".join(f"<p>{'Main sentence number %d goes on for a while, as they do. ' % k * 3}</p>" for k in range(5))
    page = f"""<body class="has-sidebar"><div class="cookie-notice"><p>We use cookies to improve things for you.</p><button>OK</button></div>
    <header><a href="/">Site</a><form><label>Search</label><input></form></header><div id="sidebar"><p>Most read today</p><ul><li><a href=x>One</a></ul></div>
    <main><article><h1>Title here</h1>{body}<div class="advertisement"><p>Buy this thing now, it is a very good thing.</p></div><p>Short.</p></article></main>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this text very much, thanks a lot.</p></div></section><footer><p>&copy; Someone</p></footer></body>"""
    out = X.texts([page], model)[0].split("\n")
    assert out[0] == "Title here" and out[-1] == "Short." and len(out) == 7


@pytest.mark.parametrize("tag", ["math", "svg", "canvas", "object", "audio", "video", "noscript"])
def test_text_in_embedded_elements_is_judged(model, tag):
    body = "".join(f"<p>{'Main sentence number %d goes on for a while, as they do. ' % k * 3}</p>" for k in range(5))
    inner = f"<p>The result is <{tag}><g>formula text inside</g></{tag}> as was shown above, which nobody had expected then.</p>"
    out = X.texts([f"<body><main><article><h1>Title here</h1>{body}{inner}</article></main></body>"], model)[0]
    assert "formula text inside" in out


def test_whole_attribute_values_are_read():
    t = X.tree(f'<div class="{"u-flex " * 100}comments"><p>x</p></div>')
    assert t.attrs[1] == X._tokens("comments") != 0


DEEP = {
    "nested blocks": "<div>" * 16_000 + "x", "inline and blocks": "<b><div>" * 8000 + "x", "open comments": "x <!--" * 40_000, "items": "<ul>" + "<li>a" * 20_000,
    "paragraphs": "<p>x<div>" * 8000, "lists": "<ul><li>" * 8000 + "x", "tables": "<table><tr><td>" * 3000 + "x", "links": "<a>" * 30_000 + "x",
    "declarations": "<!x " * 20_000, "open tags": "x <a " * 20_000, "scripts": "<script>a <!-- </script>x" * 5000,
}


@pytest.mark.parametrize("name", sorted(DEEP))
def test_time_grows_with_the_page(name):
    began = time.process_time()
    found = X.features(X.tree(DEEP[name]))
    assert time.process_time() - began < 3 and len(found)


def test_open_ends_are_read_as_browsers_do():
    def text(html):
        return " ".join(x for x in X.tree(html).text if x)

    assert text("<p>one<!-- two --> three <!-- four") == "one three"
    assert text("<p>one<!--> two") == "one two"
    assert text("<p>one <a href='x") == "one" and text("<p>1 < 2") == "1 < 2"
    assert text("<script>if (a <!-- b) </script><p>kept") == "kept"
    assert text("<ul><li>a<div>b<li>c</ul>d") == "a b c d"
