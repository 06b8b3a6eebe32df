import html
import itertools
import math
import re
import time

from plumbline.llm import html_extract as m
from plumbline.llm.html_pages import labelled_pages

MODEL = m.train()


def brute_marginals(model, page):
    """By summing over every labelling of the tree."""
    n = len(page.parent)
    total, yes = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        p = 1.0
        for i in range(1, n):
            odds = math.exp(min(25.0, max(-25.0, model.bias + sum(model.weights[f] for f in page.features[i]))))
            scale = (1 + odds) ** (model.evidence - 1)
            p *= ((scale, scale * odds) if y[page.parent[i]] else (1 - model.leak, model.leak))[y[i]]
        total += p
        for i in range(n):
            yes[i] += p * y[i]
    return [x / total for x in yes]


def test_messages_give_the_exact_marginals():
    for text in ("<div class=nav>a</div><article><p>long text here.<p>b</article>", "<body><ul><li>x<li><a href=/>y</a></ul><div>z", ""):
        page = m.parse(text)
        for e in (0.0, 0.1, 1.0):
            model = m.Model(m.np.array(MODEL.weights), MODEL.bias, 0.01, e)
            assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(model.marginals(page), brute_marginals(model, page)))


def test_held_out_labelled_pages():
    right = total = 0
    for text, labels in labelled_pages(150, seed=77):
        page = m.parse(text)
        got = [p > 0.5 for p, leaf in zip(MODEL.marginals(page), page.is_text) if leaf]
        total += len(labels)
        right += sum(bool(a) == bool(b) for a, b in zip(got, labels))
    assert right / total > 0.93


def test_parse_and_text():
    page = """<html><head><title>no</title><style>p{}</style><script>var t="</p>"</script></head><body><!-- x --><nav><a href=/>Menu</a></nav>
    <article><h1>A&amp;B  &lt;c&gt;</h1><p>One <b>two</b>\n three&nbsp;four<p>un<i>closed</i> 5 < 6<br>next<div class="advert">Buy now</div><ul><li>x y z<li>w.</ul></article>
    <section class="comments"><div class="comment"><p>Nice post, thanks to all of you.</p></div></section><form><label>Mail</label><input></form><footer>&copy; me</footer></body>"""
    assert MODEL.extract(page) == "A&B <c>\nOne two three four\nunclosed 5 < 6 next\nx y z\nw."


def test_tables_pages(spark):
    d = "/root/testdata/sf0.01"
    for r in m.query(spark, d).join(m.table(spark, d, "pages").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", body)]
        want = "\n".join(x for x in blocks if x)
        assert (r.text, r.n_chars) == (want, len(want))


def test_edge_cases(spark):
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "<article><p>" + "word " * 50000, None), (None, "<", "c"), (4, deep, ""), (5, "<p <p <<div", ""), (6, "<script>", "")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = {r.page_id: r for r in m.extract_text(df, MODEL).collect()}
    assert got[1].text == got[2].text == got[6].text == "" and got[1].n_chars == 0
    assert got[3].n_chars == 5 * 50000 - 1
    assert m.extract_text(df.limit(0), MODEL).collect() == []


def test_mathml_and_fallback_content_stay():
    page = "<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here, as all of us know.</p><p>A long line with <object>an object's text</object> inside of it.</p></article>"
    assert MODEL.extract(page) == "Energy is E=m here, as all of us know.\nA long line with an object's text inside of it."


def test_time_follows_the_length():
    """Ends without starts, open paragraphs below tables and lists of deep items take no walk over the stack."""
    for unit, end in (("<div>", "</zz>"), ("<p><table><div>", "</p>"), ("<li><zz>", "<li>"), ("<p><button><div>", "<div>")):
        began = time.time()
        m.parse(unit * 20_000 + end * 20_000)
        assert time.time() - began < 5


def test_text_column_as_html(spark):
    df = spark.createDataFrame([("<article><p>Some words of an article, in a page.</p></article>", 1)], "text string, k int")
    got = m.extract_text(df, MODEL, html="text")
    assert got.columns == ["k", "text", "n_chars"] and got.first().text == "Some words of an article, in a page."
