"""Page text: the ratios recomputed plainly, the article of every test page, pages without article, odd rows."""

import math
import re
from html import unescape

from roamframe.llm import html

PAGES = [
    "<div id=content><h1>Title</h1><p>An intro, of some words. It is short.</p><div class=body><p>Long text, a lot. Of it, this is most.</p><p>And more of that; it goes on.</p></div></div><div class=ad>Buy, now!</div><div>Links</div>",
    "<body><ul><li>one<li>two<li>three</ul><table><tr><td>A cell, with text. And more, of it.<td>Another, long one; yes.</table><footer>c 2020</footer></body>",
    "<main><p>Body text, with commas, and stops. It goes on for long.</p><p>Second, with stops. Also, some.</p></main><div class='comments'><p>First, nice. I liked it, a lot.</p></div>",
]


def plain_ratios(found, paths):
    """Means by path of Gaussian-smoothed length and punctuation, multiplied and weighed, without shared code."""
    own = {p: [t for q, (_, t) in zip(paths, found, strict=True) if q == p] for p in paths}
    length = {p: sum(map(len, x)) / len(x) for p, x in own.items()}
    marks = {p: sum(len(re.findall(r"[.,;:!?…。，、；：！？¿¡]", t)) for t in x) / len(x) for p, x in own.items()}

    def smooth(of, i):
        near = [k for k in range(i - 2, i + 3) if 0 <= k < len(paths)]
        w = [math.exp(-((k - i) ** 2) / 2) for k in near]
        return sum(a * of[paths[k]] for a, k in zip(w, near, strict=True)) / sum(w)

    of = [smooth(length, i) * (1 + smooth(marks, i)) * html.PRIOR[p[1]] for i, p in enumerate(paths)]
    return {p: sum(x for x, q in zip(of, paths, strict=True) if q == p) / len(own[p]) for p in own}


def test_ratios_against_a_plain_reading(spark, sf):
    pages = PAGES + [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").limit(60).collect() if r.html]
    for page in pages:
        found = html.blocks(page)
        paths = html._paths(found)
        want, got = plain_ratios(found, paths), html.ratios(found, paths)
        assert want.keys() == got.keys() and all(math.isclose(want[p], got[p], rel_tol=1e-9) for p in want)


def test_ratios_decide(spark, sf, monkeypatch):
    pages = PAGES + [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if r.html]
    with_ratios = [html.main_text(x) for x in pages]
    monkeypatch.setattr(html, "content_paths", lambda found, paths: set(paths))
    assert all(a != html.main_text(x) for a, x in zip(with_ratios, pages, strict=True))


def test_pages_without_article():
    assert html.main_text(PAGES[0]) == "Title\nAn intro, of some words. It is short.\nLong text, a lot. Of it, this is most.\nAnd more of that; it goes on."
    assert html.main_text(PAGES[2]) == "Body text, with commas, and stops. It goes on for long.\nSecond, with stops. Also, some."
    assert "A cell, with text." in html.main_text(PAGES[1]) and "2020" not in html.main_text(PAGES[1])


def test_wrappers_with_telling_names_keep_their_page():
    text = "<article><h1>T</h1><p>Some text, long enough. Yes, it is so, and goes on.</p><p>More of it, right here; a line.</p></article>"
    want = "T\nSome text, long enough. Yes, it is so, and goes on.\nMore of it, right here; a line."
    for page in ("<body class='has-sidebar'>{}", "<body class='sidebar'>{}", "<div class='menu'>{}</div>", "<div class='content share-enabled'>{}</div>", "<div id='main' class='comments-open comments'>{}</div>", "<div role=dialog>{}</div>"):
        assert html.main_text(f"{page.format(text)}<nav>Home, here</nav><footer>Imprint, and so on.</footer>") == want, page


def test_the_article_of_every_test_page(spark, sf):
    for r in html.extract(spark.read.parquet(f"{sf}/pages.parquet"), out="got").collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", r.html, re.DOTALL)[1]
        body = re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->", "", body, flags=re.DOTALL)
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", p))).split()) for p in re.split(r"</?(?:p|h1|div)\b[^>]*>", body)]
        assert r.got == "\n".join(p for p in parts if p), r.page_id


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, "", None), (None, "<p>" + "x, y. " * 50_000, "b"), (2, "<p>one, two.</p>", "c"), (2, "<p>one, two.</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = html.extract(pages, out="main")
    assert got.columns == [*pages.columns, "main"]
    assert [r.main for r in got.collect()] == ["", "", ("x, y. " * 50_000).strip(), "one, two.", "one, two."]
    assert html.extract(pages.limit(0)).count() == 0 and html.extract(pages).columns == pages.columns
