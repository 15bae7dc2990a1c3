import html
import re
import time

import data
import numpy as np
import pytest

from incognita.llm import op12_html as op

LONG = "Ordinary sentences of an article go on for a while, with commas and a full stop at their end. " * 3


def brute(source):
    """By regular expressions, for pages whose article is marked and holds nothing else."""
    found = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)
    if not found:
        return ""
    blocks = [html.unescape(re.sub(r"</?b>|<br>", " ", x)) for x in re.split(r"</?(?:p|h1)>", found[1])]
    return "\n".join(" ".join(x.split()) for x in blocks if x.strip())


def test_pages_of_the_table(spark):
    rows = op.op12_html(spark, "/root/testdata/sf0.001").collect()
    given = {r.page_id: r for r in op.table(spark, "/root/testdata/sf0.001", "pages").collect()}
    assert len(rows) == len(given) > 0
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (given[r.page_id].url, brute(given[r.page_id].html), len(r.text))


@pytest.mark.parametrize(
    "page, blocks",
    [
        (None, []),
        ("", []),
        ("  \n\t ", []),
        ("no tags at\n all &amp; &#x41;&nbsp;b", ["no tags at all & A b"]),
        (f"<p>{LONG}<p>Short.</p><p></p>", [LONG.strip(), "Short."]),
        (f"<article><h1>T</h1><p>{LONG}<b>x</b>y<br>z", ["T", LONG.strip() + " xy z"]),
        (f"<article><p>{LONG}</p><p>end <a href='x", [LONG.strip(), "end"]),
        (f"<article><p>{LONG}</p><!-- <p>never ended", [LONG.strip()]),
        (f"<article><p>{LONG}</p><p>3 < 4 <", [LONG.strip(), "3 < 4 <"]),
        (f"<script>var x='<p>no</p>'</script><style>p{{}}</style><p>{LONG}</p><script>open", [LONG.strip()]),
        (f"<form id=f><article><p>{LONG}</p><form><label>Name</label><input></form></article></form>", [LONG.strip()]),
        (f"<article><p>{LONG}</p><article><p>I, a reader, say {LONG}</p></article></article>", [LONG.strip()]),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p><aside>Side {LONG}</aside></article><footer>{LONG}</footer>", ["T", LONG.strip()]),
        (f"<nav>{LONG}</nav><main><p>{LONG}</p><ul><li>one<li>two</ul></main>", [LONG.strip(), "one", "two"]),
        (f"<article><p>a<span class='ad-slot'><span>buy</span> now</span> b</p><p>{LONG}</p></article>", ["a b", LONG.strip()]),
        (f"<article><p>x</p><p>{LONG * 200}</p><p>y</p></article>", ["x", (LONG * 200).strip(), "y"]),
    ],
)
def test_odd_pages(page, blocks):
    assert op.main_blocks(page) == blocks


@pytest.mark.parametrize(
    "other",
    [
        '<div class="cookie-notice"><p>{}</p></div>', '<div id="sidebar"><p>{}</p></div>', '<section class="reader-comments"><h2>2 comments</h2><article><p>{}</p></article></section>',
        '<div class="advert"><p>{}</p></div>', '<header><p>{}</p></header>', '<footer><p>{}</p></footer>', '<form><p>{}</p></form>', '<div hidden><p>{}</p></div>',
        '<div role="alert"><p>{}</p></div>', '<div style="display: none">{}</div>', "<noscript>{}</noscript>", '<ul class="main-menu"><li>{}</li></ul>', '<div class="newsletterSignup">{}</div>',
    ],
)
def test_what_is_no_article(other):
    thing, body = other.format(LONG), f"<h1>Title</h1><p>{LONG}</p><p>Short.</p>"
    want = ["Title", LONG.strip(), "Short."]
    for page in (f"<body>{thing}<article>{body}</article></body>", f"<body><article>{body}</article>{thing}", f"<div>{thing}<div id=x>{body}</div></div>"):
        assert op.main_blocks(page) == want
    if "header" not in other:
        assert op.main_blocks(f"<article><h1>Title</h1><p>{LONG}</p>{thing}<p>Short.</p></article>") == want


def test_ratios_find_the_article_without_any_names():
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(40))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p><p>Ok.</p><p>{LONG}</p></div><div><a>Imprint</a> <a>Contact</a></div></body>"
    assert op.main_blocks(page) == ["Title", LONG.strip(), LONG.strip(), "Ok.", LONG.strip()]


def test_smoothing_and_threshold_against_loops():
    ratios = np.random.default_rng(3).gamma(1.0, 3.0, 50)
    reach = int(np.ceil(3 * op.SIGMA))
    kernel = [np.exp(-(j * j) / (2 * op.SIGMA**2)) for j in range(-reach, reach + 1)]
    want = [sum(k * ratios[min(max(i + j, 0), 49)] for j, k in zip(range(-reach, reach + 1), kernel, strict=True)) / sum(kernel) for i in range(50)]
    assert np.allclose(op.smoothed(ratios), want)
    assert op.content_lines(ratios).tolist() == [w >= op.LEVEL * np.mean(want) for w in want]
    assert op.content_lines(np.array([2.0])).tolist() == [True]
    assert op.content_lines(np.array([])).tolist() == []


@pytest.mark.parametrize("bit", ["<", "<a ", "<b>", "</i>", "<i><p>", "<li>", "<!--", "&", "<a b='", "<div>", "<td>", "<script>", "<span class=ad>"])
def test_long_odd_pages_take_linear_time(bit):
    begun = time.time()
    op.main_blocks(bit * 30_000 + "text")
    op.main_blocks("<i>" * 20_000 + bit * 20_000 + "</i>" * 20_000)
    assert time.time() - begun < 20


def test_frame(spark):
    rows = [(1, "u", f"<p>{LONG}</p>", 7), (1, "u", f"<p>{LONG}</p>", 7), (None, None, None, None), (2, "", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")
    out = sorted(data.listed(op.extract(pages)), key=str)
    assert out == sorted([(1, "u", f"<p>{LONG}</p>", LONG.strip(), len(LONG.strip()))] * 2 + [(None, None, None, "", 0), (2, "", "", "", 0)], key=str)
    assert op.extract(pages.limit(0)).collect() == []
    named = pages.select("page_id", pages.html.alias("Text"), pages.url.alias("source_html"))
    assert op.extract(named, html="Text").columns == ["page_id", "source_html", "text", "n_chars"]
    many = spark.range(1200).selectExpr("id AS page_id", "IF(id % 3 = 0, NULL, concat('<p>page ', id)) AS html").coalesce(1)
    assert sorted(data.listed(op.extract(many).select("page_id", "text"))) == [(i, "" if i % 3 == 0 else f"page {i}") for i in range(1200)]
