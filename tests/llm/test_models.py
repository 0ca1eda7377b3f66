"""Main text of pages and quality scores."""

from __future__ import annotations

import html
import re
import time
import zlib

import pytest

from docspark.llm import line_blocks, nbsvm
from docspark.llm.common import table

MEDIUM = "/root/testdata/sf0.01"


def expected_text(page: str) -> str:
    """The article of the test pages, split at block tags."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p|div|ul|li)\b[^>]*>", article)
    plain = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
    return "\n".join(b for b in plain if b)


def test_articles_of_the_test_pages(spark):
    pages = table(spark, MEDIUM, "pages")
    rows = line_blocks.extracted(pages).join(pages, "page_id").collect()
    assert len(rows) == pages.count()
    for row in rows:
        assert row.text == expected_text(row.html)


LONG = "A paragraph of running text that is long enough to stand out among the lines of a page, and more."
ASIDES = [
    "<header><h1>Site</h1><a href=/>home</a></header>", "<nav><ul><li>menu<li>more</ul></nav>",
    '<div class="sidebar"><p>' + LONG + "</p></div>", "<aside>" + LONG + "</aside>",
    '<div id="cookie-notice">We use cookies</div>', '<div class="ad">Buy now!</div>',
    "<form><label>Mail</label><input><button>Send</button></form>", "<script>if (a < b) '<p>x</p>'</script>",
    "<style>p{}</style>", "<!-- <p>comment</p> -->", '<section class="comments"><article class="comment"><p>' + LONG + "</p></article></section>",
    '<div role="navigation">path</div>', "<footer>&copy; owner</footer>", '<p hidden>hidden</p>', "<noscript>no</noscript>",
]
BODY = f"<h1>Title</h1><p>{LONG}</p><p>Short &amp;  plain,\n with <b>b</b><i>i</i> and <a href=x>a link</a>.</p><ul><li>one<li>two</ul><p>{LONG}<p>End."
TEXT = f"Title\n{LONG}\nShort & plain, with bi and a link.\none\ntwo\n{LONG}\nEnd."


@pytest.mark.parametrize("aside", ASIDES)
@pytest.mark.parametrize("frame", ["<article>{}</article>", '<main class="with-sidebar">{}</main>', '<div class="content">{}</div>'])
def test_what_is_no_article_goes(aside, frame):
    before = f"<html><head><title>t</title></head><body class='has-sidebar'>{aside}{frame.format(BODY)}</body></html>"
    after = f"<html><body>{frame.format(BODY)}{aside}"
    inside = f"<body>{frame.format(BODY.replace('<ul>', aside + '<ul>'))}</body>"
    assert line_blocks.main_text(before) == TEXT
    assert line_blocks.main_text(after) == TEXT
    if not aside.startswith("<header"):
        assert line_blocks.main_text(inside) == TEXT


def test_surge_and_dive():
    assert line_blocks.between_surge_and_dive([], 40) == (0, 0)
    assert line_blocks.between_surge_and_dive([0, 0], 40) == (0, 0)
    assert line_blocks.between_surge_and_dive([5, 0, 0, 0, 0, 90, 3, 80, 0, 0, 0, 0, 9], 40) == (5, 8)
    assert line_blocks.between_surge_and_dive([3], 40) == (0, 1)


def test_all_blocks_of_an_article_stay():
    links = "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(3))
    listed = "\n".join(f"Link number {i}" for i in range(3))
    body = f"<h1><a href=/t>Title</a></h1><p>{LONG}</p><ul>{links}</ul><p>{LONG}</p><p><a href=/s>Source</a></p>"
    text = f"Title\n{LONG}\n{listed}\n{LONG}\nSource"
    assert line_blocks.main_text(f"<article>{body}</article>") == text
    assert line_blocks.main_text(f"<article>{body}<ul>{links}</ul></article>") == f"{text}\n{listed}"
    menu = f"<div><ul>{links}{links}</ul></div>"
    assert line_blocks.main_text(f"<body>{menu}<div>{body}</div>{menu}</body>") == text
    assert line_blocks.between_surge_and_dive([500, 500, 0, 0, 0, 300, 300], 40) == (0, 7)


def test_a_long_paragraph_hides_no_other():
    assert line_blocks.between_surge_and_dive([200, 200, 200, 200, 200, 10000], 40) == (0, 6)
    assert line_blocks.between_surge_and_dive([10000, 200, 200, 200, 200, 200], 40) == (0, 6)
    paragraphs = [LONG] * 5 + [" ".join([LONG] * 20)] + [LONG] * 5
    page = "".join(f"<p>{p}</p>" for p in ["Short.", *paragraphs, "End."])
    menu = "<div>" + "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(5)) + "</div>"
    expected = "\n".join(["Short.", *paragraphs, "End."])
    assert line_blocks.main_text(f"<body>{menu}<div>{page}</div>{menu}</body>") == expected


KEPT = [
    '<article class="post category-promotion tag-social">{}</article>', '<article class="notice">{}</article>',
    '<div class="content-sidebar-wrap">{}</div>', '<div class="elementor-widget elementor-widget-text">{}</div>',
    '<div class="widget">{}</div>', '<div class="widget"><div class="social">{}</div></div>', "<form action=/>{}</form>",
    "<form><article>{}</article></form>", '<div class="share"><article>{}</article></div>', '<div role="form">{}</div>',
    '<main><div class="search">{}</div></main>',
]


@pytest.mark.parametrize("frame", KEPT)
def test_names_and_forms_take_no_article(frame):
    related = f'<section id="related-work"><p>{LONG}</p></section>'
    page = f"<body><nav><p>{LONG}</p></nav>{frame.format(BODY + related)}<div class='sidebar'>{LONG}</div></body>"
    assert line_blocks.main_text(page) == f"{TEXT}\n{LONG}"


@pytest.mark.parametrize("name", ["site-footer", "comments-area", "main-navigation", "share-buttons", "related-posts", "site-header"])
def test_names_with_places_and_parts(name):
    page = f"<body><div class='{name}'>{LONG}</div><div>{BODY}</div></body>"
    assert line_blocks.main_text(page) == TEXT


def test_comments_may_be_longer_than_the_article():
    comments = f'<section class="comments">{f"<article class=comment><p>{LONG}</p></article>" * 20}</section>'
    assert line_blocks.main_text(f"<article>{BODY}{comments}</article>") == TEXT
    assert line_blocks.main_text(f"<article>{BODY}</article>{comments}") == TEXT


@pytest.fixture(scope="module")
def scores(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    model = nbsvm.train(docs, labels)
    return {r.doc_id: r for r in nbsvm.scored(docs, model).collect()}


def test_held_out_accuracy(spark, scores):
    labels = {r.doc_id: r.quality for r in table(spark, MEDIUM, "labels").collect()}
    out = [r for d, r in scores.items() if d in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in scores.items())
    assert len(out) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert sum(r.predicted == labels[r.doc_id] for r in out) >= 0.95 * len(out)
    good = [r.score for r in out if labels[r.doc_id]]
    bad = [r.score for r in out if not labels[r.doc_id]]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_held_out_labels_are_not_read(spark, scores):
    docs = table(spark, MEDIUM, "documents")
    labels = table(spark, MEDIUM, "labels")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    again = nbsvm.scored(docs, nbsvm.train(docs, flipped))
    assert {r.doc_id: round(r.score, 9) for r in again.collect()} == {d: round(r.score, 9) for d, r in scores.items()}


def test_one_class_scores_its_mean(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id bigint, text string")
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    assert nbsvm.train(docs, ones) == 1.0
    assert nbsvm.train(docs, ones.limit(0)) == 0.5
    assert {r.score for r in nbsvm.scored(docs, 0.5).collect()} == {0.5}


@pytest.mark.parametrize("piece", [3, 700, 5000])
def test_pieces_of_a_long_text_change_no_feature(monkeypatch, piece):
    texts = [" ".join(f"Word{i % 90}, {i % 7}!" for i in range(3000)), "x" * 20_000 + "\n y y \t" + "Z" * 900 + "! "]
    whole = [nbsvm.features(t).tolist() for t in texts]
    monkeypatch.setattr(nbsvm, "PIECE", piece)
    assert [nbsvm.features(t).tolist() for t in texts] == whole
    assert len(nbsvm.features(None)) == len(nbsvm.features(" \n ")) == 0


@pytest.mark.parametrize(
    "page",
    ["<p>it's <b 'x \"" * 70_000, "<b>" * 170_000 + "</i>" * 120_000, "<b a=\"" * 160_000, "<b a='x \"" * 100_000, "<a x = ' > y" * 80_000],
)
def test_malformed_pages_of_a_megabyte_are_read_in_one_pass(page):
    started = time.process_time()
    line_blocks.main_text(page)
    assert time.process_time() - started < 5  # the quadratic scanner took minutes


def test_quotes_that_are_never_closed():
    assert line_blocks.main_text('<article><p class="x>Hello</p><p>World</p></article>') == "Hello\nWorld"
    assert line_blocks.main_text("<article><p it's>Hello</p><p title='a > b'>World</p></article>") == "Hello\nWorld"
