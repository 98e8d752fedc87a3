"""Extraction on pages of many kinds: what is an article's comes back whole, and nothing else."""

import itertools
import random

import pytest

from tidemark.llm import extract, warc

PROSE = "The council met on Tuesday, and after a long debate it was agreed that the old mill by the river should be kept as it is."
OTHER = "In the end the members of the board said that they had not been told of the plan, which was made in another town."


def text(html):
    return extract.main_text(html)[0]


@pytest.mark.parametrize(
    "page",
    [
        "<body><form action='/' method=post><input type=hidden name=x><h1>Head</h1><p>{0}</p><p>{1}</p></form></body>",
        "<body><form id=aspnetForm><div><h1>Head</h1><p>{0}</p><div><p>{1}</p></div></div></form><div><a href=/>Short</a></div></body>",
        "<body><a name='top'><h1>Head</h1><p>{0}</p><p>{1}</p></body>",
        "<body><a id=x><h1>Head</h1><a name=y><p>{0}</p></a><p><a name=z>{1}</p></body>",
        "<body><h1>Head</h1><p><a href=/x>Here</a> {0}</p><p>{1}</p></body>".replace("<a href=/x>Here</a> ", ""),
        "<body><article data-hidden='0'><h1>Head</h1><p>{0}</p><p>{1}</p></article></body>",
        "<body><article hidden-x data-class='sidebar' data-role=related><h1>Head</h1><p>{0}</p><p>{1}</p></article></body>",
        "<body><div title='a hidden class=\"sidebar\" thing'><h1>Head</h1><p>{0}</p><p>{1}</p></div></body>",
        "<body><div data-id='comments' data-style='display:none'><h1>Head</h1><p>{0}</p><p>{1}</p></div></body>",
        "<body><noscript><h1>Head</h1><p>{0}</p><p>{1}</p></noscript><script>x()</script></body>",
    ],
)
def test_whole_pages_come_back(page):
    assert text(page.format(PROSE, OTHER)) == f"Head\n\n{PROSE}\n\n{OTHER}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><div><p>The rose is red,</p><p>the sky is wide,</p><p>and all the ships come in.</p></div></body>", ["The rose is red,", "the sky is wide,", "and all the ships come in."]),
        ("<body><h1>Soup</h1><ul><li>Two onions</li><li>Salt</li></ul><p>Cut and boil.</p></body>", ["Soup", "Two onions", "Salt", "Cut and boil."]),
        ("<body><nav><a href=/>Home</a></nav><p>- Who is there?</p><p>- No one.</p><footer>Imprint</footer></body>", ["- Who is there?", "- No one."]),
    ],
)
def test_pages_of_short_blocks(page, want):
    assert text(page) == "\n\n".join(want)


def test_formulas_stay_in_their_sentence():
    page = f"<article><p>{PROSE} So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> holds.</p></article>"
    assert text(page) == f"{PROSE} So x=2 holds."


def test_a_sentence_of_links_goes_with_its_neighbours():
    links = "<p>It was <a href=/a>reported by the paper of the town</a> and <a href=/b>by others that were there</a> on the day.</p>"
    plain = "It was reported by the paper of the town and by others that were there on the day."
    assert text(f"<body><p>{PROSE}</p>{links}<p>{OTHER}</p></body>") == f"{PROSE}\n\n{plain}\n\n{OTHER}"
    assert text(f"<body><p>{PROSE}</p><div><ul><li><a href=/1>One of the many things to read</a></li><li><a href=/2>Two</a></li></ul></div></body>") == PROSE


#: Parts of pages that are no article, wherever they stand.
NOISE = [
    "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us and our work</a></li></ul></nav>",
    "<header><a href=/><img src=l.png></a><p>{0}</p></header>",
    "<footer><p>{0}</p><p>Copyright 2024 The Paper</p></footer>",
    "<aside><h3>Read on</h3><p>{0}</p></aside>",
    "<div class='sidebar'><p>{0}</p></div>",
    "<div class=\"ad-banner\"><p>{0}</p></div>",
    "<div id=comments><div class=comment><p>{0}</p></div></div>",
    "<div class='cookie-notice'><p>{0}</p></div>",
    "<form action=/s><label>Search</label><input name=q><button>Go</button></form>",
    "<script>var a = '<p>{0}</p>';</script>",
    "<style>p {{ color: red }}</style>",
    "<div style='display: none'><p>{0}</p></div>",
    "<div hidden><p>{0}</p></div>",
    "<div class='discussion'><p>{0}</p></div>",
    "<!-- <p>{0}</p> -->",
    "<template><p>{0}</p></template>",
]
#: Ways in which pages hold an article of a head and three paragraphs.
FORMS = [
    "<article><h1>{h}</h1>{body}</article>",
    "<main><h1>{h}</h1>{body}</main>",
    "<div class='post entry-content'><h1>{h}</h1>{body}</div>",
    "<div id=wrap><div class='content has-sidebar'><h1>{h}</h1>{body}</div></div>",
    "<section><article class='news'><header><h1>{h}</h1></header>{body}</article></section>",
    "<table><tr><td><h1>{h}</h1>{body}</td></tr></table>",
]


@pytest.mark.parametrize("k", range(len(FORMS)))
def test_generated_pages(k):
    rng = random.Random(k)
    words = "the of and a to in is was that it for on with as his they at be this from have or by one had not but what all were when we there can an".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(18, 30))).capitalize() + "."
    for form in (FORMS[k],):
        for n in itertools.chain(range(len(NOISE)), range(100, 140)):
            noise = [NOISE[n]] if n < 100 else rng.sample(NOISE, rng.randrange(1, 6))
            paragraphs = [sentence() for _ in range(3)]
            head = "A head for this page"
            inner = "".join(f"<p>{p}</p>" if rng.random() < 0.7 else f"<p>{p.replace(' the ', ' <b>the</b> ')}" for p in paragraphs)
            cut = rng.randrange(len(noise) + 1)
            wrong = [x.format(sentence()) for x in noise]
            page = f"<!doctype html><html><head><title>x</title></head><body>{''.join(wrong[:cut])}{form.format(h=head, body=inner)}{''.join(wrong[cut:])}</body></html>"
            assert text(page) == "\n\n".join([head, *paragraphs]), page


@pytest.mark.parametrize("inside", ["<p class='cookie-notice'>{0}</p>", "<p class=newsletter-signup>{0}</p>", "<div class='ad'>{0}</div>", "<div class=comments><p>{0}</p></div>", "<form><p>{0}</p></form>"])
def test_what_an_article_holds_of_others_goes(inside):
    assert text(f"<body><article><p>{PROSE}</p>{inside.format('Not this, as it is none of the article that was to be read here.')}<p>{OTHER}</p></article></body>") == f"{PROSE}\n\n{OTHER}"


def test_rows_without_an_id_have_none(spark, tmp_path):
    """Null ids come back as null, whatever the record is called; a very long payload comes back whole."""
    long = "é<p>WARC/1.0\r\n</p>" * 200_000
    rows = [(None, "u", f"<p>{i % 3}</p>" + "x" * (2000 * (i % 2))) for i in range(40)] + [(-7, None, long), (3, "u", long), (9, "v", "y" * 1500), (8, "w", "y" * 1500)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op3_warc(spark, str(tmp_path)).collect()
    assert sorted(((r.page_id, r.payload_bytes) for r in got), key=str) == sorted(((i, len((h or "").encode())) for i, _, h in rows), key=str)
    assert {r.page_id: (r.record_type, r.refers_to) for r in got if r.page_id is not None} == {-7: ("revisit", 3), 3: ("response", None), 9: ("response", None), 8: ("revisit", 9)}
