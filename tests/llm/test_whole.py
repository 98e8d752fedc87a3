"""Operators where they once left a part of their job out."""

import hashlib
import random
import re

import pytest

from tidemark.llm import extract, lines, tokens, warc


def test_line_dedup_of_documents_that_are_mostly_boilerplate(spark):
    notice = "A long notice that stands on every site and outweighs the text of the short pages around it."
    rows = [(i, f"own {i}\n{notice}\n\nend {i}", f"site{i}") for i in range(12)] + [(20, notice, None), (21, f"{notice}\n{notice}\nx", "site0"), (22, "own text only", "site1")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_lines_removed) for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: (f"own {i}\n\nend {i}", 4, 1) for i in range(12)} | {20: ("", 1, 1), 21: ("x", 3, 2), 22: ("own text only", 1, 0)}


PROSE = "It was the first time that the people of the town had seen such a thing, and they said so to all who would listen to them in the days that came after it."


@pytest.mark.parametrize("page", ["<div class='content has-sidebar'>{}</div>", "<div class='no-sidebar'>{}</div>", "<article class='post comments-open'>{}</article>", "<div id='page' class='nav-fixed'><article>{}</article></div>", "<div class='widget'><main class='search'>{}</main></div>"])
def test_extraction_keeps_articles_in_named_wrappers(page):
    assert extract.main_text(f"<html><body>{page.format(f'<p>{PROSE}</p>')}</body></html>")[0] == PROSE


@pytest.mark.parametrize("name", ["entry-header", "post-header", "header"])
def test_extraction_keeps_titles(name):
    assert extract.main_text(f"<article><div class='{name}'><h1>The title</h1></div><p>{PROSE}</p></article>")[0] == f"The title\n\n{PROSE}"


@pytest.mark.parametrize("other", ["<div class='ad'>{}</div>", "<div class='box sidebar'>{}</div>", "<nav><article>{}</article></nav>", "<div hidden><article>{}</article></div>"])
def test_extraction_still_leaves_named_parts_out(other):
    assert extract.main_text(f"<body>{other.format(f'<p>Not this: {PROSE}</p>')}<p>{PROSE}</p></body>")[0] == PROSE


PLAIN = "The people of the town had been there for a long time, and they said that it was not the first time that the river had risen over the road by the mill."
RUSSIAN = "Жители города давно привыкли к тому, что река каждую весну выходит из берегов и заливает дорогу у старой мельницы, а потом снова уходит обратно в своё русло."
CHINESE = "小镇的居民早已习惯了每年春天河水漫过堤岸，淹没旧磨坊旁的道路，然后又慢慢退回河道。老人们说，这样的事情他们一生中见过许多次，孩子们却总是觉得新奇。"


@pytest.mark.parametrize("prose", [PLAIN, RUSSIAN, CHINESE])
@pytest.mark.parametrize("form", ["<body><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><div><h1>Head</h1><p>{0}</p><p>{0}</p></div><div class='site-footer'>{0}</div></body>", "<nav><a href=1>Menu</a></nav><article><h1>Head</h1><p>{0}<p>{0}</article><aside>{0}</aside>", "<main><h1>Head</h1><table><tr><td>{0}<td>{0}</table></main><form>{0}</form>"])
def test_extraction_in_languages_without_a_word_list(prose, form):
    assert extract.main_text(form.format(prose))[0] == f"Head\n\n{prose}\n\n{prose}"


def test_extraction_keeps_what_an_article_calls_its_own():
    page = f"<article><div class='entry-header'><h1>Head</h1></div><p class='related-work'>Related work.</p><section id='review'><p>{PLAIN}</p></section><p class='notice'>Mind this.</p><p>See <a href=x>the long report of the commission</a> now.</p></article>"
    assert extract.main_text(page)[0] == f"Head\n\nRelated work.\n\n{PLAIN}\n\nMind this.\n\nSee the long report of the commission now."


@pytest.mark.parametrize("other", ["<div class='cookie-banner'><p>{}</p></div>", "<div id='sidebar-left'>{}</div>", "<ol class='comment-list'><li><article class='comment'><p>{}</p></article></ol>", "<div class='ad-slot'><p>{}</p></div>", "<div class='newsletter-signup'>{}</div>", "<p class='ad'>{}</p>"])
@pytest.mark.parametrize("form", ["<body><div class='content'><p>{1}</p>{0}<p>{1}</p></div></body>", "<article><p>{1}</p>{0}<p>{1}</p></article>"])
def test_extraction_leaves_compound_names_out(form, other):
    assert extract.main_text(form.format(other.format(f"Not this: {PLAIN}"), PLAIN))[0] == f"{PLAIN}\n\n{PLAIN}"


def test_extraction_of_a_title_in_front_and_of_a_teaser():
    assert extract.main_text(f"<body><h1>Head</h1><article><p>{PLAIN}</p></article></body>")[0] == f"Head\n\n{PLAIN}"
    assert extract.main_text(f"<body><div>{f'<p>{PLAIN}</p>' * 9}</div><article><p>Teaser.</p></article></body>")[0].count(PLAIN) == 9


def test_extraction_of_deep_and_long_pages():
    n = 60_000
    assert extract.main_text("<div>" * n + PLAIN + "</div>" * n)[0] == PLAIN
    assert extract.main_text("<article><p>" + "<b>" * n + f"<p>{PLAIN}</p>" * 1000)[0].count(PLAIN) == 1000
    assert len(extract.main_text("<article><p>" + (PLAIN + " ") * 50_000)[0]) == 50_000 * (len(PLAIN) + 1) - 1


def test_archive_read_with_other_splits_the_second_time(spark, tmp_path, monkeypatch):
    inner = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
    pages = [(i, f"http://a/{i}", inner * (i % 7) + f"{i} " * 400) for i in range(60)] + [(None, "u", inner), (None, "u", inner)]
    warc.write_archive(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2), str(tmp_path / "w"), compression="none")
    whole, plain = warc._candidates, spark.conf.get("spark.sql.files.maxPartitionBytes")
    sizes = iter(["3000", "7000", "11000"])

    def candidates(spark, path):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes))
        return whole(spark, path)

    monkeypatch.setattr(warc, "_candidates", candidates)
    try:
        got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", plain)
    assert next(sizes) == "11000"
    assert sorted(r.payload_digest for r in got) == sorted(hashlib.sha1(h.encode()).hexdigest() for _, _, h in pages)
    assert len({r.record_id for r in got}) == len(pages)


def test_overfull_leaves_are_split():
    counter = tokens.Counter.__new__(tokens.Counter)
    counter.pattern = counter.ascii = re.compile(r"\w|\W")
    counter.known, counter.count = {}, lambda piece: 1
    text = "ab" * 500
    chars, counts = map(tokens.tree, tokens.leaves(text, counter))
    rng = random.Random(1)
    for k in range(40):
        at = rng.randrange(len(text))
        text, n, chars, counts = tokens.edit(text, chars, counts, at, min(len(text), at + 5), "xyz" * (400 if k % 8 == 0 else 1), counter)
        size = len(chars) // 2
        assert chars[1] == counts[1] == len(text) and chars[size:].max() <= 2 * tokens.LEAF + tokens.LEAF
        assert n <= 4 * tokens.LEAF or k % 8 == 0
