"""Operator 7, HTML extraction by two-pass block rules.

A helper cuts each page into blocks. Pass one labels a block by stop-word density, length and link density; pass two
gives ambiguous blocks the label of their nearest decided neighbours in the same part of the page. Where the page's
prose isn't in a language of the stop words, length and link density decide alone.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements of HTML by role.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas annotation annotation-xml xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button select option label fieldset head".split())
FORMS = frozenset("form fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open blocks that the start of another ends; a paragraph is ended by any.
ENDED_BY = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}}
#: Words of names in class, id and role that mark a part of a page as no article, and words that may stand beside them.
INTRUDERS = frozenset("cookie cookies consent gdpr newsletter subscribe subscription signup popup modal".split())
ADS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
HEADS = frozenset("header masthead".split())
#: Marks of readers' talk, but in an article the name of a section.
TALK = frozenset("discussion discussions".split())
MARKS = ADS | COMMENTS | HEADS | INTRUDERS | TALK | frozenset("sidebar menu nav navbar navigation breadcrumb breadcrumbs footer notice notices alert overlay login search share sharing social related recommended recommendations widget widgets pagination pager toolbar copyright legal disclaimer contentinfo complementary hidden skip".split())
BESIDE = frozenset("area articles bar bottom box block body bottom button buttons card col column container content form group head holder inner item items left link links list main mobile outer page panel post posts primary right row secondary section site slot stories text title top unit wrap wrapper".split())
OWN_HEADS = frozenset("article blog content entry news page post section story title".split())
#: Left out with all they hold; left out by name only, but for articles inside.
OUT, NAMED = 2, 1
#: Attributes one after another, so that a name inside a value, or at the end of another name, is none.
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
ASKED = frozenset("class id role style hidden aria-hidden href".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
WORD = re.compile(r"[^\W\d_]+")
#: Frequent function words of the languages handled.
STOP = frozenset(
    "a an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our she so than that the their there these they this to was we were what when which who will with would you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous à été "
    "aber als am an auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist kann mit nach nicht noch nur oder sich sie sind so um und von vor war wie wir zu zum zur über "
    "al como con del desde donde el ella ellos era es esta este fue ha hasta hay las lo los me mi muy más no nos o para pero por porque quien se sin sobre su sus también te tiene todo un una y ya".split()
)
LONG, SHORT, DENSE, SPARSE, LINKED = 200, 70, 0.3, 0.2, 0.35
#: Shares of a block's text in links beyond which it is no text of an article: paragraphs, and others such as list items.
LINKED_PARAGRAPH, LINKED_ITEM = 0.9, 0.8
#: Share of stop words in a page's prose from which on the word list fits its language.
FITS = 0.15
#: Characters that say as much as three letters.
WIDE = re.compile(r"[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")
ENDS = re.compile(r"[.!?…。！？।][\"'”’»)\]]*$")
RIGHTS = re.compile(r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)


@lru_cache(maxsize=65536)
def mark(name: str) -> frozenset[str]:
    """The marks in a name such as ``cookie-banner``, if it has only marks and words that may stand beside them (``has-sidebar`` has not)."""
    parts = [w for w in re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w and not w.isdigit()]
    parts = [w for w in ("".join(parts),) if w in MARKS] or parts
    found = frozenset(w for w in parts if w in MARKS)
    if not found or any(w not in MARKS and w not in BESIDE and w not in OWN_HEADS for w in parts):
        return frozenset()
    return found - HEADS if found & HEADS and any(w in OWN_HEADS for w in parts) else found


def _left_out(tag: str, attrs: dict[str, str], part: int, forms: bool) -> int:
    """Whether an element is left out: OUT, NAMED, or 0. With ``forms``, a form is but a wrapper."""
    hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").lower().replace(" ", "")
    if tag in OUTSIDE and not (forms and tag in FORMS) or tag == "header" and not part or hidden:
        return OUT
    if tag in ("html", "body", "main"):
        return 0
    found = frozenset().union(*(mark(x) for k in ("class", "id", "role") for x in attrs.get(k, "").split()))
    if part:  # an article's headings and paragraphs are its own, whatever they are called, and so is its header
        found = found & (ADS | INTRUDERS) if tag == "p" else frozenset() if tag in HEADINGS else found - HEADS - TALK
    if found & COMMENTS:
        return OUT
    if not found or tag == "article":
        return 0
    return OUT if part else NAMED


def blocks_of(html: str, names: bool = True, forms: bool = False, raw: frozenset[str] = RAW) -> list[tuple[str, int, str, int]]:
    """``(text, characters in links, tag, part)`` of each block outside menus, forms and the like. part: 0 outside any article, else the article's number.

    Without ``names``, what is left out by name only comes along; with ``forms``, what stands in forms; elements of
    ``raw`` are skipped unread. Every step looks at the top of its stack only, so
    work follows the page's length however deep it is nested.
    """
    out: list[tuple[str, int, str, int]] = []
    stack: list[tuple[str, int, int, str]] = [("", 0, 0, "")]  # tag, how it is left out, part, tag of the block or heading around
    opened: list[int] = []  # places of blocks in the stack
    count: dict[str, int] = {}
    buf: list[str] = []
    linked: list[int] = [0]
    parts, at = 0, 0

    def flush() -> None:
        if buf:
            text = " ".join(unescape("".join(buf)).split())
            if text:
                out.append((text, linked[0], stack[-1][3], stack[-1][2]))
            buf.clear()
        linked[0] = 0

    def close(i: int) -> None:
        while len(stack) > i:
            count[stack.pop()[0]] -= 1
        while opened and opened[-1] >= i:
            opened.pop()

    def end_inline(tag: str) -> None:
        """An inline element ends, and those in it, but no block around it."""
        if count.get(tag):
            i, floor = len(stack) - 1, opened[-1] if opened else 0
            while i > floor and stack[i][0] != tag:
                i -= 1
            if i > floor:
                close(i)

    def add(text: str) -> None:
        if text and not stack[-1][1]:
            buf.append(text)
            if count.get("a"):
                linked[0] += len(text.strip())

    n = len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
                while count.get(tag):
                    found = stack[opened[-1]][0]
                    close(opened[-1])
                    if found == tag:
                        break
            else:
                end_inline(tag)
            continue
        if tag in raw:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK:
            flush()
            ended = ENDED_BY.get(tag, {"p"})
            while opened and stack[opened[-1]][0] in ended:
                close(opened[-1])
        elif tag in ("br", "img"):
            add(" ")
        if tag in VOID:
            continue
        attrs = {x: v.strip("\"'") for k, v in ATTR.findall(m[3]) if (x := k.lower()) in ASKED} if m[3].strip() else {}
        if tag == "a":
            end_inline("a")  # links don't nest
            if "href" not in attrs:  # an anchor holds no text of its own, and often has no end
                continue
        _, out_now, part, around = stack[-1]
        if out_now != OUT:
            left = _left_out(tag, attrs, part, forms)
            article = tag in ("article", "main")
            if left == OUT or left == NAMED and names:
                out_now = left
            elif article:
                out_now = 0
            if not out_now and article and not part:
                parts += 1
                part = parts
        stack.append((tag, out_now, part, tag if tag in BLOCK and around not in HEADINGS else around))
        count[tag] = count.get(tag, 0) + 1
        if tag in BLOCK:
            opened.append(len(stack) - 1)
    flush()
    return out


def size_of(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(WIDE.findall(text))


def stop_words(text: str) -> tuple[int, int]:
    words = WORD.findall(text.lower())
    return sum(w in STOP for w in words), len(words)


def label(text: str, linked: int, tag: str, part: int, fits: bool) -> str:
    """Pass one: good, bad, or short for an ambiguous block. Inside an article only links make a block bad."""
    share, size = linked / len(text), size_of(text)
    if part:
        limit = 1.0 if tag in HEADINGS else LINKED_PARAGRAPH if tag in ("p", "blockquote") else LINKED_ITEM
        return "bad" if share > limit else "good" if size >= SHORT else "short"
    if size < LONG and RIGHTS.search(text):
        return "bad"
    if share > LINKED:  # a sentence full of links goes with its neighbours
        prose = tag in ("p", "blockquote") and size >= SHORT and share <= LINKED_PARAGRAPH and ENDS.search(text)
        return "short" if prose and (not fits or stop_words(text)[0] >= SPARSE * stop_words(text)[1]) else "bad"
    if size < SHORT:
        return "short" if tag in HEADINGS or not linked else "bad"
    sentence = bool(ENDS.search(text))
    if not fits:
        return "good" if size >= LONG or sentence else "short"
    stops, words = stop_words(text)
    density = stops / max(1, words)
    if density >= DENSE or density >= SPARSE and size >= LONG:
        return "good"
    return "short" if sentence or density >= SPARSE else "bad"


def _labelled(blocks: list[tuple[str, int, str, int]]) -> list[str]:
    prose = [stop_words(t) for t, linked, _, _ in blocks if size_of(t) >= SHORT and linked <= LINKED * len(t)]
    fits = sum(s for s, _ in prose) >= FITS * sum(w for _, w in prose)
    return [label(*b, fits) for b in blocks]


def _with_article(blocks: list[tuple[str, int, str, int]]) -> list[tuple[str, int, str, int]]:
    """The blocks of the page's articles and a title in front of them; all blocks where articles are but a small part of the page's prose."""
    inside = [b for b in blocks if b[3]]
    if not inside:
        return blocks
    around = [b for b in blocks if not b[3]]
    prose = sum(size_of(b[0]) for b, x in zip(around, _labelled(around)) if x == "good")
    if prose > 3 * sum(size_of(b[0]) for b in inside):
        return [(*b[:3], 0) for b in blocks]
    if not any(b[2] == "h1" for b in inside):
        title = [b for b in blocks[: blocks.index(inside[0])] if b[2] == "h1"]
        inside = [(*b[:3], inside[0][3]) for b in title[-1:]] + inside
    return inside


#: A page's text is that of its forms if these hold so many times as much as all else.
MORE = 3


def main_text(html: str) -> tuple[str, int, int]:
    """The text of a page's article, the number of its blocks and of those kept.

    Where forms hold most of the text, they are the page. Where nothing is left, what was left out by name comes along,
    and at last what is meant for readers without scripts.
    """
    low = html.lower()
    found = _kept(html, True)
    forms = "<form" in low and len((wide := _kept(html, True, True))[0]) > MORE * len(found[0])
    if forms:
        found = wide
    for names, raw in ((False, RAW), (True, RAW - {"noscript"})):
        if not found[2] and (raw is RAW or "<noscript" in low):
            found = _kept(html, names, forms, raw)
    return found


def _kept(html: str, names: bool, forms: bool = False, raw: frozenset[str] = RAW) -> tuple[str, int, int]:
    blocks = _with_article(blocks_of(html, names, forms, raw))
    labels = _labelled(blocks)
    if "good" not in labels:  # verse, recipes, talk: with nothing long to go by, short blocks are the text
        labels = ["good" if x == "short" else x for x in labels]
    n = len(blocks)
    after: list[int] = [n] * n
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if labels[i + 1] != "short" else after[i + 1]
    kept, last = [], -1
    for i, (text, _, tag, part) in enumerate(blocks):
        if labels[i] != "short":
            last = i
        verdict = labels[i]
        if verdict == "short":  # pass two; a neighbour in another part decides nothing, a heading looks ahead
            before = last if last >= 0 and blocks[last][3] == part and tag not in HEADINGS else -1
            next_ = after[i] if after[i] < n and blocks[after[i]][3] == part else -1
            near = [j for j in (before, next_) if j >= 0]
            best = min((abs(j - i) for j in near), default=0)
            found = {labels[j] for j in near if abs(j - i) == best}
            verdict = "good" if "good" in found or part else "bad"
        if verdict == "good":
            kept.append(text)
    return "\n\n".join(kept), n, len(kept)


def _extract(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([main_text(h or "") for h in html], columns=["text", "n_blocks", "n_kept"])


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html`` and with ``text, n_chars, n_blocks, n_kept``.

    A null or empty page gives an empty text. Broken or cut-off markup is read as far as it goes, nesting of any depth
    and texts of any length whole. Pages are worked on
    one by one, whole, in no shuffle; repeated rows come out alike and an empty table gives an empty result. Other
    columns pass through, and columns of the names above are replaced.
    """
    other = [c for c in pages.columns if c not in (html, "text", "n_chars", "n_blocks", "n_kept")]
    run = F.pandas_udf(_extract, "text string, n_blocks int, n_kept int")
    df = pages.select(*other, run(F.col(html)).alias("_x"))
    return df.select(*other, "_x.text", F.length("_x.text").cast("long").alias("n_chars"), "_x.n_blocks", "_x.n_kept")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
ORACLES: dict[str, str] = {}
