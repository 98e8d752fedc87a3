"""Operators against plain versions of themselves, on small tables."""

import base64
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chains, decontaminate, extract, lines, nearcopy, quality, suffixes, tokens, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    shared = [sentence(rng, 70) for _ in range(3)]
    out = [sentence(rng, rng.randrange(5, 90)) for _ in range(30)]
    out += [f"{sentence(rng, 20)} {rng.choice(shared)} {sentence(rng, 20)}" for _ in range(20)]
    base = sentence(rng, 120)
    for k in range(12):
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        out.append(" ".join(w))
    out += [base, base.upper(), "", None, "   \n", "one", "ONE", "é" * 150 + "é" * 150, "ab" * 200, sentence(rng, 40) * 3]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").repartition(5)


def test_suffix_dedup(docs, texts):
    seen, want = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        gone = [False] * len(b)
        for a in range(len(b) - 99):
            w = b[a : a + 100]
            if w in seen:
                gone[a : a + 100] = [True] * 100
            seen.add(w)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        want[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in suffixes.substring_dedup(docs).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 3000


@pytest.mark.parametrize("crowd", [1, 2, 7])
def test_suffix_dedup_in_small_blocks(docs, texts, monkeypatch, crowd):
    plain = {r.doc_id: bytes(r.kept) for r in suffixes.substring_dedup(docs).collect()}
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    assert {r.doc_id: bytes(r.kept) for r in suffixes.substring_dedup(docs).collect()} == plain


def test_previous_factors():
    rng = random.Random(8)
    for _ in range(60):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 300)))
        text += b"\x00" * suffixes.LIMIT  # every suffix has LIMIT bytes
        n = len(text) - suffixes.LIMIT
        starts = np.arange(n)
        words = suffixes.window_words(np.frombuffer(text, np.uint8), starts)
        order = np.lexsort((starts, *words.T[::-1]))
        got = suffixes.previous_factors(starts[order], suffixes.common_prefixes(np.zeros(n), words[order]))
        common = lambda i, j: next((k for k in range(suffixes.LIMIT) if text[i + k] != text[j + k]), suffixes.LIMIT)  # noqa: B023, E731
        assert got.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in order.tolist()]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, texts, k):
    sets = {}
    for i, t in texts:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if i < j and both and 100 * both >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nearcopy.near_duplicates(docs, k=k).collect()}
    assert got == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}
    assert len(set(root.values())) <= len(root) - 5


def test_near_duplicates_of_large_groups(docs, monkeypatch):
    plain = sorted(nearcopy.near_duplicates(docs, k=2).collect())
    monkeypatch.setattr(nearcopy, "BLOCK", 4)
    monkeypatch.setattr(nearcopy, "LEADERS", 1)
    assert sorted(nearcopy.near_duplicates(docs, k=2).collect()) == plain


def test_quality(docs, texts):
    rules = quality.LineRules()
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i, t in texts:
        t = t or ""
        w = WORDS.findall(t)
        wins = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        covered = {j + x for j, win in enumerate(wins) if wins.count(win) > 1 for x in range(8)}
        full = [x for x in t.split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(full) - len(set(full)))
        assert r.base_failed == (len(w) < rules.min_words or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_line_rules(spark):
    rng = random.Random(1)
    prose, end = (f"{sentence(rng, 40, 9999)}, and that was the end of it." for _ in range(2))
    text = f"{prose}\nHome | News | Sport | Contact\nThis file is licensed under the terms below.\nRead more\n{end}"
    r = quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.kept and r.clean_text == f"{prose}\n{end}" and r.n_lines_removed == 3


def test_line_dedup(spark):
    notice = "Shared notice of every site."
    rows = [(i, f"own line {i} of this text, which is longer than the notice\n{notice}\n\nlast {i}", f"site{i}") for i in range(12)]
    rows += [(20 + i, f"more text {i} on one site, also longer than the line\nOne site only.", "site0") for i in range(15)] + [(50, None, None), (51, notice, None), (51, notice, None)]
    got = {r.doc_id: r.text for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for i, t, _ in rows:
        assert got[i] == ("" if i == 51 else (t or "").replace(f"{notice}\n", "") if i < 12 else t or "")


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(3)
    inner = "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"
    pages = [(i, f"http://a/{i}", rng.choice([None, "", "short", inner, inner * 60, "é" * 700, f"{i}" * 900, "WARC/1.0\r\n" * 200])) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for kind in ("gzip", "none"):
        path = str(tmp_path / kind)
        warc.write_archive(df, path, compression=kind)
        got = {int(re.search(r"(\d+)>", r.record_id)[1]): r for r in warc.read_archive(spark, path).collect()}
        assert len(got) == len(pages)
        top = {}
        for i, _, h in pages:
            top[h] = max(top.get(h, -1), i)
        for i, _, h in pages:
            b = (h or "").encode()
            r = got[i]
            revisit = len(b) >= 1000 and top[h] != i
            assert r.record_type == ("revisit" if revisit else "response")
            assert r.declared_digest == hashlib.sha1(b).hexdigest()
            if revisit:
                assert r.refers_to_id == warc.ID_FORM % top[h] and r.payload_bytes == 0
            else:
                assert (r.payload_bytes, r.payload_digest) == (len(b), r.declared_digest)


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
def test_token_counts_follow_edits(spark):
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    alphabet = ["a", "the", " ", "  ", "\n", "'s", "7", "12", "é", "漢", "!", "...", " of", "'", "ll"]
    rows = []
    for i in range(60):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 300, 1500])))
        places = sorted(rng.sample(range(len(text) + 20), 6))
        edits = [(a, b, rng.choice(["", "new", " 's", "\n"])) for a, b in zip(places[::2], places[1::2])]
        rows.append((i, text, edits))
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start: int, end: int, new: string>>")
    for r, (_, text, edits) in zip(tokens.edited_counts(tokens.token_trees(docs)).orderBy("doc_id").collect(), rows):
        after = text
        for a, b, new in reversed(edits):
            after = after[: min(a, len(text))] + new + after[min(b, len(text)) :]
        assert r.text == after
        assert (r.n_tokens, r.n_tokens_after) == (len(enc.encode_ordinary(text)), len(enc.encode_ordinary(after)))
        size = len(r.tree_tokens) // 2
        assert all(r.tree_tokens[k] == r.tree_tokens[2 * k] + r.tree_tokens[2 * k + 1] for k in range(1, size))


def test_wand_retrieves_what_a_full_scan_does():
    rng = random.Random(1)
    items = [(i, sentence(rng, rng.randrange(4, 30), 60)) for i in range(300)]
    ix = decontaminate.build_index(items)
    for _ in range(60):
        query = sorted({ix.terms[t] for t in decontaminate.words(sentence(rng, 40, 60)) if t in ix.terms})
        scores = {}
        for t in query:
            for item, x in zip(*ix.postings[t]):
                scores[item] = scores.get(item, 0) + x
        for threshold in (0.3, 0.6):
            got = decontaminate.block_max_wand(ix, query, threshold)
            assert {i for i, _ in got} == {i for i, s in scores.items() if s >= threshold - 1e-9}


def test_decontamination_does_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(12)
    items = [(i, f"{sentence(rng, rng.randrange(3, 40), 300)}? {sentence(rng, rng.randrange(2, 30), 300)}.") for i in range(60)]
    items += [(70, f"{sentence(rng, 300, 300)}? {sentence(rng, 200, 300)}."), (5, sentence(rng, 20)), items[3], (None, "x y"), (9, None)]
    docs = [(i, f"{sentence(rng, 90, 300)} {items[i % 60][1][: rng.randrange(20, 200)]} {sentence(rng, 60, 300)}") for i in range(80)] + [(99, items[60][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for n, size in ((20_000, 64_000_000), (10, 64_000_000), (10, 1)):
        monkeypatch.setattr(decontaminate, "ITEMS", n)
        monkeypatch.setattr(decontaminate, "BYTES", size)
        found.append(sorted((r.doc_id, r.item_id, round(r.score, 6), r.question_overlap, r.answer_overlap) for r in decontaminate.retrieve(d, b).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 20
    assert (99, 70) in {x[:2] for x in found[0]}


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(i, f"{sentence(rng, 20)}? {sentence(rng, 20)}.") for i in range(40)] + [(99, None)]
    docs = [(i, sentence(rng, 300)) for i in range(20)] + [(30 + i, f"{sentence(rng, 500)} {items[i][1]} {sentence(rng, 90)}") for i in range(20)] + [(70, None), (71, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.retrieve(d, b).where("contaminated").collect()}
    assert got == {(30 + i, i) for i in range(20)}
    assert {r.doc_id for r in decontaminate.decontaminate(d, b).collect()} == {*range(20), 70, 71}


def test_fuzzy_passages(spark):
    rng = random.Random(4)
    passage = sentence(rng, 80, 5000).split()
    other = list(passage)
    for k in (20, 41, 66):
        other[k] = "changed"
    del other[50]
    rows = [(0, f"{sentence(rng, 100, 5000)} {' '.join(passage)} {sentence(rng, 30, 5000)}"), (1, sentence(rng, 200, 5000)), (2, f"{sentence(rng, 10, 5000)} {' '.join(other)} {sentence(rng, 60, 5000)}"), (3, None), (4, "")]
    got = chains.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.ref_doc_id) for r in got] == [(2, 0)]
    r = got[0]
    assert abs(r.start_word - 10) <= 2 and abs(r.end_word - 89) <= 2 and abs(r.ref_start_word - 100) <= 2 and abs(r.ref_end_word - 180) <= 2 and r.percent >= 90


def test_best_chain_is_the_best():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randrange(1, 9)
        pos, ref = [rng.randrange(30) for _ in range(n)], [rng.randrange(30) for _ in range(n)]
        score = {}
        for i in sorted(range(n), key=lambda i: (pos[i], ref[i])):
            before = [score[j] - chains.GAP * (pos[i] - pos[j] + ref[i] - ref[j]) for j in score if pos[j] < pos[i] and ref[j] < ref[i]]
            score[i] = chains.SEED + max(0, *before, 0)
        worth = lambda c: sum(chains.SEED for _ in c) - sum(chains.GAP * (pos[b] - pos[a] + ref[b] - ref[a]) for a, b in zip(c, c[1:]))  # noqa: B023, E731
        assert abs(worth(chains.best_chains(pos, ref)[0]) - max(score.values())) < 1e-9


PARAGRAPH = "The people of the town had been there for a long time, and they said that it was not the first time that the river had risen over the road by the mill. "


def test_html_extraction():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></li></ul></nav>
    <div class="sidebar"><p>{PARAGRAPH}</p></div><article><h1>Flood &amp; mill</h1><p>{PARAGRAPH}<b>Bold</b>&#33;</p><script>var x = "<p>no</p>";</script><p>Short.</p><p>{PARAGRAPH}</p></article>
    <div id="comments"><p>{PARAGRAPH}</p></div><footer>Copyright</footer></body></html>"""
    want = ["Flood & mill", f"{PARAGRAPH}Bold!", "Short.", PARAGRAPH.strip()]
    assert extract.main_text(page)[0] == "\n\n".join(want)
    assert extract.main_text("")[0] == "" and extract.main_text("<p")[0] == ""


def test_html_without_article():
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><div>{PARAGRAPH}</div><div>Next.</div><div>{PARAGRAPH}</div><p><a href=3>{PARAGRAPH}</a></p></body>"
    assert extract.main_text(page)[0] == f"{PARAGRAPH.strip()}\n\nNext.\n\n{PARAGRAPH.strip()}"
