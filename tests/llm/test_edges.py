"""Nulls, empty tables, repeated rows and clashing column names, for each operator; the pipeline on planted cases."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import chains, decontaminate, extract, lines, mixing, nearcopy, quality, suffixes, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, block long, seq long, salt int, tokens long, place int"
LONG = "a long text of many words that goes on and on, " * 20000
ROWS = [(1, "one two three", "en", "s1", 13, 5, "k", 1, 2, 3, 4, 5), (1, "one two three", "en", "s1", 13, 5, "k", 1, 2, 3, 4, 5), (2, None, None, None, None, None, None, None, None, None, None, None), (None, "no id here", "en", "s2", 3, 1, "k", 1, 1, 1, 1, 1), (3, "", "", "", 0, 1, "", 1, 1, 1, 1, 1), (4, LONG, "fr", "s3", 9, 1, "z", 1, 1, 1, 1, 1)]
ITEMS = [(1, "is this a question? yes, it is an answer"), (None, "x y z"), (2, None), (2, "")]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], DOCS)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_row_operators(docs):
    want = ids(docs)
    for out in (quality.quality(docs), lines.line_dedup(docs), mixing.mix(mixing.with_domain(docs)), tokens.token_trees(docs)):
        assert ids(out) == want
        assert {"id", "key", "block", "seq", "salt", "tokens", "place"} <= set(out.columns)


def test_rows_by_document(docs):
    want = sorted({i for i in ids(docs) if i is not None})
    assert ids(nearcopy.near_duplicates(docs)) == want
    assert ids(suffixes.substring_dedup(docs)) == want
    assert chains.fuzzy_passages(docs).count() == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ids(decontaminate.decontaminate(docs, items)) == ids(docs)
    assert ids(decontaminate.decontaminate(docs, items.limit(0))) == ids(docs)


@pytest.mark.parametrize("rows", [[(1, None, None, "e"), (1, None, None, "e"), (2, "u\r\nx", "<p>" + "a" * 2000, "e"), (3, "u", "<p>" + "a" * 2000, "e"), (None, "u", "x", "e")], []])
def test_pages(spark, tmp_path, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    out = extract.extract_text(pages)
    assert out.count() == len(rows) and "digest" in out.columns
    warc.write_archive(pages, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and sum(r.record_type == "revisit" for r in got) == (1 if rows else 0)


def test_edits_of_nulls(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "ab", [(5, 9, None)])], "doc_id long, text string, edits array<struct<start: int, end: int, new: string>>")
    assert [(r.text, r.n_tokens, r.n_tokens_after) for r in tokens.edited_counts(tokens.token_trees(docs)).orderBy("doc_id").collect()] == [("", 0, 0), ("ab", 1, 1)]


def test_mixing_keeps_to_the_budget(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["en", "fr"]), f"s{i % 7 if i % 3 else 0}") for i in range(600)]
    out = mixing.mix(mixing.with_domain(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()
    total, taken = sum(r.n_tokens for r in out), sum(r.n_tokens * r.times for r in out)
    assert taken <= total * mixing.BUDGET_PERCENT / 100 < taken + 60 * 14
    assert max(r.times for r in out) <= mixing.MAX_EPOCHS


def test_pipeline(spark, tmp_path):
    rng = random.Random(7)
    prose = lambda n: " ".join(" ".join(f"word{rng.randrange(3000)}" for _ in range(12)) + "." for _ in range(n))
    items = [(i, f"{prose(2)} {prose(2)}") for i in range(20)]
    docs = [(i, prose(12), "en", f"s{i % 15}") for i in range(60)]
    docs = [(i, f"{t}\nA notice that stands on each and every site of the web, again and again.", g, s) for i, t, g, s in docs]
    copies = [(100 + i, docs[i][1].replace("word1 ", "word2 "), "en", f"s{i}") for i in range(10)]
    leaks = [(200 + i, f"{prose(8)} {items[i][1]} {prose(3)}", "en", "s1") for i in range(10)]
    junk = [(300, "too short", "en", "s1"), (301, None, "en", "s1"), (302, "same words again and again here now ok. " * 40, "en", "s1")]
    d = spark.createDataFrame([(*r, len(r[1] or "")) for r in docs + copies + leaks + junk], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, now, left = str(tmp_path), d, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        left.append({r.doc_id: r for r in now.collect()})
        if name != "mixing sources":
            assert set(now.columns) == set(d.columns)
    clean = {r[0] for r in docs}
    assert set(left[0]) == clean | {r[0] for r in copies + leaks}
    assert set(left[1]) == set(left[0]) and all("notice" not in left[1][i].text for i in clean)
    assert set(left[2]) == clean | {r[0] for r in leaks}
    assert set(left[3]) == clean
    assert {r.doc_id: r.times for r in corpus_pipeline.run(spark, sf).collect()} == {i: r.times for i, r in left[4].items()}
    assert set(left[4]) <= clean and len(left[4]) > 20
