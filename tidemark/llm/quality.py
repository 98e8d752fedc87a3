"""Operator 10, quality rules: line-first cleaning, in DataFrame functions only.

Every line is judged on its own by three rules; failing lines go; then the document goes if it lost too much
of its text. One row of work per document, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, WHITE_RUN, table, text_of, words_of

SYMBOLS = "#*$%&|<>"
#: Phrases of licence, legal and consent lines.
BOILERPLATE = r"(licensed under|license, version|released under|all rights reserved|copyright|©|cookie|privacy policy|terms of (use|service)|enable javascript|subscribe to our|sign up for)"
#: A line ends well with one of these, closing quotes or brackets aside.
ENDS = r"[.!?…:;。！？][\"'”’»)\]]*$"


@dataclass(frozen=True)
class LineRules:
    """Limits, in integer terms so that no result hangs on rounding.

    max_boilerplate_words: a longer line is prose, whatever phrases it holds.
    max_unended_words: a line of more words need not end in punctuation.
    symbol_percent, shout_percent: symbols against characters in words, exclamation marks against words.
    max_lost_percent: a document may lose this share of its characters in words.
    """

    max_boilerplate_words: int = 30
    max_unended_words: int = 12
    symbol_percent: int = 15
    shout_percent: int = 50
    min_nav_separators: int = 3
    max_lost_percent: int = 50
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


def chars_in_words(text: Column) -> Column:
    return F.length(F.translate(text, WHITE, ""))


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def line_fails(line: Column, r: LineRules) -> Column:
    """True for a line that breaks the punctuation, the navigation or the boilerplate rule; blank lines pass."""
    trimmed = F.trim(line, F.lit(WHITE))
    n_chars = chars_in_words(line)
    n_words = F.size(F.split(trimmed, WHITE_RUN))
    symbols = 100 * count_of(line, SYMBOLS) > r.symbol_percent * n_chars
    shouts = 100 * count_of(line, "!") > r.shout_percent * n_words
    unended = (n_words <= r.max_unended_words) & ~trimmed.rlike(ENDS)
    separators = count_of(line, "|»›•·")
    navigation = (separators >= r.min_nav_separators) & (4 * separators > n_words)
    boilerplate = (n_words <= r.max_boilerplate_words) & F.lower(trimmed).rlike(BOILERPLATE)
    return (trimmed != "") & (symbols | (shouts & (count_of(line, "!") >= 3)) | unended | navigation | boilerplate)


def repeat_words(docs: DataFrame, words: str, window: int, out: str) -> DataFrame:
    """Adds ``out``: words that lie in a window of ``window`` words (a power of two) found twice or more in the text.

    Windows are 64-bit hashes built by doubling, so a word costs log2(window) small steps; only texts with an equal
    pair are sorted.
    """
    hashes = F.transform(F.col(words), lambda w: F.xxhash64(w))
    step, stages = 1, []
    while step < window:
        stages.append(step)
        step *= 2
    df = docs.withColumn("_h", F.when(F.size(words) > window, hashes))
    for s in stages:
        n = F.size("_h") - s
        df = df.withColumn("_h", F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(s + 1), n), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get(F.col("_s"), j)["h"] == x["h"], F.lit(False))
    at = F.filter("_s", lambda x, j: F.when(j > 0, same(x, j - 1)).otherwise(F.lit(False)) | same(x, j + 1))
    df = df.withColumn("_p", F.sort_array(F.transform(at, lambda x: x["i"])))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    once = F.monotonically_increasing_id() >= 0  # always true; keeps filters from being moved ahead, where all this would be computed again
    return df.withColumn(out, F.when(once, F.coalesce(covered, F.lit(0)).cast("long"))).drop("_h", "_s", "_p")


def quality(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text, n_lines_removed, kept``.

    A null text counts as empty: no words, ``base_failed``, not kept. A text of any length is one row's work. Repeated
    rows are judged alike; an empty table gives an empty result. Other columns pass through; columns of the names
    above are replaced. ``clean_text`` is the text without failing lines.
    """
    kept_cols = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "n_lines_removed", "kept")]
    body = text_of(text)
    df = docs.select(*kept_cols).withColumns({"_w": words_of(body), "_lines": F.split(body, "\n", -1)})
    df = repeat_words(df, "_w", rules.window, "n_repeat_words")
    df = df.withColumns({"n_words": F.size("_w").cast("long"), "word_chars": chars_in_words(body).cast("long"), "n_symbols": count_of(body, SYMBOLS).cast("long"), "_good": F.filter("_lines", lambda x: ~line_fails(x, rules)), "_full": F.filter("_lines", lambda x: F.trim(x, F.lit(WHITE)) != "")}).drop("_w")
    df = df.withColumns({"n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"), "clean_text": F.array_join("_good", "\n"), "n_lines_removed": (F.size("_lines") - F.size("_good")).cast("long"), "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))})
    lost = F.col("word_chars") - chars_in_words(F.col("clean_text"))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * lost <= rules.max_lost_percent * F.col("word_chars")))
    return df.select(*kept_cols, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_text", "n_lines_removed", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


def _sql(r: LineRules = LineRules()) -> str:
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    words = lambda t: f"CASE WHEN trim({t}, {ws}) = '' THEN [] ELSE string_split_regex(trim({t}, {ws}), '[\\x20\\x09-\\x0D]+') END"
    chars = lambda t: f"length(translate({t}, {ws}, ''))"
    count = lambda t, c: f"(length({t}) - length(translate({t}, '{c}', '')))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, {words('t')} AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + {r.window - 1}], ' ') AS win FROM w, unnest(range(1, len(ws) - {r.window - 2})) AS u(i)),
rep AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
cov AS (SELECT rid, sum(least({r.window}, coalesce(i - prev, {r.window}))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM rep) GROUP BY rid),
l AS (SELECT rid, line, len({words('line')}) AS nw, {chars('line')} AS nc FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)),
j AS (SELECT *, nw > 0 AND (100 * {count('line', SYMBOLS)} > {r.symbol_percent} * nc
  OR ({count('line', '!')} >= 3 AND 100 * {count('line', '!')} > {r.shout_percent} * nw)
  OR (nw <= {r.max_unended_words} AND NOT regexp_matches(trim(line, {ws}), '{ENDS.replace("'", "''")}'))
  OR ({count('line', '|»›•·')} >= {r.min_nav_separators} AND 4 * {count('line', '|»›•·')} > nw)
  OR (nw <= {r.max_boilerplate_words} AND regexp_matches(lower(line), '{BOILERPLATE}'))) AS bad FROM l),
s AS (SELECT rid, count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS n_dup_lines, coalesce(sum(nc) FILTER (bad), 0) AS lost, count(*) FILTER (bad) AS n_lines_removed FROM j GROUP BY rid),
b AS (SELECT d.*, CAST(len(ws) AS BIGINT) AS n_words, CAST({chars('t')} AS BIGINT) AS word_chars, CAST({count('t', SYMBOLS)} AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, lost, n_lines_removed
  FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid) JOIN s USING (rid)),
f AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * lost <= {r.max_lost_percent} * word_chars AS kept, n_lines_removed FROM f"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES = {"op10_quality_rules": _sql()}
