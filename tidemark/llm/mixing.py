"""Operator 9, mixing sources to target weights by hierarchical budgeting.

Weights go down a tree of domain, language and source. A branch that can't use its share gives the shortage to its
siblings, by their weights; what they can't use goes to the siblings of the parent, and so on, as a parent's capacity
is the sum of its children's. A leaf takes whole epochs of its documents and the prefix of one more, each epoch in its
own seeded order. All sums are integers, so that no choice hangs on rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, text_of, words_of, written
from .components import salted_join

LEVELS = ("domain", "lang", "source")
#: Target weights by level and value; other values weigh 1.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 2}, "lang": {"en": 6, "fr": 2, "de": 2}, "source": {}}
BUDGET_PERCENT = 60
MAX_EPOCHS = 3
#: Ratios of capacity to weight are compared in these parts; weights up to a million keep them exact.
SCALE = 10**12
SEED = 20240517
#: Documents in one part of a leaf's order, about: only the part that holds a prefix's end is put in order.
PART = 8192


def _big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str], budget: str, capacity: str, weight: str, out: str, order: list[str]) -> DataFrame:
    """Adds ``out``: each node's part of its parent's ``budget``, by weight, at most its capacity, shortages going to its siblings.

    Nodes in ascending order of capacity to weight fill up first; the first that doesn't sets the rate for the rest.
    The ratio is an integer in parts of SCALE, which tells all fractions apart whose weights have a product of at most SCALE.
    """
    ratio = F.expr(f"floor(cast({capacity} as decimal(38,0)) * {SCALE} / cast({weight} as decimal(18,0)))")
    by = W.partitionBy(*parent).orderBy(ratio, *order)
    before = by.rowsBetween(W.unboundedPreceding, -1)
    rest = by.rowsBetween(0, W.unboundedFollowing)
    df = nodes.withColumns({"_left": _big(F.col(budget)) - _big(F.coalesce(F.sum(capacity).over(before), F.lit(0))), "_w": _big(F.sum(weight).over(rest))})
    df = df.withColumn("_full", _big(F.col(capacity)) * F.col("_w") <= _big(F.col(weight)) * F.col("_left"))
    first = F.min(F.when(~F.col("_full"), F.struct(ratio.alias("r"), *[F.col(c).alias(c) for c in order], F.col("_left").alias("l"), F.col("_w").alias("w")))).over(W.partitionBy(*parent))
    df = df.withColumn("_cut", first)
    part = F.expr(f"cast({weight} as decimal(38,0)) * _cut.l div _cut.w")
    return df.withColumn(out, F.when(F.col("_full"), F.col(capacity)).otherwise(part.cast("long"))).drop("_left", "_w", "_full", "_cut")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget_percent: int, max_epochs: int) -> DataFrame:
    """``leaves (domain, lang, source, tokens, n)`` with ``budget``: its tokens in the mixture, epochs counted in."""
    nodes = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    caps = {0: nodes.groupBy("domain").agg(F.sum("capacity").alias("c0")), 1: nodes.groupBy("domain", "lang").agg(F.sum("capacity").alias("c1"))}
    total = leaves.agg(F.floor(F.sum("tokens") * budget_percent / 100).cast("long").alias("b")).select(F.coalesce("b", F.lit(0)).alias("b"), F.lit(0).alias("_root"))
    top = caps[0].withColumn("_root", F.lit(0)).join(total, "_root").withColumn("w0", _weight("domain", weights))
    top = share_out(top, ["_root"], "b", "c0", "w0", "b0", ["domain"]).select("domain", "b0")
    mid = caps[1].join(top, "domain").withColumn("w1", _weight("lang", weights))
    mid = share_out(mid, ["domain"], "b0", "c1", "w1", "b1", ["lang"]).select("domain", "lang", "b1")
    low = nodes.join(mid, ["domain", "lang"]).withColumn("w2", _weight("source", weights))
    return share_out(low, ["domain", "lang"], "b1", "capacity", "w2", "budget", ["source"]).drop("capacity", "b1", "w2")


def _order(seed: int, epoch: str, doc_id: str) -> Column:
    """A document's place in an epoch's order, from 0 up to 2**32."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(epoch).cast("string"), F.col(doc_id).cast("string"))), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", tokens: Column | None = None, levels: tuple[str, str, str] = LEVELS, weights: dict[str, dict[str, int]] | None = None, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``times``: how often the mixture takes the document, 0 if not at all.

    ``tokens`` defaults to the words of ``text``. The budget is a share of all tokens. A leaf's last epoch ends before
    the first document that doesn't fit. Nulls in a level are a branch of their own; null texts have no tokens and
    come along with any prefix that reaches their place; a null doc_id has one place per epoch. Rows of one place are
    taken or left together. The budget is a table of one row that meets one row per domain in a nested loop. An empty table gives an empty result; other columns pass through.
    """
    weights = WEIGHTS if weights is None else weights
    other = [c for c in docs.columns if c not in ("n_tokens", "times")]
    tokens = F.size(words_of(text_of())) if tokens is None else tokens
    keys = list(LEVELS)
    named = docs.select(*[F.col(c).alias(f"d_{c}") for c in other], *[F.coalesce(F.col(a).cast("string"), F.lit("")).alias(b) for a, b in zip(levels, keys)], tokens.cast("long").alias("n_tokens"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 62))).alias("_id"))
    slim = written(named.select(*keys, "n_tokens", "_id"), "mix-tokens")
    leaves = written(slim.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")), "mix-leaves")
    plan = leaf_budgets(leaves, weights, budget_percent, max_epochs)
    plan = plan.withColumns({"full": F.expr("CASE WHEN tokens > 0 THEN budget div tokens ELSE 0 END"), "parts": F.ceil(F.col("n") / PART).cast("long")}).withColumns({"epoch": F.col("full") + 1, "rest": F.col("budget") - F.col("full") * F.col("tokens")})
    plan = written(plan.select(*keys, "full", "parts", "epoch", "rest"), "mix-plan")
    place = F.struct(_order(seed, "epoch", "_id").alias("h"), F.col("_id").alias("id"))
    placed = salted_join(slim, plan, keys, "_id", merge=False).withColumn("place", place).withColumn("part", F.shiftright(F.col("place.h") * F.col("parts"), 32))
    sums = placed.groupBy(*keys, "part", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = sums.withColumn("upto", F.sum("t").over(W.partitionBy(*keys).orderBy("part")))
    ends = written(upto.where(F.col("upto") > F.col("rest")).groupBy(*keys).agg(F.min("part").alias("end"), F.min_by(F.col("upto") - F.col("t"), "part").alias("before")), "mix-ends")
    close = placed.join(ends.withColumnRenamed("end", "part"), [*keys, "part"])
    within = close.withColumn("upto", F.col("before") + F.sum("n_tokens").over(W.partitionBy(*keys).orderBy("place")))
    last = within.where(F.col("upto") <= F.col("rest")).groupBy(*keys).agg(F.max("place").alias("last"))
    final = written(plan.join(ends.select(*keys, "end"), keys, "left").join(last, keys, "left"), "mix-final")
    out = salted_join(named, final, keys, "_id", merge=False).withColumn("place", place).withColumn("part", F.shiftright(F.col("place.h") * F.col("parts"), 32))
    taken = F.coalesce(F.col("end").isNull() | (F.col("part") < F.col("end")) | ((F.col("part") == F.col("end")) & (F.col("place") <= F.col("last"))), F.lit(False)) & (F.col("rest") > 0)
    return out.select(*[F.col(f"d_{c}").alias(c) for c in other], "n_tokens", (F.col("full") + taken.cast("int")).cast("long").alias("times"))


def with_domain(docs: DataFrame, domains: int = 4) -> DataFrame:
    """``docs`` with ``domain``, dealt by the number in ``source``."""
    n = F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d+)$", 1).try_cast("long")
    return docs.withColumn("domain", F.concat(F.lit("domain"), (F.coalesce(n, F.lit(0)) % domains).cast("string")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mix(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "times")


def _sql_weight(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{v}' THEN {w}" for v, w in WEIGHTS[level].items()) + " ELSE 1 END" if WEIGHTS[level] else "1"


def _sql_level(name: str, nodes: str, parent: str, level: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    keys = f"{parent}, {level}" if parent else level
    return f"""{name}0 AS (SELECT n.*, {_sql_weight(level)} AS w FROM {nodes} n),
{name}1 AS (SELECT *, CAST(b AS HUGEINT) - coalesce(sum(c) OVER ({part} ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem, sum(w) OVER ({part} ORDER BY c / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ww FROM {name}0),
{name}2 AS (SELECT *, c * ww <= w * rem AS full_ FROM {name}1),
{name} AS (SELECT {keys}, CAST(CASE WHEN full_ THEN c ELSE (w * first_value(rem) OVER x) // first_value(ww) OVER x END AS BIGINT) AS b FROM {name}2 WINDOW x AS ({part} ORDER BY full_, c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


SQL = f"""
WITH t AS (SELECT doc_id, 'domain' || (CAST(coalesce(nullif(regexp_extract(source, '(\\d+)$', 1), ''), '0') AS BIGINT) % 4) AS domain, lang, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, {MAX_EPOCHS} * CAST(sum(n_tokens) AS BIGINT) AS cap FROM t GROUP BY ALL),
n0 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS c, (SELECT CAST(floor(sum(n_tokens) * {BUDGET_PERCENT} / 100) AS BIGINT) FROM t) AS b FROM leaf GROUP BY domain),
{_sql_level('d', 'n0', '', 'domain')},
n1 AS (SELECT leaf.domain, lang, CAST(sum(cap) AS BIGINT) AS c, any_value(b) AS b FROM leaf JOIN d ON d.domain = leaf.domain GROUP BY ALL),
{_sql_level('l', 'n1', 'domain', 'lang')},
n2 AS (SELECT leaf.domain, leaf.lang, source, cap AS c, b FROM leaf JOIN l ON l.domain = leaf.domain AND l.lang = leaf.lang),
{_sql_level('s', 'n2', 'domain, lang', 'source')},
p AS (SELECT leaf.*, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS full_, CASE WHEN tokens > 0 THEN b % tokens ELSE b END AS rest FROM leaf JOIN s USING (domain, lang, source)),
o AS (SELECT t.*, full_, rest, CAST('0x' || substr(md5('{SEED}|' || (full_ + 1) || '|' || doc_id), 1, 8) AS BIGINT) AS h FROM t JOIN p USING (domain, lang, source)),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id) AS upto FROM o)
SELECT doc_id, domain, lang, source, n_tokens, CAST(full_ + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS times FROM u"""

QUERIES = {"op9_mixing": op9_mixing}
ORACLES = {"op9_mixing": SQL}
