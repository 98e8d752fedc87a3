"""Matches in time: banded joins, semantic scores, the best pair per report, quota matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..functions.once import once
from ..sources.shared import dropped, shared_table
from .graph import components


def band_join(left: DataFrame, right: DataFrame, on_left: str, on_right: str, before: int, after: int, keys: list[str] | None = None, salts: int = 1) -> DataFrame:
    """Pairs with ``-before <= right day - left day <= after`` (and equal ``keys``), through an equi-join on spans of days instead of a nested loop.

    The right side goes to its own span, the left to all that its band touches, so each pair meets once. With ``salts``,
    a span's left rows are dealt out to so many parts, each of which has its right rows. Column names must differ.
    """
    width = max(1, before + after)
    span = lambda d: F.floor(F.unix_date(d) / width)
    l2 = left.withColumn("_span", F.explode(F.sequence(span(F.date_sub(F.col(on_left), before)), span(F.date_add(F.col(on_left), after)))))
    r2 = right.withColumn("_span", span(F.col(on_right)))
    if salts > 1:
        l2 = l2.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
        r2 = r2.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = [*(keys or []), "_span", *(["_salt"] if salts > 1 else [])]
    return l2.join(r2, on).drop("_salt").where(F.datediff(on_right, on_left).between(-before, after)).drop("_span")


def profile(items: DataFrame) -> DataFrame:
    """Adds the action, topic, canonical actor and tokens of an item."""
    text = F.lower(F.concat_ws(" ", T.normalize(F.col("title")), T.strip_html(F.col("description"))))
    df = once(items.withColumn("_text", text))
    tokens = T.claim_tokens(F.col("title"))
    tokens = F.when(F.size(tokens) < 3, F.array_union(tokens, T.claim_tokens(F.col("_text")))).otherwise(tokens)
    df = once(df.withColumns({"_found": T.found_keywords(F.col("_text"), T.TAG_KEYWORDS), "tokens": tokens}).drop("_text"))
    found = F.col("_found")
    actor = F.coalesce(F.try_element_at(T.hits_of(found, C.ACTOR_KEYWORDS), F.lit(1)), F.lit("na"))
    return once(df.withColumns({"action": T.action_tag(found, T.any_of), "topic": T.topic_tag(found, T.any_of), "actor": T.actor_group(actor)}).drop("_found"))


def pair_tier() -> Column:
    rss, direct, s = F.col("m_source_type") == "rss", ~F.col("m_aggregator"), F.col("semantic")
    proxy = F.col("m_aggregator") & (F.coalesce("m_publisher", F.lit("")) != "")
    timed = F.col("m_published_at").isNotNull()
    return F.when(rss & direct & (F.col("m_weight") >= 2) & (s >= 3), "strict").when(rss & proxy & timed & (s >= 3), F.when(F.col("m_mirrored"), "strict").otherwise("proxy_strict")).when(rss & (direct | proxy) & (s >= 2), "balanced").otherwise("exploratory")


def _keys(tokens: str, size: int) -> Column:
    """Hashes of the pairs or triples of an item's sorted tokens."""
    t = F.col(tokens)
    tail = lambda x, i: F.filter(t, lambda y, j: j > i)
    pairs = F.flatten(F.transform(t, lambda x, i: F.transform(tail(x, i), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    if size == 2:
        return F.transform(pairs, lambda p: F.xxhash64(p["a"], p["b"]))
    return F.flatten(F.transform(pairs, lambda p: F.transform(F.filter(t, lambda z: z > p["b"]), lambda z: F.xxhash64(p["a"], p["b"], z))))


def pairable(min_base: int = 50) -> Column:
    """Items that :func:`official_media_pairs` looks at."""
    return F.coalesce((F.col("category") == "ufo") & (F.col("base_score") >= min_base) & F.col("date").isNotNull(), F.lit(False))


def official_media_pairs(items: DataFrame, max_lag: int = 30, min_semantic: int = 2, min_base: int = 50) -> DataFrame:
    """``m_ord, o_ord, lag_days, semantic, tier, m_published_at, m_publisher``: the best earlier official item of like content for each media item.

    What a pair scores hangs on its actions, topics and actors, and on whether it shares two or three tokens. So official
    items are summed up: by day, action, topic and actor the first one, over all and for each pair and triple of tokens.
    Media items look up their own pairs and triples, and media items of one day, action, topic and actor look up the
    sum over all together. No official item meets a media item as such, and a summed-up item scores at most what it
    does under a key of its own, so the best stays the best.
    """
    good = shared_table(profile(items.where(pairable(min_base))).withColumn("tokens", F.sort_array("tokens")), "profiled-items")
    tags = ["action", "topic", "actor"]
    official = good.where("official").select("ord", "date", *tags, "tokens")
    name = lambda c: F.lower(T.normalize(F.col(c)))
    published = F.lower("publisher_name") if "publisher_name" in good.columns else F.lit(None).cast("string")
    media = good.where("NOT official").select("ord", "source_type", "weight", "date", "published_at", "aggregator", "publisher", "domain", *tags, "tokens", T.normalize(published).alias("_by"), name("source").alias("_source"))
    direct = media.where("source_type = 'rss' AND NOT aggregator AND weight >= 2")
    known = lambda c, to: direct.where(F.coalesce(c, F.lit("")) != "").select(F.lower(c).alias(to)).distinct().withColumn(f"{to}_known", F.lit(True))
    media = media.withColumn("_at", F.lower("publisher")).join(known("domain", "_at"), "_at", "left").join(known("_source", "_by"), "_by", "left").withColumn("mirrored", F.coalesce("_at_known", "_by_known", F.lit(False)))
    media = media.drop("_at", "_by", "_source", "_at_known", "_by_known")
    media = media.select(*[F.col(c).alias(f"m_{c}") for c in media.columns])

    def shared(df: DataFrame, tokens: str) -> DataFrame:
        worth = lambda keys, n: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(n).alias("worth")))
        return df.select("*", F.inline(F.concat(worth(_keys(tokens, 2), 1), worth(_keys(tokens, 3), 2)))).drop(tokens)

    sums = lambda df, *keys: df.groupBy("date", *tags, *keys).agg(F.min("ord").alias("ord")).select(*keys, *[F.col(c).alias(f"o_{c}") for c in ("ord", "date", *tags)])
    by_token = band_join(shared(media, "m_tokens"), sums(shared(official, "tokens"), "key", "worth"), "m_date", "o_date", max_lag, 0, ["key", "worth"]).drop("key")
    kinds = media.groupBy("m_date", *[f"m_{c}" for c in tags]).agg(F.count("*").alias("_n")).drop("_n")
    by_tag = band_join(kinds, sums(official), "m_date", "o_date", max_lag, 0).withColumn("worth", F.lit(0))
    by_tag = by_tag.where(_tag_score() >= min_semantic)
    known = media.drop("m_tokens").join(_best_of_kind(by_tag), ["m_date", *[f"m_{c}" for c in tags]])
    pairs = by_token.select(*known.columns).unionByName(known).withColumn("semantic", _tag_score() + F.col("worth")).where(F.col("semantic") >= min_semantic)
    pairs = pairs.withColumns({"lag_days": F.datediff("m_date", "o_date"), "tier": pair_tier()})
    return best_pair(pairs.select("m_ord", "o_ord", "lag_days", "semantic", "tier", "m_published_at", "m_publisher"))


def _tag_score() -> Column:
    same = lambda c, n: F.when((F.col("o_" + c) != "na") & (F.col("o_" + c) == F.col("m_" + c)), n).otherwise(0)
    return same("action", 2) + same("topic", 2) + same("actor", 1)


def _best_of_kind(by_tag: DataFrame) -> DataFrame:
    """Of media items of one day and tags, the candidates that could be best for any: the tier follows the score, so for each score the first by lag and order."""
    lag = F.datediff("m_date", "o_date")
    keys = ["m_date", "m_action", "m_topic", "m_actor"]
    best = by_tag.groupBy(*keys, _tag_score().alias("_s")).agg(F.min_by(F.struct("o_ord", "o_date", "o_action", "o_topic", "o_actor", "worth"), F.struct(F.when(lag == 0, 9999).otherwise(lag), "o_ord")).alias("b"))
    return best.select(*keys, "b.*")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "strict", 0).when(tier == "proxy_strict", 1).when(tier == "balanced", 2).otherwise(3)


def best_pair(pairs: DataFrame) -> DataFrame:
    """The best pair of each media item: tier, then a lead, score and lag (a lag of 0 counts as unknown), by aggregation."""
    lag = F.when(F.col("lag_days") == 0, 9999).otherwise(F.col("lag_days"))
    order = F.struct(tier_rank(F.col("tier")).alias("a"), (-F.col("semantic")).alias("b"), lag.alias("c"), F.col("o_ord").alias("d"))
    rest = [c for c in pairs.columns if c != "m_ord"]
    return pairs.groupBy("m_ord").agg(F.min_by(F.struct(*rest), order).alias("p")).select("m_ord", "p.*")


#: Rounds that take many pairs at once, before what hangs together is decided pair after pair, and pairs that one task may so decide.
ROUNDS, FOLD = 4, 500_000
#: Parts that the events of one span of days are dealt into, as most events may lie in one.
SALTS = 32


def _folded(pairs: DataFrame) -> DataFrame:
    """The choice of one pair after another in each ``part`` of ``pairs (part, l, r, gap, score, o, lq, rq)``."""

    def choose(df):  # noqa: ANN001, ANN202
        left: dict = {}
        right: dict = {}
        keep = []
        for l, r, lq, rq in zip(df["l"], df["r"], df["lq"], df["rq"]):
            a, b = left.get(l, lq), right.get(r, rq)
            if a > 0 and b > 0:
                left[l], right[r] = a - 1, b - 1
                keep.append(True)
            else:
                keep.append(False)
        return df.loc[keep, ["l", "r", "gap", "score"]]

    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("l", "r", "gap", "score"))
    order = [F.col("o.a"), F.col("o.b"), F.col("o.c"), F.col("o.d"), F.col("o.e")]
    numbered = pairs.withColumn("k", F.row_number().over(W.partitionBy("part").orderBy(*order))).drop("o")
    return numbered.groupBy("part").applyInPandas(lambda df: choose(df.sort_values("k")), schema)


def quota_match(pairs: DataFrame, left_quota: int = 3, right_quota: int = 2) -> DataFrame:
    """``pairs (l, r, gap, score)`` that are taken in order (later first, smaller gaps, higher scores, then l and r), each pair once and each side at most its quota of times.

    A few rounds first: a pair among the first that either side can still take is taken, whatever lies between, so a
    round takes many at once and the choice is that of one pair after another. Then what is left falls into parts that
    share no side. Parts of at most FOLD pairs are decided pair after pair, a part in one task; with a larger one there,
    rounds go on. So long chains of pairs that hang on one another cost no round each, and no group is unbounded.
    """
    first = F.struct((F.col("gap") < 0).alias("a"), F.abs("gap").alias("b"), (-F.col("score")).alias("c"), F.col("l").alias("d"), F.col("r").alias("e"))
    best = pairs.groupBy("l", "r").agg(F.min(F.struct(first.alias("o"), "gap", "score")).alias("x")).select("l", "r", "x.*")
    left = shared_table(best.withColumns({"lq": F.lit(left_quota), "rq": F.lit(right_quota)}), "quota-pairs")
    taken, done = best.select("l", "r", "gap", "score").limit(0), 0
    while not left.isEmpty():
        if done >= ROUNDS and done % ROUNDS == 0:
            # a side's pairs are one part: sides are hashed, and nodes are joined through them
            side = lambda c, n: F.xxhash64(F.lit(n), F.col(c).cast("string"))
            nodes = components(left.select(side("l", 1).alias("u"), side("r", 2).alias("v"))).toDF("_n", "part")
            parted = shared_table(left.withColumn("_n", side("l", 1)).join(nodes, "_n").drop("_n"), "quota-parts")
            if parted.groupBy("part").count().agg(F.max("count")).first()[0] <= FOLD:
                return taken.unionByName(_folded(parted))
            dropped(parted)
        rank = lambda side: F.row_number().over(W.partitionBy(side).orderBy("o"))
        now = left.withColumns({"_l": rank("l"), "_r": rank("r")}).where((F.col("_l") <= F.col("lq")) & (F.col("_r") <= F.col("rq"))).select("l", "r", "gap", "score")
        now = shared_table(now, "quota-taken")
        taken = taken.unionByName(now)
        used = lambda side: now.groupBy(side).agg(F.count("*").cast("int").alias(f"_{side}"))  # noqa: B023, E731
        rest = left.join(now.select("l", "r"), ["l", "r"], "left_anti").join(used("l"), "l", "left").join(used("r"), "r", "left")
        rest = rest.withColumns({f"{s}q": F.col(f"{s}q") - F.coalesce(f"_{s}", F.lit(0)) for s in ("l", "r")}).drop("_l", "_r")
        rest = shared_table(rest.where("lq > 0 AND rq > 0"), "quota-pairs")
        dropped(left)
        left, done = rest, done + 1
    return taken


def temporal_correlations(crises: DataFrame, outcomes: DataFrame, days: int = 60) -> DataFrame:
    """Crises and outcomes ``(id, date, score)`` within ``days`` either way, matched under quotas: ``l, r, gap, score``, the sum of scores. Events of one id count once for their quotas."""
    c = crises.select(F.col("id").alias("l"), F.col("date").alias("l_date"), F.col("score").alias("l_score")).where("l_date IS NOT NULL")
    o = outcomes.select(F.col("id").alias("r"), F.col("date").alias("r_date"), F.col("score").alias("r_score")).where("r_date IS NOT NULL")
    return quota_match(band_join(c, o, "l_date", "r_date", days, days, salts=SALTS).select("l", "r", F.datediff("r_date", "l_date").alias("gap"), (F.col("l_score") + F.col("r_score")).cast("long").alias("score")))
