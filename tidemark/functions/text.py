"""Text, URL and tagging functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def normalize(text: Column) -> Column:
    """Runs of white space as one space; single spaces, most of all, are no match and cost no copy."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def strip_html(text: Column) -> Column:
    """Without markup: tags become spaces and common entities their characters; text without angle brackets keeps its entities."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return normalize(F.when(text.contains("<") | text.contains(">"), bare).otherwise(text))


def has_keyword(text: Column, keyword: str) -> Column:
    """Whole-word match for plain words, substring match for anything else; ``text`` is lower case."""
    if keyword.isascii() and keyword.isalnum() and keyword == keyword.lower():
        return text.rlike(rf"(?<![a-z0-9]){keyword}(?![a-z0-9])")
    return text.contains(keyword)


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """One alternation instead of a match per keyword."""
    words = [k for k in keywords if k.isalnum()]
    rest = [k for k in keywords if not k.isalnum()]
    parts = ([rf"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"] if words else []) + ["|".join(escape(k) for k in rest)] * bool(rest)
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in parts)), F.lit(False)) if parts else F.lit(False)


def escape(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in text)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """The keywords found, in the list's order."""
    return F.array_compact(F.array(*[F.when(has_keyword(text, k), F.lit(k)) for k in keywords])) if keywords else F.array().cast("array<string>")


def found_keywords(text: Column, keywords: list[str]) -> Column:
    """Those of ``keywords`` that a text holds, from one pass that cuts it into words and a search for each of the others; :func:`hits_of` and :func:`any_of` look lists up in it."""
    distinct = list(dict.fromkeys(keywords))
    words = [k for k in distinct if k.isascii() and k.isalnum() and k == k.lower()]
    rest = [F.when(text.contains(k), F.lit(k)) for k in distinct if k not in words]
    hits = F.array_intersect(F.array(*map(F.lit, words)), F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1))
    return F.concat(hits, F.array_compact(F.array(*rest))) if rest else hits


def hits_of(found: Column, keywords: list[str]) -> Column:
    """The keywords among those found, in the list's order."""
    return F.array_intersect(F.array(*map(F.lit, keywords)), found)


def any_of(found: Column, keywords: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.array(*map(F.lit, keywords)), found), F.lit(False))


def is_aggregator(source: Column) -> Column:
    return F.lower(F.coalesce(source, F.lit(""))).contains(C.AGGREGATOR_HINTS[0])


def is_official(source: Column) -> Column:
    return F.lower(F.coalesce(source, F.lit(""))).rlike("|".join(C.OFFICIAL_HINTS)) & ~is_aggregator(source)


def names_official(source: Column) -> Column:
    """The review's test: an official name, be it an aggregator's; a null source is none."""
    return F.lower(F.coalesce(source, F.lit(""))).rlike("|".join(C.OFFICIAL_HINTS))


def immigration_context(text: Column, has=any_keyword) -> Column:  # noqa: ANN001
    """``text`` may be what :func:`found_keywords` found, with ``has`` as :func:`any_of`."""
    return has(text, ["alien", "aliens"]) & ~has(text, C.ALIEN_ANCHORS) & has(text, C.IMMIGRATION_CONTEXT)


def without_migrants(hits: Column, immigration: Column) -> Column:
    """Keyword hits without aliens where these are migrants."""
    return F.when(immigration, F.filter(hits, lambda h: ~h.isin("alien", "aliens"))).otherwise(hits)


def spammy(title: Column) -> Column:
    return title.rlike("(?U)" + "|".join(C.SPAM_PATTERNS))


def contains_any(text: Column, parts: list[str]) -> Column:
    return text.rlike("|".join(escape(p) for p in parts))


def claim_tokens(title: Column) -> Column:
    raw = F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    good = F.filter(raw, lambda w: (F.length(w) > 2) & ~w.isin(*C.CLAIM_STOPWORDS))
    return F.slice(F.array_distinct(F.when(F.size(good) > 0, good).otherwise(F.slice(raw, 1, 6))), 1, 8)


def claim_fingerprint(category: Column, title: Column) -> Column:
    return F.substring(F.sha1(F.concat(category, F.lit("-"), F.array_join(claim_tokens(title), " "))), 1, 16)


def confidence(score: Column) -> Column:
    return F.when(score >= 80, "HIGH").when(score >= 60, "MEDIUM").otherwise("LOW")


def action_tag(text: Column, has=any_keyword) -> Column:  # noqa: ANN001
    out = F.lit("na")
    for tag, words in reversed(C.ACTIONS.items()):
        out = F.when(has(text, words), tag).otherwise(out)
    return out


def topic_tag(text: Column, has=any_keyword) -> Column:  # noqa: ANN001
    nhi = has(text, C.TOPIC_NHI) & (has(text, C.TOPIC_NHI_ANCHORS) | ~immigration_context(text, has))
    return F.when(has(text, C.TOPIC_UFO), "ufo_uap").when(nhi, "alien_nhi").when(has(text, C.TOPIC_RETRIEVAL), "retrieval_claim").when(has(text, ["aaro"]), "aaro").otherwise("na")


#: All that :func:`action_tag`, :func:`topic_tag` and the actors look for.
TAG_KEYWORDS = [k for words in [*C.ACTIONS.values(), C.TOPIC_NHI, C.TOPIC_NHI_ANCHORS, C.TOPIC_UFO, C.TOPIC_RETRIEVAL, ["aaro", "alien", "aliens"], C.ALIEN_ANCHORS, C.IMMIGRATION_CONTEXT, C.ACTOR_KEYWORDS] for k in words]


def first_anchor(text: Column, keywords: list[str]) -> Column:
    """The first keyword of the list that is found."""
    return F.coalesce(*[F.when(has_keyword(text, k), F.lit(k)) for k in keywords], F.lit("na"))


def first_found(found: Column, keywords: list[str]) -> Column:
    """As :func:`first_anchor`, among what :func:`found_keywords` found."""
    return F.coalesce(F.try_element_at(hits_of(found, keywords), F.lit(1)), F.lit("na"))


def longest_anchor(text: Column, keywords: list[str], first=first_anchor) -> Column:  # noqa: ANN001
    """The longest keyword found; of equally long ones the first by alphabet."""
    return first(text, sorted(set(keywords), key=lambda k: (-len(k), k)))


def actor_group(actor: Column) -> Column:
    out = actor
    for k, v in C.ACTOR_GROUPS.items():
        out = F.when(actor == k, v).otherwise(out)
    return out


#: All that :func:`crisis_signature` looks for in a text.
CRISIS_SIGNS = C.OFFICIAL_ACTIONS + C.CRISIS_HARD_KEYWORDS + C.CRISIS_TOPICS


def crisis_signature(date: Column, title: Column, found: Column) -> Column:
    """``found`` are the keywords of CRISIS_SIGNS in the text; the actor is looked for in the title."""
    day = F.coalesce(date.cast("string"), F.lit("na"))
    anchor = lambda words: longest_anchor(found, words, first_found)
    return F.concat(day, F.lit("|act:"), anchor(C.OFFICIAL_ACTIONS + C.CRISIS_HARD_KEYWORDS), F.lit("|topic:"), anchor(C.CRISIS_TOPICS), F.lit("|actor:"), longest_anchor(title, C.CRISIS_ACTORS))


def week_of(date: Column) -> Column:
    return F.date_sub(date, F.weekday(date)).cast("date")


def ufo_signature(date: Column, found: Column) -> Column:
    """Null without action and actor. ``found`` are the keywords of TAG_KEYWORDS in the text."""
    action, actor = action_tag(found, any_of), first_found(found, C.ACTOR_KEYWORDS)
    sig = F.concat(F.coalesce(week_of(date).cast("string"), F.lit("na")), F.lit("|act:"), action, F.lit("|topic:"), topic_tag(found, any_of), F.lit("|actor:"), actor)
    return F.when((action != "na") | (actor != "na"), sig)


def domain_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no leading ``www.``, tracking parameters, trailing slashes or fragment; other strings stay."""
    u = F.trim(F.coalesce(url, F.lit("")))
    part = lambda p: F.try_parse_url(u, F.lit(p))
    drop = lambda kv: F.lower(F.substring_index(kv, "=", 1)).startswith("utm_") | F.lower(F.substring_index(kv, "=", 1)).isin(*C.TRACKING_KEYS) | (kv == "")
    query = F.array_join(F.transform(F.filter(F.split(F.coalesce(part("QUERY"), F.lit("")), "&"), lambda kv: ~drop(kv)), lambda kv: F.when(kv.contains("="), kv).otherwise(F.concat(kv, F.lit("=")))), "&")
    path = F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/+$", "")
    out = F.concat(F.lower(part("PROTOCOL")), F.lit("://"), F.regexp_replace(F.lower(part("AUTHORITY")), r"^www\.", ""), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.coalesce(out, u)


def date_from_url(url: Column) -> Column:
    """A valid date in the path or in ``?date=``: the first form that holds one."""

    def found(pattern: str) -> Column:
        p = [F.regexp_extract(F.coalesce(url, F.lit("")), pattern, i) for i in (1, 2, 3)]
        return F.to_date(F.try_to_timestamp(F.concat_ws("-", *p), F.lit("yyyy-M-d")))

    return F.coalesce(found(r"/(\d{4})/(\d{1,2})/(\d{1,2})(?:/|$)"), found(r"/(\d{4})-(\d{1,2})-(\d{1,2})(?:[-_/]|$)"), found(r"[?&]date=(\d{4})-(\d{1,2})-(\d{1,2})"))


def error_class(error: Column) -> Column:
    e = F.lower(F.coalesce(error, F.lit("")))
    return F.when(e == "", "none").when(e.contains("ssl") | e.contains("tls") | e.contains("certificate"), "ssl_tls").when(e.contains("timeout") | e.contains("timed out"), "timeout").when(e.contains("403"), "http_403").when(e.contains("404"), "http_404").when(e.contains("429"), "http_429").when(e.rlike(r"\b5\d{2}\b") & e.contains("http"), "http_5xx").when(e.contains("parse") | e.contains("xml"), "parse_error").otherwise("other")
