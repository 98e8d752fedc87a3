"""Merging the pages of a paged source: each entry once, by its first page, until pages bring nothing new."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import normalize

#: Successive answered pages without a new entry after which no further page is asked for, and pages of a source at most.
STOP, MOST_PAGES = 2, 120


def entry_key(url: Column, title: Column, date: Column) -> Column:
    """An entry is known by its URL, or without one by title and date."""
    blank = F.coalesce(url, F.lit("")) == ""
    by_title = F.concat_ws("\n", F.lit("t"), F.lower(normalize(title)), F.coalesce(date.cast("string"), F.lit("")))
    return F.when(blank, by_title).otherwise(F.concat(F.lit("u\n"), url))


def paged_status(pages: DataFrame, entries: DataFrame, stop: int = STOP) -> DataFrame:
    """``source, page, failed, n_new, asked``: how many entries an answered page brings that none before it had, and whether the page is asked for at all.

    ``pages (source, page, failed)`` in order of trial, ``entries (source, page, ord, url, title, date)`` of them. A
    page that failed neither counts as one without news nor breaks their run. A page's news don't hang on where the
    run ends, so they are counts of first pages; only the short list of a source's pages is put in order.
    """
    answered = entries.join(pages.where("failed").select("source", "page"), ["source", "page"], "left_anti")
    first = answered.groupBy("source", entry_key(F.col("url"), F.col("title"), F.col("date")).alias("_key")).agg(F.min("page").alias("page"))
    news = first.groupBy("source", "page").agg(F.count("*").alias("n_new"))
    known = pages.join(news, ["source", "page"], "left").withColumn("n_new", F.when(~F.col("failed"), F.coalesce("n_new", F.lit(0))))
    order = W.partitionBy("source").orderBy("page")
    ok = known.where("NOT failed").withColumn("_k", F.row_number().over(order)).withColumn("_run", F.sum("n_new").over(order.rowsBetween(1 - stop, 0)))
    end = ok.where((F.col("_k") >= stop) & (F.col("_run") == 0)).groupBy("source").agg(F.min("page").alias("_end"))
    return known.join(end, "source", "left").withColumn("asked", F.col("_end").isNull() | (F.col("page") <= F.col("_end"))).drop("_end")


def merge_pages(pages: DataFrame, entries: DataFrame, stop: int = STOP) -> DataFrame:
    """``entries`` of the pages asked for, each key's first by page and ``ord``; other columns pass through."""
    asked = paged_status(pages, entries, stop).where("asked AND NOT failed").select("source", "page")
    rest = [c for c in entries.columns if c != "source"]
    some = entries.join(asked, ["source", "page"], "left_semi")
    key = entry_key(F.col("url"), F.col("title"), F.col("date")).alias("_key")
    return some.groupBy("source", key).agg(F.min_by(F.struct(*rest), F.struct("page", "ord")).alias("x")).select("source", "x.*")


def paged_result(status: DataFrame) -> DataFrame:
    """``source, entries, pages_asked, last_page, error`` by source, of :func:`paged_status`: the last page that answered, and an error where nothing came."""
    a = status.where("asked")
    n = F.coalesce(F.sum("n_new"), F.lit(0))
    return a.groupBy("source").agg(n.alias("entries"), F.count("*").alias("pages_asked"), F.max(F.when(~F.col("failed"), F.col("page"))).alias("last_page")).withColumn("error", F.when(F.col("entries") == 0, "paged_fetch_failed"))


STREAMED = "source string, page long, ord long, url string, title string, date string"
PAGE_ENTRIES = "array<struct<ord: long, url: string, title: string, date: string>>"


def stream_pages(pages: DataFrame, first_page: int = 1, stop: int = STOP) -> DataFrame:
    """The same for a stream of ``source, page, failed, entries``, whose pages may come in any order and batch.

    A source's state is its next page, the run of pages without news, the keys seen and the pages that wait for one
    before them: at most what MOST_PAGES pages hold. What comes after the end, or once more, is ignored.
    """
    key = F.transform("entries", lambda e: F.struct(e["ord"].alias("ord"), e["url"].alias("url"), e["title"].alias("title"), e["date"].alias("date"), entry_key(e["url"], e["title"], e["date"]).alias("key")))
    rows = pages.select("source", F.col("page").cast("long"), F.coalesce("failed", F.lit(False)).alias("failed"), F.to_json(F.coalesce(key, F.array())).alias("entries"))

    def fold(group, frames, state: GroupState):  # noqa: ANN001, ANN202
        page, empty, over, seen, waiting = state.get if state.exists else (first_page, 0, False, "[]", "{}")
        seen, waiting, out = set(json.loads(seen)), json.loads(waiting), []
        for f in frames:
            for p, failed, entries in zip(f["page"], f["failed"], f["entries"]):
                if not over and page <= p < first_page + MOST_PAGES:
                    waiting.setdefault(str(p), None if failed else entries)
        while not over and str(page) in waiting:
            entries = waiting.pop(str(page))
            if entries is not None:
                fresh = []
                for e in sorted(json.loads(entries), key=lambda e: e.get("ord", 0)):
                    if e["key"] not in seen:
                        seen.add(e["key"])
                        fresh.append((group[0], page, e.get("ord"), e.get("url"), e.get("title"), e.get("date")))
                out += fresh
                empty = 0 if fresh else empty + 1
                over = empty >= stop
            page += 1
        if over:
            seen, waiting = set(), {}
        state.update((page, empty, over, json.dumps(sorted(seen)), json.dumps(waiting)))
        yield pd.DataFrame(out, columns=["source", "page", "ord", "url", "title", "date"])

    return rows.groupBy("source").applyInPandasWithState(fold, STREAMED, "page long, empty long, over boolean, seen string, waiting string", "append", GroupStateTimeout.NoTimeout)
