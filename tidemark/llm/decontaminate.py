"""Operator 6, benchmark decontamination: BM25 over test items, with block-max WAND.

The items are the stated query set's other side. How many of them hold a term, their number and their mean length are
aggregated over all items; tasks then build inverted indexes of blocks of items of like length, and every passage of
every document is a query against each. Whatever scores at or above the threshold is retrieved, and kept if the passage
holds enough of both the item's question and its answer. No result depends on how items are dealt into blocks.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, text_of, written
from .components import heavy_join

#: A score is a share of what the item itself would score; from this on, an item is retrieved.
THRESHOLD = 0.5
#: Shares of the word pairs of question and answer that a passage must hold.
QUESTION, ANSWER = 0.5, 0.5
#: Items in a block, and characters in them, at most, and bytes of indexes that are sent to the tasks together; the
#: documents are read once for each such set.
ITEMS, CHARS, BYTES = 20_000, 32_000_000, 64_000_000
#: Passages start every so many words and are twice as long: STRIDE, or the next power of two that an item of the block has.
STRIDE = 64
K1, B = 1.2, 0.75
POSTINGS = 64
#: Spans of items with bounds of their own, at most, and cells in the table of bounds.
SPANS, CELLS = 256, 4_000_000
#: Words of documents whose passages are bounded at once.
BATCH = 1 << 15
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.?!]\s")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def halves(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: up to the sentence end nearest the middle, if there is one within the middle half, else the middle word."""
    ends = [m.end() for m in SENTENCE.finditer(text) if len(text) / 4 <= m.end() <= 3 * len(text) / 4]
    if ends:
        cut = min(ends, key=lambda e: (abs(2 * e - len(text)), e))
        q, a = words(text[:cut]), words(text[cut:])
        if len(q) > 1 and len(a) > 1:
            return q, a
    w = words(text)
    return w[: len(w) // 2], w[len(w) // 2 :]


def pairs(w: list[str]) -> Counter:
    """Pairs of neighbours; a lone word is paired with nothing."""
    return Counter(zip(w, w[1:])) if len(w) > 1 else Counter((x, "") for x in w)


def overlap(part: Counter, passage: Counter, alone: set[str]) -> float:
    n = sum(part.values())
    return sum(min(c, passage[p]) if p[1] else p[0] in alone for p, c in part.items()) / n if n else 1.0


@dataclass
class Index:
    """Posting lists by term: item numbers, impacts (shares of the item's own score), and the largest impact of each block of postings."""

    ids: list[int]
    terms: dict[str, int]
    postings: list[tuple[list[int], list[float]]]
    block_max: list[list[float]]
    list_max: np.ndarray
    bounds: np.ndarray
    question: list[Counter]
    answer: list[Counter]
    stride: int


def build_index(items: list[tuple[int, str]], df: dict[str, int] | None = None, n: int = 0, mean: float = 0.0, stride: int = STRIDE) -> Index:
    """The index of ``(item id, text)``, with the largest impact of each term in each of at most SPANS spans of items.

    ``df``, ``n`` and ``mean`` are those of all items: how many hold a term, their number and mean length. Without them the given items are all.
    """
    bags = [Counter(words(t)) for _, t in items]
    if df is None:
        df = Counter(t for bag in bags for t in bag)
        n, mean = len(items), sum(sum(bag.values()) for bag in bags) / max(1, len(items))
    terms = {t: i for i, t in enumerate(sorted({t for bag in bags for t in bag}))}
    impacts: list[dict[str, float]] = []
    for bag in bags:
        norm = K1 * (1 - B + B * sum(bag.values()) / mean) if mean else 1
        raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + norm) for t, c in bag.items()}
        total = sum(raw.values())
        impacts.append({t: x / total for t, x in raw.items()})
    lists: list[tuple[list[int], list[float]]] = [([], []) for _ in terms]
    for i, imp in enumerate(impacts):
        for t, x in imp.items():
            lists[terms[t]][0].append(i)
            lists[terms[t]][1].append(x)
    span = max(1, -(-len(items) // min(SPANS, max(16, CELLS // max(1, len(terms))))))
    bounds = np.zeros((len(terms), -(-len(items) // span)), np.float32)
    for k, (at, x) in enumerate(lists):
        np.maximum.at(bounds[k], np.array(at) // span, x)
    block_max = [[max(x[j : j + POSTINGS]) for j in range(0, len(x), POSTINGS)] for _, x in lists]
    split = [halves(t) for _, t in items]
    return Index([i for i, _ in items], terms, lists, block_max, np.array([max(b) for b in block_max] or [0.0]), bounds, [pairs(q) for q, _ in split], [pairs(a) for _, a in split], stride)


def block_max_wand(ix: Index, query: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items that score at or above the threshold for the distinct terms of a query, without scoring the others."""
    eps = 1e-9
    at = {t: 0 for t in query}
    out = []
    live = sorted((ix.postings[t][0][0], t) for t in query)
    while live:
        bound, pivot = 0.0, -1
        for k, (_, t) in enumerate(live):
            bound += ix.list_max[t]
            if bound >= threshold - eps:
                pivot = k
                break
        if pivot < 0:
            break
        item = live[pivot][0]
        while pivot + 1 < len(live) and live[pivot + 1][0] == item:
            pivot += 1
        # the largest impacts in the blocks that could hold the item; their ends tell how far one may jump
        bound, jump = 0.0, live[pivot + 1][0] if pivot + 1 < len(live) else 1 << 60
        for _, t in live[: pivot + 1]:
            ids, p = ix.postings[t][0], at[t] // POSTINGS
            while (p + 1) * POSTINGS < len(ids) and ids[min(len(ids), (p + 1) * POSTINGS) - 1] < item:
                p += 1
            last = min(len(ids), (p + 1) * POSTINGS) - 1
            if ids[last] >= item:
                bound += ix.block_max[t][p]
                jump = min(jump, ids[last] + 1)
        if bound >= threshold - eps:
            score, jump = 0.0, item + 1
            for _, t in live[: pivot + 1]:
                ids, p = ix.postings[t][0], at[t]
                while p < len(ids) and ids[p] < item:
                    p += 1
                at[t] = p
                if p < len(ids) and ids[p] == item:
                    score += ix.postings[t][1][p]
            if score >= threshold - eps:
                out.append((item, score))
        jump = max(jump, item + 1)
        moved = []
        for d, t in live[: pivot + 1]:
            ids, p = ix.postings[t][0], at[t]
            while p < len(ids) and ids[p] < jump:
                p += 1
            at[t] = p
            if p < len(ids):
                moved.append((ids[p], t))
        live = sorted(moved + live[pivot + 1 :])
    return out


def search_texts(indexes: list[Index], texts: list[str], threshold: float) -> list[dict[tuple[int, int], tuple[float, float, float]]]:
    """For each text, and each item (index, number) retrieved for a passage of it: score, question and answer overlap of its best passage.

    Each passage is first held against the spans: only if its terms' largest impacts in some span add up to the
    threshold is it searched.
    """
    found: list[dict[tuple[int, int], tuple[float, float, float]]] = [{} for _ in texts]
    held: list[tuple[int, list[str]]] = []
    size = 0
    for k, text in enumerate(texts):
        held.append((k, words(text)))
        size += len(held[-1][1])
        if size >= BATCH or k == len(texts) - 1:
            for i, ix in enumerate(indexes):
                _search_batch(ix, i, held, threshold, found)
            held, size = [], 0
    return found


def _search_batch(ix: Index, number: int, held: list[tuple[int, list[str]]], threshold: float, found: list[dict[tuple[int, int], tuple[float, float, float]]]) -> None:
    stride = ix.stride
    flat = [x for _, w in held for x in w]
    ids = np.fromiter(map(ix.terms.get, flat, itertools.repeat(-1)), np.int64, len(flat))
    lengths = np.array([len(w) for _, w in held])
    first = np.cumsum(lengths) - lengths
    counts = np.maximum(1, -(-(lengths - stride) // stride))  # passages of each text
    owner = np.repeat(np.arange(len(held)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    lo = first[owner] + nth * stride
    hi = np.minimum(lo + 2 * stride, first[owner] + lengths[owner])
    of = np.repeat(np.arange(len(owner)), hi - lo)
    at = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    n = max(1, len(ix.terms))
    key = np.unique((of * n + ids[at])[ids[at] >= 0])
    passage, term = key // n, key % n
    for p0 in range(0, len(owner), 512):
        a, b = np.searchsorted(passage, (p0, p0 + 512))
        if a == b:
            continue
        here, starts = np.unique(passage[a:b], return_index=True)
        bound = np.add.reduceat(ix.bounds[term[a:b]], starts, axis=0).max(axis=1)
        for p in here[bound >= threshold - 1e-4].tolist():
            i, j = np.searchsorted(passage, (p, p + 1))
            hits = block_max_wand(ix, term[i:j].tolist(), threshold)
            if not hits:
                continue
            w = flat[lo[p] : hi[p]]
            inside, alone, best = pairs(w), set(w), found[held[owner[p]][0]]
            for item, score in hits:
                q, s = overlap(ix.question[item], inside, alone), overlap(ix.answer[item], inside, alone)
                had = best.get((number, item))
                if had is None or (min(q, s), score) > (min(had[1:]), had[0]):
                    best[number, item] = (score, q, s)


def _bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        bags = [Counter(words(t)) for t in df["t"]]
        yield df.assign(n=[sum(b.values()) for b in bags], terms=[sorted(b) for b in bags])


def item_indexes(items: DataFrame) -> DataFrame:
    """``stride, block, size, data``: the pickled index of each block of ``items (i, t)``, built in the tasks from statistics over all items."""
    bags = written(items.distinct().withColumn("key", F.sha2(F.concat_ws("|", "i", "t"), 256)).mapInPandas(_bags, "i long, t string, key string, n long, terms array<string>"), "item-bags")
    n, mean = bags.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    seen = bags.select("key", F.explode("terms").alias("term"))
    df = written(seen.groupBy("term").agg(F.count("*").alias("c")).withColumn("df", F.col("c")), "item-terms")
    known = heavy_join(seen, df, ["term"], "key").groupBy("key").agg(F.collect_list("term").alias("terms"), F.collect_list("df").alias("dfs"))
    placed = bags.drop("terms").withColumn("stride", F.greatest(F.lit(STRIDE), F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")))
    sizes = placed.groupBy("stride").agg(F.greatest(F.ceil(F.count("*") / ITEMS), F.ceil(F.sum(F.length("t")) / CHARS)).alias("blocks"))
    rows = placed.join(F.broadcast(sizes), "stride").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).join(known, "key")  # sizes: a row for each power of two

    def build(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("key")
        dfs = {t: c for ts, cs in zip(df["terms"], df["dfs"]) for t, c in zip(ts, cs)}
        data = pickle.dumps(build_index(list(zip(df["i"].tolist(), df["t"])), dfs, n, mean, int(key[0])))
        return pd.DataFrame({"stride": [int(key[0])], "block": [int(key[1])], "size": [len(data)], "data": [data]})

    out = written(rows.groupBy("stride", "block").applyInPandas(build, "stride long, block long, size long, data binary"), "item-indexes")
    dropped(bags, df)
    return out


def retrieve(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap, contaminated``: a row for each document and item that one of its passages retrieves.

    Null and empty texts and items, and items without an id, match nothing; repeated rows of documents give repeated
    rows; of equal rows of items one counts, and items of one id with different texts are different items that may give
    several rows. No text is cut short: passages cover each document, overlapping by half, and for each item there are
    some that are long enough to hold it. Empty tables give an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).cast("long").alias("i"), text_of(item_text).alias("t")).where(F.col("i").isNotNull() & F.col("t").rlike(r"[^\W_]"))
    indexes = item_indexes(items)
    sets: list[list[tuple[int, int]]] = [[]]
    size = 0
    for r in indexes.select("stride", "block", "size").orderBy("stride", "block").collect():  # a row for each block of ITEMS
        if sets[-1] and size + r["size"] > BYTES:
            sets.append([])
            size = 0
        sets[-1].append((r["stride"], r["block"]))
        size += r["size"]
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("_text"))
    out = None
    for chosen in sets:
        part = indexes.where(F.struct("stride", "block").isin([F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in chosen])) if chosen else indexes
        shipped = spark.sparkContext.broadcast([bytes(r["data"]) for r in part.orderBy("stride", "block").select("data").collect()])  # BYTES at most

        def search(frames: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            ixs = [pickle.loads(x) for x in shipped.value]
            for df in frames:
                rows = [(d, ixs[x].ids[item], *map(float, found)) for d, hits in zip(df["doc_id"], search_texts(ixs, list(df["_text"]), threshold)) for (x, item), found in sorted(hits.items())]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]).astype({"item_id": "int64", "score": "float64", "question_overlap": "float64", "answer_overlap": "float64"})

        part = base.mapInPandas(search, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    dropped(indexes)
    return out.withColumn("contaminated", (F.col("question_overlap") >= question) & (F.col("answer_overlap") >= answer))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options: object) -> DataFrame:
    """``docs`` without the contaminated documents. Rows with a null id stay: they can't be told apart."""
    bad = retrieve(docs, items, doc_id, **options).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col(doc_id) == F.col("_bad"), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": op6_decontamination}
ORACLES: dict[str, str] = {}
