"""Operator 4, exact substring dedup by longest previous factors.

Texts are cut into regions by the least 24-byte gram of each window of LIMIT bytes, so that equal windows lie in regions
of one gram. Of regions of equal bytes the first stands for the others. The regions of a gram make blocks of bounded
size; a block's suffixes are put in order, and the previous and next smaller positions in that order give each its
longest factor that also starts earlier. What a block of a gram with several blocks has found no earlier match for is
held against the like of the gram's other blocks, by a digest of its window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, one_text_each, table, text_of, written
from .components import heavy_join
from .hashing import mix, powers, prefix_sums

LIMIT, GRAM = 100, 24
SPAN = LIMIT - GRAM + 1
CHUNK = 1 << 16
_LOW = np.uint64((1 << 17) - 1)
#: Regions in a block, about.
CROWD = 8000
#: Suffixes that are worked on at once, of one or more blocks.
WINDOWS = 1 << 18


def regions(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``gram, digest of the bytes (two halves), start, number of window starts`` of a text's regions. Works in pieces of CHUNK starts."""
    out = []
    for c in range(0, len(b) - LIMIT + 1, CHUNK):
        piece = b[c : c + CHUNK + LIMIT - 1]
        p, inv = prefix_sums(piece), powers(len(piece) + 1)[1]
        g = mix((p[GRAM:] - p[:-GRAM]) * inv[: len(piece) - GRAM + 1])
        v = (g & ~_LOW) | (_LOW - np.arange(len(g), dtype=np.uint64))
        done = 1
        while 2 * done <= SPAN:
            v = np.minimum(v[:-done], v[done:])
            done *= 2
        v = np.minimum(v[: len(v) - (SPAN - done)], v[SPAN - done :])  # v[i]: the least gram, the last of equal ones, of window i
        at = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        n = np.diff(np.append(at, len(v)))
        raw = piece.tobytes()
        digests = b"".join(_digest(raw[x:y]) for x, y in zip(at.tolist(), (at + n + LIMIT - 1).tolist()))
        content = np.frombuffer(digests, np.int64).reshape(-1, 2)
        out.append((v[at] >> np.uint64(17), content[:, 0], content[:, 1], at + c, n))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _regions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        parts = []
        for i, t in zip(df["id"], df["_text"]):
            g, x, y, a, n = regions(_bytes(t))
            parts.append((g, x, y, np.full(len(g), i), a, n))
        g, x, y, i, a, n = (np.concatenate(z).astype(np.int64) for z in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 6
        yield pd.DataFrame({"gram": g, "content_a": x, "content_b": y, "id": i, "a": a.astype(np.int32), "n": n.astype(np.int32)})


def window_words(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The LIMIT bytes from each start, as big-endian numbers: their order is that of the suffixes, as far as LIMIT."""
    width = -(-LIMIT // 8) * 8
    w = np.zeros((len(starts), width), np.uint8)
    w[:, :LIMIT] = np.lib.stride_tricks.sliding_window_view(b, LIMIT)[starts]
    return w.view(">u8").astype(np.uint64)


def common_prefixes(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bytes that each suffix in order has in common with the one before it, LIMIT at most; none at a group's first."""
    raw = words.astype(">u8").view(np.uint8).reshape(len(words), -1)[:, :LIMIT]
    same = raw[1:] == raw[:-1]
    n = np.where(same.all(axis=1), LIMIT, same.argmin(axis=1))
    return np.concatenate(([0], np.where(group[1:] == group[:-1], n, 0)))


def previous_factors(position: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix in order: what it has in common with its previous or next smaller position.

    A stack holds suffixes with ever larger positions, each with what it shares with its previous smaller position;
    a suffix leaves it when its next smaller position comes.
    """
    out = [0] * len(position)
    stack: list[tuple[int, int, int]] = []  # place in order, position, bytes in common with the previous smaller position
    for i, (p, shared) in enumerate(zip([*position.tolist(), -1], [*prefix.tolist(), 0])):
        while stack and p < stack[-1][1]:
            j, _, before = stack.pop()
            out[j] = max(before, shared)
            shared = min(before, shared)
        stack.append((i, p, shared))
    return np.array(out, np.int64)


def repeated(group: np.ndarray, words: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each suffix has a longest previous factor of LIMIT bytes or more in its group. Those without their like in hash have none, and aren't ordered."""
    h = mix(group.astype(np.uint64))
    for w in words.T:
        h = mix((h ^ w) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(h)
    pair = h[by][1:] == h[by][:-1]
    by = by[np.concatenate((pair, [False])) | np.concatenate(([False], pair))]
    order = by[np.lexsort((starts[by], ids[by], *words[by].T[::-1], group[by]))]
    out = np.zeros(len(group), bool)
    if len(order):
        position = np.empty(len(order), np.int64)
        position[np.lexsort((starts[order], ids[order]))] = np.arange(len(order))
        out[order] = previous_factors(position, common_prefixes(group[order], words[order])) >= LIMIT
    return out


def _factors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by block; blocks are worked on together, WINDOWS suffixes or a block at a time."""

    def work(df: pd.DataFrame, block: np.ndarray) -> pd.DataFrame:
        n = df["n"].to_numpy(np.int64)
        group, ids = np.repeat(block, n), np.repeat(df["id"].to_numpy(), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = inner + np.repeat(df["a"].to_numpy(np.int64), n)
        b = np.frombuffer(b"".join(df["bytes"]), np.uint8)
        size = n + LIMIT - 1
        words = window_words(b, inner + np.repeat(np.cumsum(size) - size, n))
        gone = repeated(group, words, ids, starts)
        out = runs(ids, starts, gone).assign(left=False, key_a=0, key_b=0)
        left = np.flatnonzero(~gone & np.repeat(df["parts"].to_numpy() > 1, n))
        if not len(left):
            return out
        keys = np.frombuffer(b"".join(_digest(words[i].tobytes()) for i in left.tolist()), np.int64).reshape(-1, 2)
        more = pd.DataFrame({"id": ids[left], "a": starts[left].astype(np.int32), "n": np.ones(len(left), np.int32), "left": True, "key_a": keys[:, 0], "key_b": keys[:, 1]})
        return pd.concat([out, more], ignore_index=True)

    held = None
    for df in frames:
        df = df if held is None else pd.concat([held, df], ignore_index=True)
        gram, part, upto = df["gram"].to_numpy(), df["part"].to_numpy(), df["n"].cumsum().to_numpy()
        new = (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])
        block = np.cumsum(np.concatenate(([False], new)))
        ends = np.flatnonzero(np.concatenate((new, [False]))) + 1
        at = 0
        while len(ends) and at < ends[-1]:
            base = upto[at - 1] if at else 0
            k = ends[(ends > at) & (upto[ends - 1] - base <= WINDOWS)]
            to = int(k[-1]) if len(k) else int(ends[ends > at][0])
            yield work(df.iloc[at:to], block[at:to])
            at = to
        held = df.iloc[at:]
    if held is not None and len(held):
        yield work(held, np.zeros(len(held), np.int64))


def runs(ids: np.ndarray, starts: np.ndarray, marked: np.ndarray) -> pd.DataFrame:
    """Marked window starts as ``id, a, n``; neighbours become one row."""
    ids, starts = ids[marked], starts[marked]
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1] + 1)))) if len(ids) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(ids)))
    return pd.DataFrame({"id": ids[first].astype(np.int64), "a": starts[first].astype(np.int32), "n": n.astype(np.int32)})


def _cut_out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of the regions asked for."""
    for df in frames:
        rows = []
        for i, t, wanted in zip(df["id"], df["_text"], df["wanted"]):
            raw = (t or "").encode("utf-8", "surrogatepass")
            rows.extend((w["gram"], w["parts"], i, w["a"], w["n"], raw[w["a"] : w["a"] + w["n"] + LIMIT - 1]) for w in wanted)
        yield pd.DataFrame(rows, columns=["gram", "parts", "id", "a", "n", "bytes"])


def _keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        rows = []
        for i, t, spans in zip(df["id"], df["_text"], df["spans"]):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if spans is None:
                rows.append((i, len(raw), raw, []))
                continue
            a = np.array([s["a"] for s in spans], np.int64)
            e = a + np.array([s["n"] for s in spans], np.int64) + LIMIT - 1
            order = np.argsort(a, kind="stable")
            a, e = a[order], np.maximum.accumulate(e[order])
            first = np.flatnonzero(np.concatenate(([True], a[1:] > e[:-1])))
            a, e = a[first], e[np.append(first[1:], len(e)) - 1]
            bounds = [0, *np.stack([a, e], 1).ravel().tolist(), len(raw)]
            kept = b"".join(raw[x:y] for x, y in zip(bounds[::2], bounds[1::2]))
            rows.append((i, len(raw), kept, np.stack([a, e], 1).tolist()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "kept", "spans"])


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, kept (binary), spans``, a row per distinct non-null integer ``doc_id``.

    ``spans`` are the removed runs, as ``[start, end)`` in bytes: all that is covered by a string of LIMIT bytes that
    also starts earlier, in a smaller doc_id or further ahead in the same text. Matches don't cross documents and are
    judged on the input; they are told by bytes, or by 128-bit BLAKE2 digests of them. A null text counts as empty.
    Rows of one doc_id count as one document: that with the longest text, then the largest SHA-256. An empty table
    gives an empty result. Other columns are ignored.
    """
    base = one_text_each(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("_text")))
    rows = written(base.where(F.octet_length("_text") >= LIMIT).mapInPandas(_regions, "gram long, content_a long, content_b long, id long, a int, n int"), "suffix-regions")
    twice = written(rows.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1"), "suffix-grams")
    shared = written(heavy_join(rows, twice, ["gram"], "id"), "suffix-shared")
    dropped(rows, twice)
    same = ["gram", "content_a", "content_b"]
    kinds = written(shared.groupBy(*same).agg(F.min(F.struct("id", "a", "n")).alias("top"), F.count("*").alias("c")), "suffix-kinds")
    copies = kinds.where("c > 1").select(*same, F.col("top.id").alias("top_id"), F.col("top.a").alias("top_a"), "c")
    later = heavy_join(shared, copies, same, "id").where((F.col("id") != F.col("top_id")) | (F.col("a") != F.col("top_a"))).select("id", "a", "n")
    later = written(later, "suffix-later")
    dropped(shared)
    several = written(kinds.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").withColumn("parts", F.ceil(F.col("c") / CROWD).cast("int")), "suffix-several")
    ask = heavy_join(kinds.select("gram", "top.*"), several, ["gram"], "id")
    ask = ask.groupBy("id").agg(F.collect_list(F.struct("gram", "parts", "a", "n")).alias("wanted"))
    cut = base.join(ask, "id").mapInPandas(_cut_out, "gram long, parts int, id long, a int, n int, bytes binary")
    blocks = cut.withColumn("part", F.pmod(F.xxhash64("id", "a"), "parts")).repartition("gram", "part").sortWithinPartitions("gram", "part")
    found = written(blocks.mapInPandas(_factors, "id long, a int, n int, left boolean, key_a long, key_b long"), "suffix-found")
    dropped(kinds, several)
    left = found.where("left")
    least = written(left.groupBy("key_a", "key_b").agg(F.min(F.struct("id", "a")).alias("top"), F.count("*").alias("c")).where("c > 1").select("key_a", "key_b", F.col("top.id").alias("top_id"), F.col("top.a").alias("top_a"), "c"), "suffix-least")
    also = heavy_join(left, least, ["key_a", "key_b"], "id").where((F.col("id") != F.col("top_id")) | (F.col("a") != F.col("top_a"))).select("id", "a", "n")
    spans = written(later.unionByName(found.where("NOT left").select("id", "a", "n")).unionByName(also).groupBy("id").agg(F.collect_list(F.struct("a", "n")).alias("spans")), "suffix-spans")
    dropped(found, later, least)
    return base.join(spans, "id", "left").mapInPandas(_keep, "doc_id long, n_bytes long, kept binary, spans array<array<long>>")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes are taken as pairs of hexadecimal digits; windows are cut from pieces of PIECE starts.
PIECE = 500
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, c, least(n - {LIMIT - 1} - c, {PIECE}) AS k, substring(x, 2 * c + 1, 2 * {PIECE + LIMIT - 1}) AS y FROM (SELECT *, unnest(range(0, n - {LIMIT - 1}, {PIECE})) AS c FROM d)),
w AS (SELECT doc_id, c + j AS i, md5(substring(y, 2 * j + 1, 2 * {LIMIT})) AS h FROM (SELECT *, unnest(range(0, k)) AS j FROM p)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1),
t AS (SELECT doc_id, i, sum(CASE WHEN prev IS NULL OR i > prev + {LIMIT} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + {LIMIT} AS e FROM t GROUP BY doc_id, g),
b AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b FROM s),
k AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(substring(x, 2 * b + 1, 2 * (a - b)), '' ORDER BY a) || substring(any_value(x), 2 * max(e) + 1) AS kept FROM b JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLES = {"op4_suffix_dedup": SQL}
