"""Operator 8, MinHash near-duplicates: banding, verification and connected components.

Documents of one shingle set stand for one another from the start. Minima of many universal hash functions are banded
into buckets; buckets give a graph of candidates, as stars, never as all pairs. Its components are dealt into blocks
of bounded size, every block sharing some leaders of its component; a task compares signatures within its block and
confirms links on full sets. What the blocks of a large component leave apart is compared by bucket, and where a
bucket is crowded by the buckets of longer bands, so that the work follows the buckets and not the component. Where
these are crowded, too (pages of one template, just too different for links), documents meet by the rarest shingles of
their sets: two sets at the threshold have one of them in common, and a template's own shingles aren't among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, one_text_each, table, text_of, written
from .components import components, salted_join
from .hashing import mix, shingles, text_bytes, word_hashes

BANDS, ROWS = 36, 5
#: Documents in a block, and leaders of its component that each block shares, on average.
BLOCK, LEADERS = 192, 24
#: A pair whose signatures agree on less than the threshold by this share is no link: over five standard errors.
SLACK = 0.16
#: The bands of crowded buckets: a pair at 0.8 shares one with a probability of 1 - 2e-5.
FINE_BANDS, FINE_ROWS = 60, 8
#: Shingles of a set that counts as small, and blocks of left-over documents that a group may hold against all of it.
FEW, LEFT = 16, 4
_rng = np.random.default_rng(20240517)
_A = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_FINE_A = _rng.integers(1, 1 << 63, FINE_BANDS * FINE_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(text_bytes(text)), k))


def signature(s: np.ndarray, a: np.ndarray = _A, c: np.ndarray = _B) -> np.ndarray:
    """The minima; in pieces, so that memory doesn't follow the text."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(out, (a[:, None] * s[None, i : i + 2048] + c[:, None]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band's minima, taken with the band's number."""
    x = sig.reshape(-1, rows)
    h = mix(np.arange(1, len(x) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in range(rows):
        h = mix((h ^ x[:, i]) * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def set_key(text: str | None, k: int) -> tuple[np.ndarray, int, int]:
    """The set of a text, and 128 bits of it; of few shingles from two independent hashes of its words, as there a clash of one hash would matter."""
    b = text_bytes(text)
    s, at = np.unique(shingles(word_hashes(b), k), return_index=True)
    other = shingles(word_hashes(b, 1), k)[at] if len(s) < FEW else s
    one, two = (int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in (s ^ np.uint64(0x243F6A8885A308D3), mix(s) ^ other))
    return s, one, two


def _sign(frames: Iterator[pd.DataFrame], k: int, percent: int) -> Iterator[pd.DataFrame]:
    """Sets so small that only an equal one reaches ``percent`` need no bands."""
    for df in frames:
        rows = []
        for i, text in zip(df["id"], df["_text"]):
            s, a, b = set_key(text, k)
            rows.append((i, len(s), a, b, band_keys(signature(s)) if 100 * len(s) >= percent * (len(s) + 1) else None))
        yield pd.DataFrame(rows, columns=["id", "n_shingles", "set_a", "set_b", "bands"])


def _with_sets(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for df in frames:
        df["_set"] = [shingle_set(t, k).tobytes() for t in df["_text"]]
        yield df[["id", "group", "size", "_set"]]


def _fine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    none = np.zeros(len(_FINE_A), np.uint64)
    for df in frames:
        yield pd.DataFrame({"id": df["id"], "bands": [band_keys(signature(np.frombuffer(s, np.uint64), _FINE_A, none), FINE_ROWS) for s in df["_set"]]})


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def block_links(ids: np.ndarray, sets: list[np.ndarray], comps: np.ndarray, first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join the block's components. Only pairs with one of ``first`` are compared."""
    root = {c: c for c in comps.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    sigs = np.stack([signature(s) for s in sets]) if len(ids) > 8 else None
    least = percent / 100 - SLACK
    for i in np.flatnonzero(first):
        near = np.flatnonzero((sigs == sigs[i]).mean(axis=1) >= least) if sigs is not None else np.arange(len(ids))
        for j in near:
            if j != i and (not first[j] or j > i) and (x := find(int(comps[i]))) != (y := find(int(comps[j]))) and _linked(sets[i], sets[j], percent):
                root[max(x, y)] = min(x, y)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _blocks(frames: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by ``key``; a block is worked on when its last row has come."""
    held: list[pd.DataFrame] = []

    def work(block: pd.DataFrame) -> list[tuple[int, int]]:
        if len(block) < 2:
            return []
        return block_links(block["id"].to_numpy(), [np.frombuffer(s, np.uint64) for s in block["_set"]], block["comp"].to_numpy(), block["first"].to_numpy(), percent)

    for df in frames:
        df = pd.concat([*held, df], ignore_index=True)
        groups = [g for _, g in df.groupby("key", sort=False)]
        held = groups[-1:]
        yield pd.DataFrame([x for g in groups[:-1] for x in work(g)], columns=["u", "v"], dtype="int64")
    yield pd.DataFrame([x for g in held for x in work(g)], columns=["u", "v"], dtype="int64")


def _confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of the blocks in ``rows (key, id, comp, first, _set)``."""
    return rows.repartition("key").sortWithinPartitions("key").mapInPandas(lambda it: _blocks(it, percent), "u long, v long")


def _part(seed: int):  # noqa: ANN202
    return F.xxhash64(F.lit(seed), "id").bitwiseAND(F.lit((1 << 30) - 1))


def _blocks_of(members: DataFrame) -> DataFrame:
    """``members (group, size, id, comp, _set)`` dealt into blocks, of which each has the group's leaders too."""
    n = F.ceil(F.col("size") / BLOCK).cast("long")
    places = F.when(_part(5) * F.col("size") < F.lit(LEADERS << 30), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array(F.pmod(_part(3), n).cast("long")))
    return members.withColumn("b", F.explode(places)).select(F.xxhash64("group", "b").alias("key"), "id", "comp", F.lit(True).alias("first"), "_set")


def _grid_of(members: DataFrame) -> DataFrame:
    """Of each group, what is outside its most frequent component against all of it, block by block."""
    by_comp = members.groupBy("group", "comp").agg(F.count("*").alias("c"))
    giant = written(by_comp.groupBy("group").agg(F.max_by("comp", F.struct("c", "comp")).alias("giant"), (F.sum("c") - F.max("c")).alias("left_over")), "near-giants")
    zero, n_b, own_q = F.lit(0).cast("long"), F.ceil(F.col("size") / BLOCK).cast("long"), F.pmod(_part(9), F.col("n_q")).cast("long")
    wide = salted_join(members, giant, ["group"], "id").withColumn("n_q", F.ceil(F.col("left_over") / BLOCK).cast("long"))
    apart = wide.where("comp <> giant").withColumn("q", own_q).withColumn("b", F.explode(F.sequence(zero, n_b - 1))).withColumn("first", F.lit(True))
    held = wide.withColumn("q", F.explode(F.sequence(zero, F.col("n_q") - 1))).where((F.col("comp") == F.col("giant")) | (own_q != F.col("q"))).withColumn("b", F.pmod(_part(3), n_b).cast("long")).withColumn("first", F.lit(False))
    cols = ["group", "q", "b", "id", "comp", "first", "_set"]
    return apart.select(*cols).unionByName(held.select(*cols)).select(F.xxhash64("group", "q", "b").alias("key"), "id", "comp", "first", "_set")


def _open(banded: DataFrame, comps: DataFrame) -> DataFrame:
    """``group, size, id, comp`` of the buckets of ``banded (id, bands)`` that hold several components. Buckets of the same few documents count once."""
    at = written(banded.join(comps, "id").select("id", "comp", F.explode("bands").alias("bucket")), "near-at")
    stats = written(at.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "size"), "near-open")
    rows = salted_join(at, stats, ["bucket"], "id")
    few = rows.where(F.col("size") <= BLOCK).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("id", "comp"))).alias("m")).groupBy("m").agg(F.min("bucket").alias("group"))
    few = few.select("group", F.size("m").cast("long").alias("size"), F.inline("m"))
    out = written(few.unionByName(rows.where(F.col("size") > BLOCK).select(F.col("bucket").alias("group"), "size", "id", "comp")), "near-groups")
    dropped(at, stats)
    return out


def _shingle_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        for i in range(0, len(df), 64):
            part = df.iloc[i : i + 64]
            sets = [np.frombuffer(s, np.int64) for s in part["_set"]]
            yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), [len(s) for s in sets]), "shingle": np.concatenate(sets)})


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """``id, bands``: of each set in ``sets (id, _set)`` so many of the shingles that are rarest in all of them that two linked sets have one in common.

    Of n shingles a link needs ``percent``, so all but one less than that. Shingles of one set alone come first in this
    order, but no one else has them, so they needn't be told apart.
    """
    seen = sets.mapInPandas(_shingle_rows, "id long, shingle long")
    common = written(seen.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1"), "near-shingles")
    held = salted_join(seen, common, ["shingle"], "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("held"))
    sized = sets.select("id", F.expr("length(_set) div 8").alias("n")).join(held, "id")
    first = F.expr(f"cast(greatest(size(held) + 1 - ({percent} * n + 99) div 100, 0) as int)")  # n - share + 1, less the n - size(held) of one set alone
    out = written(sized.select("id", F.slice("held", F.lit(1), first)["shingle"].alias("bands")).where("size(bands) > 0"), "near-rarest")
    dropped(common)
    return out


def _links(base: DataFrame, same: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links between sets ``same (rep, bands)``, enough of them to join each component."""
    buckets = same.select(F.col("rep").alias("id"), F.explode("bands").alias("bucket"))
    shared = written(buckets.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"), "near-buckets")
    stars = salted_join(buckets, shared, ["bucket"], "id").where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v"))
    groups = components(stars, "near-candidates").toDF("id", "group")
    sizes = written(groups.groupBy("group").agg(F.count("*").alias("size")), "near-sizes")
    placed = salted_join(groups, sizes, ["group"], "id")
    members = written(base.join(placed, "id").mapInPandas(lambda it: _with_sets(it, k), "id long, group long, size long, _set binary"), "near-members")
    dropped(shared, sizes)
    links = written(_confirmed(_blocks_of(members.withColumn("comp", F.col("id"))), percent), "near-links")
    wide = members.where(F.col("size") > BLOCK).select("id", "_set")

    def comps() -> DataFrame:
        found = components(links, "near-linked").toDF("id", "component")
        return written(wide.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("comp")), "near-comps")

    def more(rows: DataFrame) -> DataFrame:
        return links.unionByName(written(_confirmed(rows, percent), "near-links"))

    if wide.isEmpty():
        return links
    # what the blocks left apart: little of a group is held against all of it, else documents meet by bucket
    comp = comps()
    now = written(members.where(F.col("size") > BLOCK).select("group", "size", "id").join(comp, "id"), "near-apart")
    left = now.groupBy("group", "comp").agg(F.count("*").alias("c")).groupBy("group").agg((F.sum("c") - F.max("c")).alias("left")).where("left > 0")
    left = written(left.withColumn("little", F.col("left") <= LEFT * BLOCK), "near-left")
    some = written(salted_join(now, left, ["group"], "id"), "near-some")
    dropped(now, left)
    if some.isEmpty():
        return links
    rows = _grid_of(some.where("little").select("group", "size", "id", "comp").join(wide, "id"))
    wide = written(wide.join(some.where("NOT little").select("id"), "id", "left_semi"), "near-wide")
    if wide.isEmpty():
        return more(rows)
    groups = _open(same.select(F.col("rep").alias("id"), "bands").join(wide.select("id"), "id", "left_semi"), comp)
    links = more(rows.unionByName(_blocks_of(groups.join(wide, "id"))))
    crowd = groups.where(F.col("size") > BLOCK).select("id").distinct()
    if crowd.isEmpty():
        return links
    # of crowded buckets, the buckets of longer bands; of those among them that are crowded, too, the buckets of rare shingles
    crowded = wide.join(crowd, "id", "left_semi")
    groups = _open(written(crowded.mapInPandas(_fine, "id long, bands array<long>"), "near-fine"), comps())
    if groups.isEmpty():
        return links
    links = more(_blocks_of(groups.join(wide, "id")))
    crowd = groups.where(F.col("size") > BLOCK).select("id").distinct()
    if crowd.isEmpty():
        return links
    groups = _open(_rarest(written(wide.join(crowd, "id", "left_semi"), "near-crowd"), percent), comps())
    if groups.isEmpty():
        return links
    rows = groups.join(wide, "id")
    return more(_blocks_of(rows.where(F.col("size") <= BLOCK)).unionByName(_grid_of(rows.where(F.col("size") > BLOCK))))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row per distinct non-null integer ``doc_id``.

    Words are lower-cased in A-Z only. Documents whose sets of distinct ``k``-word shingles (the whole text's words
    where there are fewer) share ``percent`` of their union are linked; every link is confirmed on full sets, and a
    pair at the very threshold is proposed with a probability of 1 - 7e-7. Null, empty and wordless texts have no
    shingles and no links. Rows of one doc_id count as one document: that with the longest text, then the largest
    SHA-256. An empty table gives an empty result. Other columns are ignored.
    """
    base = one_text_each(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("_text")))
    keys = ["n_shingles", "set_a", "set_b"]
    signed = written(base.mapInPandas(lambda it: _sign(it, k, percent), "id long, n_shingles long, set_a long, set_b long, bands array<long>"), "near-signatures")
    same = written(signed.where("n_shingles > 0").groupBy(*keys).agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands")), "near-sets")
    final = components(_links(base, same, k, percent), "near-final").toDF("rep", "component")
    reps = written(same.select(*keys, "rep").join(final, "rep", "left"), "near-reps")
    dropped(same)
    out = salted_join(signed.select("id", *keys), reps, keys, "id", "left")
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "rep", "id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


QUERIES = {"op8_minhash": op8_minhash}
ORACLES = {"op8_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS r FROM (SELECT doc_id, g, count(*) OVER (PARTITION BY g) AS c FROM s)),
pre AS (SELECT doc_id, g FROM rare JOIN n USING (doc_id) WHERE r <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id),
links AS (SELECT x, y FROM cand JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y AND q.g = p.g JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y GROUP BY x, y, nx.n, ny.n HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))),
e AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
r AS (SELECT doc_id AS u, doc_id AS c FROM d UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(c) AS c FROM r GROUP BY u) m ON m.u = d.doc_id"""}
