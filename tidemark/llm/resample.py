"""Operator 12, resampling documents towards a target distribution by importance of hashed n-grams.

A task counts the features of each document and keeps them as numbers of a dictionary of its block. The blocks'
dictionaries add up to the corpus' own, whose every string is hashed once; buckets add up from it. The buckets' gains
then go back by string to the blocks' dictionaries, and there to the counts of each document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, text_of, written

BUCKETS = 10_000
MAX_N = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Words in UTF-8 after lower-casing A-Z: digits, letters a-z and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Scores are first counted in bins of this width, so their number is bounded by the range of scores.
BIN = 64


def features(text: bytes, max_n: int) -> tuple[int, Counter]:
    """Words of a text in UTF-8, and the counts of all runs of 1 to ``max_n`` of them."""
    words = WORD.findall(text.lower())  # bytes: only A-Z change
    counts = Counter(words)
    for n in range(2, max_n + 1):
        counts.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return len(words), counts


def feature_counts(docs: DataFrame, max_n: int = MAX_N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of two kinds by ``block``: ``doc_id, n_words, n_features, steps, counts`` of a document, and ``features, totals`` of the block's dictionary.

    ``steps`` are the differences between the ascending places of its features in the dictionary. Blocks are parts of
    the tasks that make them, so the table should be written before use.
    """

    def emitted(block: int, rows: list, places: dict[bytes, int], totals: list[int], ids: list) -> Iterator[pa.RecordBatch]:
        cols = list(zip(*rows))
        n = len(rows) + 1
        doc_ids = pa.concat_arrays([*ids, pa.nulls(1, ids[0].type)])
        lists = [pa.array([*c, None], pa.list_(pa.int32())) for c in cols[2:]]
        words = pa.array([None] * (n - 1) + [list(places)], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), doc_ids, *[pa.array([*c, None], pa.int64()) for c in cols[:2]], *lists, words, pa.array([None] * (n - 1) + [totals], pa.list_(pa.int64()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, rows, places, totals, ids = TaskContext.get().partitionId() << 24, 0, [], {}, [], []
        for batch in batches:
            for i, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                n_words, counts = features(t, max_n)
                at = np.fromiter((places.setdefault(w, len(places)) for w in counts), np.int32, len(counts))
                n = np.fromiter(counts.values(), np.int32, len(counts))
                totals.extend([0] * (len(places) - len(totals)))
                for a, c in zip(at.tolist(), n.tolist()):
                    totals[a] += c
                order = np.argsort(at)
                rows.append((n_words, int(n.sum()), np.diff(at[order], prepend=np.int32(0)), n[order]))
                ids.append(batch.column(0).slice(i, 1))
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield from emitted(block, rows, places, totals, ids)
                    block, size, rows, places, totals, ids = block + 1, 0, [], {}, [], []
        if rows:
            yield from emitted(block, rows, places, totals, ids)

    names = ["block", "doc_id", "n_words", "n_features", "steps", "counts", "features", "totals"]
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    schema = f"block long, doc_id {kind}, n_words long, n_features long, steps array<int>, counts array<int>, features array<string>, totals array<long>"
    return docs.select(F.col(doc_id), text_of(text)).mapInArrow(run, schema)


def dictionary(counted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``feature, n, bucket`` of :func:`feature_counts`: every distinct string with its count, hashed once."""
    each = counted.where("features IS NOT NULL").select(F.inline(F.arrays_zip("features", "totals")))
    return each.groupBy(F.col("features").alias("feature")).agg(F.sum("totals").alias("n")).withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of two dictionaries: 1000 times the logarithm of the target's smoothed share over the corpus', rounded down."""
    by = lambda d, c: d.groupBy("bucket").agg(F.sum("n").alias(c))
    g = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(by(corpus, "s"), "bucket", "left").join(by(target, "t"), "bucket", "left").na.fill(0)
    sums = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")).join(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_t")))  # one row each
    d = lambda c, k: (F.col(c) + k).cast("double")
    ratio = d("t", 1) * d("all_s", buckets) / (d("s", 1) * d("all_t", buckets))
    return g.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row


def _weights(docs: pa.Table, given: pa.Table) -> pa.Table:
    """Floored mean gains of a block's documents; ``given`` has the gain of each place of its dictionary."""
    gain = np.zeros(given.num_rows, np.int64)
    gain[given.column("place").to_numpy()] = given.column("gain").to_numpy()
    steps, counts = (docs.column(c).combine_chunks() for c in ("steps", "counts"))
    sizes = steps.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    walked = np.cumsum(steps.flatten().to_numpy().astype(np.int64))
    before = np.where(ends - sizes > 0, np.append(walked, 0)[ends - sizes - 1], 0)
    sums = np.append(0, np.cumsum(gain[walked - np.repeat(before, sizes)] * counts.flatten().to_numpy()))
    total, n = sums[ends] - sums[ends - sizes], docs.column("n_features").to_numpy()
    return docs.select(["doc_id", "n_words", "n_features"]).append_column("weight", pa.array(np.where(n > 0, total // np.maximum(n, 1), 0), pa.int64()))


def _noise(seed: int, doc_id: str) -> Column:
    """1000 times a Gumbel variate from a hash of the id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def importance(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each row of ``docs``, towards the texts of ``target``.

    A null text is empty and has weight 0; a null id stays null and hashes as an empty one; rows of one id are judged
    each by its own text; an empty table gives an empty result, an empty target even shares. Only id and text are read,
    so other columns clash with nothing. The gains, one row a bucket, are broadcast; the dictionary is shuffled by
    string, in which a string comes once from each task and then once from each block.
    """
    counted = written(feature_counts(docs, max_n, doc_id, text), "resample-counts")
    known = written(dictionary(counted, buckets), "resample-dictionary")
    aim = dictionary(feature_counts(target.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), max_n), buckets)
    by_bucket = written(gains(known, aim, buckets), "resample-gains")
    by_string = known.join(F.broadcast(by_bucket), "bucket").select("feature", "gain")  # a row for each bucket
    places = counted.where("features IS NOT NULL").select(F.col("block").alias("at"), F.posexplode("features").alias("place", "feature"))
    given = places.join(by_string.hint("merge"), "feature").select("at", "place", "gain")
    each = counted.where("features IS NULL").select("block", "doc_id", "n_words", "n_features", "steps", "counts")
    kind = each.schema["doc_id"].dataType.simpleString()
    weighed = each.groupBy("block").cogroup(given.groupBy("at")).applyInArrow(_weights, f"doc_id {kind}, n_words long, n_features long, weight long")
    out = written(weighed.withColumn("score", F.col("weight") + _noise(seed, "doc_id")), "resample-scores")
    dropped(counted, known, by_bucket)
    return out


def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the highest scores among documents of ``min_words``, ``percent`` of them rounded down, ties to the smaller doc_id; null for the others.

    Null ids come last among ties, then rows with fewer features first. ``scored`` should be a written table. Only the
    bins of scores that reach into the draw are put in order, by ranges; each range then counts on from those before it.
    """
    fit = F.col("n_words") >= min_words
    at = F.floor(F.col("score") / BIN)
    counts = scored.where(fit).groupBy(at.alias("b")).agg(F.count("*").alias("n")).orderBy(F.col("b").desc()).collect()  # bounded by the range of scores
    wanted = sum(r["n"] for r in counts) * percent // 100
    front, reached = None, 0
    for r in counts:
        if reached >= wanted:
            break
        front, reached = r["b"], reached + r["n"]
    if front is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    near = fit & (at >= front)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    placed = written(scored.where(near).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "resample-order")
    # the number holds the range above its lower 33 bits, in them the place in the range
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # a row for each range
    base, starts = 0, []
    for r in sizes:
        starts.append((r["p"], base))
        base += r["n"]
    base_of = scored.sparkSession.createDataFrame(starts, "p long, base long")
    ranked = placed.withColumn("p", part).join(F.broadcast(base_of), "p").withColumn("rank", F.col("base") + place + 1)  # a row for each range
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    return ranked.unionByName(scored.where(~F.coalesce(near, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, doc_id: str = "doc_id", **how) -> DataFrame:  # noqa: ANN003
    """The drawn rows of ``docs``, all their columns, with ``weight, score, rank``; ids should be distinct and not null, as rows are found again by them. Columns of these names are replaced."""
    drawn = draw(importance(docs, target, doc_id=doc_id, **how), percent, min_words).where("rank IS NOT NULL")
    return docs.drop("weight", "score", "rank").join(drawn.select(F.col("doc_id").alias(doc_id), "weight", "score", "rank"), doc_id)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return draw(scored).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op12_resampling": op12_resampling}
ORACLES: dict[str, str] = {}
