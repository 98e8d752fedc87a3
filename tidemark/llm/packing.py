"""Operator 11, packing documents into sequences, shortest pack first over the histogram of lengths.

Documents are cut into pieces of at most the capacity, and pieces are placed by length alone: the longest first, each
time as many as there are into the shortest packs, whose pattern they extend. Patterns and their counts follow from the
histogram, which has a row for each length; pieces find their place by their rank among those of their length.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, text_of, written

CAPACITY = 2048
END = 1
#: Bytes that a tokenizer sent to the tasks may have.
TOKENIZER_BYTES = 32_000_000
#: Fixed value: the pre-token pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The quicker engine's patterns can't cross longer white space.
WIDE = re.compile(r"\s{2000}")


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: itself where printable, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Ids:
    """Token ids under a tokenizer file, special tokens of the text included, none added.

    Where the file is a plain byte-level merge list, a quicker engine runs the same merges; texts that hold a special
    token or very long white space, and any other kind of file, go to the tokenizer itself.
    """

    def __init__(self, data: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = self._quick(json.loads(data))

    def _quick(self, spec: dict):  # noqa: ANN202
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain:
            return None
        pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        vocab, byte = model["vocab"], _byte_of()
        if any(vocab[p] != 256 + k for k, p in enumerate(pairs)) or sorted(vocab[c] for c in byte) != list(range(256)):
            return None  # ids don't follow the order of merges
        import tiktoken

        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
        return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.quick and not any(s in text for s in self.special) and not WIDE.search(text):
            return np.array(self.quick.encode_ordinary(text), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


_known: dict[int, Ids] = {}


def _ids(data: str) -> Ids:
    key = hash(data)
    if key not in _known:
        _known.clear()
        _known[key] = Ids(data)
    return _known[key]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int | None = END, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of each document's pieces, all but its last of ``capacity`` ids, and ``block, k``: the piece is the k-th of its length in its task.

    ``ids`` too with ``with_ids``. Tables of this should be written before use, as blocks are the tasks that made them.
    """
    with open(tokenizer, "rb") as f:
        data = f.read(TOKENIZER_BYTES + 1)
    if len(data) > TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer} has over {TOKENIZER_BYTES} bytes")
    shipped = docs.sparkSession.sparkContext.broadcast(data.decode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, block, seen = _ids(shipped.value), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = ids_of(t)
                ids = ids if end is None else np.append(ids, np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    rows.append((i, start, len(part), zlib.crc32(part.tobytes()), len(ids), block, seen[len(part)], part.astype(np.int32) if with_ids else None))
                    seen[len(part)] += 1
            cols = list(zip(*rows)) if rows else [()] * 8
            out = [batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:7]]]
            yield pa.RecordBatch.from_arrays(out + [pa.array(cols[7], pa.list_(pa.int32()))] * with_ids, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "block", "k"] + ["ids"] * with_ids
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, block long, k long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id), text_of(text)).mapInArrow(run, schema)


def plan(histogram: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``length, rank_from, rank_to, sequence_from, offset, total``: pieces of a length with these ranks lie at ``offset`` of consecutive sequences that hold ``total`` in the end.

    From the longest length on, its pieces go to the packs that are shortest so far, if they fit, else into new ones.
    A pattern that gets a length for only a part of its packs is split in two. A length splits one pattern and opens two
    at most, so there are no more patterns than three times the lengths, of up to ``capacity`` pieces each, however many
    pieces there are.
    """
    open_packs: list[tuple[int, int, int, list[tuple[int, int, int]]]] = []  # total, first sequence, packs, pattern of (length, first rank, offset)
    full, sequences = [], 0
    for length, left in sorted(histogram, reverse=True):
        rank = 0
        while left:
            if open_packs and open_packs[0][0] + length <= capacity:
                total, first, packs, pattern = heapq.heappop(open_packs)
                n, each = min(left, packs), 1
                if packs > n:
                    heapq.heappush(open_packs, (total, first + n, packs - n, [(a, r + n, o) for a, r, o in pattern]))
            else:
                each = min(left, capacity // length)  # one opened by a length is the shortest until it holds as many as fit
                total, first, n, pattern = 0, sequences, left // each, []
                sequences += n
            grown = (total + each * length, first, n, pattern + [(length, rank + k * n, total + k * length) for k in range(each)])
            if grown[0] < capacity:
                heapq.heappush(open_packs, grown)
            else:
                full.append(grown)
            rank, left = rank + n * each, left - n * each
    return [(a, r, r + n, first, o, total) for total, first, n, pattern in full + open_packs for a, r, o in pattern]


def padded(total: Column, capacity: int = CAPACITY) -> Column:
    """The length that a sequence of ``total`` ids is padded to: the capacity, or its own if that is a power of two."""
    return F.when(total.bitwiseAND(total - 1) == 0, total).otherwise(F.lit(capacity)).cast("long")


PLACES = "length long, rank_from long, rank_to long, sequence_from long, offset long, total long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int | None = END, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_to`` of each piece, and ``ids`` with ``with_ids``.

    A null text is empty and has the end id alone (without one, no piece); a null id stays null; rows of one id are
    documents of their own, and which of equal pieces takes which place is left open; documents of any length are cut;
    an empty table gives an empty result; only id and text are read, so other columns clash with nothing. What reaches
    the driver is a count for each length. Ranks are counted by task and length, so a length that many documents share
    is no group of its own.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, capacity, end, with_ids, doc_id, text), "pack-pieces")
    groups = written(pieces.groupBy("block", "length").agg(F.count("*").alias("n")), "pack-groups")
    histogram = [(r["length"], r["n"]) for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()]  # a row for each length up to the capacity
    places = spark.createDataFrame(plan(histogram, capacity), PLACES)
    before = F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    ranked = groups.withColumn("first", F.coalesce(before, F.lit(0)))
    meet = (F.col("first") < F.col("rank_to")) & (F.col("first") + F.col("n") > F.col("rank_from"))
    placed = ranked.join(places.withColumnRenamed("length", "_l"), (F.col("length") == F.col("_l")) & meet).select("block", "length", "first", "rank_from", "rank_to", "sequence_from", "offset", "total")
    p, g = pieces.alias("p"), placed.alias("g")
    rank = F.col("g.first") + F.col("p.k")
    same = (F.col("p.block") == F.col("g.block")) & (F.col("p.length") == F.col("g.length")) & (rank >= F.col("g.rank_from")) & (rank < F.col("g.rank_to"))
    out = p.join(g, same)
    return out.select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", (F.col("g.sequence_from") + rank - F.col("g.rank_from")).alias("sequence_id"), "g.offset", F.col("g.total").alias("sequence_tokens"), padded(F.col("g.total"), capacity).alias("padded_to"), *(["p.ids"] if with_ids else []))


def sequences(packed: DataFrame, pad: int = 0) -> DataFrame:
    """``sequence_id, ids, doc_ids, starts`` from :func:`pack` with ids: the padded ids, and whose piece begins where. A sequence has at most ``capacity`` pieces."""
    piece = F.struct("offset", "doc_id", "ids")
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("_p"), F.max("padded_to").alias("_to"))
    ids = F.flatten(F.transform("_p", lambda x: x["ids"]))
    fill = F.array_repeat(F.lit(pad), (F.col("_to") - F.size(ids)).cast("int"))
    return got.select("sequence_id", F.concat(ids, fill).alias("ids"), F.transform("_p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("_p", lambda x: x["offset"]).alias("starts"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op11_packing": op11_packing}
ORACLES: dict[str, str] = {}
