"""Operator 2, token counts that follow edits.

A document's text is cut into the tokenizer's pre-tokens, and runs of LEAF of them are the leaves of a segment tree
that holds characters and tokens of every subtree. An edit re-encodes from the leaf in front of it until a new
pre-token begins where an old leaf began; only the sums above the leaves in between change.

The pattern looks at most two characters beyond a pre-token, and never back. So a leaf that ends two characters before
an edit stays as it is, and from a common start on, equal text gives equal pre-tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over ASCII, for the quicker standard engine.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
LOOK = 2
LEAF = 64
#: Pre-tokens whose counts a task remembers at most, and bytes that a vocabulary sent to the tasks may have.
REMEMBERED = 400_000
VOCABULARY_BYTES = 32_000_000


class Counter:
    """Token counts of pre-tokens under one vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.ascii = re.compile(ASCII_PATTERN) if pattern == PATTERN else self.pattern
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.pattern).findall(text)

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= 32:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = n
        return n


def leaves(text: str, counter: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each run of LEAF pre-tokens."""
    pieces = counter.pieces(text)
    counts = list(map(counter.known.get, pieces))
    for i, c in enumerate(counts):
        if c is None:
            counts[i] = counter.count(pieces[i])
    at = np.arange(0, len(pieces), LEAF)
    if not len(at):
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    return np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at), np.add.reduceat(np.array(counts, np.int64), at)


def tree(leaf_values: np.ndarray) -> np.ndarray:
    """Subtree sums in heap order: node 1 is the root, the leaves are the second half."""
    size = 1
    while size < len(leaf_values):
        size *= 2
    t = np.zeros(2 * size, np.int64)
    t[size : size + len(leaf_values)] = leaf_values
    while size > 1:
        size //= 2
        t[size : 2 * size] = t[2 * size : 4 * size : 2] + t[2 * size + 1 : 4 * size : 2]
    return t


def leaf_at(chars: np.ndarray, place: int) -> tuple[int, int]:
    """The last leaf that begins at or before a character, and its beginning: a walk down the tree."""
    node, begins, size = 1, 0, len(chars) // 2
    while node < size:
        node *= 2
        if place >= begins + chars[node] and chars[node + 1] > 0:
            begins += int(chars[node])
            node += 1
    return node - size, begins


def put(t: np.ndarray, leaf: int, value: int) -> None:
    node = leaf + len(t) // 2
    change = value - t[node]
    while node and change:
        t[node] += change
        node //= 2


def edit(text: str, chars: np.ndarray, tokens: np.ndarray, start: int, end: int, new: str, counter: Counter) -> tuple[str, int, np.ndarray, np.ndarray]:
    """Applies one edit to text and trees; returns the new text, the number of pre-tokens encoded again and the trees.

    What is encoded again goes into the leaves it came from. Where it would overfill them it is cut into runs of LEAF,
    so that later edits there stay small, and if those don't fit, the trees are built anew around them.
    """
    out = text[:start] + new + text[end:]
    first, begins = leaf_at(chars, max(0, start - LOOK))
    size = len(chars) // 2
    shift, last, old = len(new) - (end - start), first, begins  # old: where leaf `last` began
    while last < size and old < end:
        old += int(chars[size + last])
        last += 1
    n = n_chars = n_tokens = 0
    place, cuts = begins, [(0, 0)]  # characters and tokens so far, at every LEAF pre-tokens
    while place < len(out):
        while last < size and old + shift < place:
            old += int(chars[size + last])
            last += 1
        if old >= end and place == old + shift and last < size:
            break
        piece = counter.pattern.match(out, place)[0]
        n, n_tokens, place = n + 1, n_tokens + counter.count(piece), place + len(piece)
        n_chars += len(piece)
        if n % LEAF == 0:
            cuts.append((n_chars, n_tokens))
    if place >= len(out) and not (last < size and place == old + shift and old >= end):
        last = size
    if last == first:  # new text in front of the first leaf, which stays
        n_chars, n_tokens, last = n_chars + int(chars[size + first]), n_tokens + int(tokens[size + first]), first + 1
        cuts[-1] = (n_chars, n_tokens) if len(cuts) > 1 else cuts[-1]
    if n <= 2 * LEAF:
        runs = [(n_chars, n_tokens)]
    else:
        cuts += [(n_chars, n_tokens)] * (cuts[-1] != (n_chars, n_tokens))
        runs = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(cuts, cuts[1:])]
    if len(runs) > last - first:
        old_chars, old_tokens = chars[size:], tokens[size:]
        keep = np.flatnonzero(old_chars[:first]), last + np.flatnonzero(old_chars[last:])
        chars, tokens = (tree(np.concatenate((t[keep[0]], [r[k] for r in runs], t[keep[1]]))) for k, t in enumerate((old_chars, old_tokens)))
        return out, n, chars, tokens
    for leaf in range(first, last):
        c, t = runs[leaf - first] if leaf - first < len(runs) else (0, 0)
        put(chars, leaf, c)
        put(tokens, leaf, t)
    return out, n, chars, tokens


def apply_edits(text: str, chars: np.ndarray, tokens: np.ndarray, edits: list[tuple[int, int, str]], counter: Counter) -> tuple[str, int, np.ndarray, np.ndarray]:
    """Edits are in the places of the first text, by start; what overlaps an earlier one is clipped, and they go in from the back."""
    clean, upto = [], 0
    for s, e, new in sorted(edits, key=lambda x: (x[0], x[1])):
        s, e = min(max(s, upto), len(text)), min(max(e, s, upto), len(text))
        clean.append((s, e, new))
        upto = e
    n = 0
    for s, e, new in reversed(clean):
        text, k, chars, tokens = edit(text, chars, tokens, s, e, new, counter)
        n += k
    return text, n, chars, tokens


_counters: dict[int, Counter] = {}


def _counter(vocabulary: bytes) -> Counter:
    key = hash(vocabulary)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(vocabulary)
    return _counters[key]


def _vocabulary(spark: SparkSession, path: str):  # noqa: ANN202
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


TREE = "tree_chars array<long>, tree_tokens array<long>"


def token_trees(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``n_tokens`` and the trees ``tree_chars, tree_tokens`` in heap order (roots at index 1).

    A null text counts as empty: no tokens, trees of one empty leaf. Whole texts, in no shuffle; repeated rows come out
    alike; an empty table gives an empty result; other columns pass through, columns of the names above are replaced.
    """
    shipped = _vocabulary(docs.sparkSession, vocabulary)

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = _counter(shipped.value)
        for texts in frames:
            both = [tuple(map(tree, leaves(t, counter))) for t in texts]
            yield pd.DataFrame({"n_tokens": [int(k[1]) for _, k in both], "tree_chars": [c for c, _ in both], "tree_tokens": [k for _, k in both]})

    run.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    other = [c for c in docs.columns if c not in ("n_tokens", "tree_chars", "tree_tokens")]
    return docs.select(*other, F.pandas_udf(run, f"n_tokens long, {TREE}")(text_of(text)).alias("_t")).select(*other, "_t.*")


def edited_counts(docs: DataFrame, edits: str = "edits", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` (as from :func:`token_trees`) with its edits applied: ``text`` and the trees follow, ``n_tokens_after`` and ``n_reencoded`` (pre-tokens encoded again) are added.

    ``edits`` is an array of ``struct<start int, end int, new string>`` in characters of the text; places beyond the
    end mean the end, a null array means no edits, a null ``new`` means an empty one.
    """
    shipped = _vocabulary(docs.sparkSession, vocabulary)

    def run(frames: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        counter = _counter(shipped.value)
        for texts, chars, tokens, changes in frames:
            rows = []
            for t, c, k, e in zip(texts, chars, tokens, changes):
                c, k = np.array(c, np.int64), np.array(k, np.int64)
                done = [(int(x["start"] or 0), int(x["end"] or 0), x["new"] or "") for x in e] if e is not None else []
                t, n, c, k = apply_edits(t, c, k, done, counter)
                rows.append((t, c, k, int(k[1]), n))
            yield pd.DataFrame(rows, columns=["text", "tree_chars", "tree_tokens", "n_tokens_after", "n_reencoded"])

    run.__annotations__ = {"frames": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    new = (text, "tree_chars", "tree_tokens", "n_tokens_after", "n_reencoded")
    other = [c for c in docs.columns if c not in (*new, edits)]
    out = F.pandas_udf(run, f"text string, {TREE}, n_tokens_after long, n_reencoded long")(text_of(text), "tree_chars", "tree_tokens", edits)
    return docs.select(*other, out.alias("_e")).select(*other, F.col("_e.text").alias(text), "_e.tree_chars", "_e.tree_tokens", "_e.n_tokens_after", "_e.n_reencoded")


def attach_edits(docs: DataFrame, edits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the rows of ``edits (doc_id, start, end, new)`` of each document as the array ``edits``."""
    by_doc = edits.groupBy(doc_id).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int"), F.col("end").cast("int"), "new"))).alias("edits"))
    return docs.join(by_doc, doc_id, "left")


def sample_edits(text: str = "text", doc_id: str = "doc_id"):  # noqa: ANN201
    """Two edits of every document, by rule: a replacement after a third of it, an insertion after two thirds."""
    n = F.length(text_of(text))
    third = F.floor(n / 3).cast("int")
    one = F.struct(third.alias("start"), (third + 7).alias("end"), F.concat(F.lit(" edited "), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("'s ")).alias("new"))
    two = F.struct((2 * third).alias("start"), (2 * third).alias("end"), F.lit("\n  new passage, no. 7").alias("new"))
    return F.array(one, two)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", sample_edits())
    out = edited_counts(token_trees(docs))
    return out.select("doc_id", "n_tokens", "n_tokens_after", "n_reencoded", (F.size("tree_tokens") / 2).cast("long").alias("n_leaves"), F.length("text").cast("long").alias("n_chars_after"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
