"""Draws of a recorded generator, made again in parallel, and permutations that need no order.

Python's generator (``random.Random(seed)``) is sequential, and how many of its numbers a sample takes isn't known
beforehand. So one quick pass runs it and keeps its state every so many draws; tasks start from these states and make
the draws once more, where the data is. :func:`feistel` gives the place of one element under a draw's permutation
by itself, alike in numpy, Spark and SQL.
"""

from __future__ import annotations

import array
import random
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Draws from one kept state of the generator.
EVERY = 250


def saved(rng: random.Random) -> bytes:
    return array.array("I", rng.getstate()[1]).tobytes()


def resumed(state: bytes) -> random.Random:
    rng = random.Random()
    rng.setstate((3, tuple(np.frombuffer(state, np.uint32).tolist()), None))
    return rng


def snapshots(spark: SparkSession, seed: int, draws: int, step: Callable[[random.Random], object], every: int = EVERY) -> DataFrame:
    """``first, n, state``: the generator in front of every ``every``-th draw, ``step`` being one draw. The driver only runs the generator: a few kB for each state."""
    rng, rows = random.Random(seed), []
    for first in range(0, draws, every):
        n = min(every, draws - first)
        rows.append((first, n, saved(rng)))
        if first + n < draws:
            for _ in range(n):
                step(rng)
    df = spark.createDataFrame(rows, "first long, n long, state binary")
    return df.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)), "first") if rows else df


def sampling(n: int, size: int) -> Callable[[random.Random], np.ndarray]:
    """A draw: the positions that ``sample`` takes of a list of ``n``."""
    return lambda rng: np.array(rng.sample(range(n), size), np.int64)


def shuffling(n: int) -> Callable[[random.Random], np.ndarray]:
    """A draw: where the elements of a list of ``n`` come from after ``shuffle``."""

    def draw(rng: random.Random) -> np.ndarray:
        at = list(range(n))
        rng.shuffle(at)
        return np.array(at, np.int64)

    return draw


def over_draws(spark: SparkSession, seed: int, draws: int, draw: Callable[[random.Random], np.ndarray], use: Callable[[np.ndarray], list], columns: str) -> DataFrame:
    """``draw`` and ``columns``: for each draw what ``use`` makes of its positions. What ``use`` holds on to goes to the tasks, so it must be bounded."""
    import pandas as pd

    names = ["draw", *[c.split()[0].strip("`") for c in columns.split(", ")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for first, n, state in zip(f["first"].tolist(), f["n"].tolist(), f["state"]):
                rng = resumed(state)
                out += [(first + k, *use(draw(rng))) for k in range(n)]
            yield pd.DataFrame(out, columns=names).astype({"draw": "int64"})

    return snapshots(spark, seed, draws, draw).mapInPandas(run, f"draw long, {columns}")


def exact_draws(spark: SparkSession, n: int, size: int, draws: int, seed: int) -> DataFrame:
    """``draw, pos``: positions as ``random.Random(seed).sample(range(n), size)`` gives them, draw after draw; none for a size of 0 or over ``n``."""
    if not 0 < size <= n:
        return spark.createDataFrame([], "draw long, pos int")
    rows = over_draws(spark, seed, draws, sampling(n, size), lambda at: [at.tolist()], "pos array<int>")
    return rows.selectExpr("draw", "explode(pos) AS pos")


def fold_of(n: int, folds: int, seed: int) -> np.ndarray:
    """The fold of each of ``n`` ordered rows: the places of a seeded shuffle, dealt round-robin."""
    out = np.empty(n, np.int32)
    out[shuffling(n)(random.Random(seed))] = np.arange(n) % max(1, folds)
    return out


#: A Mersenne prime and the multipliers of the round function.
PRIME, BY_PART, BY_DRAW, BY_ROUND, MIX = (1 << 31) - 1, 1_103_515_245, 1_406_932_606, 654_583_775, (48_271, 69_621)
ROUNDS = 6


def half_bits(n: int) -> int:
    """Bits of one half of the smallest domain of the network that holds ``n`` elements."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _network(x, draw: int, seed: int, h: int):  # noqa: ANN001, ANN202
    left, right = x >> h, x & ((1 << h) - 1)
    for k in range(ROUNDS):
        v = (right * BY_PART + draw * BY_DRAW + k * BY_ROUND + seed) % PRIME
        for m in MIX:
            v = (v ^ v >> 15) * m % PRIME
        left, right = right, left ^ (v >> 7 & ((1 << h) - 1))
    return left << h | right


def feistel(places: np.ndarray, n: int, draw: int, seed: int) -> np.ndarray:
    """Where a draw's permutation of ``n`` elements sends ``places``: a keyed network over the next power of four, walked until it is back among them."""
    h = half_bits(n)
    out = _network(places.astype(np.int64), draw, seed, h)
    while (far := out >= n).any():
        out[far] = _network(out[far], draw, seed, h)
    return out


def network_sql(x: str, draw: str, seed: int, h: str) -> str:
    """One pass of the network as an SQL expression of lists, for the checks; the walk is a recursive query."""
    mask = f"((1 << {h}) - 1)"
    pair = f"[{x} >> {h}, {x} & {mask}]"
    for k in range(ROUNDS):
        v = f"[(p[2] * {BY_PART} + {draw} * {BY_DRAW} + {k * BY_ROUND + seed}) % {PRIME}]"
        for m in MIX:
            v = f"list_transform({v}, lambda v: xor(v, v >> 15) * {m} % {PRIME})"
        pair = f"list_transform([{pair}], lambda p: [p[2], xor(p[1], ({v}[1] >> 7) & {mask})])[1]"
    return f"list_transform([{pair}], lambda p: (p[1] << {h}) | p[2])[1]"


#: The bits of :func:`half_bits` of ``n`` in SQL.
HALF_SQL = "CAST((length(bin(greatest(1, n - 1))) + 1) // 2 AS BIGINT)"
