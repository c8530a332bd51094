"""Cutting long speeches and packing short ones: the number of pieces is the least that fits, and pieces are of like size."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def even_cuts(lengths: np.ndarray, limit: int) -> np.ndarray:
    """Where the ranges of sentences end, exclusive; joined by one character each fits in limit, unless a single sentence doesn't."""
    n = len(lengths)
    if not n:
        return np.zeros(0, int)
    ends = np.cumsum(np.asarray(lengths, np.int64) + 1)
    whole = int(ends[-1]) - 1
    for k in range(min(max(1, -(-whole // limit)), n), n + 1):
        j = np.arange(1, k)
        goal = ends[-1] * j / k
        at = np.searchsorted(ends, goal)
        before = np.where(at > 0, ends[at - 1], 0)
        near = at + 1 - ((at > 0) & (goal - before <= ends[at] - goal))
        # every range has a sentence at least, and leaves one for each that follows
        near = np.minimum(np.maximum.accumulate(np.maximum(near - j, 0)) + j, n - k + j)
        cuts = np.append(near, n)
        if k == n or np.diff(np.concatenate([[0], ends[cuts - 1]])).max() - 1 <= limit:
            return cuts
    return np.array([n])


def chunk_ends(lengths: Column, limit: int) -> Column:
    """even_cuts() of a column of arrays."""

    @F.pandas_udf("array<int>")
    def cut(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: even_cuts(np.asarray(x if x is not None else [], np.int64), limit).tolist())

    return cut.asNondeterministic()(lengths)  # or filters that the planner infers would call it where Python can't run


def deal(lengths: list[int], limit: int, separator: int) -> list[int]:
    """The pack of each text, dealt in the order given, each to the pack with the fewest characters; a pack more whenever one would overflow."""
    if not lengths:
        return []
    total = sum(lengths) + separator * (len(lengths) - 1)
    for k in range(min(max(1, -(-total // limit)), len(lengths)), len(lengths) + 1):
        heap, out = [(0, p) for p in range(k)], []
        for length in lengths:
            size, p = heap[0]
            grown = size + length + separator * (size > 0)
            if size and grown > limit and k < len(lengths):
                break
            out.append(p)
            heapq.heapreplace(heap, (grown, p))
        else:
            used = {p: i for i, p in enumerate(sorted(set(out)))}
            return [used[p] for p in out]
    raise AssertionError("one pack for each text always holds")


def deal_packs(units: DataFrame, keys: list[str], unit: str, chars: str, limit: int, separator: int, seed: int) -> DataFrame:
    """keys, unit and pack (int). The order of the deal is that of a hash of unit and seed, so it doesn't depend on partitions. Only lengths reach Python, many groups at a time; keys must bound a group, as a member and a year do."""

    @F.pandas_udf("array<int>")
    def packs(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: deal(x.tolist(), limit, separator))

    turn = F.sha2(F.concat(F.col(unit).cast("string"), F.lit(f"|{seed}")), 256)
    line = F.struct(F.col(unit).isNull().alias("last"), turn.alias("turn"), F.col(unit).alias("unit"), F.coalesce(F.col(chars), F.lit(0)).cast("bigint").alias("chars"))
    groups = units.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("_line"))
    dealt = groups.select(*keys, F.transform("_line", lambda x: x["unit"]).alias("_units"), packs.asNondeterministic()(F.transform("_line", lambda x: x["chars"])).alias("_packs"))
    each = dealt.select(*keys, F.explode(F.arrays_zip("_units", "_packs")).alias("_e"))
    return each.select(*keys, F.col("_e._units").alias(unit), F.col("_e._packs").alias("pack"))
