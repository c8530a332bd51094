"""Hard negatives by inner product, searched in inverted lists of k-means clusters.

Vectors become integers and each row goes to the list of its nearest centre; a list stores its centre and its radius, the
largest distance of a row to the centre. By the Cauchy-Schwarz inequality an anchor's inner product with any row of a list
lies within its norm times the radius of the inner product with the centre. An anchor visits the lists of highest upper
bound first, which gives a k-th score, and then just those lists whose upper bound isn't strictly below it; for negatives,
lists outside of the window of scores are skipped too. So results are exact, whatever the centres are.

Centres are fitted to at most FITTED rows, those with the smallest hashes; all rows are indexed. There are at most LISTS
lists, whose centres and radii are all that is broadcast. A list is kept in blocks of at most BLOCK rows, and visits are
dealt over a list's blocks, so a list with a third of all rows (a vector that is there very often) is no single task.
Anchors travel in batches; a task returns the best rows of each anchor in its blocks, not the pairs.

Rows with a null label, a null vector or a null or non-finite component take no part, nor do those whose norm after scaling
is 2**28 or more, as a hundred times their products may not fit in a BIGINT. Shorter vectors count as if filled with zeros. A null vec_id is
no anchor; as a row it comes after all others of its score. Rows are known by a key, so rows with equal vec_ids are
different rows, and among rows alike in score and vec_id the order is by label and key.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkscale.llm.common import materialise

#: Rows that the centres are fitted to, most lists, rounds of k-means.
FITTED, LISTS, ROUNDS = 20_000, 256, 8
#: Rows of a block, blocks that a visit covers, anchors of a batch, lists that are visited for a first k-th score, anchors whose best rows a task holds.
BLOCK, COVERED, BATCH, FIRST, HELD = 1024, 4, 256, 8, 20_000
#: The norm that a row must be under: inner products times 100 then fit in a BIGINT.
NORM = 2.0**28
#: Stands for a null vec_id, which comes last; its negative for a score that none is below.
LAST = 2**63 - 1


def prepared(rows: DataFrame, scale: float) -> DataFrame:
    """(key, vec_id, label, v): the rows that take part, with integer vectors. Where 7 divides vec_id, the label is the next one modulo 10."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    square = F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c)  # null with a null component; not under the bound with one that isn't finite
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = rows.select("vec_id", label.cast("bigint").alias("label"), F.when(square < (NORM / scale) ** 2, x).alias("x")).where("label IS NOT NULL AND x IS NOT NULL")
    return out.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", F.transform("x", lambda c: F.floor(scale * c).cast("int")).alias("v"))


def matrix(column: pa.Array, width: int, fill: int = 0) -> np.ndarray:
    """The rows of a list column as integers, filled up to width."""
    ends = column.offsets.to_numpy()
    values, size = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int64), np.diff(ends)
    out = np.full((len(size), width), fill, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) + ends[0] - ends[:-1][row]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; as doubles where all sums stay within their whole numbers."""
    most = np.sqrt((a.astype(float) ** 2).sum(1).max(initial=0) * (b.astype(float) ** 2).sum(1).max(initial=0))
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2.0**52 else a @ b.T


def centres(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Centres of k-means over at most FITTED rows: as many as the square root of n, LISTS at most."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "key").limit(FITTED) if n > FITTED else rows
    if not n or not width:
        return np.zeros((min(n, 1), width))
    x = np.unique(np.array([r.v + [0] * (width - len(r.v)) for r in sample.select("v").collect()], float), axis=0)
    k = min(LISTS, len(x), max(1, int(n**0.5)))
    c = x[np.sort(np.random.default_rng(0).permutation(len(x))[:k])]
    for _ in range(ROUNDS):
        near = nearest(x, c)
        count, order = np.bincount(near, minlength=k), np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        c[full] = np.add.reduceat(x[order], (np.cumsum(count) - count)[full], axis=0) / count[full][:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - (c * c).sum(1) / 2).argmax(1)


class Lists(NamedTuple):
    """What tasks know of all lists: centres, radii, into how many visits each is dealt (none if it is empty)."""

    width: int
    centre: np.ndarray
    radius: np.ndarray
    visits: np.ndarray

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and list the least and the greatest inner product that a row of the list may have; reversed for an empty list."""
        a = a.astype(float)
        norm = np.sqrt((a * a).sum(1))[:, None]
        middle, reach = a @ self.centre.T, norm * self.radius[None]
        reach = reach + 1e-6 + 1e-9 * (reach + norm * np.sqrt((self.centre * self.centre).sum(1))[None])  # room for the rounding of doubles
        return np.where(self.visits > 0, middle - reach, np.inf), np.where(self.visits > 0, middle + reach, -np.inf)


def indexed(rows: DataFrame) -> tuple[Lists, DataFrame]:
    """The inverted lists of all rows: what tasks know of them, and their blocks (list, visit, rows: structs of key, vec_id, label, v)."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    c = centres(rows, n, width)

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column(3), width).astype(float)
            near = nearest(x, c)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(np.sqrt(((x - c[near]) ** 2).sum(1)))], names=[*batch.schema.names, "list", "apart"])

    listed = materialise(rows.mapInArrow(assign, "key bigint, vec_id bigint, label bigint, v array<int>, list int, apart double"), "listed")
    radius, blocks = np.zeros(len(c)), np.zeros(len(c), int)
    for r in listed.groupBy("list").agg(F.max("apart").alias("radius"), F.count("*").alias("n")).collect():  # at most LISTS rows
        radius[r.list], blocks[r.list] = r.radius, -(-r.n // BLOCK)
    visits = -(-blocks // COVERED)
    sizes = F.broadcast(rows.sparkSession.createDataFrame([(i, int(b), int(s)) for i, (b, s) in enumerate(zip(blocks, visits, strict=True))], "list int, blocks int, visits int"))
    dealt = listed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    held = dealt.groupBy("list", "block", F.pmod("block", "visits").alias("visit")).agg(F.collect_list(F.struct("key", "vec_id", "label", "v")).alias("rows"))  # about BLOCK rows
    return Lists(width, c, radius, visits), materialise(held.select("list", "visit", "rows"), "lists")


def leading(rank: np.ndarray) -> np.ndarray:
    """Which lists are among an anchor's FIRST highest."""
    k = min(FIRST, rank.shape[1])
    return (rank >= -np.partition(-rank, k - 1, axis=1)[:, k - 1 : k]) & (rank > -np.inf)


def best_rows(asked: pa.RecordBatch, rows: pa.RecordBatch, score: np.ndarray, fits: np.ndarray, target: int, most: int) -> pd.DataFrame:
    """The best most rows of a block for each anchor, of those that fit: by score, then the smallest vec_id, label and key."""
    if score.shape[1] > most:
        last = -np.partition(-np.where(fits, score, -LAST), most - 1, axis=1)[:, most - 1]
        fits = fits & (score >= last[:, None])  # ties of the last one stay in
    i, j = np.nonzero(fits)
    made = pd.DataFrame({"anchor": asked.column("key").to_numpy()[i], "target": np.int32(target), "key": rows.column("key").to_numpy()[j], "vec": rows.column("vec_id").fill_null(LAST).to_numpy()[j], "label": rows.column("label").to_numpy()[j], "score": score[i, j]})
    return first_of(made, most)


def first_of(found: pd.DataFrame, most: int) -> pd.DataFrame:
    found = found.sort_values(["anchor", "target", "score", "vec", "label", "key"], ascending=[True, True, False, True, True, True])
    return found[found.groupby(["anchor", "target"]).cumcount() < most]


def visit(lists: Lists, blocks: DataFrame, anchors: DataFrame, wanted, best, most: int) -> DataFrame:
    """(anchor, target, key, vec, label, score): what anchors find in the lists that they visit; of each task the best most rows of each anchor and target.

    wanted(lists, batch, matrix) tells which list an anchor visits, best(batch, matrix, rows, matrix) what it finds in a
    block. An anchor goes to all visits of a list, in one row with the others of its batch that go there.
    """
    width = lists.width

    def ask(batches):
        for whole in batches:
            for low in range(0, whole.num_rows, BATCH):
                batch = whole.slice(low, BATCH)
                goes = wanted(lists, batch, matrix(batch.column("v"), width))
                for i in np.flatnonzero(goes.any(0)):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(batch.take(pa.array(np.flatnonzero(goes[:, i]))))
                    n, data = int(lists.visits[i]), sink.getvalue().to_pybytes()
                    for part in range(n):
                        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["list", "visit", "asked"])

    def answer(batches):
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            for k in range(batch.num_rows):
                asked = pa.ipc.open_stream(batch.column(0)[k].as_py()).read_all().combine_chunks().to_batches()[0]
                rows = pa.RecordBatch.from_struct_array(batch.column(1)[k].values)
                found = best(asked, matrix(asked.column("v"), width), rows, matrix(rows.column("v"), width))
                held.append(found)
                n += len(found)
                if n > HELD * most:
                    held = [first_of(pd.concat(held), most)]
                    n = len(held[0])
                    if n > HELD * most / 2:
                        yield pa.RecordBatch.from_pandas(held[0], preserve_index=False)
                        held, n = [], 0
        if n:
            yield pa.RecordBatch.from_pandas(first_of(pd.concat(held), most), preserve_index=False)

    met = anchors.mapInArrow(ask, "list int, visit int, asked binary").join(blocks, ["list", "visit"])
    return met.select("asked", "rows").mapInArrow(answer, "anchor bigint, target int, key bigint, vec bigint, label bigint, score bigint")


def tops(found: DataFrame, most: int) -> DataFrame:
    """(anchor, target, rows): the best most rows as structs (rank, score, vec) in order."""
    rank = F.row_number().over(Window.partitionBy("anchor", "target").orderBy(F.col("score").desc(), "vec", "label", "key"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= most)
    return ranked.groupBy("anchor", "target").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec"))).alias("rows"))


def kth(rows: Column | str, most: int) -> Column:
    """The score of the most-th row, or below all where there are fewer."""
    return F.when(F.size(rows) >= most, F.element_at(rows, most)["score"]).otherwise(F.lit(-LAST))


def with_positives(lists: Lists, blocks: DataFrame, anchors: DataFrame, count: int) -> DataFrame:
    """anchors with positives: up to count structs (rank, score, vec), the best other rows of their label."""

    def best(asked, a, rows, x):
        score = products(a, x)
        alike = asked.column("label").to_numpy()[:, None] == rows.column("label").to_numpy()[None]
        fits = alike & (asked.column("key").to_numpy()[:, None] != rows.column("key").to_numpy()[None]) & (score >= asked.column("least").to_numpy()[:, None])
        return best_rows(asked, rows, score, fits, 0, count)

    def first(lists, batch, a):
        return leading(lists.bounds(a)[1])

    def rest(lists, batch, a):
        over = lists.bounds(a)[1]
        return (over >= batch.column("least").to_numpy()[:, None]) & (over > -np.inf) & ~leading(over)

    begun = materialise(visit(lists, blocks, anchors.withColumn("least", F.lit(-LAST)), first, best, count), "first")
    least = tops(begun, count).select(F.col("anchor").alias("key"), kth("rows", count).alias("least"))
    more = visit(lists, blocks, anchors.join(least, "key", "left").withColumn("least", F.coalesce("least", F.lit(-LAST))), rest, best, count)
    found = tops(begun.unionByName(more), count).select(F.col("anchor").alias("key"), F.col("rows").alias("positives"))
    return materialise(anchors.join(found, "key"), "positives")


def mine_hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id `every` divides, positives the best other rows of the anchor's label, and negatives the
    best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    rows = materialise(prepared(rows, scale), "vectors")
    lists, blocks = indexed(rows)
    anchors = rows.where(F.col("vec_id") % every == 0)
    anchors = materialise(anchors.repartition(max(1, -(-anchors.count() // BATCH))), "anchors")
    held = with_positives(lists, blocks, anchors, positives)

    def windows(batch) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score of a negative for each anchor and positive, from the k-th one found so far on; none where the positive's score is below zero or there is none."""
        score, least = matrix(batch.column("scores"), positives, -1), matrix(batch.column("leasts"), positives)
        return np.where(score < 0, LAST, np.maximum(-(-low * score // 100), least)), np.where(score < 0, -LAST, high * score // 100)

    def best(asked, a, rows, x):
        score, (under, over) = products(a, x), windows(asked)
        other = asked.column("label").to_numpy()[:, None] != rows.column("label").to_numpy()[None]
        return pd.concat([best_rows(asked, rows, score, other & (score >= under[:, k, None]) & (score <= over[:, k, None]), k, negatives) for k in range(positives)])

    def open_lists(lists, batch, a):
        """The upper bounds of the lists that may hold a row of a window."""
        (under, over), (least, greatest) = windows(batch), lists.bounds(a)
        fits = (greatest[:, :, None] >= under[:, None]) & (least[:, :, None] <= over[:, None]) & (under <= over)[:, None]
        return np.where(fits.any(2), greatest, -np.inf)

    def first(lists, batch, a):
        return leading(open_lists(lists, batch, a))

    def rest(lists, batch, a):
        begun = batch.set_column(batch.schema.get_field_index("leasts"), "leasts", batch.column("none"))
        return (open_lists(lists, batch, a) > -np.inf) & ~first(lists, begun, a)

    none = F.array_repeat(F.lit(-LAST), positives)
    asked = held.select("key", "label", "v", F.col("positives")["score"].alias("scores"), none.alias("none"))
    begun = materialise(visit(lists, blocks, asked.withColumn("leasts", none), first, best, negatives), "first")
    found = tops(begun, negatives).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("target", kth("rows", negatives)))).alias("kths"))  # a target for each positive
    leasts = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.try_element_at("kths", i), F.lit(-LAST)))
    further = asked.join(found.select(F.col("anchor").alias("key"), leasts.alias("leasts")), "key", "left").withColumn("leasts", F.coalesce("leasts", "none"))
    more = visit(lists, blocks, further, rest, best, negatives)
    named = held.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("target", "p"))
    out = named.join(tops(begun.unionByName(more), negatives), ["anchor", "target"]).select("anchor_id", "p", F.explode("rows").alias("r"))
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select("anchor_id", known("p.vec").alias("positive_id"), F.col("r.rank").alias("rank"), known("r.vec").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("r.score").alias("negative_score"))
