"""Bootstrap replicates of the estimator as vectors: all that comes above a member's draws is sums of vectors over replicates, and no member's vectors are written.

The members of a slice are dealt by a hash of their keys to parts. A part's cells come sorted and are read as a stream, a
few members at a time, and it hands on one vector for each of its actors, so what is written goes by the number of parts,
which is bounded, and not by that of members. Draws depend on seed and member alone, parts on the data, and vectors are
added in the order of parts and members, so reruns over the same cells agree on any cluster and with any partitions; a
slice's variance and design effect, sums in no fixed order, are taken to DIGITS digits for that.

1. Cells meet by slice and part. Each member's sums are drawn for all replicates and added up for the slice and each actor.
2. Parts are added up: the variance within a slice, then that between the members of an actor type, are vectors too.
3. Cells meet by slice and part once more, behind their slice's variances, and the same draws are made again, which takes
   less than to keep 16 bytes for each member and replicate. They give weighted sums for each actor, which are added up.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 12
#: Members of a part, at least and at most, and the number of parts in between; members of a chunk; draws made at once; parts added up at once; actors that a part adds up at once.
MEMBERS, MOST, PARTS, CHUNK, DRAWN, FAN, HELD = 128, 8192, 256, 64, 1 << 21, 64, 1024
STATS = ["w", "wy", "wyy", "ww"]
LOW, HIGH = 0.0, 10.0  # fixed values: the ends of the scale


def _bytes(rows: np.ndarray) -> bytes:
    return np.ascontiguousarray(rows, "<f8").tobytes()


def steady(x: float) -> float:
    return float(f"{x:.{DIGITS}g}")


def _vectors(data: bytes, replicates: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, replicates)


def per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, and zero where b isn't above zero."""
    return np.divide(a, b, out=np.zeros(np.broadcast_shapes(a.shape, b.shape)), where=b > 0)


def added(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, data): the vectors of each key added up in the given order. A key has a bounded number of rows."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        total = np.array(np.frombuffer(table["data"][0].as_py(), "<f8"))
        for x in table["data"][1:]:
            total += np.frombuffer(x.as_py(), "<f8")
        return pa.table([*[table[c][:1] for c in keys], pa.array([total.tobytes()])], names=[*keys, "data"])

    kinds = dict(df.dtypes)
    return df.select(*keys, *order, "data").groupBy(*keys).applyInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", data binary")


def added_parts(df: DataFrame, keys: list[str]) -> DataFrame:
    """added() over parts, of which each has a row or a few: FAN neighbours first, then what they make."""
    some = F.floor(F.col("_part") / FAN).cast("int")
    return added(added(df.withColumn("_some", some), [*keys, "_some"], ["_part", "chunk"]), keys, ["_some"])


def mapped(df: DataFrame, keep: list[str], run: Callable[..., list[bytes]], inputs: list[str]) -> DataFrame:
    """(keep, data): run over the columns inputs of each row."""
    kinds = dict(df.dtypes)

    def batches(each):
        for batch in each:
            own = [batch.column(len(keep) + i).to_pylist() for i in range(len(inputs))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([run(*x) for x in zip(*own, strict=True)], pa.binary())], names=[*keep, "data"])

    return df.select(*keep, *inputs).mapInArrow(batches, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", data binary")


def redrawn(cells: np.ndarray, replicates: int, rng: np.random.Generator) -> np.ndarray:
    """Sums (4, replicates) of a member's cells, drawn with replacement as often as there are: how often each is drawn, times its own sums."""
    n = len(cells)
    if n == 1:
        return np.repeat(cells.T, replicates, 1)
    out, step = [], max(1, DRAWN // n)
    for low in range(0, replicates, step):
        many = min(step, replicates - low)
        picks = rng.integers(0, n, (many, n)) + n * np.arange(many)[:, None]
        times = np.bincount(picks.ravel(), minlength=many * n).reshape(many, n)
        out.append(cells.T @ times.T)
    return np.concatenate(out, 1)


def member_draws(cells: np.ndarray, unit_variance: float, replicates: int, rng: np.random.Generator) -> np.ndarray:
    """(w, wy, wyy, ww) of a member for each replicate. n drawn sittings vary by (n - 1) / n of what they should, so the mean is moved away from the full one by that factor; a single sitting doesn't vary, so its mean moves by the slice's variance."""
    w, wy, wyy, ww = redrawn(cells, replicates, rng)
    full, n = cells.sum(0), len(cells)
    mean, centre = per(wy, w), float(per(full[1], full[0]))
    inner = wyy - mean * wy
    if n > 1:
        moved = centre + np.sqrt(n / (n - 1)) * (mean - centre)
    else:
        moved = mean + np.sqrt(max(unit_variance * float(per(full[3], full[0] ** 2)), 0.0)) * rng.standard_normal(replicates)
    moved = np.clip(moved, LOW, HIGH)
    return np.stack([w, moved * w, inner + moved * moved * w, ww])


def slice_variance(sums: np.ndarray) -> np.ndarray:
    """The variance within members for each replicate, from (spread, free, w, wy, wyy, ww); over the whole slice where no member has any freedom."""
    spread, free, w, wy, wyy, ww = sums
    own = per(spread, free)
    whole = per(wyy - per(wy * wy, w), w - per(ww, w))
    return np.maximum(np.where(free > 1e-9 * w, own, whole), 0.0)


def members_of(batches: Iterator[pa.RecordBatch], head: list[str], keys: list[str], first: list[str]) -> Iterator[tuple]:
    """(values of head, of keys, of first in the first row, STATS of all rows) of each member. Rows are sorted by head and keys; a member's may go on in the next batch."""
    rest = None
    for batch in chain(batches, [None]):
        tables = [x for x in (rest, batch and pa.Table.from_batches([batch])) if x is not None and x.num_rows]
        if not tables:
            continue
        table = pa.concat_tables(tables)
        codes = np.stack([table[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in [*head, *keys]])
        begin = np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(0)]))
        ends = np.append(begin[1:], table.num_rows)
        whole = len(begin) if batch is None else len(begin) - 1
        stats = np.stack([table[c].to_numpy() for c in STATS], 1)
        at, own, more = (list(zip(*[table[c].take(pa.array(begin[:whole])).to_pylist() for c in names], strict=True)) for names in (head, keys, first))
        for i in range(whole):
            yield at[i], own[i], more[i], stats[begin[i] : ends[i]]
        rest = table.slice(begin[-1]) if batch is not None else None


def _part_rows(slices: list[str], keys: list[str], types: list[str], kind: str, weighing: bool, replicates: int, seed: int):
    """Rows of the slice (kind slice) and the actors (kind actor) of each part of sorted cells: sums for the variances or, weighing, the weighted sums of members, whose slice's variances come before a part's cells. A chunk of members is held at once, and the sums of HELD actors."""
    head, first = [*slices, "_part", "_is_cell"], ["data", "_unit", *[f"_id{i}" for i in range(len(types))]]

    def drawn(some: list[tuple]) -> np.ndarray:
        units = [steady(more[1]) if more[1] is not None and np.isfinite(more[1]) else 0.0 for _, _, more, _ in some]
        own = [np.random.default_rng([seed, zlib.crc32("|".join(map(str, key)).encode())]) for _, key, _, _ in some]
        return np.stack([member_draws(x[3], unit, replicates, rng) for x, unit, rng in zip(some, units, own, strict=True)], 1)

    def sums_of(members: Iterator[tuple], variances: np.ndarray | None) -> Iterator[dict]:
        held = {}
        while some := list(islice(members, CHUNK)):
            w, wy, wyy, ww = draws = drawn(some)
            mean, factor, there = per(wy, w), per(ww, w * w), w > 0
            if kind == "position" and not weighing:
                sums = np.stack([there, mean * there, mean * mean * there, factor * there])
                held["slice", None, None] = held.get(("slice", None, None), 0) + np.stack([np.maximum(wyy - mean * wy, 0).sum(0), (w - per(ww, w)).sum(0), *draws.sum(1)])
            elif not weighing:
                sums = np.stack([w, wy])
            for i, name in enumerate(types):
                if weighing:
                    weight = np.where(there, 1 / np.maximum(variances[1 + i] + variances[0] * factor, 1e-12), 0)
                    sums = np.stack([weight, weight * mean])
                for k, (_, _, more, _) in enumerate(some):
                    key = "actor", name, more[2 + i]
                    if key in held:
                        held[key] += sums[:, k]
                    elif key[2] is not None:
                        held[key] = sums[:, k].copy()
            if len(held) >= HELD:
                yield held
                held = {}
        yield held

    def run(batches):
        begun = next(batches, None)
        if begun is None:
            return
        schema = pa.schema([*[begun.schema.field(c) for c in [*slices, "_part"]], ("chunk", pa.int32()), ("kind", pa.string()), ("actor_type", pa.string()), ("actor_id", pa.string()), ("data", pa.binary())])
        variances = {}
        for at, members in groupby(members_of(chain([begun], batches), head, keys, first), lambda x: repr(x[0][:-1])):
            for is_cell, own in groupby(members, lambda x: x[0][-1]):
                if not is_cell:
                    variances = {at: _vectors(next(own)[2][0], replicates)}
                elif at in variances or not weighing:  # a slice without named actors has none
                    begin = next(own)
                    for chunk, held in enumerate(sums_of(chain([begin], own), variances.get(at))):
                        rows = [(*begin[0][:-1], chunk, *key, _bytes(x)) for key, x in held.items()]
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def replicate_estimates(cell_table: DataFrame, units: DataFrame, slices: list[str], keys: list[str], actors: dict[str, str], sitting: str, once, kind: str, replicates: int, seed: int) -> DataFrame:
    """(slices, actor_type, actor_id, se_boot, replicates): each actor's estimate in all replicates as an array, NaN where none of its members has weight, and their standard deviation, null if one is NaN.

    units: (slices, members, deff, sigma2), the size, design effect and variance of each slice. once(df, name) writes a table that is read
    several times. A null actor has no row.
    """
    kinds = dict(cell_table.dtypes)
    typed = lambda names: "".join(f"`{c}` {kinds[c]}, " for c in names)
    size = F.greatest(F.lit(MEMBERS), F.least(F.lit(MOST), F.ceil(F.col("_all") / PARTS)))
    parts = units.crossJoin(F.broadcast(units.agg(F.sum("members").alias("_all")))).select(*slices, (F.col("deff") * F.col("sigma2")).alias("_unit"), F.ceil(F.col("members") / size).cast("int").alias("_parts"))
    part: Column = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in keys]), F.col("_parts")).cast("int")
    columns = list(dict.fromkeys([*slices, *keys, *actors.values(), sitting]))
    cells = cell_table.join(F.broadcast(parts), slices).select(*columns, *[F.col(c).cast("double").alias(c) for c in STATS], "_unit", part.alias("_part"), F.lit(True).alias("_is_cell"), F.lit(None).cast("binary").alias("data"))
    who = [*slices, "actor_type", "actor_id"]

    def of_parts(rows: DataFrame, weighing: bool) -> DataFrame:
        dealt = rows.repartition(*slices, "_part").sortWithinPartitions(*dict.fromkeys([*slices, "_part", "_is_cell", *keys, sitting]))
        named = dealt.select("*", *[F.col(c).cast("string").alias(f"_id{i}") for i, c in enumerate(actors.values())])
        return named.mapInArrow(_part_rows(slices, keys, list(actors), kind, weighing, replicates, seed), typed(slices) + "_part int, chunk int, kind string, actor_type string, actor_id string, data binary")

    made = once(added_parts(of_parts(cells, False), [*slices, "kind", "actor_type", "actor_id"]), "replicates")
    of_actors = made.where("kind = 'actor'").select(*who, "data")
    if kind == "position":
        sums = made.where("kind = 'slice'").select(*slices, "data").join(F.broadcast(units.select(*slices, "deff")), slices)
        within = mapped(sums, slices, lambda x, d: _bytes(steady(d) * slice_variance(_vectors(x, replicates))), ["data", "deff"]).withColumnRenamed("data", "within")

        def between_parts(x: bytes, unit: bytes) -> bytes:
            k, mean, square, factor = _vectors(x, replicates)
            unit = _vectors(unit, replicates)[0]
            return _bytes(np.stack([square - per(mean * mean, k) - unit * (factor - per(factor, k)), np.maximum(k - 1, 0)]))

        spread = mapped(of_actors.join(F.broadcast(within), slices), who, between_parts, ["data", "within"]).withColumn("_some", F.pmod(F.xxhash64("actor_id"), F.lit(FAN)))
        spread = added(added(spread, [*slices, "actor_type", "_some"], ["actor_id"]), [*slices, "actor_type"], ["_some"])
        between = mapped(spread, [*slices, "actor_type"], lambda x: _bytes(np.maximum(per(*_vectors(x, replicates)), 0.0)), ["data"])
        # one row for each slice: its variances, of which there is one for each type of actors
        variances = between.groupBy(*slices).agg(F.map_from_entries(F.collect_list(F.struct("actor_type", "data"))).alias("between")).join(F.broadcast(within), slices)
        none = np.full(replicates, np.nan).tobytes()  # of a type without actors here
        variances = mapped(variances, slices, lambda x, y: b"".join([x, *[dict(y).get(name, none) for name in actors]]), ["within", "between"])
        variances = variances.join(F.broadcast(parts), slices).select(*slices, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(False).alias("_is_cell"), "data")
        of_actors = once(added_parts(of_parts(cells.unionByName(variances, allowMissingColumns=True), True), who), "estimates")

    def finished(batches):
        for batch in batches:
            weight, value = (np.stack([_vectors(x, replicates)[i] for x in batch.column(len(who)).to_pylist()]) if batch.num_rows else np.zeros((0, replicates)) for i in (0, 1))
            made = np.where(weight > 0, per(value, weight), np.nan)
            error = made.std(1, ddof=1) if replicates > 1 else np.full(len(made), np.nan)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * replicates, pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(who)], pa.array(error, mask=np.isnan(error)), lists], names=[*who, "se_boot", "replicates"])

    return of_actors.select(*who, "data").mapInArrow(finished, typed(slices) + "actor_type string, actor_id string, se_boot double, replicates array<double>")
