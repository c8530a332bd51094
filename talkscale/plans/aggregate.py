"""One run over scored units: all dimensions, period types and kinds of actors, from one scan of the units to four tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkscale.operators.store import once
from talkscale.plans import estimate
from talkscale.settings import SETTINGS, Settings

SLICES = ["dimension", "period_type", "period"]
STATS = ["n", "w", "wy", "wyy", "ww"]
LOW, HIGH = 0.0, 10.0  # fixed values: the ends of the scale


class Dimension(NamedTuple):
    """A dimension's id, its kind (position or salience) and its columns of the units; units with a null score take no part."""

    id: str
    kind: str
    score: str
    gate: str


class Tables(NamedTuple):
    member_scores: DataFrame
    group_scores: DataFrame
    salience: DataFrame
    unit_scores: DataFrame


def rolling(period: Column, later: int = 1, last: Column | None = None) -> Column:
    """The period and the next ones, whose windows it is in too; none after last."""
    each = F.sequence(period, period + later)
    return each if last is None else F.filter(each, lambda p: p <= last)


def scored_units(units: DataFrame, dimensions: list[Dimension], settings: Settings) -> DataFrame:
    """The units with score_i and usable_i of each dimension, in the order of dimensions, for its columns. A position counts where its gate is passed, salience everywhere."""
    spent = {x for d in dimensions for x in (d.score, d.gate)}
    usable = [F.coalesce(F.col(d.gate).cast("double") >= settings.gate, F.lit(False)) if d.kind == "position" else F.lit(True) for d in dimensions]
    return units.select(*[c for c in units.columns if c not in spent], *[F.col(d.score).cast("double").alias(f"score_{i}") for i, d in enumerate(dimensions)], *[u.alias(f"usable_{i}") for i, u in enumerate(usable)])


def each_dimension(scored: DataFrame, dimensions: list[Dimension], columns: list[str]) -> DataFrame:
    """A row for each unit and dimension with a score: columns, dimension, kind, score, usable."""
    each = F.explode(F.array(*[F.struct(F.lit(d.id).alias("dimension"), F.lit(d.kind).alias("kind"), F.col(f"score_{i}").alias("score"), F.col(f"usable_{i}").alias("usable")) for i, d in enumerate(dimensions)]))
    return scored.select(*columns, each.alias("_d")).select(*columns, "_d.*").where("score IS NOT NULL")


def scales(scored: DataFrame, dimensions: list[Dimension], member: str, settings: Settings) -> dict[str, tuple[float, float]]:
    """Intercept and slope that bring a dimension's committee scores to the plenary scale; only dimensions that have them. One row for each dimension comes to the driver."""
    rows = each_dimension(scored, dimensions, [member, "setting"]).where("usable AND kind = 'position'")
    found = estimate.calibration(rows, member, "setting", settings, ["dimension"]).where("b IS NOT NULL")
    return {r["dimension"]: (r["a"], r["b"]) for r in found.collect()}


def speeches_of(scored: DataFrame, dimensions: list[Dimension], moves: dict[str, tuple[float, float]], order: str) -> DataFrame:
    """A row for each speech and dimension from the speech's units: the mean score by words, and the weight: sqrt(words) times the share that counts for positions, the words that count for salience. Other columns come from the first unit.

    Committee scores of positions are moved to the plenary scale, with precision, what their words count for. A committee unit
    of a dimension without calibration, or of salience, is left out. Units meet by speech once for all dimensions.
    """
    own = [f"{c}_{i}" for i in range(len(dimensions)) for c in ("score", "usable")]
    other = [c for c in scored.columns if c not in {"speech_id", "setting", "words", order, *own}]
    committee = F.coalesce(F.col("setting") == "committee", F.lit(False))
    made = []
    for i, d in enumerate(dimensions):
        score, precision, there = F.col(f"score_{i}"), F.lit(1.0), F.col(f"score_{i}").isNotNull()
        if d.id in moves and d.kind == "position":
            a, b = (F.lit(x) for x in moves[d.id])
            score = F.when(committee, F.least(F.greatest(a + b * score, F.lit(LOW)), F.lit(HIGH))).otherwise(score)
            precision = F.when(committee, 1 / (b * b)).otherwise(precision)
        else:
            there &= ~committee
        eff = F.col("words") * F.when(F.col(f"usable_{i}"), precision).otherwise(F.lit(0.0))
        total, effective = F.sum(F.when(there, F.col("words"))), F.sum(F.when(there, eff))
        weight = F.sqrt(total) * F.try_divide(effective, total) if d.kind == "position" else effective
        mean = F.try_divide(F.sum(F.when(there, eff * score)), effective)
        made.append(F.struct(F.lit(d.id).alias("dimension"), F.lit(d.kind).alias("kind"), mean.alias("score"), weight.cast("double").alias("weight"), F.min_by(F.struct(*other), F.when(there, F.col(order))).alias("first")))
    met = scored.repartition("speech_id").groupBy("speech_id").agg(F.array(*made).alias("_each"))  # dealt first, so that units are sorted once
    each = met.select("speech_id", F.explode("_each").alias("_d")).select("speech_id", "_d.*").where("score IS NOT NULL AND weight > 0")
    return each.select("dimension", "kind", "speech_id", "score", "weight", "first.*")


def cells_of(speeches: DataFrame, periods: dict[str, Column], keys: list[str], member: str, sitting: str) -> DataFrame:
    """Cells of keys in all period types and periods. Speeches meet by member and sitting, in cells that keep their arrays of periods, and only cells are dealt to periods, where they lie."""
    arrays = {f"_p{i}": column.cast("array<string>") for i, column in enumerate(periods.values())}
    base = estimate.cells(speeches.withColumns(arrays).repartition("dimension", member, sitting), [*[c for c in keys if c not in SLICES[1:]], *arrays], sitting)
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("period_type"), F.col(c).alias("periods")) for name, c in zip(periods, arrays, strict=True)]))
    each = base.select("*", named.alias("_p")).drop(*arrays).select("*", "_p.period_type", F.explode("_p.periods").alias("period")).drop("_p")
    return each.groupBy(*keys, sitting).agg(*[F.sum(c).alias(c) for c in STATS])


def run(units: DataFrame, dimensions: list[Dimension], periods: dict[str, Column], member: str, actors: dict[str, str], order: str = "unit_id", bloc: str | None = None, party: str = "party", replicates: int = 0, settings: Settings = SETTINGS) -> Tables:
    """The tables of member scores, group scores, salience and unit scores.

    units: unit_id, speech_id, setting (plenary, committee or null), sitting, words, the member, the columns of actors, those
    of periods and of the dimensions. periods: for each period type an array of the periods that a unit counts for, so rolling
    ones are members of several keys. The units are scanned once, for the table of unit scores, which is written; cells of
    speeches for all dimensions, period types and periods are written next, and all estimates are made of them. With bloc,
    group scores of party carry the commonest bloc of the period.
    """
    scored = once(scored_units(units, dimensions, settings), "unit-scores")
    speeches = speeches_of(scored, dimensions, scales(scored, dimensions, member, settings), order)
    columns = list(dict.fromkeys(actors.values()))
    keys = [*SLICES, *[c for c in (member,) if c not in columns], *columns]
    carried = [bloc] if bloc and bloc not in keys else []
    cells = once(cells_of(speeches, periods, ["kind", *keys, *carried], member, "sitting"), "cells")

    def of(kind: str) -> tuple[DataFrame, DataFrame]:
        own = cells.where(F.col("kind") == kind).drop("kind")
        if carried:  # a member's sitting has one row, whatever its blocs
            own = own.groupBy(*keys, "sitting").agg(*[F.sum(c).alias(c) for c in STATS])
            own = once(own, "cells")
        return estimate.estimate_cells(own, SLICES, keys, actors, "sitting", kind, replicates, settings)

    member_scores, group_scores = of("position")
    salience = of("salience")[1]
    if bloc:
        said = cells.where(F.col(party).isNotNull()).groupBy("period_type", "period", party, bloc).agg(F.sum("n").alias("n"))
        often = said.where(F.col(bloc).isNotNull()).groupBy("period_type", "period", party).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col(bloc).alias("bloc")))["bloc"].alias("bloc"))
        often = often.withColumn("actor_id", F.col(party).cast("string")).drop(party).withColumn("actor_type", F.lit(next(k for k, c in actors.items() if c == party)))
        on = ["period_type", "period", "actor_type", "actor_id"]
        group_scores, salience = (t.join(often, on, "left") for t in (group_scores, salience))
    return Tables(member_scores, group_scores, salience, each_dimension(scored, dimensions, ["unit_id"]).select("unit_id", "dimension", "usable"))
