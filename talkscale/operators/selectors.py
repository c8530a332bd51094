"""Cuts of the estimate tables that reports start from, and small joins that decorate them."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkscale.operators import sequences


def estimates(t: DataFrame, dimension: str, actor_type: str, period_type: str) -> DataFrame:
    return t.where((F.col("dimension") == dimension) & (F.col("actor_type") == actor_type) & (F.col("period_type") == period_type))


def members(t: DataFrame, dimensions: list[str], period: str | None = None, faction: str | None = None, blocs: list[str] | None = None) -> DataFrame:
    """Distinct speaker_id of member estimates that meet all conditions given."""
    keep = F.col("dimension").isin(dimensions)
    for column, wanted in (("period", period), ("faction_id", faction)):
        if wanted is not None:
            keep &= F.col(column) == wanted
    return t.where(keep if blocs is None else keep & F.col("bloc").isin(blocs)).select("speaker_id").distinct()


def sentences_behind(packs: DataFrame, usable: DataFrame, dimensions: list[str], periods: DataFrame, term: str = "knesset") -> DataFrame:
    """One row, the sentences of packs with a usable score on any dimension and in any period; a period of several terms, as 21-22-23, stands for each."""
    ids = usable.where(F.col("usable") & F.col("dimension").isin(dimensions)).select("unit_id").distinct()
    terms = periods.select(F.explode(F.split("period", "-")).alias("_t")).select(F.col("_t").cast("int").alias(term)).distinct()
    return packs.join(ids, "unit_id", "left_semi").join(terms, term, "left_semi").agg(F.coalesce(F.sum("n_sentences"), F.lit(0)).alias("n_sentences"))


def sentence_total(units: DataFrame, keep: Column, chairs: bool = False) -> DataFrame:
    keep = F.coalesce(keep, F.lit(False))
    return units.where(keep if chairs else keep & ~F.coalesce(F.col("is_chairman"), F.lit(False))).agg(F.coalesce(F.sum("n_sentences"), F.lit(0)).alias("n_sentences"))


def decorate(t: DataFrame, actors: DataFrame, periods: DataFrame, party_blocs: DataFrame, columns: list[str]) -> DataFrame:
    """Estimates with actors' names and blocs and periods' bounds; the bloc that a party had in the period wins. columns fix the order, and any that is missing is null."""
    out = t.join(actors, ["actor_type", "actor_id"], "left").join(periods, ["period_type", "period"], "left")
    own = party_blocs.select(F.lit("party").alias("actor_type"), "actor_id", "period_type", "period", F.col("bloc").alias("_own"))
    out = out.join(own, ["actor_type", "actor_id", "period_type", "period"], "left").withColumn("bloc", F.coalesce("_own", "bloc"))
    return reindexed(out, columns)


def reindexed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def chamber(t: DataFrame, dimension: str, period_type: str, periods: list[str]) -> DataFrame:
    """One row per member, party and period; thin means too little speech."""
    own = t.where((F.col("dimension") == dimension) & (F.col("period_type") == period_type) & F.col("period").isin(periods))
    return own.select("period", "speaker_id", "faction_id", "bloc", F.col("estimate").alias("value"), "n_speeches", (~F.coalesce(F.col("sufficient"), F.lit(False))).alias("thin"))


def careers(t: DataFrame, member: str, slot: str, value: str, within: float) -> DataFrame:
    """Of each member's sufficient and finite estimates: n, runs of consecutive slots, the first and the last, and whether these lie within so many points."""
    good = t.where(F.coalesce(F.col("sufficient"), F.lit(False)) & F.col(value).isNotNull() & ~F.isnan(value))
    runs = sequences.islands(good.select(member, slot), [member], slot).groupBy(member).agg(F.count("*").alias("runs"))
    ends = good.groupBy(member).agg(F.count("*").alias("n"), F.min_by(value, slot).alias("first"), F.max_by(value, slot).alias("last"))
    return ends.join(runs, member).withColumn("near", F.abs(F.col("last") - F.col("first")) <= within)


def spans(elections: DataFrame, date: str, last: str) -> DataFrame:
    """Terms from one election to the next, the last open until last: term, start, end."""
    w = Window.orderBy(date)  # a row for each election
    return elections.select(F.row_number().over(w).alias("term"), F.col(date).alias("start"), F.coalesce(F.lead(date).over(w), F.lit(last).cast("date")).alias("end"))


def terms_crossed(intervals: DataFrame, terms: DataFrame, keys: list[str], least_years: float = 0.1) -> DataFrame:
    """Of each key the number of terms that its intervals overlap by more than least_years."""
    common = F.datediff(F.least("i.end", "t.end"), F.greatest("i.start", "t.start"))
    hit = intervals.alias("i").join(terms.alias("t"), (F.col("i.start") < F.col("t.end")) & (F.col("t.start") < F.col("i.end")) & (common > least_years * 365.25))
    return hit.groupBy(*[F.col(f"i.{k}") for k in keys]).agg(F.countDistinct("t.term").alias("terms"))


def new_families(lists: DataFrame, period: str, family: str, parts: str) -> DataFrame:
    """Lists whose family stood in no period before, as a list of its own or a part of one."""
    seated = lists.select(F.col(period).alias("_p"), F.explode(F.array_union(F.array(family), F.coalesce(F.col(parts), F.array().cast("array<string>")))).alias("_f")).groupBy("_f").agg(F.min("_p").alias("_p"))
    return lists.join(seated, (F.col(family) == F.col("_f")) & (F.col("_p") < F.col(period)), "left_anti")


def category_shares(df: DataFrame, group: list[str], value: str, weight: str, categories: dict[str, list[int]], rest: str) -> DataFrame:
    """Weighted shares of categories of a survey's answers; what is in none is rest."""
    total = F.sum(weight)
    out = df.groupBy(*group).agg(*[F.try_divide(F.sum(F.when(F.col(value).isin(v), F.col(weight)).otherwise(0.0)), total).alias(k) for k, v in categories.items()])
    return out.withColumn(rest, 1 - sum((F.col(k) for k in categories), F.lit(0.0)))


def largest_membership(df: DataFrame, family: str, period: str, member: str) -> DataFrame:
    """The most members that a family had in any period."""
    return df.groupBy(family, period).agg(F.countDistinct(member).alias("n")).groupBy(family).agg(F.max("n").alias("most"))


def mean_interval(df: DataFrame, keys: list[str], value: str, draws: int = 2000, seed: int = 20260921) -> DataFrame:
    """(keys, n, mean, lo, hi): means with 95% bounds from draws of rows with replacement. A group is the members of a period and side, a few hundred at most."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(df[value].to_numpy(float))
        rng = np.random.default_rng([seed, zlib.crc32("|".join(str(df[k].iloc[0]) for k in keys).encode())])
        drawn = x[rng.integers(0, len(x), (draws, len(x)))].mean(1)
        lo, hi = np.quantile(drawn, [0.025, 0.975])
        return df[keys].iloc[:1].assign(n=len(x), mean=x.mean(), lo=lo, hi=hi)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(value).cast("double").alias(value)).dropna(subset=[value]).groupBy(*keys).applyInPandas(one, f"{kinds}, n long, mean double, lo double, hi double")


def best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the largest order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
