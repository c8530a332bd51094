"""Summaries: weighted means over sets of actors, rates, standardisation, panels, guarded correlations, volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Nulls of a value are left out of its weights."""
    return F.try_divide(F.sum(weight * value), F.sum(F.when(value.isNotNull(), weight)))


def summarise(df: DataFrame, period: str, values: list[str], weight: Column, actors: dict[str, tuple[str | None, Column]]) -> DataFrame:
    """Weighted means for several sets of actors in one pass: each row is dealt to the sets it belongs to (actors: set to its column, None for all, and its row filter); null actors are left out. Long form: period, actor_type, actor_id, item, value, n_speeches."""
    sets = F.array(*[F.when(keep & (F.lit(True) if c is None else F.col(c).isNotNull()), F.struct(F.lit(k).alias("actor_type"), (F.lit("all") if c is None else F.col(c).cast("string")).alias("actor_id"))) for k, (c, keep) in actors.items()])
    each = df.withColumn("_w", weight).withColumn("_a", F.explode(F.filter(sets, lambda x: x.isNotNull())))
    wide = each.groupBy(period, "_a").agg(*[weighted_mean(F.col(v), F.col("_w")).alias(v) for v in values], F.count("*").alias("n_speeches"))
    return wide.select(period, "_a.*", "n_speeches", *values).unpivot([period, "actor_type", "actor_id", "n_speeches"], values, "item", "value")


def standardised(df: DataFrame, group: str, stratum: str, value: str) -> DataFrame:
    """Means of each group with the strata weighted as in the whole; strata that a group lacks are left out of its weights."""
    cell = df.groupBy(group, stratum).agg(F.avg(value).alias("m"))
    size = df.groupBy(stratum).agg(F.count("*").alias("n"))
    return cell.join(size, stratum).groupBy(group).agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("rate"))


def pearson(x: Column, y: Column) -> Column:
    """Null under three pairs or without variance; Spark's corr raises on a constant column."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n, sx, sy = F.count(x), F.sum(x), F.sum(y)
    a, b, c = n * F.sum(x * y) - sx * sy, n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy
    return F.when((n >= 3) & (b > 0) & (c > 0), F.try_divide(a, F.sqrt(b) * F.sqrt(c)))


def weighted_pearson(x: Column, y: Column, w: Column) -> Column:
    s = F.sum(w)
    mx, my = F.sum(w * x) / s, F.sum(w * y) / s
    return F.try_divide(F.sum(w * x * y) / s - mx * my, F.sqrt(F.greatest(F.sum(w * x * x) / s - mx * mx, F.lit(0.0))) * F.sqrt(F.greatest(F.sum(w * y * y) / s - my * my, F.lit(0.0))))


def volatility(shares: DataFrame, period: str, family: str, share: str) -> DataFrame:
    """Half the sum of absolute changes between consecutive periods; a family that a period lacks has share 0."""
    times = shares.select(period).distinct()
    after = times.withColumn("next", F.lead(period).over(Window.orderBy(period))).where("next IS NOT NULL")  # one row for each period
    before = shares.join(after, period).select(F.col("next").alias(period), family, F.col(share).alias("_a"))
    now = shares.join(after.select(F.col("next").alias(period)), period, "left_semi").select(period, family, F.col(share).alias("_b"))
    return before.join(now, [period, family], "full").groupBy(period).agg((F.sum(F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))) / 2).alias("volatility"))


def peer_gap(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """value minus the mean of the others of the group, where there are at least two."""
    w = Window.partitionBy(*group)
    n, s = F.count(value).over(w), F.sum(value).over(w)
    return df.withColumn("gap", F.when(n >= 3, F.col(value) - (s - F.col(value)) / (n - 1)))


def panel(df: DataFrame, member: str, before: Column, after: Column, value: str, least: int) -> DataFrame:
    """Members with at least `least` rows on both sides: means before and after."""
    out = df.groupBy(member).agg(F.count(F.when(before, 1)).alias("n_before"), F.count(F.when(after, 1)).alias("n_after"), F.avg(F.when(before, F.col(value))).alias("before"), F.avg(F.when(after, F.col(value))).alias("after"))
    return out.where((F.col("n_before") >= least) & (F.col("n_after") >= least))
