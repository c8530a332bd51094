"""Reproducible samples by hash order: they don't depend on the order of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_hash(df: DataFrame, strata: list[str], row: str, seed: int, quota: Column) -> DataFrame:
    """Of each stratum the first quota rows in the order of a hash."""
    w = Window.partitionBy(*strata).orderBy(F.sha2(F.concat(F.col(row).cast("string"), F.lit(f"|{seed}")), 256), row)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= quota).drop("_rn")


def quotas(sizes: DataFrame, key: str, n: int) -> DataFrame:
    """Shares of n by size, at least one each and at most the size. sizes has a row for each stratum; ties go by key.

    What floors leave is given to the largest remainders; what the minimum of one takes too much comes back, one at a time,
    from the strata furthest above their share. With fewer places than strata, n of them by the hash of key get one.
    """
    whole = Window.partitionBy()  # strata are few
    q = sizes.withColumn("_x", F.col("size") * F.lit(float(n)) / F.sum("size").over(whole)).withColumn("_k", F.count("*").over(whole))
    q = q.withColumn("_f", F.least("size", F.greatest(F.floor("_x"), F.lit(1)))).withColumn("_over", F.sum("_f").over(whole) - n)
    room = F.when(F.col("_f") < F.col("size"), F.col("_x") - F.col("_f"))
    q = q.withColumn("_up", F.when(room.isNotNull() & (F.row_number().over(Window.orderBy(room.desc_nulls_last(), key)) <= -F.col("_over")), 1).otherwise(0))
    steps = F.when((F.col("_over") > 0) & (F.col("_f") > 1), F.sequence(F.lit(1).cast("bigint"), F.least(F.col("_f") - 1, F.col("_over")))).otherwise(F.array().cast("array<bigint>"))
    down = q.select(key, "_over", F.explode(steps).alias("_j"), (F.col("_f") - F.col("_x")).alias("_d")).withColumn("_r", F.row_number().over(Window.orderBy((F.col("_d") - F.col("_j")).desc(), key)))
    down = down.where("_r <= _over").groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_down"))
    few = (F.row_number().over(Window.orderBy(F.sha2(F.col(key).cast("string"), 256), key)) <= n).cast("bigint")
    q = q.withColumn("_few", few).join(down, F.col(key).eqNullSafe(F.col("_key")), "left")
    quota = F.when(F.lit(n) < F.col("_k"), F.col("_few")).otherwise(F.col("_f") + F.col("_up") - F.coalesce("_down", F.lit(0)))
    return q.select(key, "size", quota.cast("bigint").alias("quota"))


def stratified(df: DataFrame, strata: list[str], row: str, n: int, seed: int) -> DataFrame:
    """n rows spread over the strata (null ones too) in proportion, at least one each; all rows if there are no more."""
    key = F.to_json(F.struct(*strata), {"ignoreNullFields": "false"})
    keyed = df.withColumn("_s", key)
    given = quotas(keyed.groupBy("_s").agg(F.count("*").alias("size")), "_s", n)
    return by_hash(keyed.join(given.select("_s", "quota"), "_s"), ["_s"], row, seed, F.col("quota")).drop("_s", "quota")


def share(df: DataFrame, strata: list[str], row: str, rate: Column, seed: int) -> DataFrame:
    """Of each stratum round(rate * size) rows, half to even, each with sample_weight: the rows it stands for."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    on = F.lit(True)
    for c in strata:
        on &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    with_n = df.alias("l").join(sizes.alias("r"), on).select("l.*", "_n").withColumn("_take", F.bround(rate * F.col("_n")).cast("bigint"))
    return by_hash(with_n, strata, row, seed, F.col("_take")).withColumn("sample_weight", F.col("_n") / F.col("_take")).drop("_n", "_take")


def shuffled(df: DataFrame, row: str, seed: int) -> DataFrame:
    """All rows in the order of a hash."""
    return df.orderBy(F.sha2(F.concat(F.col(row).cast("string"), F.lit(f"|{seed}")), 256), row)
