"""Lookups and temporal joins: fallbacks, wildcards, overrides, intervals, latest spell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_fallback(df: DataFrame, table: DataFrame, key: str, column: str, fallback: Column) -> DataFrame:
    """Add column from a small dimension table; blank or missing values take the fallback."""
    return df.join(table.select(key, column), key, "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), fallback))


def with_wildcard(df: DataFrame, table: DataFrame, key: str, second: str, column: str, fallback: Column) -> DataFrame:
    """Add column by (key, second), else by (key, '*'), else the fallback."""
    exact = table.where(F.col(second) != "*").select(key, F.col(second).alias("_s"), F.col(column).alias("_exact"))
    any_ = table.where(F.col(second) == "*").select(key, F.col(column).alias("_any"))
    out = df.join(any_, key, "left")
    out = out.join(exact.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col(second).cast("string") == F.col("_s")), "left")
    return out.withColumn(column, F.coalesce("_exact", "_any", fallback)).drop("_k", "_s", "_exact", "_any")


def override(df: DataFrame, table: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The right value wins where present."""
    return df.join(table.select(*keys, F.col(column).alias("_new")), keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def in_windows(df: DataFrame, windows: DataFrame, key: str, date: str, name: str) -> DataFrame:
    """Rows with each window (key, date_from, date_to, name) they lie in; once per name even if several of its windows hit. windows is a small table."""
    w = windows.withColumnRenamed(key, "_k")
    return df.join(w, (F.col(key) == F.col("_k")) & F.col(date).between(F.col("date_from"), F.col("date_to"))).drop("_k", "date_from", "date_to").dropDuplicates()


def latest_spell(df: DataFrame, spells: DataFrame, row: str, key: str, date: str, value: str) -> DataFrame:
    """(row, value): of the spells that contain the date the one that starts last."""
    s = spells.select(F.col(key).alias("_k"), "start", "end", value)
    hit = df.join(s, (F.col(key) == F.col("_k")) & F.col(date).between(F.col("start"), F.coalesce("end", F.lit("2099-12-31").cast("date"))))
    return hit.groupBy(row).agg(F.max_by(value, "start").alias(value))


def first_spell(df: DataFrame, spells: DataFrame, row: str, date: str, value: str) -> DataFrame:
    """(row, value): the first spell, by ord, that contains the date; null without one."""
    s = F.broadcast(spells.select("ord", "start", "end", value))
    hit = df.join(s, F.col(date).between(F.col("start"), F.col("end")), "left")
    return hit.groupBy(row).agg(F.min_by(value, "ord").alias(value))


def active_within(df: DataFrame, spells: DataFrame, key: str, date: str, pad: int) -> DataFrame:
    """Rows whose date lies in a spell of their key, widened by pad days on both sides."""
    s = spells.select(F.col(key).alias("_k"), F.date_sub("start", pad).alias("_a"), F.date_add("end", pad).alias("_b"))
    return df.join(s, (F.col(key) == F.col("_k")) & F.col(date).between(F.col("_a"), F.col("_b")), "left_semi")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def mode_with_count(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The commonest value of each key and its count; ties go to the smallest value. Two aggregates, no window."""
    n = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(column).alias("v"))).alias("_b")).select(*keys, F.col("_b.v").alias(column), (-F.col("_b.m")).alias("n"))


def union_precedence(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of first, and of second those whose key first lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))
