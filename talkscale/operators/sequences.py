"""Ordered analytics: context, speech sessions, interruptions, islands, rolling windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_context(turns: DataFrame, protocol: str, turn: str, text: str) -> DataFrame:
    """Add context: the turn before, empty for the first."""
    return turns.withColumn("context", F.lag(text, 1, "").over(Window.partitionBy(protocol).orderBy(turn)))


def speech_sessions(turns: DataFrame, protocol: str, turn: str, key: list[str], words: Column, limit: int) -> DataFrame:
    """Number the speeches of each key in a protocol: a key's next turn goes on with its speech unless another key had a turn of limit words or more in between."""
    order = Window.partitionBy(protocol).orderBy(turn)
    own = Window.partitionBy(protocol, *key).orderBy(turn)
    long_ = (words >= limit).cast("int")
    df = turns.withColumn("_long", long_).withColumn("_c", F.sum("_long").over(order))
    before = F.lag("_c").over(own)
    df = df.withColumn("_new", F.when(before.isNull() | (F.col("_c") - F.col("_long") > before), 1).otherwise(0))
    return df.withColumn("speech_no", F.sum("_new").over(own)).drop("_long", "_c", "_new")


def speeches(numbered: DataFrame, protocol: str, turn: str, key: list[str], words: Column) -> DataFrame:
    return numbered.groupBy(protocol, *key, "speech_no").agg(F.min(turn).alias("first_turn"), F.max(turn).alias("last_turn"), F.count("*").alias("n_turns"), F.sum(words).alias("n_words"))


def interruptions(turns: DataFrame, spoken: DataFrame, protocol: str, turn: str, speaker: str) -> DataFrame:
    """Turns of others strictly inside a speech; a turn without a speaker counts as another's."""
    t = turns.select(F.col(protocol).alias("_p"), F.col(turn).alias("at"), F.col(speaker).alias("heckler"))
    inside = (F.col(protocol) == F.col("_p")) & (F.col("at") > F.col("first_turn")) & (F.col("at") < F.col("last_turn"))
    return spoken.join(t, inside & ~F.col("heckler").eqNullSafe(F.col(speaker))).drop("_p")


def islands(df: DataFrame, keys: list[str], at: str, gap: int = 1, ok: Column | None = None) -> DataFrame:
    """Runs of rows whose steps are at most gap (and that meet ok, if given, on both sides): keys, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(at)
    good = F.lit(True) if ok is None else ok
    df = df.withColumn("_ok", F.coalesce(good, F.lit(False)))
    broken = F.coalesce((F.col(at) - F.lag(at).over(w) > gap) | ~F.col("_ok") | ~F.lag("_ok").over(w), F.lit(True))
    df = df.withColumn("_new", broken.cast("int")).withColumn("_run", F.sum("_new").over(w))
    return df.groupBy(*keys, "_run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("_run")


def rolling2(df: DataFrame, year: str, first: int, last: int) -> DataFrame:
    """Each row in its year and the next one; the first window goes, the last stays."""
    return df.withColumn("period", F.explode(F.array(F.col(year), F.col(year) + 1))).where((F.col("period") > first) & (F.col("period") <= last))


def interval_overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Intersections of two interval tables (keys, start, end), merged where they touch."""
    x, y = a.alias("x"), b.alias("y")
    on = (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))
    for k in keys:
        on &= F.col(f"x.{k}") == F.col(f"y.{k}")
    cut = x.join(y, on).select(*[F.col(f"x.{k}").alias(k) for k in keys], F.greatest("x.start", "y.start").alias("start"), F.least("x.end", "y.end").alias("end"))
    return merge_intervals(cut, keys)


def merge_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w))
    return df.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
