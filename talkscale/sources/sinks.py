"""Writers. All work is in Spark's commit protocol; nothing passes through the driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkscale.sources import readers, schemas


def write_units(units: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Units or packs as zstd Parquet, a folder for each protocol type and Knesset, sorted by date so that row groups prune."""
    # a random part of the key splits a large Knesset over tasks
    dealt = units.repartition("protocol_type", "knesset", F.pmod(F.xxhash64("unit_id"), F.lit(16)))
    dealt.sortWithinPartitions("protocol_type", "knesset", "date", "protocol_name").write.mode(mode).option("compression", "zstd").partitionBy("protocol_type", "knesset").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A small result table as one CSV file with a fixed column order."""
    df.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def claim(spark: SparkSession, root: str, kind: str) -> None:
    """Mark a store as live or mock; a store of the other kind is refused."""
    try:
        stored = spark.read.schema("kind string").parquet(f"{root}/kind").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    if stored is None:
        spark.range(1).select(F.lit(kind).alias("kind")).coalesce(1).write.mode("overwrite").parquet(f"{root}/kind")
    elif stored["kind"] != kind:
        raise ValueError(f"{root} holds {stored['kind']} results; {kind} ones are refused")


def append_answers(answers: DataFrame, root: str, kind: str) -> None:
    """Add the answers whose key isn't stored yet; the first stored answer stays. Running it again adds nothing.

    Within one call, of rows with the same key the earliest created_at stays, then the smallest row. Only stages that the call brings are read.
    """
    spark = answers.sparkSession
    claim(spark, root, kind)
    rest = [c for c in schemas.ANSWER.names if c not in schemas.ANSWER_KEY]
    best = F.min(F.struct("created_at", *[c for c in rest if c != "created_at"])).alias("_best")
    new = answers.groupBy(*schemas.ANSWER_KEY).agg(best).select(*schemas.ANSWER_KEY, *[F.col(f"_best.{c}").alias(c) for c in rest])
    known = readers.table(spark, f"{root}/answers", schemas.ANSWER, schemas.ANSWER_KEY, missing_ok=True)
    new.join(known, schemas.ANSWER_KEY, "left_anti").select(*schemas.ANSWER.names).write.mode("append").partitionBy("stage").parquet(f"{root}/answers")
