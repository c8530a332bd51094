"""Helpers shared by the corpus operators: written tables, running sums and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that the contracts name: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, a folder of the driver's machine, but only if all tasks run there."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='talkscale-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage. The files go when the session ends, or by discard()."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/talkscale/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df; nothing may read df afterwards."""
    spark, path = df.sparkSession, getattr(df, "_written_at", None)
    if path:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add out: the sum of value over the rows before this one, by order within group.

    No task holds a whole group: rows are range-partitioned by (group, order), the sums of each part are added up over
    the parts (one row for each part and group), and only the rest is summed inside a part. order must be total but for
    rows that are alike; group columns may be null. df is read twice, so it should be a written table.
    """
    spark = df.sparkSession
    ranged = materialise(df.repartitionByRange(shuffle_partitions(spark), *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*group, "_part").agg(F.sum(value).alias("_total"))
    over = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part")
    before = totals.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_g_part"), (F.sum("_total").over(over) - F.col("_total")).alias("_before"))
    on = ranged["_part"] == before["_g_part"]
    for c in group:
        on &= ranged[c].eqNullSafe(before[f"_g_{c}"])
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.join(before, on, "inner")
        .withColumn(out, F.col("_before") + F.sum(value).over(inside) - F.col(value))
        .drop("_part", "_g_part", "_before", *[f"_g_{c}" for c in group])
    )


def join_by_hot_key(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, total: int, share: int = 1000) -> DataFrame:
    """Left join of left with right, which has one row for each key and in weight the number of left's rows with it.

    Keys with at least 1/share of total rows number share at most, so they are broadcast; left's rows with such a key
    then get a key of their own (from spread), match nothing and deal out evenly in the shuffled join with the rest.
    Adds right's other columns; no row is lost.
    """
    least = max(1, total // share)
    names = [c for c in right.columns if c != key]
    hot = right.where(F.col(weight) > least).select(F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    rest = right.where(F.col(weight) <= least).select(F.col(key).alias("_rest_key"), *[F.col(c).alias(f"_rest_{c}") for c in names])
    first = left.join(F.broadcast(hot), left[key] == hot["_hot_key"], "left").withColumn("_own", F.when(F.col("_hot_key").isNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("\x00"), spread.cast("string"))))
    rest = rest.withColumn("_rest_own", F.col("_rest_key").cast("string"))
    joined = first.join(rest, first["_own"] == rest["_rest_own"], "left")
    return joined.select(*[F.col(c) for c in left.columns], *[F.coalesce(F.col(f"_hot_{c}"), F.col(f"_rest_{c}")).alias(c) for c in names])


def array_starts(lengths: Column) -> Column:
    """Running sums of an array of BIGINT, from 0 and without the last: where each element starts. In blocks, so that long arrays don't take quadratic time."""
    block = 64
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / block).cast("int") - 1, F.lit(0)))
    part = lambda b: F.slice(lengths, b * block + 1, F.lit(block))
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    sums = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0).cast("bigint"), lambda acc, x: acc + x))
    bases = F.aggregate(sums, F.array(F.lit(0).cast("bigint")), add)
    inner = F.transform(F.arrays_zip(blocks.alias("b"), F.slice(bases, F.lit(1), F.size(blocks)).alias("base")), lambda z: F.slice(F.aggregate(part(z["b"]), F.array(z["base"]), add), F.lit(1), F.size(part(z["b"]))))
    return F.when(F.size(lengths) > 0, F.flatten(inner)).otherwise(F.array().cast("array<bigint>"))


def add_columns(df: DataFrame, keep: list[str], text: str, schema: str, kernel) -> DataFrame:
    """keep and the columns of schema (as DDL), which kernel computes from each slice of the text column: kernel(Texts) -> arrays in the order of schema. Null texts count as empty."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    new = T.StructType.fromDDL(schema)
    fields = T.StructType([df.schema[c] for c in keep] + new.fields)
    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    names = fields.names

    def run(batches):
        from talkscale.llm import kernels

        for batch in batches:
            *kept, column = batch.columns
            parts: list[list] = [[] for _ in kinds]
            for t in kernels.slices(column):
                for part, x, kind in zip(parts, kernel(t), kinds, strict=True):
                    part.append(x if isinstance(x, pa.Array) else pa.array(x, type=kind))
            made = [pa.concat_arrays(p) if p else pa.array([], type=k) for p, k in zip(parts, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, fields)
