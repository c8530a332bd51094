"""Readers with explicit schemas, so that a scan never infers types and columns are pruned at the source."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkscale.sources import schemas


def _flag(c: str) -> Column:
    return F.coalesce(F.lower(c) == "true", F.lit(False))


def _text(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """Sentence rows from JSON lines, .bz2 too; blank lines and undated rows go. The shard is the last number in the file's name. Raises if there is no file."""
    raw = spark.read.schema(schemas.RAW_SENTENCE).json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*(?:\.bz2)?$", 1)
    out = raw.select(
        stem.try_cast("smallint").alias("shard"), "protocol_name", "protocol_type", F.col("knesset_number").try_cast("smallint").alias("knesset"), F.substring("protocol_date", 1, 10).try_cast("date").alias("date"),
        _flag("is_ocr_output").alias("is_ocr"), _text("speaker_id").alias("speaker_id"), _text("speaker_name").alias("speaker_name"), _flag("is_valid_speaker").alias("is_valid_speaker"), _flag("is_chairman").alias("is_chairman"),
        _flag("speaker_is_knesset_member").alias("is_mk"), F.col("turn_num_in_protocol").try_cast("int").alias("turn"), F.col("sent_num_in_turn").try_cast("int").alias("sent"), _text("faction_id").alias("faction_id"),
        _text("current_faction_name").alias("faction_name"), _text("faction_general_name").alias("faction_general_name"), _text("member_of_coalition_or_opposition").alias("coalition"), F.coalesce("sentence_text", F.lit("")).alias("text"),
    )
    return out.where(F.col("date").isNotNull())


def table(spark: SparkSession, path: str | list[str], schema: T.StructType, columns: list[str] | None = None, missing_ok: bool = False) -> DataFrame:
    """Parquet under a known schema, one path or a union of several; an empty table if there is none and missing_ok."""
    try:
        df = spark.read.schema(schema).parquet(*([path] if isinstance(path, str) else path))
    except AnalysisException as e:
        if not missing_ok or e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and typed columns; quotes are doubled inside quoted fields; empty fields are null."""
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=True, encoding="UTF-8")


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose columns are all text, with empty fields kept as empty text. A byte order mark in the header is dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("\ufeff")) for c in df.columns])


def experts(spark: SparkSession, path: str, scales: list[str]) -> DataFrame:
    """Expert ratings in long form: year, id, party_id, scale, rating, without missing ones."""
    wide = csv_text(spark, path)
    ids = ["year", "id", "party_id"]
    wide = wide.select(*ids, *[F.col(s).try_cast("double").alias(s) for s in scales])
    return wide.unpivot(ids, scales, "scale", "rating").where(F.col("rating").isNotNull())


def crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """Party windows: text keys, party_wave = year:party, dates parsed and open if empty."""
    df = csv_text(spark, path)
    day = lambda c: _text(c).try_cast("date").alias(c)
    rest = [c for c in df.columns if c not in ("date_from", "date_to")]
    return df.select(*rest, day("date_from"), day("date_to"), F.concat_ws(":", "ches_year", "ches_party_id").alias("party_wave"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(protocol_name, text): each file is one transcript in UTF-8, named without its ending."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("protocol_name"), F.col("value").alias("text"))


def with_text_keys(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """CSV with inferred types, but keys as the text that they are; for small tables, as it reads them twice."""
    found = spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"', multiLine=True).schema
    return csv(spark, path, T.StructType([T.StructField(f.name, T.StringType()) if f.name in keys else f for f in found]))


def estimate_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four tables that reports start from, by name; periods and actors are text."""
    return {name: with_text_keys(spark, f"{folder}/{name}.csv", ["period", "actor_id"]) for name in ("group_scores", "mk_scores", "validation_points", "validation_summary")}
