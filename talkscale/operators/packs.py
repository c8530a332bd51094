"""Packs: a member's short speeches of a year dealt to texts of bounded length. The deal sees ids and lengths; texts meet in one ordered aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkscale.operators import cutting
from talkscale.settings import SETTINGS, Settings
from talkscale.sources import schemas

KEYS = ["protocol_type", "speaker_id", "faction_id", "knesset", "year"]


def json_list(items: Column) -> Column:
    """A JSON list of texts with ', ' between them."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")), ", "), F.lit("]"))


def build_packs(units: DataFrame, corpus_end: str, settings: Settings = SETTINGS, separator: str = "\n\n") -> DataFrame:
    """Packs in the columns of schemas.PACK. Chair units stay out; speeches after corpus_end are dealt apart, in packs whose year is marked x."""
    key = [*KEYS, "extension"]
    own = units.where(~F.coalesce(F.col("is_chairman"), F.lit(False))).withColumn("extension", F.coalesce(F.col("date") > F.lit(corpus_end).cast("date"), F.lit(False)))
    dealt = cutting.deal_packs(own, key, "unit_id", "n_chars", settings.pack_chars, len(separator), settings.seed)
    df = own.join(dealt.select("unit_id", "pack"), "unit_id")
    line = F.array_sort(F.collect_list(F.struct("date", "unit_id", "text")))
    packed = df.groupBy(*key, "pack").agg(
        line.alias("_line"), F.min_by("speaker_name", "unit_id").alias("speaker_name"), F.mode("faction_name", True).alias("faction_name"), F.min_by("faction_general_name", "unit_id").alias("faction_general_name"),
        F.mode("coalition", True).alias("coalition"), F.coalesce(F.bool_or("is_ocr"), F.lit(False)).alias("is_ocr"), *[F.sum(c).alias(c) for c in ("n_turns", "n_sentences", "n_words")],
        F.count("*").alias("n_member_units"), F.countDistinct("protocol_name").alias("n_member_protocols"),
    )
    year = F.concat(F.col("year").cast("string"), F.when(F.col("extension"), "x").otherwise(""))
    unit = F.concat(F.lit("pack|"), F.array_join(F.array(*[F.col(c).cast("string") for c in KEYS[:-1]], year), "|", "None"), F.lit("|"), F.lpad(F.col("pack").cast("string"), F.greatest(F.lit(2), F.length(F.col("pack").cast("string"))), F.lit("0")))
    text = F.array_join(F.transform("_line", lambda x: x["text"]), separator)
    dates = F.array_sort(F.transform("_line", lambda x: x["date"]))
    made = {
        "unit_id": unit, "speech_id": unit, "protocol_name": unit, "n_chunks": F.lit(1), "date": F.get(dates, F.floor(F.size(dates) / 2).cast("int")), "is_chairman": F.lit(False), "first_turn": F.lit(0), "last_turn": F.lit(0),
        "n_chars": F.length(text), "text": text, "member_unit_ids": json_list(F.transform("_line", lambda x: x["unit_id"])),
    }
    return packed.select(*[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schemas.PACK.fields])
