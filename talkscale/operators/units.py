"""From sentence rows to speech units: sentences once, turns, who presides, speeches, cutting, units of 23 columns.

All steps are keyed by protocol, so a transcript is shuffled once for turns and once for speeches; the walk over the chair's
phrases and the search for cutting points alone are Python, and the latter sees lengths only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkscale.functions import text as tx
from talkscale.operators import cutting, presiding, sequences
from talkscale.settings import SETTINGS, Settings
from talkscale.sources import schemas

KEY = ["protocol_name", "turn", "sent"]
PROTOCOL = ["protocol_type", "knesset", "date"]
SPEAKER = ["speaker_id", "speaker_name", "is_valid_speaker", "is_mk", "faction_id", "faction_name", "faction_general_name", "coalition"]


def sentences_once(rows: DataFrame) -> DataFrame:
    """A sentence that two shards hold is kept from the first, by shard and line."""
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.struct("shard", "line")).alias("_r")).select(*KEY, "_r.*")


def group_turns(rows: DataFrame) -> DataFrame:
    """Turns: sentences (collapsed, without blank ones), n_words, flagged and is_ocr (any sentence's; flagged also the first row's), the speaker of the first row."""
    text, at = tx.collapse(F.col("text")), F.col("sent")
    said = text != ""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.groupBy("protocol_name", "turn").agg(
        F.transform(F.array_sort(F.collect_list(F.when(said, F.struct(at.alias("at"), text.alias("text"))))), lambda x: x["text"]).alias("sentences"),
        F.coalesce(F.sum(F.when(said, tx.count_words(text))), F.lit(0)).cast("int").alias("n_words"),
        (F.coalesce(F.bool_or(F.when(said, flag("is_chairman"))), F.lit(False)) | F.min_by(flag("is_chairman"), at)).alias("flagged"),
        F.coalesce(F.bool_or(F.when(said, flag("is_ocr"))), F.lit(False)).alias("is_ocr"),
        *[F.min_by(c, at).alias(c) for c in [*PROTOCOL, *SPEAKER]],
    )


def with_presiding(turns: DataFrame, phrases: str = "plenary") -> DataFrame:
    """Add presiding: from the chair's phrases in protocols of the type phrases, from the flag alone in others, as committees."""
    named = F.coalesce(F.col("protocol_type") == phrases, F.lit(False))
    walked = turns.where(named).withColumn("_text", F.array_join("sentences", " "))
    walked = presiding.presiding(walked, "protocol_name", "turn", "speaker_id", "_text", "n_words", "is_valid_speaker", "flagged")
    flagged = F.col("flagged") & F.coalesce(F.col("is_valid_speaker"), F.lit(False))
    return turns.join(walked.withColumnRenamed("presiding", "_p"), ["protocol_name", "turn"], "left").withColumn("presiding", F.when(named, F.coalesce("_p", F.lit(False))).otherwise(flagged)).drop("_p")


def speeches(turns: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Speeches of each speaker in or out of the chair: first and last turn, is_ocr, the head's fields, and parts (turn, sentences) in order."""
    numbered = sequences.speech_sessions(turns, "protocol_name", "turn", ["speaker_id", "presiding"], F.col("n_words"), settings.interruption_words)
    return numbered.groupBy("protocol_name", "speaker_id", "presiding", "speech_no").agg(
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.bool_or("is_ocr").alias("is_ocr"),
        *[F.min_by(c, "turn").alias(c) for c in [*PROTOCOL, *SPEAKER] if c != "speaker_id"], F.array_sort(F.collect_list(F.struct("turn", "sentences"))).alias("parts"),
    )


def cut_run_on(sentence: Column, limit: int) -> Column:
    """A sentence as pieces of at most limit characters, cut at spaces; a longer word is cut itself."""
    parts = F.transform(F.split(sentence, " "), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(w), F.lit(1)) - 1) / limit).cast("int")), lambda i: F.substring(w, i * limit + 1, F.lit(limit))))

    def add(state, w):
        fits = F.length(state["now"]) + 1 + F.length(w) <= limit
        return F.when(state["now"] == "", F.struct(state["done"].alias("done"), w.alias("now"))).when(fits, F.struct(state["done"].alias("done"), F.concat(state["now"], F.lit(" "), w).alias("now"))).otherwise(F.struct(F.array_append(state["done"], state["now"]).alias("done"), w.alias("now")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    cut = F.aggregate(F.flatten(parts), start, add, lambda s: F.array_append(s["done"], s["now"]))
    return F.when(F.length(sentence) <= limit, F.array(sentence)).otherwise(F.filter(cut, lambda x: x != ""))


def _joined(pieces: Column) -> Column:
    """Pieces (turn, text) as one text: a space inside a turn, a line break between turns."""
    gap = lambda x, i: F.when(i == 0, "").when(x["turn"] == F.get(pieces, i - 1)["turn"], " ").otherwise("\n")
    return F.array_join(F.transform(pieces, lambda x, i: F.concat(gap(x, i), x["text"])), "")


def emit(spoken: DataFrame, settings: Settings = SETTINGS, members_only: bool = True) -> DataFrame:
    """Units in the columns of schemas.UNIT: speeches of valid speakers (members with a faction if members_only) cut into the fewest like ranges that fit; units under min_words go."""
    good = F.col("is_valid_speaker") & (F.col("is_mk") & F.col("faction_id").isNotNull() if members_only else F.lit(True))
    pieces = F.flatten(F.transform("parts", lambda p: F.flatten(F.transform(p["sentences"], lambda s: F.transform(cut_run_on(s, settings.max_chars), lambda x: F.struct(p["turn"].alias("turn"), x.alias("text")))))))
    df = spoken.where(F.coalesce(good, F.lit(False))).withColumn("pieces", pieces).drop("parts").where(F.size("pieces") > 0)
    df = df.withColumn("ends", cutting.chunk_ends(F.transform("pieces", lambda x: F.length(x["text"]).cast("bigint")), settings.max_chars))
    df = df.select("*", F.posexplode("ends").alias("chunk", "end")).withColumn("start", F.coalesce(F.get("ends", F.col("chunk") - 1), F.lit(0)))
    df = df.withColumn("own", F.slice("pieces", F.col("start") + 1, F.col("end") - F.col("start"))).withColumn("text", _joined(F.col("own")))
    df = df.withColumn("n_words", tx.count_words(F.col("text")).cast("int")).where(F.col("n_words") >= settings.min_words)
    speech = F.concat_ws("|", "protocol_name", F.col("first_turn").cast("string"))
    made = {
        "unit_id": F.concat_ws("|", speech, F.col("chunk").cast("string")), "speech_id": speech, "n_chunks": F.size("ends"), "year": F.year("date"), "is_chairman": F.col("presiding"),
        "n_turns": F.size(F.array_distinct(F.transform("own", lambda x: x["turn"]))), "n_sentences": F.col("end") - F.col("start"), "n_chars": F.length("text"),
    }
    return df.select(*[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schemas.UNIT.fields])


def build_units(rows: DataFrame, settings: Settings = SETTINGS, members_only: bool = True) -> DataFrame:
    """Units from sentence rows (schemas.SENTENCE and line)."""
    return emit(speeches(with_presiding(group_turns(sentences_once(rows))), settings), settings, members_only)
