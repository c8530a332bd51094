"""Fixed schemas of the tables; ids and periods are always text."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "smallint": T.ShortType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}


def _schema(columns: str) -> T.StructType:
    """A schema from "name type, ..."; unlike fromDDL it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


#: Raw transcript lines. Numbers and flags come as text or not from one shard to the next, so all are read as text.
RAW_SENTENCE = _schema(
    "knesset_number string, protocol_name string, protocol_type string, protocol_date string, is_ocr_output string, speaker_id string, speaker_name string, is_valid_speaker string, is_chairman string, "
    "speaker_is_knesset_member string, turn_num_in_protocol string, sent_num_in_turn string, faction_id string, current_faction_name string, faction_general_name string, member_of_coalition_or_opposition string, sentence_text string"
)
SENTENCE = _schema(
    "shard smallint, protocol_name string, protocol_type string, knesset smallint, date date, is_ocr boolean, speaker_id string, speaker_name string, is_valid_speaker boolean, is_chairman boolean, is_mk boolean, turn int, sent int, "
    "faction_id string, faction_name string, faction_general_name string, coalition string, text string"
)
UNIT = _schema(
    "unit_id string, speech_id string, n_chunks int, protocol_name string, protocol_type string, knesset int, date date, year int, speaker_id string, speaker_name string, faction_id string, faction_name string, faction_general_name string, coalition string, "
    "is_chairman boolean, is_ocr boolean, first_turn int, last_turn int, n_turns int, n_sentences int, n_words int, n_chars int, text string"
)
PACK = T.StructType(UNIT.fields + _schema("n_member_units int, n_member_protocols int, member_unit_ids string").fields)
ANSWER_KEY = ["unit_id", "qid", "prompt_hash", "model", "stage"]
ANSWER = _schema("unit_id string, qid string, prompt_hash string, model string, stage string, type string, score double, confidence double, noul double, probabilities string, raw string, created_at string")
