"""Printed transcripts to sentence rows: lines, turns, speakers, sentences.

The parser is a handful of running windows over a protocol's lines, all by the same key and order, so a transcript is shuffled
and sorted once: what a line is depends on itself, on the last tag, and on the last vote header or end of one. Names alone
need Python, and only distinct ones are matched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkscale.functions import names
from talkscale.functions import text as tx
from talkscale.sources import schemas

# The words of the tags, misprints included, and what they say of the lines below them.
KINDS = {
    "יור": "chair", "דובר": "speaker", "דובר_המשך": "speaker", "קריאה": "interjection", "קריאות": "interjection", "אורח": "speaker",
    "דור_המשך": "speaker", "דשובר": "speaker", "דובר_זהמשך": "speaker", "דובר_המש ך": "speaker", "קרתיאה": "interjection",
}
HEADINGS, ENDS, NOTES = ["נושא", "הצח", "הלסי", "שאילתה"], ["סיום", "הפסקה"], ["מנהל", "אחרי_כן"]
RESUMED = "אחרי_כן"  # the note whose text goes on with the turn
VOTE = r"^(?:הצבעה|הצביעה)(?:(?: מס['׳]| מספר)?\s*\d+\.?| מס['׳])?$"
# Titles and party labels as printed in speaker lines.
NOBODY = ["קריאה", "קריאות"]
CHAIR = ["היור", "היוריי", "היושב ראש", "היושבת ראש", "יור הכנסת", "יושב ראש הכנסת", "יושבת ראש הכנסת"]
CHAIR_ALONE = ["היור", "היושב ראש"]
ON_BEHALF = r"""\s+[–-]?\s*בשם\s+(?:ה?וועד|ועד|יושב|יו"ר|הסיע).*$"""
TITLES = [
    "סג(?:ן|נית) מזכיר(?:ת)? הכנסת", "מזכיר(?:ת)? הכנסת", "נשיא(?:ת)? המדינה", "נשיא(?:ת)? ארצות הברית(?: של אמריקה)?", r"נשיא(?:ת)? הרפובליקה של \S+",
    r"נשיא(?:ת)? \S+", r"ראש(?:ת)? ממשלת \S+", r"יושב(?:ת)? ראש (?:בית )?\S+(?: \S+)?", "היועצ(?:ת)? המשפטי(?:ת)? (?:לממשלה|לכנסת)", r"נציב(?:ת)? \S+",
]
PARTIES = {
    "יש עתיד": "136", "הליכוד": "31", "סיעת הליכוד": "31", "העבודה": "35", "חדש תעל": "118", "ישראל ביתנו": "110", "רעם הרשימה הערבית המאוחדת": "101", "שס": "75",
    "המחנה הממלכתי": "142", "הציונות הדתית": "111", "כחול לבן המחנה הממלכתי": "142", "כחול לבן": "142", "עוצמה יהודית": "148", "יהדות התורה": "90", "הימין הממלכתי": "146", "נעם": "150",
}
LEAST_HEAD, LEAST_WORDS, MOST_NAME_WORDS = 5, 3, 6

_any_of = lambda words: "|".join(sorted(words, key=len, reverse=True))
TAG, SPEAKER_TAG = _any_of([*KINDS, *HEADINGS, *ENDS, *NOTES]), _any_of(KINDS)
OPENING = rf"(?U)^\s*<?\s*<?\s*({TAG})\s*>\s*>?"
CLOSING = rf"(?U)<\s*<?\s*(?:{TAG})?\s*(?:>\s*>?)?\s*$"
MARKUP = rf"(?U)<\s*<\s*(?:{TAG})\s*>\s*>|<<|>>"
INLINE = rf"(?Us)^(.*?\S)\s*(<<\s*(?:{SPEAKER_TAG})\s*>>.*)$"
BRACKETED = r"(?s)^\(.*\)\.?$"


def _bare(text: Column) -> Column:
    return tx.collapse(F.regexp_replace(text, MARKUP, " "))


def _tagged(line: Column) -> Column:
    """What stands between a line's opening and closing tag."""
    return _bare(F.regexp_replace(F.regexp_replace(line, OPENING, ""), CLOSING, ""))


def _holds_markup(raw: Column) -> Column:
    return raw.contains("<<") | raw.contains(">>")


def printed_lines(text: Column) -> Column:
    """The lines of a text; a speaker's tag at the end of a paragraph is a line of its own."""

    def parted(raw: Column) -> Column:
        head, tail = F.regexp_extract(raw, INLINE, 1), F.regexp_extract(raw, INLINE, 2)
        apart = (F.length(F.regexp_replace(head, r"(?U)^\s+|\s+$", "")) >= LEAST_HEAD) & head.rlike(r"(?U)\w{2,}") & ~head.contains("<<") & _tagged(tail).endswith(":")
        return F.when(raw.contains("<<") & ~raw.rlike(OPENING) & apart, F.array(head, tail)).otherwise(F.array(raw))

    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n\f\r\u2028\u2029]"), parted))


def split_turns(texts: DataFrame, protocol: str = "protocol_name", text: str = "text") -> DataFrame:
    """(protocol, turn from 0, kind, line, lines): who speaks as printed, and the lines said; turns without any have an empty list.

    Lines before the first tag go, and headings, notes, lines in brackets and blocks of vote results, which run from their
    header to the blank line after them. Text after a heading goes too, unless the last turn is a named chair's, who then goes
    on from the first line of three words or more that is no list item or note. A protocol is one text and one
    window; null texts have no turns.
    """
    df = texts.select(F.col(protocol).alias("_p"), F.posexplode(printed_lines(F.col(text))).alias("_i", "raw"))
    raw = F.col("raw")
    kind_of = F.create_map(*[F.lit(x) for w, k in [*KINDS.items(), *((w, "heading") for w in HEADINGS + ENDS), *((w, "note") for w in NOTES)] for x in (w, k)])
    opened = F.regexp_extract(raw, OPENING, 1)
    closes = (opened == "") & raw.contains("<<") & raw.rlike(CLOSING)
    late = F.when(closes, F.nullif(F.regexp_extract(F.regexp_extract(raw, r"(?s)<[^<]*$", 0), f"({TAG})", 1), F.lit("")))  # the opening tag was lost
    df = df.withColumns({"opened": opened, "late": late, "before": F.when(late.isNotNull(), _bare(F.regexp_extract(raw, r"(?s)^(.*)<<", 1)))})
    late_tag = F.when(F.col("late").isin(HEADINGS) | F.col("before").endswith(":"), F.col("late"))
    df = df.withColumn("word", F.coalesce(F.nullif("opened", F.lit("")), late_tag)).withColumn("kind", F.get(F.array(kind_of[F.col("word")]), F.lit(0)))
    plain = tx.collapse(F.when(_holds_markup(raw), F.regexp_replace(raw, MARKUP, " ")).otherwise(raw))
    df = df.withColumn("said", F.when(F.col("opened") != "", _tagged(raw)).when(F.col("word").isNotNull(), F.col("before")).otherwise(plain))
    tag, said = F.col("word").isNotNull(), F.col("said")
    df = df.withColumn("mark", F.when(tag, "tag").when(said.rlike("(?U)" + VOTE), "vote").when(said != "", "text"))

    order = Window.partitionBy("_p").orderBy("_i")
    now, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    mark, kind = F.col("mark"), F.col("kind")
    speaks = F.coalesce(kind.isin(*set(KINDS.values())), F.lit(False))
    df = df.withColumn("_begun", F.max(F.col("opened") != "").over(now)).where("_begun")
    df = df.withColumn("_ends", mark.isNull() & (F.last("mark", ignorenulls=True).over(past) == "text"))
    df = df.withColumn("_vote", F.last(F.when(mark == "vote", True).when((mark == "tag") | F.col("_ends"), False), ignorenulls=True).over(past))
    df = df.withColumns({"turn": F.sum(speaks.cast("int")).over(now) - 1, "_chair": F.last(F.when(speaks, (kind == "chair") & (said != "")), ignorenulls=True).over(now)})
    spoken = (mark == "text") & ~F.coalesce("_vote", F.lit(False))
    resumes = spoken & F.col("_chair") & ~_holds_markup(raw) & ~said.rlike(r"^[()\[\]]") & ~said.rlike(r"(?U)^\d+\s*\.") & (F.size(F.split(said, " ")) >= LEAST_WORDS)
    df = df.withColumn("_open", F.last(F.when(speaks | F.coalesce(resumes, F.lit(False)), True).when(kind == "heading", False), ignorenulls=True).over(now))
    goes_on = (F.col("word") == RESUMED) & (said != "")
    kept = F.coalesce(F.col("_open") & (spoken | goes_on) & ~said.rlike(BRACKETED), F.lit(False))
    df = df.where((F.col("turn") >= 0) & (speaks | kept))
    held = F.array_sort(F.collect_list(F.when(kept, F.struct("_i", "said"))))
    turns = df.groupBy("_p", "turn").agg(F.max(F.when(speaks, kind)).alias("kind"), F.max(F.when(speaks, said)).alias("line"), F.transform(held, lambda x: x["said"]).alias("lines"))
    return turns.select(F.col("_p").alias(protocol), F.col("turn").cast("int").alias("turn"), "kind", "line", "lines")


def sentences(line: Column) -> Column:
    """A paragraph's sentences: split after . ? ! and a quote behind them, without final full stops; parts without a word or dash go."""
    dashed = F.translate(F.replace(line, F.lit("– – –"), F.lit("- - -")), "—", "–")
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    parts = F.transform(F.split(dashed, r"""(?U)(?<=[.!?])\s+|(?<=[.!?]["״”])\s+"""), lambda x: strip(F.regexp_replace(strip(x), r"""(?U)[.\s]+(?=["״”]*$)""", "")))
    return F.filter(parts, lambda x: x.rlike(r"(?U)\w|-"))


def with_speakers(lines: DataFrame, people: DataFrame, namespace: uuid.UUID, parties: dict[str, str] = PARTIES) -> DataFrame:
    """lines (line, kind, date), each once, with key, speaker_id, speaker_name, is_valid, is_chair, is_mk and person_id.

    people: as of names.resolve, and person_name. Titles of the chair are stripped first, and a party's label in brackets
    tells namesakes apart. Calls by nobody in particular aren't valid. A name that is nobody's is taken without its title,
    and is valid unless it is the chair's, empty, longer than six words or has a digit.
    """
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("line", F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U):*$", "")
    inside = F.regexp_extract_all(clean, F.lit(r"\(([^)]*)\)"), F.lit(1))
    outside = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, r"\([^)]*\)?", " "), "(?U)" + ON_BEHALF, ""), r"(?U)\s+[–-]\s*$", "")
    df = lines.select("line", "kind", "date", names.name_key(outside).alias("full"), F.posexplode_outer(F.when(F.size(inside) > 0, inside)).alias("at", "inside"))
    label = F.create_map(*[F.lit(x) for pair in parties.items() for x in pair])[F.coalesce(names.name_key(F.col("inside")), F.lit(""))] if parties else F.lit(None).cast("string")
    df = df.withColumn("party", label).groupBy("line", "kind", "date", "full").agg(F.max_by("party", F.when(F.col("party").isNotNull(), F.col("at"))).alias("party"))
    titled = F.col("full").rlike(f"^(?:{_any_of(CHAIR)}) ")
    chair = F.coalesce(F.col("kind") == "chair", F.lit(False)) | titled | F.col("full").isin(CHAIR_ALONE)
    df = df.withColumns({"is_chair": chair, "key": F.trim(F.regexp_replace("full", f"^(?:{_any_of(CHAIR)}) ", ""))})
    nobody = F.col("full").isin(NOBODY)
    known = names.resolve(df.where(~nobody).select("key", "date", "party"), people).drop("how").alias("r")
    own = people.groupBy("person_id").agg(F.max("person_name").alias("person_name"), F.max("is_mk").alias("person_mk"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("key", "date", "party")]
    df = df.alias("l").join(known, [*same, ~F.col("l.full").isin(NOBODY)], "left").select("l.*", "person_id").join(own, "person_id", "left")
    stripped = F.trim(F.regexp_replace("key", f"(?U)^(?:{'|'.join(TITLES)})\\s+", ""))
    unknown = F.coalesce(F.nullif(stripped, F.lit("")), F.col("key"))
    found = F.col("person_id").isNotNull()
    debris = (unknown == "") | F.col("is_chair") | (F.size(F.split(unknown, " ")) > MOST_NAME_WORDS) | unknown.rlike(r"(?U)\d")
    printed = F.when(found, F.col("person_name")).when(nobody, F.col("full")).otherwise(F.coalesce(F.nullif(unknown, F.lit("")), tx.collapse(F.col("line")), F.lit("")))
    mk = found & F.coalesce("person_mk", F.lit(False))
    df = df.withColumns({"speaker_name": printed, "is_mk": mk, "is_valid": found | (~nobody & ~debris), "is_chair": F.col("is_chair") & ~nobody})
    df = df.withColumn("speaker_id", F.when(F.col("is_mk"), F.col("person_id")).otherwise(names.stable_id(F.col("speaker_name"), namespace)))
    return df.select("line", "kind", "date", "key", "speaker_id", "speaker_name", "is_valid", "is_chair", "is_mk", "person_id")


def sentence_rows(sittings: DataFrame, people: DataFrame, memberships: DataFrame, coalition: DataFrame, namespace: uuid.UUID, shard: int = 90, kind: str = "plenary") -> DataFrame:
    """Rows of schemas.SENTENCE and line (a sentence's place in its sitting) from sittings (protocol_name, knesset, date, text), each once.

    memberships: person_id, date_from, date_to, faction_id, faction_name, faction_general_name; on a day of two the later
    one holds. coalition: faction_id, date_from, date_to, status. A chair's tag without a name is the last named chair's.
    """
    turns = split_turns(sittings).join(sittings.select("protocol_name", "knesset", "date"), "protocol_name")
    who = with_speakers(turns.select("line", "kind", "date").distinct(), people, namespace)
    day = F.col("date").between(F.col("date_from"), F.coalesce("date_to", F.lit("2099-12-31").cast("date")))
    seat = ["faction_id", "faction_name", "faction_general_name"]
    days = who.where("is_mk").select("person_id", "date").distinct()
    seats = days.join(memberships, "person_id").where(day).groupBy("person_id", "date").agg(F.max_by(F.struct(*seat), F.struct("date_from", "faction_id")).alias("s")).select("person_id", "date", "s.*")
    sides = seats.select("faction_id", "date").distinct().join(coalition, "faction_id").where(day).groupBy("faction_id", "date").agg(F.min_by("status", "date_from").alias("coalition"))
    who = who.join(seats.join(sides, ["faction_id", "date"], "left"), ["person_id", "date"], "left")
    fields = ["speaker_id", "speaker_name", "is_valid", "is_chair", "is_mk", *seat, "coalition"]
    who = who.select("line", "kind", "date", F.struct(*fields).alias("who"), (F.col("is_chair") & F.col("person_id").isNotNull()).alias("named"))
    turns = turns.join(who, ["line", "kind", "date"])
    past = Window.partitionBy("protocol_name").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("named"), F.col("who")), ignorenulls=True).over(past)
    turns = turns.withColumn("who", F.when((F.col("line") == "") & (F.col("kind") == "chair"), F.coalesce(last, F.col("who"))).otherwise(F.col("who")))
    turns = turns.withColumn("parts", F.flatten(F.transform("lines", sentences)))
    before = F.coalesce(F.sum(F.size("parts")).over(past), F.lit(0))
    rows = turns.withColumn("first", before).select("protocol_name", "knesset", "date", "turn", "who.*", "first", F.posexplode("parts").alias("sent", "text"))
    made = {"shard": F.lit(shard), "protocol_type": F.lit(kind), "is_ocr": F.lit(False), "is_valid_speaker": F.col("is_valid"), "is_chairman": F.col("is_chair") & F.col("is_valid")}
    return rows.select(*[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schemas.SENTENCE.fields], (F.col("first") + F.col("sent")).cast("int").alias("line"))
