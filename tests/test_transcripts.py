"""Transcripts: turns, sentences, speakers and rows by hand-made cases."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from talkscale.functions import names
from talkscale.operators import transcripts
from talkscale.plans.transcripts import printed, transcript_rows
from talkscale.operators import units

DAY = dt.date(2025, 1, 6)
TEXT = "\n".join([
    "contents", 'היו"ר Dana Cohen:\t9', " << נושא >> Opening words << נושא >>   ", " << יור >> היו\"ר Dana Cohen: << יור >>   ", "Members, the sitting is open.",
    "הצבעה מס' 1", "", "for – 49", "against – ", "It was taken.", "", "For – 49, none against.", " << הצח >> A bill << הצח >> ", "[notes]", "(first reading)", "1. An item;", "Members, we go to the next item.",
    " דובר >> Avi Levi (Left): << דובר >>   ", "(applause)", "Thanks.", " << הצח >> Another bill << הצח >> ", "I call on the next member.", "<< קריאה >> קריאות: << קריאה >>", "Shame, shame",
    " << קריאה >> Gila Katz (Right): << קריאה >> ", "Michael, Michael.  << קריאה >> Moshe Saada (Right): << קריאה >> ", "We are with you - - -", "<< אחרי_כן >> said on << אחרי_כן >>", "<< סיום >> closed << סיום >>", "gone for good now",
])


def turns_of(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "protocol_name string, text string")
    return [(r.protocol_name, r.turn, r.kind, r.line, r.lines) for r in transcripts.split_turns(df).orderBy("protocol_name", "turn").collect()]


def test_turns(spark):
    want = [
        ("chair", 'היו"ר Dana Cohen:', ["Members, the sitting is open.", "For – 49, none against.", "Members, we go to the next item."]), ("speaker", "Avi Levi (Left):", ["Thanks."]),
        ("interjection", "קריאות:", ["Shame, shame"]), ("interjection", "Gila Katz (Right):", ["Michael, Michael."]), ("interjection", "Moshe Saada (Right):", ["We are with you - - -", "said on"]),
    ]
    assert turns_of(spark, TEXT) == [("0", i, *w) for i, w in enumerate(want)]


def test_turns_of_odd_texts(spark):
    assert turns_of(spark, None, "", "no tag at all", "<< נושא >> only a heading << נושא >>\nthree words follow") == []
    lost = "<< דובר >> A: << דובר >>\rone two\n\x0cItem 7 << נושא >>\nis dropped as speech\nB: << דובר >>\nthree"
    assert turns_of(spark, lost) == [("0", 0, "speaker", "A:", ["one", "two"]), ("0", 1, "speaker", "B:", ["three"])]
    # a second vote header goes on; a chair without a name doesn't resume; a turn may be empty
    votes = "<< יור >> << יור >>\nהצבעה 1.\nx\nהצבעה\n\ny\n\nz\n<< נושא >> h << נושא >>\nwe would go on\n<< דובר >> C: << דובר >>"
    assert turns_of(spark, votes) == [("0", 0, "chair", "", ["z"]), ("0", 1, "speaker", "C:", [])]


def test_sentences(spark):
    texts = ['I am – it is hard to say "glad" these days. What? It 2–3 passed!', 'He said: "Peace." Then he went.', "up by 2.5 percent – – –", "... . !", "", "one—two.."]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(transcripts.sentences(F.col("t"))).collect()]
    assert got == [['I am – it is hard to say "glad" these days', "What?", "It 2–3 passed!"], ['He said: "Peace"', "Then he went"], ["up by 2.5 percent - - -"], [], [], ["one–two"]]


def people_of(spark):
    rows = [("1", "Dana", "Cohen", True, "31"), ("2", "Avi", "Levi", True, "136"), ("3", "Avi", "Levi", True, "35"), ("4", "Guest", "Minister", False, None)]
    df = spark.createDataFrame(rows, "person_id string, f string, l string, is_mk boolean, party string").withColumns({"person_name": F.concat_ws(" ", "f", "l"), "date_from": F.lit(dt.date(2022, 11, 15)), "date_to": F.lit(dt.date(2099, 1, 1))})
    return names.with_variants(df, "f", "l")


def test_speakers(spark):
    lines = [('היו"ר Dana Cohen:', "chair"), ("Avi Levi (יש עתיד):", "speaker"), ("Avi Levi:", "speaker"), ("קריאות:", "interjection"), ("נשיאת המדינה Ruth Bar:", "speaker"), ("Guest Minister:", "speaker"), ("", "chair"), ("Item 7 of it:", "speaker"), ("a b c d e f g:", "speaker"), ("היושב ראש Nobody Known:", "speaker")]
    df = spark.createDataFrame([(a, b, DAY) for a, b in lines], "line string, kind string, date date")
    got = {r.line: r for r in transcripts.with_speakers(df, people_of(spark), uuid.NAMESPACE_URL).collect()}
    assert len(got) == len(lines)
    flags = {k: (r.is_valid, r.is_chair, r.is_mk, r.speaker_name) for k, r in got.items()}
    assert flags == {
        'היו"ר Dana Cohen:': (True, True, True, "Dana Cohen"), "Avi Levi (יש עתיד):": (True, False, True, "Avi Levi"), "Avi Levi:": (True, False, False, "Avi Levi"), "קריאות:": (False, False, False, "קריאות"),
        "נשיאת המדינה Ruth Bar:": (True, False, False, "Ruth Bar"), "Guest Minister:": (True, False, False, "Guest Minister"), "": (False, True, False, ""), "Item 7 of it:": (False, False, False, "Item 7 of it"),
        "a b c d e f g:": (False, False, False, "a b c d e f g"), "היושב ראש Nobody Known:": (False, True, False, "Nobody Known"),
    }
    assert got['היו"ר Dana Cohen:'].speaker_id == "1" and got["Avi Levi (יש עתיד):"].speaker_id == "2"
    assert got["Guest Minister:"].speaker_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "Guest Minister")) and got["קריאות:"].speaker_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "קריאות"))


def test_rows(spark):
    text = "<< יור >> היו\"ר Dana Cohen: << יור >>\nOne. Two!\n<< דובר >> Avi Levi (העבודה): << דובר >>\nThree\n<< יור >> << יור >>\nFour."
    sittings = spark.createDataFrame([("p", 25, DAY, text), ("q", 25, DAY, None)], "protocol_name string, knesset int, date date, text string")
    seats = spark.createDataFrame([("1", dt.date(2022, 1, 1), dt.date(2025, 1, 6), "31", "A", "G"), ("1", DAY, None, "32", "B", "H"), ("3", DAY, None, "35", "C", "I")], "person_id string, date_from date, date_to date, faction_id string, faction_name string, faction_general_name string")
    sides = spark.createDataFrame([("32", dt.date(2020, 1, 1), None, "coalition")], "faction_id string, date_from date, date_to date, status string")
    rows = transcripts.sentence_rows(sittings, people_of(spark), seats, sides, uuid.NAMESPACE_URL).orderBy("line").collect()
    assert [(r.line, r.turn, r.sent, r.speaker_id, r.faction_id, r.coalition, r.is_chairman, r.text) for r in rows] == [
        (0, 0, 0, "1", "32", "coalition", True, "One"), (1, 0, 1, "1", "32", "coalition", True, "Two!"), (2, 1, 0, "3", "35", None, False, "Three"), (3, 2, 0, "1", "32", "coalition", True, "Four"),
    ]
    assert transcripts.sentence_rows(sittings.limit(0), people_of(spark), seats, sides, uuid.NAMESPACE_URL).count() == 0


def test_rows_feed_units(spark):
    sf = "/root/testdata/sf0.001"
    rows = transcript_rows(spark, sf).cache()
    turns = {(r.protocol_name, r.turn): r for r in transcripts.split_turns(printed(spark, sf)).collect()}
    got = {}
    for r in rows.collect():
        got.setdefault((r.protocol_name, r.turn), []).append((r.sent, r.text))
    assert got.keys() <= turns.keys() and len(got) > 20
    for key, own in got.items():
        assert [s for s, _ in sorted(own)] == list(range(len(own)))
        letters = lambda s: "".join(c for c in s if c.isalnum())
        assert letters("".join(t for _, t in sorted(own))) == letters("".join(turns[key].lines))
    assert units.build_units(rows).count() > 0
