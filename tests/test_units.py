"""Units, packs, questions, names and samples: what SQL can't say."""

import collections
import hashlib
import json
import random
import textwrap
import unicodedata
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from talkscale.functions import names
from talkscale.operators import packs, questions, sampling, units
from talkscale.plans import asking, speech
from talkscale.settings import SETTINGS

DIR = "/root/testdata/sf0.001"


def test_cut_units_hold_whole_speeches(spark):
    rows = speech._sentences(spark, DIR).where("protocol_name % 5 = 0")
    whole = {r.speech_id: r for r in units.build_units(rows, replace(SETTINGS, max_chars=10**7, min_words=1)).collect()}
    cut = collections.defaultdict(list)
    for r in units.build_units(rows, replace(SETTINGS, max_chars=300, min_words=1)).collect():
        assert r.n_chars == len(r.text) <= 300 and r.unit_id == f"{r.speech_id}|{r.unit_id.split('|')[-1]}"
        cut[r.speech_id].append((int(r.unit_id.split("|")[-1]), r))
    assert cut and cut.keys() == whole.keys() and max(map(len, cut.values())) > 1
    for key, own in cut.items():
        own = [r for _, r in sorted(own)]
        assert all(r.n_chunks == len(own) for r in own) and sum(r.n_words for r in own) == whole[key].n_words
        assert " ".join(" ".join(r.text for r in own).split()) == " ".join(whole[key].text.split())


def test_run_on_sentences(spark):
    texts = ["a b c", "aaaa bbbb cccc dddd", "x" * 25, "ab " + "x" * 25 + " cd ef", " ".join(f"w{i}" for i in range(40))]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(units.cut_run_on(F.col("t"), 10)).collect()]
    assert got[0] == ["a b c"] and got[2] == ["x" * 10, "x" * 10, "x" * 5] and got[3] == ["ab", "x" * 10, "x" * 10, "xxxxx cd", "ef"]
    assert got[1] == textwrap.wrap(texts[1], 10) and got[4] == textwrap.wrap(texts[4], 10)


def test_turns_of_repeated_and_blank_sentences(spark):
    row = lambda shard, line, turn, sent, text, chair, ocr, who: (shard, line, "p", "committee", 1, None, ocr, who, who, True, chair, True, turn, sent, "f", "F", "G", None, text)
    schema = "shard int, line int, protocol_name string, protocol_type string, knesset int, date date, is_ocr boolean, speaker_id string, speaker_name string, is_valid_speaker boolean, is_chairman boolean, is_mk boolean, turn int, sent int, faction_id string, faction_name string, faction_general_name string, coalition string, text string"
    rows = [row(0, 1, 1, 0, " ", False, True, "a"), row(0, 2, 1, 1, "one  two", None, False, "b"), row(1, 0, 1, 1, "again", True, True, "c"), row(0, 3, 2, 0, "three", True, False, "d"), row(0, 4, 3, 0, "", True, True, "e")]
    got = {r.turn: r for r in units.with_presiding(units.group_turns(units.sentences_once(spark.createDataFrame(rows, schema)))).collect()}
    assert got[1].sentences == ["one two"] and got[1].speaker_id == "a" and not got[1].flagged and not got[1].is_ocr and got[1].n_words == 2
    assert got[2].presiding and got[3].sentences == [] and got[3].presiding and got[3].n_words == 0 and not got[3].is_ocr
    assert units.build_units(spark.createDataFrame([], schema)).count() == 0


def test_packs(spark):
    u = speech.cut_units(spark, DIR).withColumn("year", (F.col("protocol_name").cast("bigint") % 3).cast("int")).cache()
    by_id = {r.unit_id: r for r in u.collect()}
    rows = packs.build_packs(u, "2024-03-20", replace(SETTINGS, pack_chars=1000)).collect()
    held = [json.loads(r.member_unit_ids) for r in rows]
    assert sorted(x for ids in held for x in ids) == sorted(k for k, r in by_id.items() if not r.is_chairman) and len({r.unit_id for r in rows}) == len(rows)
    for r, ids in zip(rows, held, strict=True):
        own = [by_id[x] for x in ids]
        assert ids == [x.unit_id for x in sorted(own, key=lambda x: (x.date, x.unit_id))] and r.member_unit_ids == json.dumps(ids)
        assert r.text == "\n\n".join(x.text for x in own) and r.n_chars == len(r.text) and (r.n_chars <= 1000 or len(ids) == 1)
        assert r.date == sorted(x.date for x in own)[len(own) // 2] and r.n_words == sum(x.n_words for x in own) and r.n_member_protocols == len({x.protocol_name for x in own})
        assert r.unit_id.startswith(f"pack|committee|{r.speaker_id}|f|20|{r.year}|") and len(r.unit_id.split("|")[-1]) >= 2
    assert len(rows) > 5
    late = packs.build_packs(u, "2015-01-01", SETTINGS).first()
    assert f"|{late.year}x|" in late.unit_id


def test_questions(spark):
    rows = {r.qid: r for r in questions.question_table(spark, asking.DIMS).collect()}
    assert list(rows) == ["left_right__gate", "left_right__score", "tone__score", "attack__flag"] and [r.role for r in rows.values()] == ["gate", "score", "salience", "flag"]
    payload = {"type": "noul", "instructions": "Is it about the axis?", "criteria": {"true": "yes", "false": "no"}}
    assert json.loads(rows["left_right__gate"].payload) == payload and rows["tone__score"].n_levels == 5 and str(rows["left_right__gate"].valid_from) == "1997-01-01"
    assert rows["left_right__gate"].prompt_hash == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]
    speech_items = questions.dimensions({"a": [{"id": "x", "instructions": "i", "levels": ["0", "1"]}], "b": [{"id": "y", "question": "q", "when_true": "t", "when_false": "f"}]})
    assert [(d["id"], d["kind"]) for d in speech_items] == [("x", "salience"), ("y", "flag")]


def test_sending(spark):
    slept, calls = [], []

    def busy(body):
        calls.append(body)
        if len(calls) < 3:
            raise questions.Refused(429, "busy", retry_after=500.0)
        return "ok"

    assert questions.send(busy, "x", sleep=slept.append) == (200, "ok", None) and slept == [300.0, 300.0]
    most = [min(60.0, 2.0**k) for k in range(12)]
    for seed in range(20):
        assert all(m / 2 <= w <= m for w, m in zip(questions.waits(12, seed), most, strict=True))
    slept.clear()
    calls[:] = ["before"] * 2  # the next attempt is answered
    assert questions.send(busy, "x", sleep=slept.append) == (200, "ok", None) and slept == []

    def broken(body):
        raise questions.Refused(401, "no")

    req = spark.createDataFrame([(i, str(i)) for i in range(100)], "id long, body string").coalesce(1)
    got = [r.error for r in questions.execute(req, broken, "id", "body", workers=5, failures=25).collect()]
    assert got.count("no") == 25 and got.count("stopped") == 75


def test_live_gate():
    ok = {"prompts_approved": True, "api_key_env": "KEY"}
    assert questions.live_problems(ok, True, {"KEY": "k"}) == [] and len(questions.live_problems({"prompts_approved": "true", "api_key_env": "KEY"}, 1, {})) == 3
    assert questions.run_mode(True, False, ok, False, {}) == ("dry-run", 0) and questions.run_mode(False, True, ok, False, {}) == ("mock", 0)
    assert questions.run_mode(False, False, ok, True, {"KEY": "k"}) == ("live", 0) and questions.run_mode(False, False, ok, True, {})[1] == 2


@pytest.mark.parametrize(("sizes", "n", "want"), [([100, 1, 1, 1], 4, [1, 1, 1, 1]), ([100, 1, 1, 1], 10, [7, 1, 1, 1]), ([5, 5], 10, [5, 5]), ([10, 20, 30], 7, [1, 2, 4]), ([50, 40, 1, 1, 1, 1], 8, [2, 2, 1, 1, 1, 1])])
def test_quotas(spark, sizes, n, want):
    got = sampling.quotas(spark.createDataFrame(list(enumerate(sizes)), "s int, size long"), "s", n).orderBy("s").collect()
    assert [r.quota for r in got] == want and sum(want) == n
    assert sum(r.quota for r in sampling.quotas(spark.createDataFrame(list(enumerate(sizes)), "s int, size long"), "s", 1).collect()) == 1


def test_names(spark):
    texts = ["Dan–Ben  'Levi'", "שָׁלוֹם כהן", "émile", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", names.name_key(F.col("t")).alias("k"), names.nfc(F.col("t")).alias("n"), names.stable_id(F.col("t"), uuid.NAMESPACE_DNS).alias("u")).orderBy("i").collect()
    assert [r.k for r in rows] == ["Dan Ben Levi", "שלום כהן", "émile", None, ""] and rows[2].n == unicodedata.normalize("NFC", texts[2])
    assert rows[0].u == str(uuid.uuid5(uuid.NAMESPACE_DNS, "Dan Ben Levi")) and rows[3].u is None
    people = spark.createDataFrame([("1", "Tatiana (Tania)", "Cohen"), ("2", "Mike Meir", "Levi (Lev)")], "id string, f string, l string")
    got = {r.id: r for r in names.with_variants(people, "f", "l").collect()}
    assert {"Tatiana Cohen", "Tania Cohen"} == set(got["1"].variants) and {"Mike Levi", "Meir Lev", "Mike Meir Levi"} < set(got["2"].variants) and got["2"].last_keys == ["Lev", "Levi"]


def test_resolver(spark):
    spell = [("1", "Dana", "Cohen", True, "p", "2000-01-01", "2005-01-01"), ("2", "Dana", "Cohen", False, "q", "2004-01-01", "2010-01-01"), ("3", "Avraham", "Levi", True, "p", "2000-01-01", "2010-01-01"), ("4", "Shlomo", "Levi", True, "p", "2000-01-01", "2010-01-01"), ("5", "Yitzhak", "Rabinovich", True, "p", "2000-01-01", "2010-01-01")]
    people = spark.createDataFrame(spell, "person_id string, f string, l string, is_mk boolean, party string, a string, b string").withColumns({"date_from": F.to_date("a"), "date_to": F.to_date("b")})
    lines = [("the minister Dana Cohen", "2001-06-01", None), ("Dana Cohen", "2008-01-01", None), ("Dana Cohen", "2004-06-01", None), ("Dana Cohen", "2004-06-01", "q"), ("Avrham Levi", "2001-01-01", None), ("X Levi", "2001-01-01", None), ("Yitzhak Rabinovitch", "2001-01-01", None), ("Nobody Atall", "2001-01-01", None), ("Nick Rabinovich", "2001-01-01", None), ("", "2001-01-01", None)]
    asked = spark.createDataFrame(lines, "key string, d string, party string").select("key", F.to_date("d").alias("date"), "party")
    got = {(r.key, str(r.date), r.party): r.person_id for r in names.resolve(asked, names.with_variants(people, "f", "l")).collect()}
    assert [got[x] for x in lines] == ["1", "2", "1", "2", "3", None, "5", None, "5", None]


def test_resolved_parts(spark):
    got = speech.names_resolved(spark, DIR).collect()
    assert len(got) == len({r.key for r in got}) and sum(r.person_id is not None for r in got) > 0
    assert {r.p_name: r.id for r in speech.stable_ids(spark, DIR).collect()} == {r.p_name: str(uuid.uuid5(uuid.NAMESPACE_URL, r.p_name)) for r in speech.stable_ids(spark, DIR).collect()}


def test_summary_and_bootstrap_run(spark):
    assert {r.status for r in speech.validation_summary(spark, DIR).collect()} <= {"ok", "inconclusive"}
    rows = speech.est_with_bootstrap(spark, DIR).collect()
    assert len(rows) == speech.est_actor_types(spark, DIR).count() and all(r.se is not None and 0 <= r.se < 5 for r in rows)
    near = [r for r in rows if r.actor_type == "whole" and r.se_analytic]
    assert near and all(0.2 < r.se / r.se_analytic < 5 for r in near)


def test_near_names_against_all_pairs(spark):
    """All pairs that are like enough are found, from far fewer candidates; aliases count as names."""
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcdeiouhlmnrst") for _ in range(rnd.randint(1, 16))) for _ in range(300)] + ["a", "ab", "banana", "ananan", ""]

    def touched(x):
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randint(0, len(x))
            x = x[:i] + rnd.choice(["", "e", "an"]) + x[i + rnd.randint(0, 1) :]
        return x

    asked = sorted({touched(x) for x in base})
    one, two = (spark.createDataFrame([(x,) for x in names_], "text string") for names_ in (asked, base))
    want = {(a, b) for a in asked for b in set(base) if names.ratio(a, b) >= names.LIKE_FULL}
    got = [(r.a, r.b) for r in names.near_names(one, two).collect()]
    assert set(got) == want and len(got) == len(want) > 200
    assert names.near_candidates(one, two).count() < 4 * len(want) < len(asked) * len(set(base)) / 20
    people = spark.createDataFrame([("7", "Ada", "Day", ["Queen of Hearts", "", None]), ("8", "Bo", "Cut", None)], "person_id string, f string, l string, also array<string>")
    found = {r.person_id: r.variants for r in names.with_variants(people, "f", "l", "also").collect()}
    assert found == {"7": ["Ada Day", "Queen of Hearts"], "8": ["Bo Cut"]}
