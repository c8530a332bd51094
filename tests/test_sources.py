"""Readers, writers, the stream and the cutting operators."""

import bz2
import hashlib
import http.server
import json
import threading
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkscale.operators import cutting
from talkscale.plans import queries as plans
from talkscale.sources import paged, readers, schemas, sinks
from talkscale.streaming import answers as stream

DIR = "/root/testdata/sf0.001"


def answer(unit, qid="q", score=1.0, created="2024-01-01", stage="unit"):
    return {"unit_id": unit, "qid": qid, "prompt_hash": "h", "model": "m", "stage": stage, "type": "score", "score": score, "created_at": created}


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in schemas.ANSWER.names) for r in rows], schemas.ANSWER)


def stored(spark, root):
    return sorted((r.unit_id, r.stage, r.score) for r in readers.table(spark, f"{root}/answers", schemas.ANSWER).collect())


def test_sentences(spark, tmp_path):
    base = {"knesset_number": "20", "protocol_name": "p", "protocol_type": "plenary", "protocol_date": "2015-05-01 10:00", "is_ocr_output": False, "speaker_id": " 7 ", "speaker_name": " ", "is_valid_speaker": True, "is_chairman": None, "turn_num_in_protocol": 1, "sent_num_in_turn": 2, "sentence_text": None}
    rows = [base | {"speaker_is_knesset_member": "True"}, base | {"speaker_is_knesset_member": True}, base | {"speaker_is_knesset_member": False}, base | {"protocol_date": None}]
    text = "\n\n".join(json.dumps(r) for r in rows) + "\n"
    (tmp_path / "plenary_12.jsonl.bz2").write_bytes(bz2.compress(text.encode()))
    df = readers.sentences(spark, str(tmp_path))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schemas.SENTENCE]
    got = df.collect()
    assert len(got) == 3 and sum(r.is_mk for r in got) == 2
    r = got[0]
    assert (r.shard, r.knesset, str(r.date), r.speaker_id, r.speaker_name, r.is_chairman, r.turn, r.sent, r.text) == (12, 20, "2015-05-01", "7", None, False, 1, 2, "")


def test_sentences_without_files(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.sentences(spark, str(tmp_path / "none" / "*.bz2"))


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('\ufeffyear,id,party_id,lr,eu,note\n2021,1,01,5.5,,"a ""b"", c"\n2022,2,02,,3,\n', encoding="utf-8")
    text = {r.year: r.asDict() for r in readers.csv_text(spark, str(path)).collect()}
    assert text["2021"]["note"] == 'a "b", c' and text["2021"]["party_id"] == "01" and text["2022"]["note"] == ""
    assert sorted(map(tuple, readers.experts(spark, str(path), ["lr", "eu"]).collect())) == [("2021", "1", "01", "lr", 5.5), ("2022", "2", "02", "eu", 3.0)]
    sinks.write_csv(spark.createDataFrame([("01", "x")], "period string, v string"), str(tmp_path / "out"), ["v", "period"])
    back = readers.csv(spark, str(tmp_path / "out"), "v string, period string").collect()
    assert [tuple(r) for r in back] == [("x", "01")]


def test_crosswalk(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("ches_year,ches_party_id,knesset,date_from,date_to\n2021,7,24,2021-01-01,\n")
    r = readers.crosswalk(spark, str(path)).first()
    assert (r.party_wave, str(r.date_from), r.date_to) == ("2021:7", "2021-01-01", None)


def test_answers_are_added_once(spark, tmp_path):
    root = str(tmp_path / "store")
    sinks.append_answers(frame(spark, [answer("a", score=1.0, created="2"), answer("a", score=2.0, created="1"), answer("a", stage="pack")]), root, "mock")
    assert stored(spark, root) == [("a", "pack", 1.0), ("a", "unit", 2.0)]
    sinks.append_answers(frame(spark, [answer("a", score=9.0), answer("b")]), root, "mock")
    assert stored(spark, root) == [("a", "pack", 1.0), ("a", "unit", 2.0), ("b", "unit", 1.0)]
    with pytest.raises(ValueError, match="mock"):
        sinks.append_answers(frame(spark, [answer("c")]), root, "live")


def test_stream(spark, tmp_path):
    landing, root = tmp_path / "in", str(tmp_path / "store")
    landing.mkdir()
    for name, rows in (("1", [answer("a"), answer("b")]), ("2", [answer("b", score=3.0), answer("c")])):
        (landing / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
        stream.follow(spark, str(landing), root, str(tmp_path / "ckpt"), "mock").awaitTermination()
    assert stored(spark, root) == [("a", "unit", 1.0), ("b", "unit", 1.0), ("c", "unit", 1.0)]


def test_units_are_pruned(spark, tmp_path):
    rows = spark.range(40).select(*[(F.lit(None) if f.name not in ("unit_id", "protocol_type", "knesset") else {"unit_id": F.col("id"), "protocol_type": F.lit("plenary"), "knesset": F.col("id") % 3}[f.name]).cast(f.dataType).alias(f.name) for f in schemas.UNIT])
    sinks.write_units(rows, str(tmp_path / "units"))
    got = readers.table(spark, str(tmp_path / "units"), schemas.UNIT, ["unit_id", "knesset"]).where("knesset = 1")
    assert got.count() == 13 and "PartitionFilters: [isnotnull(knesset" in got._jdf.queryExecution().toString()
    assert readers.table(spark, str(tmp_path / "none"), schemas.UNIT, missing_ok=True).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_cuts_fit_and_are_few(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 90, rng.integers(1, 60))
    cuts = cutting.even_cuts(lengths, 100)
    parts = np.split(lengths, cuts[:-1])
    assert cuts[-1] == len(lengths) and all(len(p) for p in parts)
    assert all(p.sum() + len(p) - 1 <= 100 for p in parts) and len(parts) >= -(-(lengths.sum() + len(lengths) - 1) // 100)
    assert cutting.even_cuts(lengths, 10**6).tolist() == [len(lengths)]


def test_cuts_at_the_edges():
    assert cutting.even_cuts(np.array([]), 10).tolist() == []
    assert cutting.even_cuts(np.array([500]), 10).tolist() == [1]
    assert cutting.even_cuts(np.array([500, 1, 1]), 10).tolist() == [1, 2, 3]
    assert cutting.even_cuts(np.array([10, 10, 10, 10]), 25).tolist() == [2, 4]


def test_deal():
    assert cutting.deal([], 10, 2) == []
    assert cutting.deal([50], 10, 2) == [0]
    assert cutting.deal([4, 4, 4, 4], 10, 2) == [0, 1, 2, 0]  # 16 characters and three separators need three packs
    assert cutting.deal([50, 60], 10, 2) == [0, 1]


def test_packs_hold_every_unit_once(spark):
    got = plans.pack_deal(spark, DIR)
    sizes = got.groupBy("l_suppkey", "year", "pack").agg(F.sum(F.substring_index("unit_id", "|", -1).cast("int")).alias("q"), F.count("*").alias("n"))
    assert sizes.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{DIR}/lineitem.parquet").count() and sizes.where("q + 2 * (n - 1) > 200").count() == 0


def test_packs_against_plain_python(spark):
    """Groups, null keys and null units too, are dealt in the order of their hashes by a few calls of Python, not by one for each group."""
    rows = [(None if i % 9 == 0 else f"m{i % 9}", i % 3, None if i == 77 else f"é{i}", None if i % 10 == 0 else i % 47) for i in range(300)]
    df = spark.createDataFrame(rows, "member string, year int, unit string, n int")
    got = cutting.deal_packs(df, ["member", "year"], "unit", "n", 90, 2, 5)
    assert got.columns == ["member", "year", "unit", "pack"] and dict(got.dtypes)["pack"] == "int"
    groups = {}
    for member, year, unit, n in rows:
        turn = None if unit is None else hashlib.sha256(f"{unit}|5".encode()).hexdigest()
        groups.setdefault((member, year), []).append((unit is None, turn, unit, n or 0))
    want = {(*key, line[2], pack) for key, lines in groups.items() for line, pack in zip(sorted(lines), cutting.deal([x[3] for x in sorted(lines)], 90, 2), strict=True)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(rows)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_whole_texts_and_estimate_tables(spark, tmp_path):
    (tmp_path / "a.1.txt").write_text("one\n\ntwo", encoding="utf-8")
    (tmp_path / "b.txt").write_text("שלום", encoding="utf-8")
    assert sorted(map(tuple, readers.transcripts(spark, f"{tmp_path}/*.txt").collect())) == [("a.1", "one\n\ntwo"), ("b", "שלום")]
    for name in ("group_scores", "mk_scores", "validation_points", "validation_summary"):
        (tmp_path / f"{name}.csv").write_text("period,actor_id,estimate,sufficient\n07,031,1.5,true\n2021,,,\n", encoding="utf-8")
    tables = readers.estimate_tables(spark, str(tmp_path))
    assert len(tables) == 4
    for t in tables.values():
        assert t.dtypes == [("period", "string"), ("actor_id", "string"), ("estimate", "double"), ("sufficient", "boolean")]
        assert sorted(map(tuple, t.collect())) == [("07", "031", 1.5, True), ("2021", None, None, None)]


def test_paged_lists(spark, tmp_path):
    pages = {"/api/L?$format=json": {"value": [{"id": 1, "name": "א"}, {"id": 2}], "odata.nextLink": "L?page=2"}, "/api/L?page=2&$format=json": {"value": [{"id": 3}]}}
    asked = []

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            known = len(asked) > 1 and pages.get(self.path)  # the first request fails
            self.send_response(200 if known else 503)
            self.end_headers()
            self.wfile.write(json.dumps(known).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/api/L"
    read = lambda **more: sorted(map(tuple, paged.listing(spark, url, str(tmp_path / "l"), "id int, name string", pause="0", **more).collect()))
    want = [(1, "א"), (2, None), (3, None)]
    assert read() == want
    n = len(asked)
    assert read() == want and len(asked) == n  # from the store
    assert read(refresh=True) == want and len(asked) > n
    server.shutdown()


def test_fetching():
    slept, calls = [], []

    def gone(url):
        calls.append(url)
        raise urllib.error.HTTPError(url, 404, "", None, None)

    with pytest.raises(urllib.error.HTTPError):
        paged.fetch("u", get=gone, sleep=slept.append)
    assert len(calls) == 1 and not slept

    def down(url):
        raise ConnectionError

    with pytest.raises(ConnectionError):
        paged.fetch("u", tries=3, get=down, sleep=slept.append)
    assert slept == [5.0, 10.0]
    with pytest.raises(ValueError, match="twice"):
        list(paged.items("http://h/L", "value", "next", "", lambda u: b'{"value": [], "next": "L"}'))
    assert paged.address("http://h/a/L?x=1", "L?skip=2", "$format=json") == "http://h/a/L?skip=2&$format=json"


def test_files_of_sittings(spark):
    sessions = spark.createDataFrame([(1, "2024-02-05T16:00:00"), (2, "2024-02-01T00:00:00"), (3, "2024-02-06T00:00:00"), (4, None)], "PlenumSessionID int, StartDate string")
    docs = [(1, 28, "x.doc", "2024-09-01"), (1, 28, "a.DOCX ", "2024-03-01"), (1, 28, "b.docx", None), (1, 5, "c.docx", "2025-01-01"), (2, 28, "d.docx", None), (3, 28, "", None), (3, 28, None, None), (4, 28, "e.doc", None)]
    documents = spark.createDataFrame(docs, "PlenumSessionID int, GroupTypeID int, FilePath string, LastUpdatedDate string")
    assert [(r.session_id, str(r.date), r.path) for r in paged.files_of_sittings(sessions, documents, "2024-02-01", 28).collect()] == [(1, "2024-02-05", "a.DOCX")]
