import re

import pytest
from pyspark.sql import functions as F

from talkscale.plans import aggregate, estimate
from talkscale.settings import Settings

DIMENSIONS = [aggregate.Dimension("d", "position", "score", "gate"), aggregate.Dimension("t", "salience", "topic", "gate")]


@pytest.fixture(scope="module")
def units(spark):
    """Members whose committee scores lie half as far from 5 as their plenary ones, on both sides."""
    rows = []
    for m in range(40):
        for k in range(4):
            for setting, score in (("plenary", m / 4), ("committee", 5 + (m / 4 - 5) / 2)):
                rows.append((f"{m}-{k}-{setting}", f"{m}-{k}-{setting}", setting, k, 2000 + k % 2, 100.0, f"m{m}", "p" if m < 20 else "q", "left" if m < 15 else "right", score, 1.0 if k else 0.9, float(k)))
    rows.append(("none", "none", "plenary", 1, 2000, 10.0, "m1", "p", "left", None, 1.0, None))
    return spark.createDataFrame(rows, "unit_id string, speech_id string, setting string, sitting int, year int, words double, member string, party string, bloc string, score double, gate double, topic double")


def test_calibration_is_applied(units):
    table = aggregate.run(units, DIMENSIONS, {"year": F.array("year")}, "member", {"party": "party"}, bloc="bloc")
    means = {r.member: r.estimate for r in table.member_scores.where("period = '2000'").collect()}
    # committee scores come back to the plenary ones, so both agree
    assert all(means[f"m{m}"] == pytest.approx(m / 4, abs=1e-9) for m in range(40))
    assert {(r.actor_id, r.bloc) for r in table.group_scores.collect()} == {("p", "left"), ("q", "right")}
    assert {r.n_speeches for r in table.salience.collect()} == {20 * 2}  # plenary units alone
    scores = table.unit_scores
    assert scores.count() == 2 * 320 and scores.where("unit_id = 'none'").count() == 0 and scores.where("NOT usable").count() == 0


def test_committee_is_left_out_without_calibration(units):
    strict = Settings(calibration_pairs=41)
    table = aggregate.run(units.where("gate >= 0.5"), DIMENSIONS, {"all": F.array(F.lit("all"))}, "member", {"party": "party"}, settings=strict)
    assert {r.n_speeches for r in table.member_scores.collect()} == {4}


def test_rolling_periods(spark, units):
    periods = {"year": F.array("year"), "two": aggregate.rolling(F.col("year"), 1, F.lit(2001))}
    table = aggregate.run(units, DIMENSIONS[:1], periods, "member", {"party": "party"}).group_scores
    assert {(r.period_type, r.period): r.n_speeches for r in table.where("actor_id = 'p'").collect()} == {("year", "2000"): 80, ("year", "2001"): 80, ("two", "2000"): 80, ("two", "2001"): 160}


def test_the_units_are_scanned_once(spark, units, tmp_path):
    """What the estimates read are tables that the run has written; the units are in no plan."""
    path = str(tmp_path / "units")
    units.write.parquet(path)
    table = aggregate.run(spark.read.parquet(path), DIMENSIONS, {"year": F.array("year")}, "member", {"party": "party"})
    for df in table:
        assert path not in "".join(df.inputFiles())


def test_no_join_meets_by_slices_alone(spark, units, monkeypatch):
    """A dimension, or a period of it, may be all of the input, so no join may leave it to one task, even where Spark can't know that the other side is small."""
    plans = []
    for module in (aggregate, estimate):
        monkeypatch.setattr(module, "once", lambda df, name, old=module.once: plans.append(df) or old(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans += aggregate.run(units, DIMENSIONS, {"year": F.array("year")}, "member", {"party": "party"})
        joins = re.findall(r"(?:SortMerge|ShuffledHash)Join \[([^\]]*)\]", "".join(df._jdf.queryExecution().toString() for df in plans))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    met = [{re.sub(r"#.*", "", c.strip()) for c in keys.split(",")} for keys in joins]
    assert met and not [m for m in met if m <= set(aggregate.SLICES)]


def test_speeches_of_several_units(spark):
    """Each dimension takes its columns from the first of its own units; a committee's moved scores count by their precision."""
    rows = [("b", "s", "plenary", 2.0, "late", 4.0, True, None, True), ("a", "s", "committee", 1.0, "early", 6.0, True, 10.0, True), ("c", "s", None, 3.0, "last", None, True, 0.0, True), ("d", "t", "committee", 1.0, "other", None, True, 5.0, True)]
    scored = spark.createDataFrame(rows, "unit_id string, speech_id string, setting string, words double, member string, score_0 double, usable_0 boolean, score_1 double, usable_1 boolean")
    got = {r.dimension: r for r in aggregate.speeches_of(scored, DIMENSIONS, {"d": (1.0, 0.5)}, "unit_id").collect()}
    # 1 + 6 / 2 = 4 with precision 4; salience has the unit without a setting alone
    assert (got["d"].member, got["d"].score, got["d"].weight) == ("early", pytest.approx(4.0), pytest.approx(3**0.5 * (2 + 4) / 3))
    assert (got["t"].member, got["t"].score, got["t"].weight) == ("last", 0.0, 3.0) and len(got) == 2
    assert [r.dimension for r in aggregate.speeches_of(scored, DIMENSIONS, {}, "unit_id").where("member = 'late'").collect()] == ["d"]
