"""Intervals, merged families and the presiding officer against values worked out by hand."""

import numpy as np
import pytest

from talkscale.operators import presiding, validation


def test_bca_of_a_symmetric_bootstrap_is_the_percentile_interval():
    boot = np.linspace(-1, 1, 2001)
    lo, hi = validation.bca(0.0, boot, np.array([-0.1, 0.0, 0.1]))
    assert lo == pytest.approx(-0.95, abs=1e-3) and hi == pytest.approx(0.95, abs=1e-3)
    assert validation.bca(0.0, boot[:40], np.zeros(3)) == (None, None) and validation.bca(2.0, boot, np.zeros(3)) == (None, None)


def test_validate(spark):
    rng = np.random.default_rng(1)
    rows = [("good", f"c{i % 10}", float(v), float(v + e)) for i, (v, e) in enumerate(rng.normal(0, (1, 0.2), (40, 2)))]
    rows += [("few", "a", 1.0, 2.0), ("few", "b", None, 1.0)]
    got = {r.scale: r for r in validation.validate(spark.createDataFrame(rows, "scale string, cluster string, x double, y double"), "scale", "x", "y", "cluster").collect()}
    g = got["good"]
    assert g.n_clusters == 10 and g.r == pytest.approx(np.corrcoef([r[2] for r in rows[:40]], [r[3] for r in rows[:40]])[0, 1]) and g.r_lo < g.r < g.r_hi
    assert got["few"].status == "inconclusive" and got["few"].r is None and got["few"].n_clusters == 1


def test_confirmed_rate(spark):
    df = spark.createDataFrame([("a", 1000, 100, 0.5), ("b", 10, 0, 0.5), ("c", None, None, None)], "k string, n long, f long, h double")
    got = {r.k: r for r in validation.confirmed_rate(df, "k", "n", "f", "h").collect()}
    assert got["a"].rate == pytest.approx(0.05) and 0.03 < got["a"].lo < 0.05 < got["a"].hi < 0.07
    assert got["b"].rate is None and got["c"].rate is None


def test_joint_lists_move_no_votes(spark):
    rows = [(1, "a", [], 60.0), (1, "b", [], 40.0), (2, "a", ["b", "z"], 100.0), (3, "a", [], 30.0), (3, "c", None, 70.0)]
    df = spark.createDataFrame(rows, "t int, f string, parts array<string>, share double")
    assert {r.t: r.volatility for r in validation.volatility_of_families(df, "t", "f", "parts", "share").collect()} == {2: 0.0, 3: 70.0}


def test_floor_and_stints():
    who, no = np.array([0, 1, 0, 1, 0, 0]), np.zeros(6, bool)
    at = lambda *x: np.isin(np.arange(6), x)
    assert presiding.floor_spans(who, at(0), at(2, 4), no) == [(0, 0, 2)]
    assert presiding.floor_spans(who, at(0), at(2, 3, 4), no) == [(0, 0, 6)]  # another's formula lies between
    assert presiding.stints(np.array([0, 0, 0, 1, 0, 1, 0]), np.array([1, 1, 1, 1, 0, 0, 0], bool)).tolist() == [True, True, True, False, False, False, False]
    assert presiding.stints(np.array([0, 1, 0, 1, 0]), np.array([1, 0, 1, 0, 1], bool)).tolist() == [True, False, True, False, True]
    assert not presiding.stints(who, at(1, 2)).any()


def test_presiding(spark):
    thanks = "תודה רבה."
    said = [("c", thanks), ("m", "דברים"), ("c", thanks), ("n", "עוד דברים"), ("c", thanks), ("f", "אדוני היושב-ראש, נאום ארוך"), (None, None)]
    rows = [("p", i, s, t, 2 if t else 0, True, s == "f") for i, (s, t) in enumerate(said)]
    df = spark.createDataFrame(rows, "p string, turn int, s string, t string, n int, valid boolean, chair boolean")
    got = {r.turn for r in presiding.presiding(df, "p", "turn", "s", "t", "n", "valid", "chair").collect() if r.presiding}
    assert got == {0, 2, 4}  # the flagged member spoke from the floor
