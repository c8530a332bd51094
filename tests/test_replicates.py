import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from talkscale.operators import validation
from talkscale.plans import agreement, estimate, replicates

KEYS, ACTORS = ["year", "member", "party"], {"party": "party", "whole": "whole"}


@pytest.fixture(scope="module")
def cells(spark):
    """Cells of two years: members with many sittings, with one, and with none that has weight."""
    rng = np.random.default_rng(3)
    rows = []
    for year in (1, 2):
        for m in range(30 if year == 1 else 6):
            base = 5 + rng.normal()
            for s in range(1 if m % 7 == 3 else int(rng.integers(2, 30))):
                for _ in range(int(rng.integers(1, 5))):
                    rows.append((year, f"m{m}", None if m == 5 else f"p{m % 3}", "all", s, float(np.clip(base + rng.normal(), 0, 10)), 0.0 if m == 8 else float(rng.uniform(1, 3))))
    df = spark.createDataFrame(rows, "year int, member string, party string, whole string, sitting int, score double, weight double")
    return df, estimate.cells(df, [*KEYS, "whole"], "sitting").cache()


def boot(table, kind="position", times=200):
    out = estimate.bootstrap(table, ["year"], [*KEYS, "whole"], ACTORS, kind, times, 7).collect()
    return {(r.year, r.actor_type, r.actor_id): (r.se_boot, r.replicates) for r in out}


def plain(rows, unit, deff, kind, times):
    """The replicates of one year's actors, by loops over members and replicates."""
    members = {}
    for r in sorted(rows, key=lambda r: r.sitting):
        members.setdefault((r.year, r.member, r.party, r.whole), []).append((r.w, r.wy, r.wyy, r.ww))
    drawn = {k: replicates.member_draws(np.array(v), unit, times, np.random.default_rng([7, zlib.crc32("|".join(map(str, k)).encode())])) for k, v in members.items()}
    out = {}
    for t in range(times):
        one = {k: v[:, t] for k, v in drawn.items() if v[0, t] > 0}
        w = np.array(list(one.values())).T
        mean, free = w[1] / w[0], w[0] - w[3] / w[0]
        sigma2 = max((w[2] - w[1] * mean).clip(0).sum() / free.sum(), 0)
        v = deff * sigma2 * w[3] / w[0] ** 2
        for name, at in (("party", 2), ("whole", 3)):
            ids = np.array([str(k[at]) for k in one])
            named = [x for x in sorted(set(ids)) if x != "None"]
            between, rest = 0.0, 0
            for x in named:
                own = ids == x
                between += ((mean[own] - mean[own].mean()) ** 2 - v[own] * (1 - 1 / own.sum())).sum()
                rest += own.sum() - 1
            tau = max(between / rest, 0) if rest else 0.0
            for x in named:
                own = ids == x
                weight = 1 / np.maximum(tau + v[own], 1e-12)
                value = (weight * mean[own]).sum() / weight.sum() if kind == "position" else w[1][own].sum() / w[0][own].sum()
                out.setdefault((name, x), []).append(value)
    return out


@pytest.mark.parametrize("kind", ["position", "salience"])
def test_replicates_against_loops(spark, cells, kind, monkeypatch):
    monkeypatch.setattr(replicates, "MEMBERS", 4)  # several parts a year
    table = cells[1]
    facts = {r.year: r for r in estimate.variances(estimate.members(table, [*KEYS, "whole"]), ["year"]).collect()}
    got, seen = boot(table, kind, 40), 0
    for year in (1, 2):
        own = [r for r in table.collect() if r.year == year]
        for (name, x), want in plain(own, facts[year].deff * facts[year].sigma2, facts[year].deff, kind, 40).items():
            se, found = got[year, name, x]
            assert found == pytest.approx(want, rel=1e-9) and se == pytest.approx(np.std(want, ddof=1), rel=1e-6)
            seen += 1
    assert seen == len(got)


def test_reruns_are_equal_whatever_the_partitions(spark, cells):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = boot(cells[1].repartition(1))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert boot(cells[1].orderBy(F.rand(1)).repartition(5)) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_bootstrap_is_near_the_analytic_error(spark):
    rng = np.random.default_rng(8)
    rows = [(f"m{m}", f"p{m % 4}", s, float(np.clip(5 + m % 3 + rng.normal(0, 1.5), 0, 10)), 1.0) for m in range(60) for s in range(25) for _ in range(2)]
    df = spark.createDataFrame(rows, "member string, party string, sitting int, score double, weight double").withColumn("year", F.lit(1))
    for kind in ("position", "salience"):
        out = estimate.estimate(df, ["year"], ["member"], {"party": "party"}, "sitting", kind, 300)[1].collect()
        # salience draws sittings inside members, the analytic error takes a sitting's members together
        assert len(out) == 4 and all(0.6 < r.se / r.se_analytic < 1.4 for r in out)


def test_actor_without_weight(spark):
    df = spark.createDataFrame([(1, "a", "p", 1, 5.0, 0.0), (1, "b", "q", 1, 4.0, 1.0), (1, "b", "q", 2, 6.0, 1.0)], "year int, member string, party string, sitting int, score double, weight double")
    got = {r.actor_id: r for r in estimate.bootstrap(estimate.cells(df, ["year", "member", "party"], "sitting"), ["year"], ["year", "member", "party"], {"party": "party"}, replicates=20).collect()}
    assert got["p"].se_boot is None and all(x != x for x in got["p"].replicates) and got["q"].se_boot >= 0


def test_points_move_together():
    """A draw takes the same replicate of all points; what has none moves by its error."""
    rng = np.random.default_rng(0)
    shared = rng.normal(0, 1, 500)
    moved = validation.moved_points(np.array([1.0, 2.0, 3.0, 4.0]), np.array([1.0, 1.0, 0.5, np.nan]), [1 + shared, 2 + shared, None, [float("nan")]], 400, rng)
    assert moved.shape == (400, 4) and np.allclose(moved[:, 1] - moved[:, 0], 1)
    assert 0.3 < moved[:, 2].std() < 0.7 and (moved[:, 3] == 4).all()
    apart = validation.moved_points(np.array([1.0, 2.0]), np.array([1.0, 1.0]), [], 400, rng)
    assert np.corrcoef(apart.T)[0, 1] < 0.2


def test_interval_of_shared_errors(spark):
    """Errors that all points share leave r and its interval as without any; errors of each point's own, of the same size, don't."""
    rng = np.random.default_rng(1)
    shared = rng.normal(0, 1.5, 300)
    rows = [("s", f"c{i}", float(i), 1.5, 0.0, float(i + rng.normal(0, 2)), [float(i)], "x", [float(v) for v in i + shared]) for i in range(12)]
    df = spark.createDataFrame(rows, "scale string, cluster string, x double, se double, none double, y double, ratings array<double>, bloc string, replicates array<double>")
    one = lambda se, held: validation.summary(df, "scale", "x", se, "y", "ratings", "cluster", "bloc", held).first()
    joint, apart, still = one("se", "replicates"), one("se", None), one("none", None)
    assert joint.r == apart.r == still.r and (joint.r_lo, joint.r_hi) == pytest.approx((still.r_lo, still.r_hi), abs=1e-9)
    assert abs(apart.r_lo - still.r_lo) > 0.01


def test_validation_run(spark):
    rng = np.random.default_rng(2)
    truth = {f"w{i}": float(i) for i in range(9)}
    said = [("lr", "y", w, f"{w}m{m}", s, 1.0, float(np.clip(v + rng.normal(0, 0.5), 0, 10))) for w, v in truth.items() for m in range(4) for s in range(6)]
    speeches = spark.createDataFrame(said, "scale string, ches_year string, party_wave string, member string, sitting int, weight double, score double")
    waves = spark.createDataFrame([(w, "y", w, f"c{w}", "x" if v < 5 else "z") for w, v in truth.items()], "party_wave string, ches_year string, ches_party_id string, cluster_id string, bloc string")
    ratings = spark.createDataFrame([("y", w, "lr", float(v + e)) for w, v in truth.items() for e in (-1, 0, 1)] + [("y", "w1", "lr", None)], "ches_year string, ches_party_id string, scale string, rating double")
    points, summary = agreement.run(speeches, waves, ratings, replicates=100, draws=500)
    assert points.columns == agreement.POINTS and points.count() == 9
    got = summary.first()
    assert got.status == "ok" and got.n_clusters == 9 and got.r > 0.9 and 0.5 < got.r_lo < got.r_hi <= 1 and got.floor < got.r
    assert agreement.run(speeches, waves, ratings.limit(0), replicates=0)[0].count() == 0


def test_vectors_never_meet_by_slice_alone(spark, cells, monkeypatch):
    """A slice's members are most of the input, so none of their vectors may be dealt by slice, even where Spark can't know that the other side is small; and parts are added up a few at a time, to the same sums."""
    want, plans = boot(cells[1], times=20), []
    keep = estimate.once
    monkeypatch.setattr(estimate, "once", lambda df, name: plans.append(df) or keep(df, name))
    monkeypatch.setattr(replicates, "FAN", 2)
    monkeypatch.setattr(replicates, "MEMBERS", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = estimate.bootstrap(cells[1], ["year"], [*KEYS, "whole"], ACTORS, "position", 20, 7)
        got = {(r.year, r.actor_type, r.actor_id): r.replicates for r in made.collect()}
        text = "".join(df._jdf.queryExecution().toString() for df in [*plans, made])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in text and not re.findall(r"(?:SortMerge|ShuffledHash)Join \[year#\d+\w*\]", text)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k][1], rel=1e-9) for k in want)


def test_what_is_written_goes_by_actors(spark, cells, monkeypatch):
    """Tables that are written hold vectors of slices and actors, and none of members; sums handed on an actor at a time are the same."""
    want, sizes, keep = boot(cells[1], times=20), {}, estimate.once

    def once(df, name):
        out = keep(df, name)
        if "data" in out.columns:
            sizes[name] = out.agg(F.sum(F.length("data"))).first()[0] / (8 * 20)
        return out

    monkeypatch.setattr(estimate, "once", once)
    monkeypatch.setattr(replicates, "MEMBERS", 4)
    monkeypatch.setattr(replicates, "HELD", 1, raising=False)
    got = boot(cells[1], times=20)
    actors = len(want)
    assert sizes == {"replicates": 2 * 6 + 4 * actors, "estimates": 2 * actors}
    assert got.keys() == want.keys() and all(got[k][1] == pytest.approx(want[k][1], rel=1e-9) for k in want)


def test_members_over_several_batches():
    """A member's rows may lie in several batches, and nulls are a key's value like others."""
    rows = [(p, k, float(i)) for i, (p, k) in enumerate([(0, None)] * 2 + [(0, "a")] * 7 + [(0, "b")] + [(1, "b")] * 3)]
    table = pa.table({"_part": [r[0] for r in rows], "k": [r[1] for r in rows], **{c: [r[2] for r in rows] for c in replicates.STATS}})
    for size in (1, 3, 100):
        got = list(replicates.members_of(iter(table.to_batches(size)), ["_part"], ["k"], ["w"]))
        assert [(at, own, first, len(x)) for at, own, first, x in got] == [((0,), (None,), (0.0,), 2), ((0,), ("a",), (2.0,), 7), ((0,), ("b",), (9.0,), 1), ((1,), ("b",), (10.0,), 3)]
        assert [x for g in got for x in g[3][:, 0]] == [r[2] for r in rows]
    assert list(replicates.members_of(iter([]), ["_part"], ["k"], ["w"])) == []
