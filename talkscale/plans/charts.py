"""Reports and the cuts that feed them, with SQL. Years are periods, suppliers members, nations parties, regions blocs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkscale.operators import selectors, sequences, summaries, validation
from talkscale.plans import estimate
from talkscale.plans.queries import QUERIES, SPEECH, query, rounded, speeches, table
from talkscale.plans.reports import _shares

MEMBERS = f"{SPEECH}, mc AS (SELECT year, l_suppkey, r_name, n_name, sitting, count(*) AS n, sum(w) AS w, sum(w*y) AS wy FROM s GROUP BY ALL), mk AS (SELECT year, l_suppkey, r_name, n_name, CAST(sum(n) AS BIGINT) AS n_speeches, count(*) AS n_sittings, sum(wy)/sum(w) AS estimate FROM mc GROUP BY ALL)"


def _members(spark, sf_dir):
    keys = ["year", "l_suppkey", "r_name", "n_name"]
    m = estimate.members(estimate.cells(speeches(spark, sf_dir), keys, "sitting"), keys)
    return m.select(*keys, "n_speeches", "n_sittings", F.col("ybar").alias("estimate"), estimate.member_sufficient().alias("sufficient"))


@query(f"""WITH {MEMBERS}, g AS (SELECT * FROM mk WHERE n_speeches >= 3 AND n_sittings >= 3), r AS (SELECT l_suppkey, count(*) AS runs FROM (SELECT l_suppkey, year - lag(year) OVER (PARTITION BY l_suppkey ORDER BY year) AS d FROM g) WHERE d IS NULL OR d <> 1 GROUP BY 1)
SELECT l_suppkey, count(*) AS n, any_value(runs) AS runs, round(min_by(estimate, year), 6) AS first, round(max_by(estimate, year), 6) AS last, abs(max_by(estimate, year) - min_by(estimate, year)) <= 2 AS near FROM g JOIN r USING (l_suppkey) GROUP BY 1""")
def report_careers(spark, sf_dir):
    return rounded(selectors.careers(_members(spark, sf_dir), "l_suppkey", "year", "estimate", 2))


@query(f"""WITH {MEMBERS}, b AS (SELECT r_name, year, sum(estimate) / count(*) AS estimate, count(*) AS n_mks FROM mk GROUP BY ALL), l AS (SELECT *, n_mks >= 4 AS ok, coalesce(year - lag(year) OVER w > 1 OR NOT n_mks >= 4 OR NOT lag(n_mks >= 4) OVER w, true) AS new FROM b WINDOW w AS (PARTITION BY r_name ORDER BY year))
SELECT r_name, year, round(estimate, 6) AS estimate, NOT ok AS thin, CAST(sum(new::INT) OVER (PARTITION BY r_name ORDER BY year) AS BIGINT) AS line FROM l""")
def report_bloc_lines(spark, sf_dir):
    """Blocs by year; a line breaks at a gap and at years with too few members."""
    b = _members(spark, sf_dir).groupBy("r_name", "year").agg(F.avg("estimate").alias("estimate"), F.count("*").alias("n_mks"))
    w = Window.partitionBy("r_name").orderBy("year")
    ok = F.col("n_mks") >= 4
    new = F.coalesce((F.col("year") - F.lag("year").over(w) > 1) | ~ok | ~F.lag(ok).over(w), F.lit(True))
    return rounded(b.withColumn("thin", ~ok).withColumn("new", new.cast("int")).withColumn("line", F.sum("new").over(w)).select("r_name", "year", "estimate", "thin", "line"))


@query(f"""WITH {SPEECH}, a AS (SELECT n_name, year FROM (SELECT n_name, year, sum(words) AS words FROM s GROUP BY ALL) QUALIFY words >= avg(words) OVER (PARTITION BY n_name)), i AS (SELECT *, coalesce(year - lag(year) OVER (PARTITION BY n_name ORDER BY year) > 2, true)::INT AS new FROM a), r AS (SELECT *, sum(new) OVER (PARTITION BY n_name ORDER BY year) AS run FROM i), v AS (SELECT n_name, make_date(min(year), 1, 1) AS a, make_date(max(year) + 1, 1, 1) AS b FROM r GROUP BY n_name, run),
e AS (SELECT unnest([DATE '1994-06-01', DATE '1996-05-29', DATE '1999-05-17']) AS d), t AS (SELECT row_number() OVER (ORDER BY d) AS term, d AS a, coalesce(lead(d) OVER (ORDER BY d), DATE '2002-01-28') AS b FROM e)
SELECT n_name, count(DISTINCT term) AS terms FROM v JOIN t ON v.a < t.b AND t.a < v.b AND least(v.b, t.b) - greatest(v.a, t.a) > 0.1 * 365.25 GROUP BY n_name""")
def report_terms_crossed(spark, sf_dir):
    """Years of more speech than usual, bridged over one missing year, and the terms between elections that they cross."""
    said = speeches(spark, sf_dir).groupBy("n_name", "year").agg(F.sum("words").alias("words"))
    active = said.withColumn("usual", F.avg("words").over(Window.partitionBy("n_name"))).where("words >= usual").select("n_name", "year")
    runs = sequences.islands(active, ["n_name"], "year", gap=2)
    v = runs.select("n_name", F.make_date("start", F.lit(1), F.lit(1)).alias("start"), F.make_date(F.col("end") + 1, F.lit(1), F.lit(1)).alias("end"))
    e = spark.createDataFrame([("1994-06-01",), ("1996-05-29",), ("1999-05-17",)], "d string").select(F.to_date("d").alias("d"))
    return selectors.terms_crossed(v, selectors.spans(e, "d", "2002-01-28"), ["n_name"])


@query(f"WITH {SPEECH}, p AS (SELECT n_name, 'score' AS item, avg(y) AS v FROM s WHERE n_name IN (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 3) GROUP BY ALL UNION ALL SELECT n_name, 'gate', avg(gate) FROM s WHERE n_name IN (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 3) GROUP BY ALL) SELECT item, count(*) AS parties, round(max(v) - min(v), 6) AS difference FROM p GROUP BY item")
def report_largest_difference(spark, sf_dir):
    three = table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(3).select("n_name")  # three parties
    p = speeches(spark, sf_dir).join(F.broadcast(three), "n_name", "left_semi").groupBy("n_name").agg(F.avg("score").alias("score"), F.avg("gate").alias("gate"))
    long = p.unpivot(["n_name"], ["score", "gate"], "item", "v")
    return rounded(long.groupBy("item").agg(F.count("*").alias("parties"), (F.max("v") - F.min("v")).alias("difference")))


@query(f"WITH {SPEECH}, y AS (SELECT year, sum(w * CASE WHEN gate >= 0.5 THEN 1 ELSE 0 END) / sum(w) AS share, count(*) AS n FROM s GROUP BY year) SELECT round(avg(share) FILTER (year <= 1997), 6) AS usual, max_by(year, share) AS peak, round(max(share), 6) AS top, round(max(share) FILTER (year < 1999), 6) AS top_before, count(*) FILTER (n < 2000) AS thin_years FROM y")
def report_usual_and_peak(spark, sf_dir):
    y = speeches(spark, sf_dir).groupBy("year").agg(summaries.weighted_mean((F.col("gate") >= 0.5).cast("double"), F.col("weight")).alias("share"), F.count("*").alias("n"))
    return rounded(y.agg(F.avg(F.when(F.col("year") <= 1997, F.col("share"))).alias("usual"), F.max_by("year", "share").alias("peak"), F.max("share").alias("top"), F.max(F.when(F.col("year") < 1999, F.col("share"))).alias("top_before"), F.count(F.when(F.col("n") < 2000, 1)).alias("thin_years")))


@query(f"WITH {SPEECH} SELECT year, round(sum(w*y) FILTER (l_linestatus = 'F') / sum(w) FILTER (l_linestatus = 'F'), 6) AS plenary, round(sum(w*y) FILTER (l_linestatus = 'O') / sum(w) FILTER (l_linestatus = 'O'), 6) AS committee FROM s GROUP BY year")
def report_two_settings(spark, sf_dir):
    s = speeches(spark, sf_dir)
    own = lambda k: summaries.weighted_mean(F.col("score"), F.when(F.col("l_linestatus") == k, F.col("weight")))
    return rounded(s.groupBy("year").agg(own("F").alias("plenary"), own("O").alias("committee")))


@query(f"WITH {MEMBERS}, g AS (SELECT year, r_name, sum(w) AS w, sum(wy) AS wy, count(DISTINCT l_suppkey) AS n FROM mc GROUP BY ALL) SELECT year, round(sum(wy / w) FILTER (r_name = 'EUROPE'), 6) AS a, round(sum(wy / w) FILTER (r_name = 'ASIA'), 6) AS b, coalesce(sum(n) FILTER (r_name = 'EUROPE'), 0) < 5 AS thin_a FROM g GROUP BY year")
def report_salience_by_bloc(spark, sf_dir):
    g = speeches(spark, sf_dir).groupBy("year", "r_name").agg((F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("v"), F.countDistinct("l_suppkey").alias("n"))
    of = lambda k, c: F.max(F.when(F.col("r_name") == k, F.col(c)))
    return rounded(g.groupBy("year").agg(of("EUROPE", "v").alias("a"), of("ASIA", "v").alias("b"), (F.coalesce(of("EUROPE", "n"), F.lit(0)) < 5).alias("thin_a")))


CARDS = [3, 8, 21, 34, 55, 89]


@query(f"SELECT o.place, event_id, event_type, round(value, 2) AS value FROM (VALUES {', '.join(f'({i}, {c})' for i, c in enumerate(CARDS))}) AS o(place, id) JOIN events ON event_id = id")
def report_cards(spark, sf_dir):
    """Six rows picked by hand, in their order."""
    c = spark.createDataFrame(list(enumerate(CARDS)), "place int, id long")
    return rounded(table(spark, sf_dir, "events").join(F.broadcast(c), F.col("event_id") == F.col("id")).select("place", "event_id", "event_type", "value"), 2)


@query(f"WITH {SPEECH}, t AS (SELECT r_name, 'topic_score' AS item, sum(w * CASE WHEN y >= 5 THEN 1 ELSE 0 END) / sum(w) AS v FROM s GROUP BY ALL UNION ALL SELECT r_name, 'topic_gate', sum(w * CASE WHEN gate >= 0.5 THEN 1 ELSE 0 END) / sum(w) FROM s GROUP BY ALL) SELECT substr(item, 7) AS topic, r_name, round(v, 6) AS share, rank() OVER (PARTITION BY item ORDER BY round(v, 6) DESC) AS place FROM t")
def report_issues_by_bloc(spark, sf_dir):
    s = speeches(spark, sf_dir).groupBy("r_name").agg(*[summaries.weighted_mean(c.cast("double"), F.col("weight")).alias(n) for n, c in (("topic_score", F.col("score") >= 5), ("topic_gate", F.col("gate") >= 0.5), ("other", F.lit(1)))])
    long = rounded(s.unpivot(["r_name"], ["topic_score", "topic_gate", "other"], "item", "share")).where(F.col("item").startswith("topic_"))
    return long.select(F.expr("substring(item, 7)").alias("topic"), "r_name", "share", F.rank().over(Window.partitionBy("item").orderBy(F.col("share").desc())).cast("bigint").alias("place"))


@query(f"WITH {MEMBERS} SELECT year AS period, round(median(estimate) FILTER (r_name IN ('EUROPE', 'ASIA')), 6) AS median_a, round(median(estimate) FILTER (r_name NOT IN ('EUROPE', 'ASIA')), 6) AS median_b, round(median(estimate) FILTER (r_name IN ('EUROPE', 'ASIA')) - median(estimate) FILTER (r_name NOT IN ('EUROPE', 'ASIA')), 6) AS gap, count(*) FILTER (r_name = 'AFRICA') AS n_left, count(*) FILTER (n_speeches < 3 OR n_sittings < 3) AS n_thin FROM mk GROUP BY year")
def report_chamber(spark, sf_dir):
    """Camps' median members, the gap, a bloc's members and the thin ones, by period."""
    t = _members(spark, sf_dir).select(F.lit("lr").alias("dimension"), F.lit("year").alias("period_type"), F.col("year").alias("period"), F.col("l_suppkey").alias("speaker_id"), F.col("n_name").alias("faction_id"), F.col("r_name").alias("bloc"), "estimate", "n_speeches", "sufficient")
    c = selectors.chamber(t, "lr", "year", list(range(1990, 2005)))
    camp = F.col("bloc").isin("EUROPE", "ASIA")
    a, b = F.median(F.when(camp, F.col("value"))), F.median(F.when(~camp, F.col("value")))
    return rounded(c.groupBy("period").agg(a.alias("median_a"), b.alias("median_b"), (a - b).alias("gap"), F.count(F.when(F.col("bloc") == "AFRICA", 1)).alias("n_left"), F.count(F.when(F.col("thin"), 1)).alias("n_thin")))


@query(f"WITH {MEMBERS} SELECT DISTINCT l_suppkey AS speaker_id FROM mk WHERE year = 1997 AND r_name IN ('EUROPE', 'ASIA')")
def members_selected(spark, sf_dir):
    t = _members(spark, sf_dir).select(F.lit("lr").alias("dimension"), F.col("year").cast("string").alias("period"), F.col("l_suppkey").alias("speaker_id"), F.col("r_name").alias("bloc"))
    return selectors.members(t, ["lr"], "1997", None, ["EUROPE", "ASIA"])


@query("SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS n_sentences FROM lineitem WHERE l_orderkey % 3 = 0 AND year(l_shipdate) IN (1996, 1997, 1998, 2000) AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def sentences_behind(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("n_sentences"))
    u = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderpriority").alias("dimension"), (F.col("o_orderkey") % 3 == 0).alias("usable"))
    return selectors.sentences_behind(p, u, ["1-URGENT", "2-HIGH"], spark.createDataFrame([("1996-1997-1998",), ("2000",), ("1997",)], "period string"), "year")


@query("SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS n_sentences FROM lineitem WHERE l_returnflag IN ('A', 'R') AND year(l_shipdate) BETWEEN 1995 AND 1997 AND l_linestatus <> 'O'")
def side_sentences(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("n_sentences"), (F.col("l_linestatus") == "O").alias("is_chairman"))
    return selectors.sentence_total(u, F.col("l_returnflag").isin("A", "R") & F.col("year").between(1995, 1997))


@query(f"WITH {SPEECH}, e AS (SELECT year, n_name, avg(y) AS estimate FROM s GROUP BY ALL), a AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), p AS (SELECT year, min(make_date(sitting // 100, sitting % 100, 1)) AS start FROM s GROUP BY year) SELECT 'party' AS actor_type, n_name AS actor_id, CAST(year AS VARCHAR) AS period, CASE WHEN year = 1996 AND n_name = 'NATION_1' THEN 'moved' ELSE r_name END AS bloc, start AS period_start, round(estimate, 6) AS estimate, CAST(NULL AS VARCHAR) AS lineage FROM e LEFT JOIN a USING (n_name) LEFT JOIN p USING (year)")
def estimates_decorated(spark, sf_dir):
    s = speeches(spark, sf_dir)
    e = s.groupBy(F.col("year").cast("string").alias("period"), F.col("n_name").alias("actor_id")).agg(F.avg("score").alias("estimate")).withColumns({"actor_type": F.lit("party"), "period_type": F.lit("year")})
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    actors = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("party").alias("actor_type"), F.col("n_name").alias("actor_id"), F.col("r_name").alias("bloc"))
    day = F.make_date((F.col("sitting") / 100).cast("int"), F.col("sitting") % 100, F.lit(1))
    periods = s.groupBy(F.col("year").cast("string").alias("period")).agg(F.min(day).alias("period_start")).withColumn("period_type", F.lit("year"))
    blocs = spark.createDataFrame([("NATION_1", "year", "1996", "moved")], "actor_id string, period_type string, period string, bloc string")
    return rounded(selectors.decorate(e, actors, periods, blocs, ["actor_type", "actor_id", "period", "bloc", "period_start", "estimate", "lineage"]))


@query("""WITH o AS (SELECT CAST(year(o_orderdate) AS INT) AS year, c_mktsegment AS family FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' OR year(o_orderdate) >= 1997 GROUP BY ALL), p AS (SELECT year, family, CASE WHEN family = 'AUTOMOBILE' AND year = 1996 THEN ['MACHINERY'] WHEN family = 'BUILDING' AND year = 1998 THEN ['FURNITURE'] ELSE [] END AS parts FROM o),
f AS (SELECT f, min(year) AS first FROM (SELECT year, family AS f FROM p UNION ALL SELECT year, unnest(parts) FROM p) GROUP BY f) SELECT year, family FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.f = family AND first < year)""")
def report_new_families(spark, sf_dir):
    lists = _shares(spark, sf_dir).where((F.col("family") != "BUILDING") | (F.col("year") >= 1997))
    return selectors.new_families(lists, "year", "family", "parts").select("year", "family")


@query("SELECT CAST(year(o_orderdate) AS INT) AS year, round(sum(CASE WHEN o_orderkey % 10 IN (1, 2, 3) THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS a, round(sum(CASE WHEN o_orderkey % 10 IN (7, 8) THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS b, round(1 - sum(CASE WHEN o_orderkey % 10 IN (1, 2, 3) THEN o_totalprice ELSE 0 END) / sum(o_totalprice) - sum(CASE WHEN o_orderkey % 10 IN (7, 8) THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS dont_know FROM orders GROUP BY 1")
def survey_shares(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 10).cast("int").alias("answer"), "o_totalprice")
    return rounded(selectors.category_shares(o, ["year"], "answer", "o_totalprice", {"a": [1, 2, 3], "b": [7, 8]}, "dont_know"))


@query(f"WITH {SPEECH}, n AS (SELECT n_name, year, count(DISTINCT l_suppkey) AS n FROM s GROUP BY ALL) SELECT n_name, max(n) AS most FROM n GROUP BY n_name")
def largest_membership(spark, sf_dir):
    return selectors.largest_membership(speeches(spark, sf_dir), "n_name", "year", "l_suppkey")


@query("SELECT o_custkey, max(struct_pack(a := o_orderpriority = '1-URGENT', b := o_orderdate, c := o_orderkey)).c AS o_orderkey FROM orders GROUP BY 1")
def preferred_latest(spark, sf_dir):
    """Of each key the row of the preferred kind, then the latest."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return selectors.best(o, ["o_custkey"], [F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT l_returnflag, CAST(year(l_shipdate) AS INT) AS year FROM lineitem")
def distinct_terms(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("year")).distinct()


@query("SELECT scale, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(x, y) END, 6) AS r FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS scale, c_acctbal AS x, c_custkey::DOUBLE AS y, c_mktsegment AS bloc FROM customer) WHERE bloc <> 'BUILDING' GROUP BY scale")
def r_without_one_bloc(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("scale"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"), F.col("c_mktsegment").alias("bloc"))
    n = c.where(F.col("bloc") != "BUILDING").groupBy("scale").agg(F.count("*").alias("n"))
    return rounded(validation.r_without(c, "scale", "x", "y", "bloc", "BUILDING").join(n, "scale"))


def era_intervals(spark, sf_dir):
    """Means of members by bloc and era with bounds from draws; random, so only rows can be compared."""
    m = _members(spark, sf_dir).withColumn("era", F.when(F.col("year") < 1997, "early").otherwise("late")).groupBy("r_name", "era", "l_suppkey").agg(F.avg("estimate").alias("v"))
    return rounded(selectors.mean_interval(m, ["r_name", "era"], "v"))


QUERIES["era_intervals"] = era_intervals
