"""Report queries: the tables behind charts, on the stand-in roles of queries.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkscale.operators import summaries, validation
from talkscale.plans.queries import SPEECH, query, rounded, speeches, table


@query(f"""WITH {SPEECH}, m AS (SELECT l_suppkey, any_value(r_name) AS r_name, avg(y) AS a, avg(gate) AS b FROM s GROUP BY 1)
SELECT r_name, count(*) AS members, round(avg(a), 6) AS mean_score, round(median(a), 6) AS median_score, round(avg(b), 6) AS mean_gate, round(median(b), 6) AS median_gate, round(stddev_samp(a) / stddev_samp(b), 6) AS sd_ratio, round(quantile_cont(a, 0.1), 6) AS decile_1, round(quantile_cont(a, 0.9), 6) AS decile_9 FROM m GROUP BY r_name""")
def report_members_map(spark, sf_dir):
    m = speeches(spark, sf_dir).groupBy("l_suppkey").agg(F.any_value("r_name").alias("r_name"), F.avg("score").alias("a"), F.avg("gate").alias("b"))
    return rounded(m.groupBy("r_name").agg(
        F.count("*").alias("members"), F.avg("a").alias("mean_score"), F.median("a").alias("median_score"), F.avg("b").alias("mean_gate"), F.median("b").alias("median_gate"),
        F.try_divide(F.stddev_samp("a"), F.stddev_samp("b")).alias("sd_ratio"), F.percentile("a", F.lit(0.1)).alias("decile_1"), F.percentile("a", F.lit(0.9)).alias("decile_9"),
    ))


@query(f"""WITH {SPEECH}, p AS (SELECT n_name, avg(y) FILTER (year >= 1998) - avg(y) FILTER (year < 1998) AS score, avg(gate) FILTER (year >= 1998) - avg(gate) FILTER (year < 1998) AS gate FROM s GROUP BY 1), u AS (SELECT n_name, 'score' AS item, score AS move FROM p UNION ALL SELECT n_name, 'gate', gate FROM p)
SELECT n_name, item, round(move, 6) AS move, CAST(row_number() OVER (PARTITION BY n_name ORDER BY abs(move) DESC, item) AS INT) AS place FROM u""")
def report_changed_sides(spark, sf_dir):
    step = lambda c: (F.avg(F.when(F.col("year") >= 1998, F.col(c))) - F.avg(F.when(F.col("year") < 1998, F.col(c)))).alias(c)
    u = speeches(spark, sf_dir).groupBy("n_name").agg(step("score"), step("gate")).unpivot(["n_name"], ["score", "gate"], "item", "move")
    return rounded(u.withColumn("place", F.row_number().over(Window.partitionBy("n_name").orderBy(F.abs("move").desc_nulls_last(), "item"))))


@query(f"WITH {SPEECH} SELECT year, round(sum(w * (gate >= 0.5)::INT) FILTER (in_gov) / sum(w) FILTER (in_gov), 6) AS government, round(sum(w * (gate >= 0.5)::INT) FILTER (NOT in_gov) / sum(w) FILTER (NOT in_gov), 6) AS opposition, least(count(*) FILTER (in_gov), count(*) FILTER (NOT in_gov)) < 100 AS thin FROM s GROUP BY year")
def report_tone_by_side(spark, sf_dir):
    flag, w = (F.col("gate") >= 0.5).cast("double"), F.col("weight")
    side = lambda c, out: summaries.weighted_mean(F.when(c, flag), w).alias(out)
    size = lambda c: F.count(F.when(c, 1))
    g = F.col("in_gov")
    return rounded(speeches(spark, sf_dir).groupBy("year").agg(side(g, "government"), side(~g, "opposition"), (F.least(size(g), size(~g)) < 100).alias("thin")))


@query(f"""WITH {SPEECH}, y AS (SELECT r_name, year, sum(w * (gate >= 0.8)::INT) / sum(w) AS share FROM s GROUP BY ALL)
SELECT r_name, round(avg(share), 6) AS long_run, arg_max(year, share) AS top_year, round(min(share) FILTER (year < 1998), 6) AS least_before, round(max(share) FILTER (year < 1998), 6) AS most_before, round(min(share) FILTER (year >= 1998), 6) AS least_after, round(max(share) FILTER (year >= 1998), 6) AS most_after FROM y GROUP BY r_name""")
def report_new_targets(spark, sf_dir):
    y = speeches(spark, sf_dir).groupBy("r_name", "year").agg(summaries.weighted_mean((F.col("gate") >= 0.8).cast("double"), F.col("weight")).alias("share"))
    old, new = F.when(F.col("year") < 1998, F.col("share")), F.when(F.col("year") >= 1998, F.col("share"))
    return rounded(y.groupBy("r_name").agg(F.avg("share").alias("long_run"), F.max_by("year", "share").alias("top_year"), F.min(old).alias("least_before"), F.max(old).alias("most_before"), F.min(new).alias("least_after"), F.max(new).alias("most_after")))


@query(f"""WITH {SPEECH}, p AS (SELECT n_name, CASE WHEN year < 1997 THEN 'a' WHEN year < 1999 THEN 'b' ELSE 'c' END AS period, y, w, in_gov FROM s)
SELECT n_name, period, round(sum(w*y)/sum(w), 6) AS estimate, sum(w) FILTER (in_gov) / sum(w) FILTER (in_gov IS NOT NULL) >= 0.5 AS in_government FROM p GROUP BY ALL""")
def report_when_power_changed(spark, sf_dir):
    period = F.when(F.col("year") < 1997, "a").when(F.col("year") < 1999, "b").otherwise("c").alias("period")
    w = F.col("weight")
    return rounded(speeches(spark, sf_dir).groupBy("n_name", period).agg(summaries.weighted_mean(F.col("score"), w).alias("estimate"), (summaries.weighted_mean(F.col("in_gov").cast("double"), w) >= 0.5).alias("in_government")))


@query(f"""WITH {SPEECH}, m AS (SELECT l_suppkey, any_value(n_name) AS n_name, any_value(r_name) AS r_name, avg(y) AS y FROM s GROUP BY 1), g AS (SELECT *, CASE WHEN count(*) OVER k >= 3 THEN y - (sum(y) OVER k - y) / (count(*) OVER k - 1) END AS gap FROM m WINDOW k AS (PARTITION BY n_name))
SELECT r_name, count(gap) AS members, round(avg(gap), 6) AS mean_gap, round(1.96 * stddev_samp(gap) / sqrt(count(gap)), 6) AS half_width, count(*) FILTER (gap < 0) AS below_zero FROM g GROUP BY r_name""")
def report_gap_to_copartisans(spark, sf_dir):
    m = speeches(spark, sf_dir).groupBy("l_suppkey").agg(F.any_value("n_name").alias("n_name"), F.any_value("r_name").alias("r_name"), F.avg("score").alias("y"))
    g = summaries.peer_gap(m, ["n_name"], "y")
    half = F.try_divide(1.96 * F.stddev_samp("gap"), F.sqrt(F.count("gap")))
    return rounded(g.groupBy("r_name").agg(F.count("gap").alias("members"), F.avg("gap").alias("mean_gap"), half.alias("half_width"), F.count(F.when(F.col("gap") < 0, 1)).alias("below_zero")))


@query(f"""WITH {SPEECH}, m AS (SELECT CASE WHEN year < 1998 THEN 'early' ELSE 'late' END AS era, in_gov, l_suppkey, avg(y) AS y, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT era, sum(n) FILTER (in_gov IS NULL) / sum(n) AS missing FROM m GROUP BY era)
SELECT m.era, in_gov, count(*) AS members, round(avg(y), 6) AS mean, round(any_value(missing), 6) AS missing FROM m JOIN t USING (era) WHERE in_gov IS NOT NULL GROUP BY m.era, in_gov""")
def report_eras_by_group(spark, sf_dir):
    era = F.when(F.col("year") < 1998, "early").otherwise("late").alias("era")
    m = speeches(spark, sf_dir).groupBy(era, "in_gov", "l_suppkey").agg(F.avg("score").alias("y"), F.count("*").alias("n"))
    g = m.groupBy("era", "in_gov").agg(F.count("*").alias("members"), F.avg("y").alias("mean"), F.sum("n").alias("n"))
    w = Window.partitionBy("era")  # three rows for each era
    g = g.withColumn("missing", F.coalesce(F.sum(F.when(F.col("in_gov").isNull(), F.col("n"))).over(w), F.lit(0)) / F.sum("n").over(w))
    return rounded(g.where("in_gov IS NOT NULL").drop("n"))


@query("SELECT role, count(DISTINCT conv_id) AS conversations, round(count(DISTINCT conv_id) / (SELECT count(DISTINCT conv_id) FROM conversations), 6) AS share_of_conversations, round(count(*) / (SELECT count(*) FROM conversations), 6) AS share_of_turns FROM conversations GROUP BY role")
def report_on_the_floor(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("role", "conv_id").agg(F.count("*").alias("n"))
    whole = c.agg(F.countDistinct("conv_id").alias("_c"), F.sum("n").alias("_n"))  # one row
    g = c.groupBy("role").agg(F.count("*").alias("conversations"), F.sum("n").alias("n")).crossJoin(F.broadcast(whole))
    return rounded(g.select("role", "conversations", (F.col("conversations") / F.col("_c")).alias("share_of_conversations"), (F.col("n") / F.col("_n")).alias("share_of_turns")))


SURVEYS = [("main", 1995, 0.21), ("main", 1997, 0.19), ("other", 1996, 0.25), ("other", 1997, 0.5)]


@query("""WITH v(kind, year, x) AS (VALUES ('main',1995,0.21),('main',1997,0.19),('other',1996,0.25),('other',1997,0.5)), o AS (SELECT CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice) FILTER (o_mktsegment = 'BUILDING') / sum(o_totalprice) AS share FROM (SELECT o_orderdate, o_totalprice, c_mktsegment AS o_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1)
SELECT o.year, round(share, 6) AS seats, CAST(coalesce(a.x, b.x) AS DOUBLE) AS voters FROM o LEFT JOIN v a ON a.kind = 'main' AND a.year = o.year LEFT JOIN v b ON b.kind = 'other' AND b.year = o.year""")
def report_voters_and_seats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    share = F.sum(F.when(F.col("c_mktsegment") == "BUILDING", F.col("o_totalprice"))) / F.sum("o_totalprice")
    v = spark.createDataFrame(SURVEYS, "kind string, year int, x double")
    pick = lambda k: F.broadcast(v.where(F.col("kind") == k).select("year", F.col("x").alias(k)))
    out = o.groupBy(F.year("o_orderdate").alias("year")).agg(share.alias("seats")).join(pick("main"), "year", "left").join(pick("other"), "year", "left")
    return rounded(out.select("year", "seats", F.coalesce("main", "other").alias("voters")))


LISTS = {"AUTOMOBILE": (1996, "MACHINERY"), "BUILDING": (1998, "FURNITURE")}


def _shares(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy(F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("family")).agg(F.sum("o_totalprice").alias("v"))
    parts = F.array().cast("array<string>")
    for lead, (year, part) in LISTS.items():
        parts = F.when((F.col("family") == lead) & (F.col("year") == year), F.array(F.lit(part))).otherwise(parts)
    return g.select("year", "family", parts.alias("parts"), (100 * F.col("v") / F.sum("v").over(Window.partitionBy("year"))).alias("share"))


@query("""WITH o AS (SELECT CAST(year(o_orderdate) AS INT) AS year, c_mktsegment AS f, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), s AS (SELECT year, f, 100 * v / sum(v) OVER (PARTITION BY year) AS x FROM o),
n AS (SELECT year AS a, lead(year) OVER (ORDER BY year) AS b FROM (SELECT DISTINCT year FROM s)), u AS (SELECT n.b AS year, f, CASE WHEN s.year = n.a THEN -x ELSE x END AS x, s.year AS at FROM s JOIN n ON s.year IN (n.a, n.b) WHERE n.b IS NOT NULL),
j AS (SELECT n.b AS year, CASE WHEN f = 'MACHINERY' AND 1996 IN (n.a, n.b) THEN 'AUTOMOBILE' WHEN f = 'FURNITURE' AND 1998 IN (n.a, n.b) THEN 'BUILDING' ELSE f END AS g, u.x FROM u JOIN n ON n.b = u.year), t AS (SELECT year, g, sum(x) AS x FROM j GROUP BY ALL)
SELECT year, round(sum(abs(x)) / 2, 6) AS volatility FROM t GROUP BY year""")
def report_dealignment(spark, sf_dir):
    return rounded(validation.volatility_of_families(_shares(spark, sf_dir), "year", "family", "parts", "share"))


def _points(spark, sf_dir):
    """A party and wave: nation and year; its clusters are nations, its other rating is the mean gate."""
    s = speeches(spark, sf_dir)
    return s.groupBy(F.col("r_name").alias("bloc"), F.col("n_name").alias("cluster"), "year").agg(F.avg("score").alias("x"), F.avg("gate").alias("y")).withColumn("scale", F.when(F.col("year") % 2 == 0, "even").otherwise("odd"))


@query(f"""WITH {SPEECH}, p AS (SELECT CASE WHEN year % 2 = 0 THEN 'even' ELSE 'odd' END AS scale, r_name AS bloc, n_name AS cluster, avg(gate) AS y FROM s GROUP BY year, r_name, n_name),
t AS (SELECT p.scale, p.y, coalesce((SELECT avg(q.y) FROM p q WHERE q.scale = p.scale AND q.bloc = p.bloc AND q.cluster <> p.cluster), (SELECT avg(q.y) FROM p q WHERE q.scale = p.scale AND q.cluster <> p.cluster)) AS told FROM p)
SELECT scale, round(corr(told, y), 6) AS floor FROM t GROUP BY scale""")
def validation_bloc_floor(spark, sf_dir):
    return rounded(validation.bloc_floor(_points(spark, sf_dir), "scale", "y", "cluster", "bloc"))


@query()
def validation_by_scale(spark, sf_dir):
    return rounded(validation.validate(_points(spark, sf_dir), "scale", "x", "y", "cluster"))


@query()
def confirmed_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("scored"), F.count(F.when(F.col("value") > 50, 1)).alias("flagged"), F.lit(0.75).alias("held"))
    return rounded(validation.confirmed_rate(e, "event_type", "scored", "flagged", "held"))
