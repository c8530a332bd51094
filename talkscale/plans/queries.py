"""Queries over the driver's tables, each with DuckDB SQL for the same rows. Roles: a lineitem row is a scored speech, l_suppkey its speaker, nations and regions are groups, months are sittings; conversations are protocols."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkscale.functions import text as tx
from talkscale.operators import cutting, lookups, planning, sampling, sequences, summaries
from talkscale.plans import estimate
from talkscale.settings import SETTINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_discount", "l_quantity", "l_shipdate", "l_tax", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        line.join(supp, line.l_suppkey == supp.s_suppkey)
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # nations and regions are fixed in number
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.year("l_shipdate").alias("year"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("sitting"), "l_suppkey", "n_name", "r_name", (F.col("l_discount") * 100).alias("score"), F.sqrt("l_quantity").alias("weight"),
            F.col("l_quantity").alias("words"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("in_gov"), (F.col("l_tax") * 12.5).alias("gate"), "l_linestatus", "l_orderkey", "l_linenumber",
        )
    )


SPEECH = """s AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS INT) AS sitting, l_suppkey, n_name, r_name, l_discount * 100 AS y, sqrt(l_quantity) AS w, l_quantity AS words,
 CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END AS in_gov, l_tax * 12.5 AS gate, l_linestatus, l_orderkey, l_linenumber
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _estimate_sql(group: str) -> str:
    return f"""WITH {SPEECH},
c AS (SELECT year, l_suppkey, {group} AS g, sitting, count(*) AS n, sum(w) AS w, sum(w*y) AS wy, sum(w*y*y) AS wyy, sum(w*w) AS ww FROM s GROUP BY ALL),
m AS (SELECT year, l_suppkey, g, sum(n) AS n, count(*) AS k, sum(w) AS s0, sum(wy) AS s1, sum(wyy) AS s2, sum(ww) AS sw2 FROM c GROUP BY ALL),
r AS (SELECT c.year, c.l_suppkey, c.g, sum((c.wy - m.s1 / m.s0 * c.w) ** 2) AS rr FROM c JOIN m USING (year, l_suppkey, g) GROUP BY ALL),
m2 AS (SELECT m.*, s1/s0 AS ybar, s0*s0/sw2 AS neff, greatest(s2 - s1*s1/s0, 0) AS wss, s0 - sw2/s0 AS wdf, CASE WHEN k >= 2 THEN k/(k-1) * rr/(s0*s0) END AS cr FROM m JOIN r USING (year, l_suppkey, g)),
m3 AS (SELECT *, CASE WHEN wdf > 1e-9*s0 AND wss/wdf > 0 THEN cr / (wss/wdf/neff) END AS ratio FROM m2),
d AS (SELECT year, greatest(1, coalesce(median(ratio) FILTER (k >= 3), 1)) AS deff, CASE WHEN sum(wdf) > 1e-9*sum(s0) THEN sum(wss)/sum(wdf) ELSE greatest(coalesce((sum(s2)-sum(s1)**2/sum(s0))/nullif(sum(s0)-sum(sw2)/sum(s0), 0), 0), 0) END AS sigma2 FROM m3 GROUP BY year),
v AS (SELECT m3.*, deff*sigma2/neff AS v, deff FROM m3 JOIN d USING (year)),
mu AS (SELECT year, g, avg(ybar) AS mu, count(*) AS kk FROM v GROUP BY ALL),
t AS (SELECT year, greatest(coalesce((sum((ybar-mu)**2) - sum(v*(1-1.0/kk))) / nullif((SELECT sum(greatest(kk-1,0)) FROM mu x WHERE x.year = v.year), 0), 0), 0) AS tau2 FROM v JOIN mu USING (year, g) GROUP BY year),
e AS (SELECT year, g, count(*) AS n_mks, CAST(sum(n) AS BIGINT) AS n_speeches, sum(ybar/greatest(tau2+v,1e-12))/sum(1/greatest(tau2+v,1e-12)) AS estimate, sqrt(sum(v/greatest(tau2+v,1e-12)**2))/sum(1/greatest(tau2+v,1e-12)) AS se FROM v JOIN t USING (year) GROUP BY ALL),
b AS (SELECT year, g, sitting, sum(w) AS w, sum(wy) AS wy FROM c GROUP BY ALL),
p AS (SELECT year, g, count(*) AS n_sittings, sum(w) AS s0, sum(wy)/sum(w) AS pooled, sum(w)**2/sum(w*w) AS eff FROM b GROUP BY ALL),
q AS (SELECT year, g, CASE WHEN any_value(n_sittings) >= 2 THEN sqrt(any_value(n_sittings)/(any_value(n_sittings)-1) * sum((b.wy - pooled*b.w)**2))/any_value(s0) END AS pooled_se FROM b JOIN p USING (year, g) GROUP BY ALL)
SELECT year, g AS {group}, n_mks, n_speeches, round(estimate, 6) AS estimate, round(se, 6) AS se, n_sittings, round(pooled, 6) AS pooled, round(pooled_se, 6) AS pooled_se, round(eff, 6) AS effective_sittings,
 n_speeches >= 5 AND n_sittings >= 5 AND se <= 0.6 AND eff >= 3 AS sufficient FROM e JOIN p USING (year, g) JOIN q USING (year, g)"""


@query(_estimate_sql("n_name"))
def est_nation_year(spark, sf_dir):
    return rounded(estimate.estimate_groups(speeches(spark, sf_dir), ["year"], ["l_suppkey"], "n_name", "sitting"))


@query(_estimate_sql("r_name"))
def est_region_year(spark, sf_dir):
    return rounded(estimate.estimate_groups(speeches(spark, sf_dir), ["year"], ["l_suppkey"], "r_name", "sitting"))


@query(f"""WITH {SPEECH}, c AS (SELECT year, l_suppkey, sitting, count(*) AS n, sum(w) AS w, sum(w*y) AS wy FROM s GROUP BY ALL), m AS (SELECT year, l_suppkey, CAST(sum(n) AS BIGINT) AS n_speeches, count(*) AS n_sittings, sum(wy)/sum(w) AS ybar, sum(w) AS s0 FROM c GROUP BY ALL),
r AS (SELECT year, l_suppkey, sum((wy - ybar*w)**2) AS rr FROM c JOIN m USING (year, l_suppkey) GROUP BY ALL)
SELECT year, l_suppkey, n_speeches, n_sittings, round(ybar, 6) AS estimate, round(CASE WHEN n_sittings >= 2 THEN sqrt(n_sittings/(n_sittings-1)*rr)/s0 END, 6) AS se, n_speeches >= 3 AND n_sittings >= 3 AS sufficient FROM m JOIN r USING (year, l_suppkey)""")
def est_members_year(spark, sf_dir):
    m = estimate.members(estimate.cells(speeches(spark, sf_dir), ["year", "l_suppkey"], "sitting"), ["year", "l_suppkey"])
    return rounded(m.select("year", "l_suppkey", "n_speeches", "n_sittings", F.col("ybar").alias("estimate"), F.sqrt("cr").alias("se"), estimate.member_sufficient().alias("sufficient")))


@query("""WITH e AS (SELECT *, CASE WHEN l_tax * 12.5 >= 0.5 THEN l_quantity ELSE 0 END AS eff FROM lineitem)
SELECT l_orderkey, count(*) AS n_units, round(sum(eff * l_discount * 100) / nullif(sum(eff), 0), 6) AS score, round(sqrt(sum(l_quantity)) * sum(eff) / sum(l_quantity), 6) AS weight, min_by(l_suppkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_suppkey) AS l_suppkey FROM e GROUP BY l_orderkey""")
def speech_rollup(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_suppkey")).alias("at"), "l_suppkey", F.col("l_quantity").alias("words"), (F.col("l_discount") * 100).alias("score"), (F.col("l_tax") * 12.5 >= 0.5).cast("double").alias("multiplier"))
    return rounded(estimate.roll_up(u, ["l_orderkey"], "at", "position"))


@query("""WITH p AS (SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b, avg(l_discount*100) FILTER (l_linestatus = 'F') AS x, avg(l_discount*100) FILTER (l_linestatus = 'O') AS y FROM lineitem GROUP BY 1),
o AS (SELECT count(*) AS pairs, stddev_samp(x)/stddev_samp(y) AS b, avg(x) AS mx, avg(y) AS my FROM p WHERE a >= 3 AND b >= 3)
SELECT pairs, round(CASE WHEN pairs >= 30 THEN b END, 6) AS b, round(CASE WHEN pairs >= 30 THEN mx - b * my END, 6) AS a FROM o""")
def calibration_sd_match(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_linestatus") == "F", "plenary").otherwise("committee").alias("setting"), (F.col("l_discount") * 100).alias("score"))
    return rounded(estimate.calibration(s, "l_suppkey", "setting"))


@query(f"WITH {SPEECH} SELECT n_name, year, round(sum(w) FILTER (in_gov) / nullif(sum(w) FILTER (in_gov IS NOT NULL), 0), 6) AS share FROM s GROUP BY ALL")
def coalition_share(spark, sf_dir):
    s = speeches(spark, sf_dir)
    return rounded(s.groupBy("n_name", "year").agg(summaries.weighted_mean(F.col("in_gov").cast("double"), F.col("weight")).alias("share")))


@query("WITH b AS (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS z FROM orders), e AS (SELECT o_orderkey, o_totalprice, unnest([year(o_orderdate), year(o_orderdate) + 1]) AS period FROM orders) SELECT CAST(period AS INT) AS period, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM e, b WHERE period > a AND period <= z GROUP BY period")
def period_rolling2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    first, last = o.agg(F.min("year"), F.max("year")).first()
    return rounded(sequences.rolling2(o, "year", first, last).groupBy("period").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("SELECT CAST(year(o_orderdate) AS INT) AS period, CAST(min(o_orderdate) AS DATE) AS start, CAST(max(o_orderdate) AS DATE) AS \"end\", CASE WHEN year(o_orderdate) IN (1996, 1997, 1998) THEN '96-97-98' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS label FROM orders GROUP BY ALL")
def period_bounds(spark, sf_dir):
    y = F.year("o_orderdate")
    o = table(spark, sf_dir, "orders").select(y.alias("period"), "o_orderdate", F.when(y.isin(1996, 1997, 1998), "96-97-98").otherwise(y.cast("string")).alias("label"))
    return o.groupBy("period", "label").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))


LINEAGE = [(0, "A"), (1, ""), (2, "B"), (3, None), (5, "C")]
BLOCS = [(0, "1995", "left"), (0, "*", "right"), (1, "*", "centre"), (2, "1996", "left")]


@query("SELECT s_suppkey, s_nationkey, coalesce(nullif(l, ''), 'nation ' || s_nationkey) AS lineage FROM supplier LEFT JOIN (VALUES (0,'A'),(1,''),(2,'B'),(3,NULL),(5,'C')) t(k, l) ON k = s_nationkey")
def lookup_fallback(spark, sf_dir):
    dim = spark.createDataFrame(LINEAGE, "s_nationkey int, lineage string")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("s_nationkey"))
    return lookups.with_fallback(s, dim, "s_nationkey", "lineage", F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))).select("s_suppkey", "s_nationkey", "lineage")


@query("""WITH b(k, y, bloc) AS (VALUES (0,'1995','left'),(0,'*','right'),(1,'*','centre'),(2,'1996','left')), c AS (SELECT o_orderkey, CAST(c_nationkey AS INT) AS k, CAST(year(o_orderdate) AS INT) AS y FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, c.k, c.y, coalesce(e.bloc, a.bloc, 'other') AS bloc FROM c LEFT JOIN b e ON e.k = c.k AND e.y = CAST(c.y AS VARCHAR) LEFT JOIN b a ON a.k = c.k AND a.y = '*'""")
def lookup_wildcard(spark, sf_dir):
    blocs = spark.createDataFrame(BLOCS, "k int, y string, bloc string")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").cast("int").alias("k"), F.year("o_orderdate").alias("y"))
    return lookups.with_wildcard(o, blocs, "k", "y", "bloc", F.lit("other"))


@query("SELECT n_nationkey, coalesce(v, n_name) AS n_name FROM nation LEFT JOIN (VALUES (1, 'ONE'), (7, 'SEVEN')) t(k, v) ON k = n_nationkey")
def lookup_override(spark, sf_dir):
    new = spark.createDataFrame([(1, "ONE"), (7, "SEVEN")], "n_nationkey int, n_name string")
    return lookups.override(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name"), new, ["n_nationkey"], "n_name")


@query("WITH n AS (SELECT CAST(c_nationkey AS INT) AS c_nationkey, CAST(year(o_orderdate) AS INT) AS year, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT c_nationkey, year, c_mktsegment, n FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey, year ORDER BY n DESC, c_mktsegment) = 1")
def party_bloc_mode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("int").alias("c_nationkey"), F.year("o_orderdate").alias("year"), "c_mktsegment")
    return lookups.mode_with_count(o, ["c_nationkey", "year"], "c_mktsegment")


@query("WITH n AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag AS flag FROM n QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) = 1")
def mode_deterministic(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.mode("l_returnflag", True).alias("flag"))


WINDOWS = [("A", "1995-01-01", "1995-06-30", "w1"), ("A", "1995-06-01", "1995-12-31", "w1"), ("B", "1996-01-01", "1996-12-31", "w2"), ("A", "1996-03-01", "1996-04-30", "w3")]
SEGMENT = "CASE WHEN o_custkey % 3 = 0 THEN 'A' WHEN o_custkey % 3 = 1 THEN 'B' ELSE 'C' END"


@query(f"SELECT DISTINCT o_orderkey, {SEGMENT} AS seg, CAST(o_orderdate AS DATE) AS day, name FROM orders JOIN (VALUES ('A', DATE '1995-01-01', DATE '1995-06-30', 'w1'), ('A', DATE '1995-06-01', DATE '1995-12-31', 'w1'), ('B', DATE '1996-01-01', DATE '1996-12-31', 'w2'), ('A', DATE '1996-03-01', DATE '1996-04-30', 'w3')) w(k, a, z, name) ON k = {SEGMENT} AND CAST(o_orderdate AS DATE) BETWEEN a AND z")
def interval_crosswalk(spark, sf_dir):
    w = spark.createDataFrame(WINDOWS, "seg string, a string, z string, name string").select("seg", F.to_date("a").alias("date_from"), F.to_date("z").alias("date_to"), "name")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SEGMENT).alias("seg"), F.to_date("o_orderdate").alias("day"))
    return lookups.in_windows(o, w, "seg", "day", "name")


SPELLS = [("A", "1995-01-01", "1996-12-31", 10), ("A", "1996-01-01", None, 11), ("B", "1995-06-01", "1995-12-31", 12)]


@query(f"SELECT o_orderkey, arg_max(f, a) AS faction FROM orders JOIN (VALUES ('A', DATE '1995-01-01', DATE '1996-12-31', 10), ('A', DATE '1996-01-01', NULL, 11), ('B', DATE '1995-06-01', DATE '1995-12-31', 12)) s(k, a, z, f) ON k = {SEGMENT} AND CAST(o_orderdate AS DATE) BETWEEN a AND coalesce(z, DATE '2099-12-31') GROUP BY 1")
def asof_latest_spell(spark, sf_dir):
    s = spark.createDataFrame(SPELLS, "seg string, a string, z string, faction int").select("seg", F.to_date("a").alias("start"), F.to_date("z").alias("end"), "faction")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SEGMENT).alias("seg"), F.to_date("o_orderdate").alias("day"))
    return lookups.latest_spell(o, s, "o_orderkey", "seg", "day", "faction")


@query("SELECT o_orderkey, arg_min(v, n) AS status FROM orders LEFT JOIN (VALUES (1, DATE '1995-03-01', DATE '1996-03-01', 'coalition'), (2, DATE '1996-01-01', DATE '1997-06-30', 'opposition')) s(n, a, z, v) ON CAST(o_orderdate AS DATE) BETWEEN a AND z GROUP BY 1")
def spell_first(spark, sf_dir):
    s = spark.createDataFrame([(1, "1995-03-01", "1996-03-01", "coalition"), (2, "1996-01-01", "1997-06-30", "opposition")], "ord int, a string, z string, status string").select("ord", F.to_date("a").alias("start"), F.to_date("z").alias("end"), "status")
    return lookups.first_spell(table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), s, "o_orderkey", "day", "status")


@query(f"SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM (VALUES ('A', DATE '1995-01-01', DATE '1995-02-01'), ('B', DATE '1997-01-01', DATE '1997-03-01')) s(k, a, z) WHERE k = {SEGMENT} AND CAST(o_orderdate AS DATE) BETWEEN a - 3 AND z + 3)")
def interval_exists_padded(spark, sf_dir):
    s = spark.createDataFrame([("A", "1995-01-01", "1995-02-01"), ("B", "1997-01-01", "1997-03-01")], "seg string, a string, z string").select("seg", F.to_date("a").alias("start"), F.to_date("z").alias("end"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SEGMENT).alias("seg"), F.to_date("o_orderdate").alias("day"))
    return lookups.active_within(o, s, "seg", "day", 3).select("o_orderkey")


@query("SELECT d.doc_id, d.lang FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id")
def semi_usable(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id")
def anti_answered(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


EVENTS = "click purchase scroll signup view".split()


@query("SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (event_type = '{e}'), 6) AS {e}" for e in EVENTS) + " FROM events GROUP BY user_id")
def outer_answers_pivot(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", EVENTS).agg(F.avg("value")))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in EVENTS) + " FROM events GROUP BY user_id")
def pivot_counts_zero(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*[F.count(F.when(F.col("event_type") == e, 1)).alias(e) for e in EVENTS])


@query("WITH w AS (SELECT user_id, avg(value) AS mean, max(value) AS largest FROM events GROUP BY 1) SELECT user_id, 'mean' AS item, round(mean, 6) AS value FROM w UNION ALL SELECT user_id, 'largest', round(largest, 6) FROM w")
def unpivot_long(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.max("value").alias("largest")).unpivot(["user_id"], ["mean", "largest"], "item", "value"))


@query("WITH c AS (SELECT user_id, avg(value) AS a, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1), v AS (SELECT user_id, avg(value) AS b, count(*) AS m FROM events WHERE event_type = 'view' GROUP BY 1) SELECT user_id, round(a, 6) AS click, round(b, 6) AS view, n + m AS n FROM c JOIN v USING (user_id)")
def self_join_two_scales(spark, sf_dir):
    one = lambda e, out: F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(out)
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return rounded(e.groupBy("user_id").agg(one("click", "click"), one("view", "view"), F.count("*").alias("n")).where("click IS NOT NULL AND view IS NOT NULL"))


@query(r"""WITH c AS (SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS p FROM conversations), w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '') AS w FROM c) SELECT conv_id, turn, array_to_string(w[greatest(len(w) - 39, 1):], ' ') AS context FROM w""")
def turn_context_lag(spark, sf_dir):
    c = sequences.with_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return c.select("conv_id", "turn", tx.last_words(F.col("context"), 40).alias("context"))


WORDS = r"len(regexp_extract_all(coalesce(text, ''), '\S*[\pL\pN_]\S*'))"
SESSIONS = f"""t AS (SELECT conv_id, turn, role, {WORDS} AS words FROM conversations),
c AS (SELECT *, sum(CASE WHEN words >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS c, CASE WHEN words >= 25 THEN 1 ELSE 0 END AS l FROM t),
n AS (SELECT *, CASE WHEN lag(c) OVER k IS NULL OR c - l > lag(c) OVER k THEN 1 ELSE 0 END AS new FROM c WINDOW k AS (PARTITION BY conv_id, role ORDER BY turn)),
s AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, role ORDER BY turn) AS no FROM n),
sp AS (SELECT conv_id, role, CAST(no AS BIGINT) AS speech_no, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_turns, CAST(sum(words) AS BIGINT) AS n_words FROM s GROUP BY ALL)"""


def _sessions(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", tx.count_words(F.coalesce("text", F.lit(""))).alias("words"))
    return t, sequences.speeches(sequences.speech_sessions(t, "conv_id", "turn", ["role"], F.col("words"), 25), "conv_id", "turn", ["role"], F.col("words"))


@query(f"WITH {SESSIONS} SELECT * FROM sp")
def speech_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir)[1]


@query(f"WITH {SESSIONS} SELECT sp.conv_id, sp.role, speech_no, t.turn AS \"at\", t.role AS heckler FROM sp JOIN t ON t.conv_id = sp.conv_id AND t.turn > first_turn AND t.turn < last_turn AND t.role IS DISTINCT FROM sp.role")
def interruptions_pairs(spark, sf_dir):
    t, s = _sessions(spark, sf_dir)
    return sequences.interruptions(t, s, "conv_id", "turn", "role").select("conv_id", "role", "speech_no", "at", "heckler")


@query(f"""WITH {SESSIONS}, h AS (SELECT sp.conv_id, sp.role, speech_no, count(*) AS n FROM sp JOIN t ON t.conv_id = sp.conv_id AND t.turn > first_turn AND t.turn < last_turn AND t.role IS DISTINCT FROM sp.role GROUP BY ALL)
SELECT role, count(*) AS n_speeches, CAST(sum(n_words) AS BIGINT) AS n_words, round(1000 * sum(coalesce(n, 0)) / nullif(sum(n_words), 0), 6) AS per_1000, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0 END), 6) AS any_share FROM sp LEFT JOIN h USING (conv_id, role, speech_no) GROUP BY role""")
def interruption_rates(spark, sf_dir):
    t, s = _sessions(spark, sf_dir)
    n = sequences.interruptions(t, s, "conv_id", "turn", "role").groupBy("conv_id", "role", "speech_no").agg(F.count("*").alias("n"))
    d = s.join(n, ["conv_id", "role", "speech_no"], "left").na.fill(0, ["n"])
    return rounded(d.groupBy("role").agg(F.count("*").alias("n_speeches"), F.sum("n_words").alias("n_words"), F.try_divide(1000 * F.sum("n"), F.sum("n_words")).alias("per_1000"), F.avg((F.col("n") > 0).cast("double")).alias("any_share")))


@query("SELECT conv_id, count(*) AS n_turns, min_by(role, turn) AS first_role, max_by(role, turn) AS last_role, string_agg(role, ' ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def turn_first_last(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), " ").alias("roles")
    )


@query(f"SELECT doc_id, CAST({WORDS} AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_chars, left(text, 10) AS head, right(text, 10) AS tail FROM documents")
def word_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.count_words(t).cast("bigint").alias("n_words"), F.length(t).cast("bigint").alias("n_chars"), F.left(t, F.lit(10)).alias("head"), F.right(t, F.lit(10)).alias("tail"))


@query("SELECT sha256(text) AS text_hash, min(doc_id) AS first_doc_id, count(*) AS n FROM documents GROUP BY 1")
def text_dedupe_hash(spark, sf_dir):
    return planning.distinct_texts(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(f"""WITH {SPEECH}, u AS (SELECT year, 'all' AS actor_type, 'all' AS actor_id, y, gate, w FROM s UNION ALL SELECT year, 'bloc', r_name, y, gate, w FROM s WHERE r_name <> 'ASIA' UNION ALL SELECT year, 'side', CAST(in_gov AS VARCHAR), y, gate, w FROM s WHERE in_gov IS NOT NULL),
a AS (SELECT year, actor_type, actor_id, count(*) AS n_speeches, sum(w*y)/sum(w) AS score, sum(w*gate)/sum(w) AS gate FROM u GROUP BY ALL)
SELECT year, actor_type, actor_id, n_speeches, 'score' AS item, round(score, 6) AS value FROM a UNION ALL SELECT year, actor_type, actor_id, n_speeches, 'gate', round(gate, 6) FROM a""")
def weighted_means_grouping_sets(spark, sf_dir):
    s = speeches(spark, sf_dir)
    return rounded(summaries.summarise(s, "year", ["score", "gate"], F.col("weight"), {"all": (None, F.lit(True)), "bloc": ("r_name", F.col("r_name") != "ASIA"), "side": ("in_gov", F.lit(True))}))


@query(f"WITH {SPEECH} SELECT n_name, count(*) AS n, round(sum(w * CASE WHEN gate >= 0.5 THEN 1 ELSE 0 END) / sum(w), 6) AS share, any_value(r_name) = 'EUROPE' AS in_camp FROM s GROUP BY n_name HAVING count(*) >= 40")
def weighted_flag_share_having(spark, sf_dir):
    s = speeches(spark, sf_dir).groupBy("n_name").agg(F.count("*").alias("n"), summaries.weighted_mean((F.col("gate") >= 0.5).cast("double"), F.col("weight")).alias("share"), (F.first("r_name") == "EUROPE").alias("in_camp"))
    return rounded(s.where("n >= 40"))


@query("WITH q AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, o_orderpriority AS p, o_totalprice AS v FROM orders) SELECT quarter, coalesce(p, 'total') AS actor, count(*) AS n, round(avg(v), 6) AS mean FROM q GROUP BY GROUPING SETS ((quarter, p), (quarter))")
def quarter_counts_with_total(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("quarter"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("v"))
    g = o.groupingSets([[F.col("quarter"), F.col("p")], [F.col("quarter")]], "quarter", "p").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.grouping("p").alias("g"))
    return rounded(g.select("quarter", F.when(F.col("g") == 1, "total").otherwise(F.col("p")).alias("actor"), "n", "mean"))


@query("SELECT CAST(year(l_shipdate) AS INT) AS year, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS share FROM lineitem GROUP BY 1")
def quarter_to_year_ratio(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("q")).agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0)).alias("a"), F.sum("l_quantity").alias("b"))
    return rounded(q.groupBy("year").agg((F.sum("a") / F.sum("b")).alias("share")))


@query(f"WITH {SPEECH}, c AS (SELECT r_name, year, avg(y) AS m FROM s GROUP BY ALL), z AS (SELECT year, count(*) AS n FROM s GROUP BY 1) SELECT r_name, round(sum(m * n) / sum(n), 6) AS rate FROM c JOIN z USING (year) GROUP BY r_name")
def standardised_rates(spark, sf_dir):
    return rounded(summaries.standardised(speeches(spark, sf_dir), "r_name", "year", "score"))


@query(f"WITH {SPEECH}, p AS (SELECT l_suppkey, count(*) FILTER (year < 1998) AS n_before, count(*) FILTER (year >= 1998) AS n_after, avg(y) FILTER (year < 1998) AS b, avg(y) FILTER (year >= 1998) AS a FROM s GROUP BY 1) SELECT l_suppkey, n_before, n_after, round(b, 6) AS before, round(a, 6) AS \"after\" FROM p WHERE n_before >= 10 AND n_after >= 10")
def panel_same_members(spark, sf_dir):
    s = speeches(spark, sf_dir)
    return rounded(summaries.panel(s, "l_suppkey", F.col("year") < 1998, F.col("year") >= 1998, "score", 10))


@query(f"WITH {SPEECH} SELECT year, round(median(y) FILTER (r_name IN ('ASIA', 'EUROPE')), 6) AS left_median, round(median(y) FILTER (r_name IN ('AMERICA', 'AFRICA')), 6) AS right_median, round(median(y) FILTER (r_name IN ('AMERICA', 'AFRICA')) - median(y) FILTER (r_name IN ('ASIA', 'EUROPE')), 6) AS gap FROM s GROUP BY year")
def camp_medians_gap(spark, sf_dir):
    med = lambda *blocs: F.median(F.when(F.col("r_name").isin(*blocs), F.col("score")))
    s = speeches(spark, sf_dir).groupBy("year").agg(med("ASIA", "EUROPE").alias("left_median"), med("AMERICA", "AFRICA").alias("right_median"))
    return rounded(s.withColumn("gap", F.col("right_median") - F.col("left_median")))


@query(f"WITH {SPEECH} SELECT n_name, round(CASE WHEN count(*) >= 3 THEN corr(y, words) END, 6) AS r, round((sum(w*y*words)/sum(w) - sum(w*y)/sum(w)*sum(w*words)/sum(w)) / (sqrt(sum(w*y*y)/sum(w) - (sum(w*y)/sum(w))**2) * sqrt(sum(w*words*words)/sum(w) - (sum(w*words)/sum(w))**2)), 6) AS rw FROM s GROUP BY n_name")
def corr_guarded_weighted(spark, sf_dir):
    s = speeches(spark, sf_dir)
    return rounded(s.groupBy("n_name").agg(summaries.pearson(F.col("score"), F.col("words")).alias("r"), summaries.weighted_pearson(F.col("score"), F.col("words"), F.col("weight")).alias("rw")))


@query(f"WITH {SPEECH} SELECT n_name, count(*) AS n, round(avg(y), 6) AS mean, round(avg(y) - 1.96*stddev_samp(y)/sqrt(count(*)), 6) AS low, round(avg(y) + 1.96*stddev_samp(y)/sqrt(count(*)), 6) AS high, round(quantile_cont(y, 0.1), 6) AS p10, round(quantile_cont(y, 0.9), 6) AS p90 FROM s GROUP BY n_name")
def mean_se_ci_percentiles(spark, sf_dir):
    s = speeches(spark, sf_dir)
    se = 1.96 * F.stddev_samp("score") / F.sqrt(F.count("*"))
    return rounded(s.groupBy("n_name").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), (F.avg("score") - se).alias("low"), (F.avg("score") + se).alias("high"), F.percentile("score", 0.1).alias("p10"), F.percentile("score", 0.9).alias("p90")))


@query(f"WITH {SPEECH}, e AS (SELECT n_name, year, count(*) AS n, avg(CASE WHEN y <= 2 OR y >= 8 THEN 1.0 ELSE 0 END) AS share FROM s GROUP BY ALL) SELECT n_name, year, n, round(share, 6) AS share, n < 50 OR n < 2.0/3 * median(n) OVER (PARTITION BY n_name) AS thin FROM e")
def scale_ends_thin(spark, sf_dir):
    e = speeches(spark, sf_dir).groupBy("n_name", "year").agg(F.count("*").alias("n"), F.avg(((F.col("score") <= 2) | (F.col("score") >= 8)).cast("double")).alias("share"))
    return rounded(e.withColumn("thin", (F.col("n") < 50) | (F.col("n") < 2.0 / 3 * F.median("n").over(Window.partitionBy("n_name")))))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_suppkey, l_linenumber) = 1")
def one_per_member_first(spark, sf_dir):
    return lookups.keep_first(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_orderkey"], [F.col("l_quantity").desc(), F.col("l_suppkey"), F.col("l_linenumber")])


DAYS = "d AS (SELECT DISTINCT user_id, CAST(day(ts) AS INT) AS day FROM events)"


def _island_sql(rule: str) -> str:
    return f"WITH {DAYS}, f AS (SELECT *, CASE WHEN {rule} THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS run FROM f) SELECT user_id, min(day) AS start, max(day) AS \"end\", count(*) AS n FROM r GROUP BY user_id, run"


def _days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.dayofmonth("ts").alias("day")).distinct()


@query(_island_sql("day - lag(day) OVER w <= 1"))
def islands_consecutive(spark, sf_dir):
    return sequences.islands(_days(spark, sf_dir), ["user_id"], "day")


@query(_island_sql("day - lag(day) OVER w <= 2"))
def islands_tolerant(spark, sf_dir):
    return sequences.islands(_days(spark, sf_dir), ["user_id"], "day", gap=2)


@query(_island_sql("day - lag(day) OVER w <= 1 AND day % 5 <> 0 AND lag(day) OVER w % 5 <> 0"))
def islands_predicate(spark, sf_dir):
    return sequences.islands(_days(spark, sf_dir), ["user_id"], "day", ok=F.col("day") % 5 != 0)


@query("WITH m AS (SELECT o_orderpriority AS p, year(o_orderdate)*12 + month(o_orderdate) AS m, avg(o_totalprice) AS v FROM orders GROUP BY ALL), f AS (SELECT *, CASE WHEN v < lag(v) OVER w THEN 1 ELSE 0 END AS fall FROM m WINDOW w AS (PARTITION BY p ORDER BY m)), r AS (SELECT *, sum(1 - fall) OVER (PARTITION BY p ORDER BY m) AS run FROM f), l AS (SELECT p, run, sum(fall) AS n FROM r GROUP BY ALL) SELECT p, CAST(max(n) AS BIGINT) AS longest_fall FROM l GROUP BY p")
def longest_fall(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).agg(F.avg("o_totalprice").alias("v"))
    w = Window.partitionBy("p").orderBy("m")
    f = m.withColumn("fall", F.coalesce((F.col("v") < F.lag("v").over(w)).cast("int"), F.lit(0))).withColumn("run", F.sum(1 - F.col("fall")).over(w))
    return f.groupBy("p", "run").agg(F.sum("fall").alias("n")).groupBy("p").agg(F.max("n").alias("longest_fall"))


@query("WITH y AS (SELECT o_orderpriority AS p, CAST(year(o_orderdate) AS INT) AS y, avg(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT p, min_by(y, v) FILTER (y < 1999) AS lowest_before, max_by(y, v) AS highest FROM y GROUP BY p")
def argmin_argmax_year(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    return y.groupBy("p").agg(F.min_by("y", F.when(F.col("y") < 1999, F.col("v"))).alias("lowest_before"), F.max_by("y", "v").alias("highest"))


@query("SELECT s_suppkey, round(CASE WHEN count(s_acctbal) OVER w >= 3 THEN s_acctbal - (sum(s_acctbal) OVER w - s_acctbal) / (count(s_acctbal) OVER w - 1) END, 6) AS gap FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def peer_gap(spark, sf_dir):
    return rounded(summaries.peer_gap(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal").select("s_suppkey", "gap"))


@query("WITH a AS (SELECT o_orderkey AS k, 'a' AS src FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey AS k, 'b' AS src FROM orders WHERE o_totalprice > 100000) SELECT k, src FROM a UNION ALL SELECT k, src FROM b ANTI JOIN a USING (k)")
def union_precedence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("a").alias("src")), o.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("k"), F.lit("b").alias("src"))
    return lookups.union_precedence(a, b, "k")


@query("SELECT l_suppkey AS k, 'both' AS side FROM (SELECT l_suppkey FROM lineitem WHERE year(l_shipdate) = 1995 INTERSECT SELECT l_suppkey FROM lineitem WHERE year(l_shipdate) = 2001) UNION ALL SELECT p_partkey, 'unsold' FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)")
def intersect_except_keys(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    both = line.where(F.year("l_shipdate") == 1995).select("l_suppkey").intersect(line.where(F.year("l_shipdate") == 2001).select("l_suppkey"))
    unsold = table(spark, sf_dir, "part").select("p_partkey").subtract(line.select(F.col("l_partkey").alias("p_partkey")))
    return both.select(F.col("l_suppkey").alias("k"), F.lit("both").alias("side")).union(unsold.select("p_partkey", F.lit("unsold")))


@query("""WITH i AS (SELECT o_custkey AS k, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1), t(s, e) AS (VALUES (DATE '1995-03-01', DATE '1996-01-01'), (DATE '1996-01-01', DATE '1997-01-01'), (DATE '1998-01-01', DATE '1999-01-01')),
x AS (SELECT k, greatest(i.s, t.s) AS s, least(i.e, t.e) AS e FROM i JOIN t ON i.s < t.e AND t.s < i.e), f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM x), r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e) AS run FROM f)
SELECT k, min(s) AS start, max(e) AS "end" FROM r GROUP BY k, run""")
def interval_intersection(spark, sf_dir):
    i = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end"))
    t = spark.createDataFrame([("1995-03-01", "1996-01-01"), ("1996-01-01", "1997-01-01"), ("1998-01-01", "1999-01-01")], "a string, z string").select(F.to_date("a").alias("start"), F.to_date("z").alias("end"))
    x, y = i.alias("x"), F.broadcast(t).alias("y")
    cut = x.join(y, (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end"))).select("k", F.greatest("x.start", "y.start").alias("start"), F.least("x.end", "y.end").alias("end"))
    return sequences.merge_intervals(cut, ["k"])


@query("""WITH s AS (SELECT CAST(year(o_orderdate) AS INT) AS y, c_mktsegment AS f, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' OR year(o_orderdate) % 2 = 0 GROUP BY ALL), h AS (SELECT y, f, v / sum(v) OVER (PARTITION BY y) AS p FROM s), y AS (SELECT y, lag(y) OVER (ORDER BY y) AS b FROM (SELECT DISTINCT y FROM h))
SELECT y.y, round(sum(abs(coalesce(n.p, 0) - coalesce(o.p, 0))) / 2, 6) AS volatility FROM y CROSS JOIN (SELECT DISTINCT f FROM h) f LEFT JOIN h n ON n.y = y.y AND n.f = f.f LEFT JOIN h o ON o.y = y.b AND o.f = f.f WHERE y.b IS NOT NULL GROUP BY y.y""")
def volatility_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.year("o_orderdate").alias("y"), F.col("c_mktsegment").alias("f"), "o_totalprice")
    s = o.where("f <> 'BUILDING' OR y % 2 = 0").groupBy("y", "f").agg(F.sum("o_totalprice").alias("v"))
    return rounded(summaries.volatility(s.withColumn("p", F.col("v") / F.sum("v").over(Window.partitionBy("y"))), "y", "f", "p"))


QUESTIONS = [("q1", "h1", None), ("q2", "h2", "1997-01-01"), ("q2", "h2b", "1998-01-01"), ("q3", "h3", None)]
PLAN = """q(qid, prompt_hash, valid_from) AS (VALUES ('q1','h1',NULL), ('q2','h2',DATE '1997-01-01'), ('q2','h2b',DATE '1998-01-01'), ('q3','h3',NULL)),
u AS (SELECT o_orderkey AS unit, CAST(o_orderdate AS DATE) AS day FROM orders), a AS (SELECT unit, qid, prompt_hash FROM u CROSS JOIN q WHERE valid_from IS NULL OR day >= valid_from),
p AS (SELECT * FROM a WHERE NOT (unit % 4 = 0 AND qid = 'q1'))"""


def _plan(spark, sf_dir):
    q = spark.createDataFrame(QUESTIONS, "qid string, prompt_hash string, v string").select("qid", "prompt_hash", F.to_date("v").alias("valid_from"))
    u = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"), F.to_date("o_orderdate").alias("day"))
    answered = u.where("unit % 4 = 0").select("unit", F.lit("q1").alias("qid"), F.lit("h1").alias("prompt_hash"))
    return planning.plan_questions(u, q, answered, "unit", "day").select("unit", "qid", "prompt_hash")


@query(f"WITH {PLAN} SELECT unit, qid, prompt_hash, dense_rank() OVER (PARTITION BY unit, qid ORDER BY prompt_hash) AS layer FROM p")
def question_plan_layers(spark, sf_dir):
    return planning.layers(_plan(spark, sf_dir), "unit").withColumn("layer", F.col("layer").cast("bigint"))


@query("WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'noul' WHEN 'view' THEN 'score' ELSE 'odd' END AS type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 400 END AS noul, value / 100 AS score FROM events) SELECT event_id, CASE WHEN type = 'odd' THEN 'unknown type' WHEN type = 'noul' AND (noul IS NULL OR noul > 1) THEN 'bad noul' WHEN type = 'score' AND score > 4 THEN 'bad score' END AS problem FROM e")
def answer_validation(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "noul").when(F.col("event_type") == "view", "score").otherwise("odd")
    e = table(spark, sf_dir, "events").select("event_id", kind.alias("type"), F.when(F.col("event_id") % 7 != 0, F.col("value") / 400).alias("noul"), (F.col("value") / 100).alias("score"))
    return e.select("event_id", planning.answer_problem().alias("problem"))


@query("SELECT o_orderkey, o_orderpriority, CAST(year(o_orderdate) AS INT) AS year FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || '|7'), o_orderkey) <= 5")
def stratified_hash_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("year"))
    return sampling.by_hash(o, ["o_orderpriority", "year"], "o_orderkey", 7, F.lit(5))


@query("WITH z AS (SELECT o_orderpriority AS p, count(*) AS size FROM orders GROUP BY 1), f AS (SELECT *, size * 103.0 / sum(size) OVER () AS x FROM z), g AS (SELECT *, greatest(floor(x), 1) AS fl, x - floor(x) AS r FROM f) SELECT p, size, CAST(fl + CASE WHEN row_number() OVER (ORDER BY r DESC, p) <= 103 - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM g")
def quota_largest_remainder(spark, sf_dir):
    return sampling.quotas(table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("size")), "p", 103)


@query("SELECT d.lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS confirmed, round(avg(CAST(quality AS DOUBLE)), 6) AS rate FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang")
def hand_check_rate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return rounded(d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("bigint").alias("confirmed"), F.avg("quality").alias("rate")))


def bootstrap_se(spark, sf_dir):
    """Bootstrap errors of nations by year; random, so only rows can be compared."""
    keys = ["year", "l_suppkey", "n_name"]
    c = estimate.once(estimate.cells(speeches(spark, sf_dir), keys, "sitting"), "cells")
    out = estimate.bootstrap(c, ["year"], keys, {"n_name": "n_name"}, replicates=SETTINGS.replicates)
    return out.select("year", F.col("actor_id").alias("n_name"), "se_boot")


QUERIES["bootstrap_se"] = bootstrap_se


@query("SELECT conv_id, turn, len(parts) AS n_sentences, parts[1] AS first_sentence FROM (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1\n', 'g'), '\\n+'), lambda s: regexp_replace(trim(s), '\\.+$', '')), lambda s: s <> '') AS parts FROM conversations)")
def sentence_split(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.sentences(F.col("text")).alias("parts"))
    return c.select("conv_id", "turn", F.size("parts").cast("bigint").alias("n_sentences"), F.try_element_at("parts", F.lit(1)).alias("first_sentence"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def dedupe_adjacent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("SELECT l_suppkey, max(struct_pack(d := l_shipdate, o := l_orderkey, n := l_linenumber)).o AS l_orderkey FROM lineitem GROUP BY 1")
def one_per_member_last(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    return line.groupBy("l_suppkey").agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber"))["l_orderkey"].alias("l_orderkey"))


@query("WITH p AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year, o_orderpriority FROM orders), y AS (SELECT DISTINCT year FROM p), k AS (SELECT DISTINCT o_orderpriority FROM p), n AS (SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY ALL), t AS (SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS total FROM orders GROUP BY ALL) SELECT y.year, k.o_orderpriority, coalesce(n.n, 0) AS n, round(coalesce(n.n, 0) / total, 6) AS share FROM y CROSS JOIN k LEFT JOIN n ON n.year = y.year AND n.o_orderpriority = k.o_orderpriority JOIN t ON t.year = y.year")
def period_share_zero_fill(spark, sf_dir):
    """Shares of large orders; every year has a row for every priority, 0 where there is none. One pass: a pivot to columns is unpivoted again."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority", F.when(F.col("o_totalprice") > 400000, 1).alias("large"))
    per = o.groupBy("year", "o_orderpriority").agg(F.count("large").alias("n"), F.count("*").alias("all"))
    kinds = per.agg(F.collect_set("o_orderpriority").alias("kinds"))  # one row; priorities are fixed in number
    years = per.groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("had"), F.sum("all").alias("total"))
    full = years.join(F.broadcast(kinds)).select("year", "total", "had", F.explode("kinds").alias("o_orderpriority"))
    return rounded(full.select("year", "o_orderpriority", F.coalesce(F.try_element_at("had", F.col("o_orderpriority")), F.lit(0)).alias("n"), "total").select("year", "o_orderpriority", "n", (F.col("n") / F.col("total")).alias("share")))


@query(f"WITH {SPEECH}, m AS (SELECT r_name, n_name, l_suppkey, sum(w) AS w, sum(w*y) AS wy FROM s GROUP BY ALL), t AS (SELECT *, wy / w AS own, (sum(wy) OVER (PARTITION BY r_name) - wy) / nullif(sum(w) OVER (PARTITION BY r_name) - w, 0) AS others FROM m) SELECT r_name, count(*) AS n, round(corr(own, others), 5) AS r FROM t WHERE others IS NOT NULL GROUP BY r_name HAVING count(*) >= 3")
def loo_bloc_corr(spark, sf_dir):
    """Correlation of each member's mean with that of the rest of the bloc. Sums by bloc are joined back, so no window holds a bloc."""
    m = speeches(spark, sf_dir).groupBy("r_name", "n_name", "l_suppkey").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("score")).alias("wy"))
    bloc = m.groupBy("r_name").agg(F.sum("w").alias("bw"), F.sum("wy").alias("bwy"))
    t = m.join(F.broadcast(bloc), "r_name").select("r_name", (F.col("wy") / F.col("w")).alias("own"), ((F.col("bwy") - F.col("wy")) / F.nullif(F.col("bw") - F.col("w"), F.lit(0.0))).alias("others"))  # one row for each region
    return rounded(t.where("others IS NOT NULL").groupBy("r_name").agg(F.count("*").alias("n"), F.corr("own", "others").alias("r")).where("n >= 3"), 5)


@query("SELECT event_id, round(p0, 6) AS low, round(p1, 6) AS high, round(p0 * 0 + p1 * 4, 6) AS expected FROM (SELECT event_id, CAST(json_extract_string(j, '$.0') AS DOUBLE) AS p0, CAST(json_extract_string(j, '$.4') AS DOUBLE) AS p1 FROM (SELECT event_id, '{\"0\": ' || CAST((event_id % 11) / 10.0 AS VARCHAR) || ', \"4\": ' || CAST(1 - (event_id % 11) / 10.0 AS VARCHAR) || '}' AS j FROM events))")
def split_probabilities(spark, sf_dir):
    """Level probabilities out of a JSON map: two of them and the expected level."""
    p = (F.col("event_id") % 11) / 10.0
    j = F.concat(F.lit('{"0": '), p.cast("string"), F.lit(', "4": '), (1 - p).cast("string"), F.lit("}"))
    e = table(spark, sf_dir, "events").select("event_id", F.from_json(j, "map<string,double>").alias("levels"))
    expected = F.aggregate(F.map_entries("levels"), F.lit(0.0), lambda acc, x: acc + x["key"].cast("double") * x["value"])
    return rounded(e.select("event_id", F.col("levels")["0"].alias("low"), F.col("levels")["4"].alias("high"), expected.alias("expected")))


@query("SELECT l_returnflag, CAST(year(l_shipdate) AS INT) AS year, count(*) AS size, least(count(*), 50) AS taken, round(count(*) / least(count(*), 50), 6) AS sample_weight FROM lineitem GROUP BY ALL")
def fractional_sample_weights(spark, sf_dir):
    """What each row of a sample of at most 50 a stratum stands for."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("size")).withColumn("taken", F.least("size", F.lit(50)).cast("bigint"))
    return rounded(n.withColumn("sample_weight", F.col("size") / F.col("taken")))


def chunk_text(spark, sf_dir):
    """Documents over 2,000 characters cut into like ranges of sentences; tested against plain Python."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(tx.sentences(F.coalesce("text", F.lit(""))), lambda s: F.length(s)).alias("lengths"))
    return d.select("doc_id", F.size("lengths").alias("n_sentences"), cutting.chunk_ends(F.col("lengths"), 2000).alias("ends"))


def pack_deal(spark, sf_dir):
    """Orders' lines dealt to packs of at most 200 units of quantity, by supplier and year; tested against plain Python."""
    u = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int")).alias("unit_id"), "l_quantity")
    return cutting.deal_packs(u, ["l_suppkey", "year"], "unit_id", "l_quantity", 200, 2, 20260921)


QUERIES |= {"chunk_text": chunk_text, "pack_deal": pack_deal}
