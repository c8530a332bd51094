"""Queries over time and links, and the run of all estimates: components, spells of customers from their orders, names that change on a date. Roles: an order is a position or an event of its customer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkscale.operators import spells
from talkscale.operators.components import components
from talkscale.plans import aggregate
from talkscale.plans.queries import SPEECH, _estimate_sql, query, rounded, speeches, table

PAIRS = "p AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS b, l_quantity AS q FROM lineitem), e AS (SELECT a, b FROM p WHERE b IS NOT NULL AND q >= 49 AND a <> b)"


@query(f"WITH RECURSIVE {PAIRS}, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS other FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.other), c AS (SELECT node, min(other) AS root FROM r GROUP BY node) SELECT root, count(*) AS n, max(node) AS last FROM c GROUP BY root")
def parts_linked(spark, sf_dir):
    """Components of parts that follow each other in an order behind a large line."""
    behind = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), behind.alias("b"), "l_quantity").where("l_quantity >= 49")
    return components(pairs).groupBy("root").agg(F.count("*").alias("n"), F.max("node").alias("last"))


ISLANDS = """SELECT {by}, date_from, max(date_to) AS date_to, CASE WHEN date_from > max(max(date_to)) OVER w + 1 OR max(max(date_to)) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM o GROUP BY {by}, date_from WINDOW w AS (PARTITION BY {by} ORDER BY date_from ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _merged(by: str) -> str:
    return f"i AS ({ISLANDS.format(by=by)}), n AS (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY date_from) AS k FROM i), m AS (SELECT {by}, min(date_from) AS date_from, max(date_to) AS date_to FROM n GROUP BY {by}, k)"


@query(f"WITH o AS (SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS date_from, CAST(o_orderdate AS DATE) + 90 AS date_to FROM orders), {_merged('o_custkey, o_orderpriority')} SELECT * FROM m")
def spells_merged(spark, sf_dir):
    """Orders as positions of ninety days, by customer; priorities are kinds and stay apart."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("start"))
    return spells.spells(o.withColumn("end", F.date_add("start", 90)), ["o_custkey"], "start", "end", ["o_orderpriority"])


EVENTS = """d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max(nullif(o_orderstatus, 'P')) AS status FROM orders GROUP BY ALL),
c AS (SELECT * FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day) QUALIFY row_number() OVER w = 1 OR status IS DISTINCT FROM lag(status) OVER w),
s AS (SELECT o_custkey, status, day AS date_from, coalesce(CAST(lead(day) OVER (PARTITION BY o_custkey ORDER BY day) - 1 AS DATE), DATE '2099-12-31') AS date_to FROM c)"""


def _status(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return spells.spells_of_events(o, ["o_custkey"], "day", "status")


@query(f"WITH {EVENTS} SELECT * FROM s WHERE status IS NOT NULL")
def status_spells(spark, sf_dir):
    """Sides of customers over time, from the events that change them."""
    return _status(spark, sf_dir)


@query(f"WITH {EVENTS}, o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) + 30 AS later FROM orders) SELECT o.o_orderkey, coalesce(arg_max(s.status, s.date_from), 'none') AS status FROM o LEFT JOIN (SELECT * FROM s WHERE status IS NOT NULL) s ON s.o_custkey = o.o_custkey AND o.later BETWEEN s.date_from AND s.date_to GROUP BY o.o_orderkey")
def status_held(spark, sf_dir):
    """The side that an order's customer stood on a month later."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_add(F.col("o_orderdate").cast("date"), 30).alias("later"))
    return spells.held_on(o, _status(spark, sf_dir), ["o_custkey"], "later", "status", F.lit("none")).select("o_orderkey", "status")


@query("""SELECT CASE WHEN c_nationkey % 5 = 0 AND o_orderdate >= TIMESTAMP '1998-06-15' THEN n_name || ' (2)' ELSE n_name END AS name, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def names_versioned(spark, sf_dir):
    """Orders by the name that their nation had that day; every fifth nation is another one from 15 June 1998."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", F.col("o_orderdate").cast("date").alias("day"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    later = n.where("c_nationkey % 5 = 0").select("c_nationkey", F.lit("1998-06-15").alias("since"), F.concat("name", F.lit(" (2)")).alias("name"))
    return spells.versioned(o, "c_nationkey", "day", n, later).groupBy("name").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


def _people(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    persons = c.select(F.col("c_custkey").alias("person_id"), F.col("c_mktsegment").alias("first"), F.concat(F.lit(" "), "c_name").alias("last"), F.when(F.col("c_acctbal") < 0, F.col("c_name")).alias("full_name"), F.when(F.col("c_nationkey") == 3, F.lit(True)).alias("is_member"))
    day = F.col("o_orderdate").cast("date")
    positions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") % 5).alias("kind"), F.nullif(F.col("o_orderkey") % 3, F.lit(0)).alias("faction_id"), F.year("o_orderdate").alias("term"), day.alias("start"), F.when(F.col("o_orderkey") % 7 != 0, F.date_add(day, 200)).alias("end"))
    return spells.people(persons, positions, [1], [2], 3, 1997)


@query("""WITH m AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 5 = 1)
SELECT c_custkey AS person_id, CASE WHEN c_acctbal < 0 THEN c_name ELSE c_mktsegment || ' ' || c_name END AS person_name, o_custkey IS NOT NULL OR c_nationkey = 3 AS is_mk FROM customer LEFT JOIN m ON o_custkey = c_custkey""")
def people_named(spark, sf_dir):
    """People from raw lists: their names, and who is a member."""
    return _people(spark, sf_dir)[0]


@query(f"""WITH o AS (SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS date_from, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + 200 ELSE DATE '2099-12-31' END AS date_to FROM orders WHERE o_orderkey % 5 IN (1, 2)), {_merged('person_id')} SELECT * FROM m""")
def people_offices(spark, sf_dir):
    """Spells in office from raw lists of positions, open ones too."""
    return _people(spark, sf_dir)[1]


@query(f"""WITH o AS (SELECT o_custkey AS person_id, o_orderkey % 3 AS faction_id, CAST(o_orderdate AS DATE) AS date_from, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + 200 ELSE DATE '2099-12-31' END AS date_to FROM orders WHERE o_orderkey % 5 = 3 AND o_orderkey % 3 <> 0 AND year(o_orderdate) >= 1997), {_merged('person_id, faction_id')} SELECT * FROM m""")
def people_memberships(spark, sf_dir):
    """Memberships in factions, from 1997 on."""
    return _people(spark, sf_dir)[2]


DIMENSIONS = [aggregate.Dimension("lr", "position", "lr", "gate"), aggregate.Dimension("galtan", "position", "galtan", "lr_gate"), aggregate.Dimension("topic", "salience", "topic", "gate")]
RUN = f"""{SPEECH}, u_ AS (SELECT *, l_orderkey || ':' || l_suppkey AS speech_id, (l_orderkey * 8 + l_linenumber) * 1000000 + sitting AS unit_id, CASE l_linestatus WHEN 'F' THEN 'plenary' ELSE 'committee' END AS setting FROM s),
d_ AS (SELECT u_.* EXCLUDE (y), 'lr' AS dimension, 'position' AS kind, y AS score, gate >= 0.5 AS usable FROM u_ UNION ALL SELECT u_.* EXCLUDE (y), 'galtan', 'position', gate * 10, y / 10 >= 0.5 FROM u_ UNION ALL SELECT u_.* EXCLUDE (y), 'topic', 'salience', CASE WHEN y >= 5 THEN 10.0 ELSE 0.0 END, true FROM u_),
k_ AS (SELECT dimension, l_suppkey, count(*) FILTER (setting = 'plenary') AS n1, count(*) FILTER (setting = 'committee') AS n2, avg(score) FILTER (setting = 'plenary') AS p, avg(score) FILTER (setting = 'committee') AS c FROM d_ WHERE usable AND kind = 'position' GROUP BY ALL),
q_ AS (SELECT dimension, CASE WHEN count(*) >= 30 THEN stddev_samp(p) / stddev_samp(c) END AS b, avg(p) - CASE WHEN count(*) >= 30 THEN stddev_samp(p) / stddev_samp(c) END * avg(c) AS a FROM k_ WHERE n1 >= 3 AND n2 >= 3 GROUP BY dimension),
z_ AS (SELECT d_.* REPLACE (CASE WHEN setting = 'committee' THEN least(greatest(a + b * score, 0), 10) ELSE score END AS score), CASE WHEN setting = 'committee' THEN 1 / (b * b) ELSE 1 END * usable::INT * words AS eff FROM d_ LEFT JOIN q_ USING (dimension) WHERE setting = 'plenary' OR (kind = 'position' AND b IS NOT NULL)),
f_ AS (SELECT dimension, kind, speech_id, sum(eff * score) / nullif(sum(eff), 0) AS y, CASE WHEN kind = 'position' THEN sqrt(sum(words)) * sum(eff) / sum(words) ELSE sum(eff) END AS w, arg_min(year, unit_id) AS yr, arg_min(sitting, unit_id) AS sitting, arg_min(l_suppkey, unit_id) AS l_suppkey, arg_min(n_name, unit_id) AS n_name, arg_min(r_name, unit_id) AS r_name FROM z_ GROUP BY dimension, kind, speech_id HAVING sum(eff) > 0),
x_ AS (SELECT *, 'year' AS t, yr AS period FROM f_ UNION ALL SELECT *, 'two years', unnest([yr, yr + 1]) FROM f_),
"""


def _run_sql(kind: str, group: str, name: str) -> str:
    sql = _estimate_sql(group).replace(SPEECH, RUN + f"sx AS (SELECT dimension || '|' || t || '|' || period AS year, sitting, l_suppkey, n_name, r_name, y, w FROM x_ WHERE kind = '{kind}')")
    sql = sql.replace("sum(w*w) AS ww FROM s GROUP", "sum(w*w) AS ww FROM sx GROUP")
    value = "estimate, se" if kind == "position" else "pooled AS estimate, pooled_se AS se"
    return f"SELECT split_part(year, '|', 1) AS dimension, split_part(year, '|', 2) AS period_type, split_part(year, '|', 3) AS period, '{name}' AS actor_type, {group} AS actor_id, {value}, n_mks, n_speeches, n_sittings FROM ({sql})"


def _run(spark, sf_dir):
    u = speeches(spark, sf_dir)
    units = u.select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1_000_000 + F.col("sitting")).alias("unit_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("speech_id"), F.when(F.col("l_linestatus") == "F", "plenary").otherwise("committee").alias("setting"),
        "sitting", "year", "words", "l_suppkey", "n_name", "r_name", F.col("score").alias("lr"), "gate", (F.col("gate") * 10).alias("galtan"), (F.col("score") / 10).alias("lr_gate"), F.when(F.col("score") >= 5, 10.0).otherwise(0.0).alias("topic"),
    )
    periods = {"year": F.array("year"), "two years": aggregate.rolling(F.col("year"))}
    return aggregate.run(units, DIMENSIONS, periods, "l_suppkey", {"party": "n_name", "camp": "r_name"}, bloc="r_name", party="n_name")


RESULT = ["dimension", "period_type", "period", "actor_type", "actor_id", "estimate", "se", "n_mks", "n_speeches", "n_sittings"]


@query(f"{_run_sql('position', 'n_name', 'party')} UNION ALL {_run_sql('position', 'r_name', 'camp')}")
def run_group_scores(spark, sf_dir):
    """Positions of two kinds of actors on two dimensions in years and rolling pairs of years, committee scores calibrated: one run."""
    return rounded(_run(spark, sf_dir).group_scores.select(*RESULT))


@query(f"{_run_sql('salience', 'n_name', 'party')} UNION ALL {_run_sql('salience', 'r_name', 'camp')}")
def run_salience(spark, sf_dir):
    """Salience from the same run, of plenary units alone."""
    return rounded(_run(spark, sf_dir).salience.select(*RESULT))


@query(f"WITH {RUN} y AS (SELECT 1) SELECT dimension, period_type, period, l_suppkey, n_speeches, n_sittings, round(s1 / s0, 6) AS estimate FROM (SELECT dimension, t AS period_type, CAST(period AS VARCHAR) AS period, l_suppkey, count(*) AS n_speeches, count(DISTINCT sitting) AS n_sittings, sum(w * y) AS s1, sum(w) AS s0 FROM x_ WHERE kind = 'position' GROUP BY ALL)")
def run_member_scores(spark, sf_dir):
    """Members from the same run."""
    return rounded(_run(spark, sf_dir).member_scores.select("dimension", "period_type", "period", "l_suppkey", "n_speeches", "n_sittings", "estimate"))


@query(f"WITH {RUN} y AS (SELECT 1) SELECT dimension, count(*) AS n, count(*) FILTER (usable) AS usable, CAST(sum(CASE WHEN usable THEN unit_id % 1000 ELSE 0 END) AS BIGINT) AS digest FROM d_ GROUP BY dimension")
def run_unit_scores(spark, sf_dir):
    """Which units count for which dimension, from the same run."""
    u = _run(spark, sf_dir).unit_scores
    return u.groupBy("dimension").agg(F.count("*").alias("n"), F.count(F.when(F.col("usable"), 1)).alias("usable"), F.sum(F.when(F.col("usable"), F.col("unit_id") % 1000).otherwise(0)).alias("digest"))
