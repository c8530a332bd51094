"""Queries of the question layer and of samples, with SQL. Orders are units, priorities and questions stand for a battery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkscale.operators import questions as qs
from talkscale.operators import sampling
from talkscale.plans.queries import PLAN, QUERIES, _plan, query, rounded, table

DIMS = [
    {"id": "left_right", "kind": "position", "gate": {"instructions": "Is it  about\nthe axis?", "when_true": "yes", "when_false": "no"}, "score": {"instructions": "Where?", "levels": ["left", "centre", "right"]}, "valid_from": "1997-01-01"},
    {"id": "tone", "kind": "salience", "score": {"instructions": "How sharp?", "levels": ["calm", "sharp", "hostile", "abusive", "violent"]}},
    {"id": "attack", "kind": "flag", "gate": {"instructions": "Any attack?", "when_true": "one", "when_false": "none"}},
]


@query("""WITH f(pos, qid, dimension, role, type, n_levels, valid_from, payload, sorted) AS (VALUES
 (0, 'left_right__gate', 'left_right', 'gate', 'noul', NULL, DATE '1997-01-01', '{"type": "noul", "instructions": "Is it about the axis?", "criteria": {"true": "yes", "false": "no"}}', '{"criteria": {"false": "no", "true": "yes"}, "instructions": "Is it about the axis?", "type": "noul"}'),
 (1, 'left_right__score', 'left_right', 'score', 'score', 3, DATE '1997-01-01', '{"type": "score", "instructions": "Where?", "criteria": ["left", "centre", "right"]}', '{"criteria": ["left", "centre", "right"], "instructions": "Where?", "type": "score"}'),
 (2, 'tone__score', 'tone', 'salience', 'score', 5, NULL, '{"type": "score", "instructions": "How sharp?", "criteria": ["calm", "sharp", "hostile", "abusive", "violent"]}', '{"criteria": ["calm", "sharp", "hostile", "abusive", "violent"], "instructions": "How sharp?", "type": "score"}'),
 (3, 'attack__flag', 'attack', 'flag', 'noul', NULL, NULL, '{"type": "noul", "instructions": "Any attack?", "criteria": {"true": "one", "false": "none"}}', '{"criteria": {"false": "none", "true": "one"}, "instructions": "Any attack?", "type": "noul"}')),
b AS (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1),
g AS (SELECT CAST(3 + row_number() OVER (ORDER BY b) AS INT), b || '__flag', b, 'flag', 'noul', NULL, NULL, '{"type": "noul", "instructions": "Is it one of the ' || n || ' about ' || b || '?", "criteria": {"true": "about it", "false": "about another"}}', '{"criteria": {"false": "about another", "true": "about it"}, "instructions": "Is it one of the ' || n || ' about ' || b || '?", "type": "noul"}' FROM b)
SELECT pos, qid, dimension, role, type, payload, left(sha256(sorted), 16) AS prompt_hash, n_levels, valid_from, CAST(ceil((length(qid) + length(payload)) / 4.0) AS INT) AS tokens FROM (SELECT * FROM f UNION ALL SELECT * FROM g)""")
def question_table(spark, sf_dir):
    """The questions that three dimensions make, and one flag for each brand of parts with its number of parts."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).orderBy("p_brand").collect()  # definitions are made on the driver; brands are a fixed list
    flags = [{"id": b.p_brand, "kind": "flag", "gate": {"instructions": f"Is it one of the  {b.n} about\n{b.p_brand}?", "when_true": "about it", "when_false": " about another"}} for b in brands]
    return qs.question_table(spark, DIMS + flags)


@query(f"WITH {PLAN}, k AS (SELECT unit, qid, CAST(substr(qid, 2) AS INT) * 25 AS pos FROM p), m AS (SELECT unit, CAST(pos // 60 AS INT) AS block, bit_or(CAST(1 AS BIGINT) << (pos % 60)) AS mask FROM k GROUP BY ALL), d AS (SELECT unit, CAST(pos // 60 AS INT) AS block, bit_or(CAST(1 AS BIGINT) << (pos % 60)) AS mask FROM k WHERE unit % 3 = 0 AND qid <> 'q3' GROUP BY ALL) SELECT m.unit, m.block, m.mask & ~coalesce(d.mask, 0) AS mask FROM m LEFT JOIN d USING (unit, block) WHERE m.mask & ~coalesce(d.mask, 0) <> 0")
def question_masks(spark, sf_dir):
    asked = _plan(spark, sf_dir).withColumn("pos", F.substring("qid", 2, 9).cast("int") * 25)
    done = asked.where((F.col("unit") % 3 == 0) & (F.col("qid") != "q3"))
    return qs.open_masks(qs.masks(asked, "unit", "pos"), qs.masks(done, "unit", "pos"), "unit")


REQUESTED = """r AS (SELECT unit % 500 AS text_hash, CASE WHEN unit % 2 = 0 THEN 'speech' ELSE 'pack' END AS stage, unit % 2 AS ord, unit, qid, prompt_hash, length(qid) * 10 + length(prompt_hash) AS tokens FROM p),
l AS (SELECT *, dense_rank() OVER (PARTITION BY text_hash, qid ORDER BY prompt_hash) AS layer FROM r)"""


def _requests(spark, sf_dir):
    u = F.col("unit")
    a = _plan(spark, sf_dir).select((u % 500).alias("text_hash"), F.when(u % 2 == 0, "speech").otherwise("pack").alias("stage"), (u % 2).alias("ord"), "unit", "qid", "prompt_hash", (F.length("qid") * 10 + F.length("prompt_hash")).alias("tokens"))
    return qs.requests(a)


@query(f"WITH {PLAN}, {REQUESTED}, sent AS (SELECT text_hash, layer, sum(tokens) AS tokens, count(*) AS n, string_agg(qid || ':' || prompt_hash, ',' ORDER BY qid) AS questions FROM (SELECT DISTINCT text_hash, layer, qid, prompt_hash, tokens FROM l) GROUP BY ALL), t AS (SELECT text_hash, layer, min(struct_pack(ord := ord, unit := unit)).unit AS sender, count(DISTINCT unit) AS n_targets FROM l GROUP BY ALL) SELECT text_hash, CAST(layer AS INT) AS layer, sender, questions, n_targets, CAST(tokens AS BIGINT) AS tokens FROM sent JOIN t USING (text_hash, layer)")
def question_requests(spark, sf_dir):
    r = _requests(spark, sf_dir)
    return r.select("text_hash", "layer", "sender", F.array_join(F.transform("questions", lambda q: F.concat(q["qid"], F.lit(":"), q["prompt_hash"])), ",").alias("questions"), F.size("targets").cast("bigint").alias("n_targets"), "tokens")


@query(f"WITH {PLAN}, {REQUESTED}, sent AS (SELECT text_hash, layer, sum(tokens) AS tokens, count(*) AS n FROM (SELECT DISTINCT text_hash, layer, qid, prompt_hash, tokens FROM l) GROUP BY ALL), s AS (SELECT count(*) AS n_requests, CAST(sum(n) AS BIGINT) AS n_questions, CAST(sum(ceil((text_hash + 10) / 2.5) + 200 + tokens) AS BIGINT) AS n_tokens FROM sent) SELECT *, round(n_tokens * 0.042 / 1e6, 6) AS cost, round(n_requests * 1.5 / 16, 6) AS eta_seconds FROM s")
def describe_requests(spark, sf_dir):
    return rounded(qs.describe(_requests(spark, sf_dir).withColumn("chars", F.col("text_hash") + 10), "chars", 200, 0.042, 1.5, 16))


@query("WITH u AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS stage, doc_id % 2 AS ord, doc_id AS unit, sha256(coalesce(text, '')) AS text_hash FROM documents), f AS (SELECT text_hash, min(struct_pack(o := ord, u := unit, s := stage)) AS f FROM u GROUP BY 1) SELECT unit, stage, f.u AS sender, CASE WHEN unit = f.u AND stage = f.s THEN 'sent' WHEN stage = f.s THEN 'repeated' ELSE 'shared' END AS status FROM u JOIN f USING (text_hash)")
def text_fan_out(spark, sf_dir):
    d = F.col("doc_id")
    u = table(spark, sf_dir, "documents").select(F.when(d % 2 == 0, "a").otherwise("b").alias("stage"), (d % 2).alias("ord"), d.alias("unit"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    return qs.shared_texts(u).select("unit", "stage", "sender", "status")


@query(f"WITH {PLAN}, s AS (SELECT unit, qid, ceil((unit % 4000) / 2.5) + 100 + max(CASE qid WHEN 'q1' THEN 30 WHEN 'q2' THEN 500 ELSE 80 END) OVER (PARTITION BY unit) AS size FROM p) SELECT unit, qid, CAST(size AS BIGINT) AS size, size > 1500 AS too_long FROM s")
def size_partition(spark, sf_dir):
    a = _plan(spark, sf_dir).select("unit", "qid", (F.col("unit") % 4000).alias("chars"), F.when(F.col("qid") == "q1", 30).when(F.col("qid") == "q2", 500).otherwise(80).alias("tokens"))
    return qs.with_size(a, "unit", "chars", "tokens", 100, 1500).select("unit", "qid", F.col("size").cast("bigint").alias("size"), "too_long")


def _draw_sql(salt: str) -> str:
    return f"CAST(CAST(concat('0x', substr(sha256('{salt}' || chr(31) || qid || chr(31) || CAST(unit AS VARCHAR)), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"


@query(f"""WITH {PLAN}, d AS (SELECT unit, qid, {_draw_sql('noul')} AS a, {_draw_sql('level')} AS l, {_draw_sql('confidence')} AS c FROM p), m AS (SELECT *, floor(l * 5) AS level, (c * 4 + 1) / 5 AS top FROM d)
SELECT unit, qid, CASE WHEN qid = 'q1' THEN round(a, 3) END AS noul, CASE WHEN qid <> 'q1' THEN CAST(level AS BIGINT) END AS level, CASE WHEN qid <> 'q1' THEN round(c, 6) END AS confidence, CASE WHEN qid <> 'q1' THEN round(level * top + (10 - level) * (1 - top) / 4, 6) END AS score FROM m""")
def stand_in_answers(spark, sf_dir):
    kind = F.when(F.col("qid") == "q1", "noul").otherwise("score")
    a = qs.stand_in(_plan(spark, sf_dir), F.col("unit").cast("string"), F.col("qid"), kind, F.lit(5))
    exact = F.when(F.col("qid") == "q1", F.round(qs.draw(F.col("unit").cast("string"), F.col("qid"), "noul"), 3))
    return rounded(a.select("unit", "qid", exact.alias("noul"), F.col("level").cast("bigint").alias("level"), "confidence", "score"))


BODY = """b AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"answers": {"q1": {"type": "noul", "noul": 0.5}}, "usage": {"input_tokens": ' || event_id || ', "cost": 0.25}}' WHEN 1 THEN '{"data": {"answers": {"q1": {"noul": 1}, "q2": {"score": 2}}, "usage": {"prompt_tokens": ' || event_id || '}}, "cost": 0.5}'
 WHEN 2 THEN '{"data": {"q2": {"score": 1}}, "cost_usd": 1.5}' ELSE 'no object' END AS body FROM events)"""


def _bodies(spark, sf_dir):
    i = F.col("event_id")
    text = i.cast("string")
    body = (
        F.when(i % 4 == 0, F.concat(F.lit('{"answers": {"q1": {"type": "noul", "noul": 0.5}}, "usage": {"input_tokens": '), text, F.lit(', "cost": 0.25}}')))
        .when(i % 4 == 1, F.concat(F.lit('{"data": {"answers": {"q1": {"noul": 1}, "q2": {"score": 2}}, "usage": {"prompt_tokens": '), text, F.lit('}}, "cost": 0.5}')))
        .when(i % 4 == 2, '{"data": {"q2": {"score": 1}}, "cost_usd": 1.5}').otherwise("no object")
    )
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"))


@query(f"WITH {BODY} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'q1' WHEN 1 THEN 'q1,q2' WHEN 2 THEN 'q2' END AS answered, CASE WHEN event_id % 4 < 2 THEN event_id END AS input_tokens, CASE event_id % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 1.5 END::DOUBLE AS cost FROM b")
def responses_parsed(spark, sf_dir):
    r = qs.parse_responses(_bodies(spark, sf_dir), "body")
    return r.select("event_id", F.array_join(F.array_sort(F.map_keys("answers")), ",").alias("answered"), "input_tokens", "cost")


SAMPLES = [
    ("noul", '{"noul": 0.5}', None), ("noul", '{"noul": 1.5}', "`noul` is not a number in [0, 1]"), ("noul", '{"noul": true}', "`noul` is not a number in [0, 1]"), ("noul", '{"noul": "0.5x"}', "`noul` is not a number in [0, 1]"),
    ("noul", "[1]", "answer is not an object"), ("noul", None, "no answer in the response"), ("noul", '{"type": "score", "noul": 0.5}', "answer type does not match question type"),
    ("score", '{"score": 1, "confidence": 0.5, "probabilities": {"0": 0.25, "1": 0.5, "2": 0.25}}', None), ("score", '{"score": 3, "confidence": 0.5, "probabilities": {"0": 1}}', "`score` is not a number in range"),
    ("score", '{"score": 1, "probabilities": {"0": 1}}', "`confidence` is not a number in [0, 1]"), ("score", '{"score": 1, "confidence": 1}', "`probabilities` is missing"), ("score", '{"score": 1, "confidence": 1, "probabilities": {"3": 1}}', "`probabilities` has a level out of range"),
    ("score", '{"score": 1, "confidence": 1, "probabilities": {"1": 2}}', "a probability is not a number in [0, 1]"), ("score", '{"score": 1, "confidence": 1, "probabilities": {"1": 0.5}}', "`probabilities` do not sum to 1"),
]


def _text(x):
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query(f"WITH s(id, problem) AS (VALUES {', '.join(f'({i}, {_text(p)})' for i, (_, _, p) in enumerate(SAMPLES))}) SELECT event_id, problem FROM events JOIN s ON id = event_id % {len(SAMPLES)}")
def answers_checked(spark, sf_dir):
    s = spark.createDataFrame([(i, k, a) for i, (k, a, _) in enumerate(SAMPLES)], "id long, kind string, answer string")
    e = table(spark, sf_dir, "events").select("event_id").join(F.broadcast(s), F.col("event_id") % len(SAMPLES) == F.col("id"))
    return e.select("event_id", qs.answer_problem(F.col("answer"), F.col("kind"), F.lit(3)).alias("problem"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id % 3)::DOUBLE END AS score, 0.5::DOUBLE AS confidence, CASE WHEN event_id % 2 = 0 THEN '{"type": "score", "score": ' || event_id % 3 || ', "confidence": 0.5}' ELSE '{"type": "score", "confidence": 0.5, "legend": {"0": "other"}}' END AS raw FROM events""")
def answer_rows_stored(spark, sf_dir):
    i = F.col("event_id")
    answer = F.when(i % 2 == 0, F.concat(F.lit('{"type": "score", "score": '), (i % 3).cast("string"), F.lit(', "confidence": 0.5, "legend": {"1": "b", "0": "a"}}'))).otherwise('{"type": "score", "confidence": 0.5, "legend": {"0": "other"}}')
    e = table(spark, sf_dir, "events").select("event_id", answer.alias("answer"), F.lit('{"type": "score", "criteria": ["a", "b"]}').alias("payload"))
    return qs.answer_rows(e, "answer", "payload").select("event_id", "score", "confidence", "raw")


def _echo(body: str) -> str:
    if body.endswith("7"):
        raise qs.Refused(400, "bad request")
    return f"got {body}"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 7 THEN 400 ELSE 200 END::BIGINT AS status, CASE WHEN o_orderkey % 10 <> 7 THEN 'got ' || o_orderkey END AS response, CASE WHEN o_orderkey % 10 = 7 THEN 'bad request' END AS error FROM orders")
def requests_executed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("body"))
    return qs.execute(o, _echo, "o_orderkey", "body")


@query("SELECT count(*) FILTER (event_id % 5 <> 0) AS requests_ok, count(*) FILTER (event_id % 5 = 0) AS requests_failed, CAST(sum(event_id % 7) AS BIGINT) AS answers_stored, CAST(sum(event_id % 2) AS BIGINT) AS answers_invalid, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, round(sum(CASE WHEN event_id % 3 <> 0 THEN 0.5 ELSE 0 END), 6)::DOUBLE AS cost, count(*) FILTER (event_id % 5 <> 0 AND event_id % 3 = 0) AS requests_without_cost FROM events")
def run_report(spark, sf_dir):
    i = F.col("event_id")
    log = table(spark, sf_dir, "events").select(F.when(i % 5 != 0, 200).when(i % 10 == 0, 500).alias("status"), (i % 7).alias("n_answers"), (i % 2).alias("n_invalid"), (i % 100).alias("input_tokens"), F.when(i % 3 != 0, 0.5).alias("cost"))
    return rounded(qs.run_summary(log))


@query("SELECT unit_id, min(event_id) AS event_id FROM (SELECT user_id AS unit_id, event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND coalesce(value <= 300, true) AND year(ts) IN (2024)) GROUP BY 1 ORDER BY 1 LIMIT 50")
def units_selected(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id"), "event_id", F.col("event_type").alias("protocol_type"), (F.col("value") > 300).alias("is_chairman"), F.year("ts").alias("year"))
    return qs.select_units(e, ["click", "view"], years=[2024], limit=50).select("unit_id", "event_id")


SIZES = "z AS (SELECT CAST(floor(sqrt(o_totalprice) / 60) AS BIGINT) AS s, count(*) AS size FROM orders GROUP BY 1)"
QUOTA = """x AS (SELECT *, size * {n}.0 / sum(size) OVER () AS x, count(*) OVER () AS k FROM z), f AS (SELECT *, least(size, greatest(floor(x), 1)) AS f FROM x), o AS (SELECT *, sum(f) OVER () - {n} AS over FROM f),
u AS (SELECT *, CASE WHEN f < size AND row_number() OVER (ORDER BY CASE WHEN f < size THEN x - f END DESC NULLS LAST, s) <= -over THEN 1 ELSE 0 END AS up FROM o),
j AS (SELECT s, row_number() OVER (ORDER BY f - x - j DESC, s) AS r, over FROM (SELECT s, f, x, over, unnest(range(1, CAST(f AS BIGINT))) AS j FROM o WHERE over > 0)), d AS (SELECT s, count(*) AS down FROM j WHERE r <= over GROUP BY s),
q AS (SELECT u.s, size, CAST(f + up - coalesce(down, 0) AS BIGINT) AS quota FROM u LEFT JOIN d USING (s))"""


@query(f"WITH {SIZES}, {QUOTA.format(n=14)} SELECT * FROM q")
def quota_overshoot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.floor(F.sqrt("o_totalprice") / 60).alias("s")).agg(F.count("*").alias("size"))
    return sampling.quotas(o, "s", 14)


@query(f"WITH {SIZES}, {QUOTA.format(n=60)}, t AS (SELECT o_orderkey, CAST(floor(sqrt(o_totalprice) / 60) AS BIGINT) AS s FROM orders) SELECT o_orderkey, s FROM t JOIN q USING (s) QUALIFY row_number() OVER (PARTITION BY s ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || '|11'), o_orderkey) <= quota")
def stratified_proportional(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.sqrt("o_totalprice") / 60).alias("s"))
    return sampling.stratified(o, ["s"], "o_orderkey", 60, 11)


@query("WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, count(*) OVER (PARTITION BY year(o_orderdate)) AS n FROM orders), t AS (SELECT *, CAST(round_even(n * (1.0::DOUBLE / 3), 0) AS BIGINT) AS take FROM o) SELECT o_orderkey, year, round(n / take, 6) AS sample_weight FROM t QUALIFY row_number() OVER (PARTITION BY year ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || '|5'), o_orderkey) <= take")
def share_sample(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return rounded(sampling.share(o, ["year"], "o_orderkey", F.lit(1 / 3), 5))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || '|1'), o_orderkey) AS place FROM orders QUALIFY place <= 100")
def shuffled_head(spark, sf_dir):
    """The first hundred of a full shuffle (the limit is the query's own)."""
    head = sampling.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1).limit(100)
    placed = F.sha2(F.concat(F.col("o_orderkey").cast("string"), F.lit("|1")), 256)
    return head.select("o_orderkey", F.row_number().over(Window.orderBy(placed, "o_orderkey")).cast("bigint").alias("place"))
