"""Queries of units, packs, estimates of all actors, heckles, validation points and printed values, with SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from talkscale.functions import display, names
from talkscale.functions import text as tx
from talkscale.operators import packs, sequences, units, validation
from talkscale.operators import speech as sp
from talkscale.plans import agreement, estimate
from talkscale.plans.queries import QUERIES, SESSIONS, SPEECH, WORDS, _estimate_sql, _sessions, query, rounded, speeches, table
from talkscale.settings import SETTINGS


def _sentences(spark, sf_dir):
    """Each conversation is a committee's protocol; a pair of its turns is a turn of two sentences, some of them blank or held twice."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    rows = c.select(
        F.lit(0).cast("smallint").alias("shard"), F.lit(0).alias("line"), F.col("conv_id").cast("string").alias("protocol_name"), F.lit("committee").alias("protocol_type"), F.lit(20).cast("smallint").alias("knesset"), F.to_date(F.lit("2015-03-17")).alias("date"),
        (t % 7 == 3).alias("is_ocr"), F.col("role").alias("speaker_id"), F.col("role").alias("speaker_name"), F.lit(True).alias("is_valid_speaker"), (t % 5 == 4).alias("is_chairman"), (F.col("role") != "system").alias("is_mk"),
        F.floor(t / 2).cast("int").alias("turn"), (t % 2).cast("int").alias("sent"), F.lit("f").alias("faction_id"), F.lit("F").alias("faction_name"), F.lit("G").alias("faction_general_name"), F.lit("coalition").alias("coalition"), F.when(t % 11 == 5, " \n").otherwise(F.coalesce("text", F.lit(""))).alias("text"),
    )
    again = rows.where("sent = 1").withColumn("shard", F.lit(1).cast("smallint")).withColumn("text", F.lit("held twice"))
    return rows.unionByName(again)


TURNS = r"""r AS (SELECT conv_id, turn // 2 AS turn, turn % 2 AS sent, role, turn % 7 = 3 AS ocr, turn % 5 = 4 AS chair, CASE WHEN turn % 11 = 5 THEN '' ELSE trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) END AS text FROM conversations),
g AS (SELECT conv_id, turn, min_by(role, sent) AS role, coalesce(bool_or(chair) FILTER (text <> ''), false) OR min_by(chair, sent) AS flagged, coalesce(bool_or(ocr) FILTER (text <> ''), false) AS ocr, count(*) FILTER (text <> '') AS n_sentences, coalesce(string_agg(text, ' ' ORDER BY sent) FILTER (text <> ''), '') AS text FROM r GROUP BY ALL)"""


@query(f"WITH {TURNS} SELECT CAST(conv_id AS VARCHAR) AS protocol_name, CAST(turn AS INT) AS turn, role AS speaker_id, flagged, ocr AS is_ocr, n_sentences, CAST({WORDS} AS INT) AS n_words, sha256(text) AS hash FROM g")
def turns_grouped(spark, sf_dir):
    t = units.group_turns(units.sentences_once(_sentences(spark, sf_dir)))
    return t.select("protocol_name", "turn", "speaker_id", "flagged", "is_ocr", F.size("sentences").cast("bigint").alias("n_sentences"), "n_words", F.sha2(F.array_join("sentences", " "), 256).alias("hash"))


@query(f"""WITH {TURNS}, w AS (SELECT *, {WORDS} AS words FROM g), c AS (SELECT *, sum(CASE WHEN words >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS c, CASE WHEN words >= 25 THEN 1 ELSE 0 END AS l FROM w),
n AS (SELECT *, CASE WHEN lag(c) OVER k IS NULL OR c - l > lag(c) OVER k THEN 1 ELSE 0 END AS new FROM c WINDOW k AS (PARTITION BY conv_id, role, flagged ORDER BY turn)), s AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, role, flagged ORDER BY turn) AS no FROM n),
u AS (SELECT conv_id, role, flagged, no, min(turn) AS first_turn, max(turn) AS last_turn, bool_or(ocr) AS ocr, count(*) FILTER (n_sentences > 0) AS n_turns, sum(n_sentences) AS n_sentences, string_agg(text, '\n' ORDER BY turn) FILTER (n_sentences > 0) AS text FROM s GROUP BY ALL)
SELECT conv_id || '|' || first_turn || '|0' AS unit_id, role AS speaker_id, flagged AS is_chairman, CAST(first_turn AS INT) AS first_turn, CAST(last_turn AS INT) AS last_turn, ocr AS is_ocr, CAST(n_turns AS INT) AS n_turns, CAST(n_sentences AS INT) AS n_sentences, CAST({WORDS} AS INT) AS n_words, CAST(length(text) AS INT) AS n_chars, sha256(text) AS hash FROM u WHERE role <> 'system' AND text IS NOT NULL AND {WORDS} >= 20""".replace(r"'\n'", "chr(10)"))
def speech_units(spark, sf_dir):
    """Whole speeches: the limit is above any text, so SQL needs no cutting."""
    u = units.build_units(_sentences(spark, sf_dir), replace(SETTINGS, max_chars=10_000_000, min_words=20))
    return u.select("unit_id", "speaker_id", "is_chairman", "first_turn", "last_turn", "is_ocr", "n_turns", "n_sentences", "n_words", "n_chars", F.sha2("text", 256).alias("hash"))


def cut_units(spark, sf_dir):
    """The same speeches cut to 300 characters; tested against plain Python."""
    return units.build_units(_sentences(spark, sf_dir), replace(SETTINGS, max_chars=300, min_words=5))


def member_packs(spark, sf_dir):
    """Units of 300 characters dealt to packs of 1,000; tested by what packs must hold."""
    u = cut_units(spark, sf_dir).withColumn("year", (F.col("protocol_name").cast("bigint") % 200).cast("int"))
    return packs.build_packs(u, "2024-03-20", replace(SETTINGS, pack_chars=1000))


QUERIES |= {"cut_units": cut_units, "member_packs": member_packs}

ACTORS = {"nation": "n_name", "region": "r_name", "whole": "whole"}


def _actors(spark, sf_dir):
    return speeches(spark, sf_dir).withColumn("whole", F.lit("all"))


def _actor_sql(kind: str, group: str) -> str:
    sql = _estimate_sql(group) if group != "whole" else _estimate_sql("whole").replace("whole AS g", "'all' AS g")
    value = "estimate, n_mks, round(se, 6) AS se, sufficient" if kind == "position" else "pooled AS estimate, n_mks, pooled_se AS se, n_speeches >= 5 AND n_sittings >= 5 AND pooled_se <= 0.6 AND effective_sittings >= 3 AS sufficient"
    name = next(k for k, v in ACTORS.items() if v == group)
    return f"SELECT year, '{name}' AS actor_type, {group} AS actor_id, n_speeches, n_sittings, effective_sittings, {value} FROM ({sql})"


@query(" UNION ALL ".join(_actor_sql("position", g) for g in ACTORS.values()))
def est_actor_types(spark, sf_dir):
    """Nations, regions and the whole in one pass over the speeches."""
    g = estimate.estimate(_actors(spark, sf_dir), ["year"], ["l_suppkey"], ACTORS, "sitting")[1]
    return rounded(g.select("year", "actor_type", "actor_id", "n_speeches", "n_sittings", "effective_sittings", "estimate", "n_mks", "se", "sufficient"))


@query(" UNION ALL ".join(_actor_sql("salience", g) for g in ACTORS.values()))
def est_salience(spark, sf_dir):
    g = estimate.estimate(_actors(spark, sf_dir), ["year"], ["l_suppkey"], ACTORS, "sitting", kind="salience")[1]
    return rounded(g.select("year", "actor_type", "actor_id", "n_speeches", "n_sittings", "effective_sittings", "estimate", "n_mks", "se", "sufficient"))


def est_with_bootstrap(spark, sf_dir):
    """All actors with bootstrap errors that count for sufficiency; random, so only rows can be compared."""
    g = estimate.estimate(_actors(spark, sf_dir), ["year"], ["l_suppkey"], ACTORS, "sitting", replicates=SETTINGS.replicates)[1]
    return rounded(g.select("year", "actor_type", "actor_id", "estimate", "se", "se_analytic", "sufficient"))


QUERIES["est_with_bootstrap"] = est_with_bootstrap

GENDERS = {"assistant": "Women", "user": "Men"}
GENDER_SQL = "(VALUES ('assistant','Women'), ('user','Men')) AS x(speaker_id, gender)"
HECKLES = f"""{SESSIONS}, x AS (SELECT * FROM {GENDER_SQL}), h AS (SELECT sp.conv_id, t.turn, t.role AS heckler_id, t.turn % 3 <> 0 AS heckler_named, sp.role AS target_id, speech_no, sp.conv_id % 4 AS knesset, 2000 + sp.conv_id % 7 AS year FROM sp JOIN t ON t.conv_id = sp.conv_id AND t.turn > first_turn AND t.turn < last_turn AND t.role IS DISTINCT FROM sp.role),
d AS (SELECT h.*, coalesce(a.gender, '') AS target_gender, CASE WHEN heckler_named THEN coalesce(b.gender, '') ELSE '' END AS heckler_gender, conv_id || '|' || turn || '|' || target_id || '|' || speech_no AS id FROM h LEFT JOIN x a ON a.speaker_id = target_id LEFT JOIN x b ON b.speaker_id = heckler_id)"""


def _heckles(spark, sf_dir):
    t, s = _sessions(spark, sf_dir)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    context = tx.last_words(F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn")), 40)
    turns = c.select(F.col("conv_id").alias("protocol_name"), "turn", F.col("role").alias("speaker_id"), (F.col("turn") % 3 != 0).alias("named"), "text", context.alias("context"))
    spoken = s.select(F.col("conv_id").alias("protocol_name"), F.col("speech_no").alias("speech_id"), F.col("role").alias("speaker_id"), "first_turn", "last_turn", (F.col("conv_id") % 4).alias("knesset"), (2000 + F.col("conv_id") % 7).cast("int").alias("year"), "n_words")
    gender = spark.createDataFrame(list(GENDERS.items()), "speaker_id string, gender string")
    d = sp.interjections(turns, spoken, gender)
    return d.withColumn("id", F.concat_ws("|", F.col("protocol_name").cast("string"), F.col("turn").cast("string"), "target_id", F.col("speech_id").cast("string")))


@query(f"WITH {HECKLES}, told AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations), said AS (SELECT d.*, told.text AS heckle, list_filter(regexp_split_to_array(before, '\\s+'), lambda z: z <> '') AS w, len(list_filter(regexp_split_to_array(told.text, '\\s+'), lambda z: z <> '')) AS n_words FROM d JOIN told USING (conv_id, turn)), u AS (SELECT *, 'Speech being interrupted (last words): ' || array_to_string(w[greatest(len(w) - 39, 1):], ' ') || chr(10) || chr(10) || 'Interjection: ' || heckle AS text FROM said WHERE n_words >= 1) SELECT id, 'heckle|' || conv_id || '|' || turn AS unit_id, heckler_gender, target_gender, make_date(year, 7, 1) AS date, CAST(n_words AS INT) AS n_words, CAST(length(text) AS INT) AS n_chars, sha256(text) AS hash FROM u")
def interjection_units(spark, sf_dir):
    return _heckles(spark, sf_dir).select("id", "unit_id", "heckler_gender", "target_gender", "date", "n_words", "n_chars", F.sha2("text", 256).alias("hash"))


CHAIR_SQL = "p AS (SELECT DISTINCT conv_id, role FROM conversations WHERE turn % 13 = 12)"
REAL_SQL = f"{HECKLES}, {CHAIR_SQL}, real AS (SELECT d.* FROM d LEFT JOIN p ON p.conv_id = d.conv_id AND p.role = heckler_id WHERE heckler_named AND target_gender IN ('Men', 'Women') AND p.role IS NULL)"


def _real(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("protocol_name"), F.col("role").alias("speaker_id"), (F.col("turn") % 13 == 12).alias("is_chairman"))
    return sp.real_heckles(_heckles(spark, sf_dir), sp.presiding_keys(c))


@query(f"WITH {REAL_SQL} SELECT id, heckler_id, target_gender FROM real")
def real_heckles(spark, sf_dir):
    return _real(spark, sf_dir).select("id", "heckler_id", "target_gender")


@query(f"WITH {HECKLES} SELECT CASE WHEN turn % 5 = 0 THEN 'chair' WHEN heckler_named THEN 'member' ELSE 'anonymous' END AS kind, count(*) AS n, count(*) FILTER (target_gender = 'Women') AS at_women FROM d GROUP BY 1")
def heckler_kinds(spark, sf_dir):
    d = _heckles(spark, sf_dir).withColumn("kind", sp.heckler_kind(F.col("turn") % 5 == 0, F.col("heckler_named")))
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("target_gender") == "Women", 1)).alias("at_women"))


@query(f"""WITH {REAL_SQL}, f AS (SELECT *, turn % 2 AS mocking, (turn % 5) / 4.0 AS angry, CASE WHEN target_gender = 'Men' THEN 3.0 ELSE 1.0 END AS w, CASE WHEN knesset >= 2 THEN 'late' ELSE 'early' END AS era FROM real),
e AS (SELECT 'target' AS facet, target_gender, NULL AS heckler_gender, NULL AS era, mocking, angry, w FROM f UNION ALL SELECT 'target_x_heckler', target_gender, heckler_gender, NULL, mocking, angry, w FROM f WHERE heckler_gender IN ('Men', 'Women') UNION ALL SELECT 'era', target_gender, NULL, era, mocking, angry, w FROM f)
SELECT facet, target_gender, heckler_gender, era, round(sum(w * CAST(mocking >= 0.5 AS INT)) / sum(w), 6) AS mocking, round(sum(w * CAST(angry >= 0.5 AS INT)) / sum(w), 6) AS angry, count(*) AS n_scored, sum(w)::DOUBLE AS n_weighted FROM e GROUP BY ALL""")
def heckle_facets(spark, sf_dir):
    d = _real(spark, sf_dir).select("target_gender", "heckler_gender", F.when(F.col("knesset") >= 2, "late").otherwise("early").alias("era"), (F.col("turn") % 2).alias("mocking"), ((F.col("turn") % 5) / 4).alias("angry"), F.when(F.col("target_gender") == "Men", 3.0).otherwise(1.0).alias("w"))
    sets = {"target": (["target_gender"], F.lit(True)), "target_x_heckler": (["target_gender", "heckler_gender"], F.col("heckler_gender").isin("Men", "Women")), "era": (["era", "target_gender"], F.lit(True))}
    return rounded(sp.facets(d, ["mocking", "angry"], "w", sets))


STANDARD = f"""{REAL_SQL}, flagged AS (SELECT *, CAST(turn % 2 AS DOUBLE) AS flag, CASE WHEN target_gender = 'Men' THEN 3.0 ELSE 1.0 END AS w FROM real), cell AS (SELECT target_gender, knesset, sum(w * flag) / sum(w) AS m, count(*) AS n, sum(flag) AS f FROM flagged GROUP BY ALL),
weights AS (SELECT knesset, sum(w) AS w, count(DISTINCT target_gender) AS k FROM flagged GROUP BY 1), standard AS (SELECT target_gender, CAST(sum(n) AS BIGINT) AS n_scored, CAST(sum(f) AS BIGINT) AS n_flagged, sum(m * w) FILTER (k = (SELECT count(DISTINCT target_gender) FROM flagged)) / sum(w) FILTER (k = (SELECT count(DISTINCT target_gender) FROM flagged)) AS flagged FROM cell JOIN weights USING (knesset) GROUP BY 1)"""


def _standard(spark, sf_dir):
    d = _real(spark, sf_dir).withColumn("w", F.when(F.col("target_gender") == "Men", 3.0).otherwise(1.0))
    return sp.standardised_share(d, "target_gender", "knesset", F.col("turn") % 2 == 1, "w")


@query(f"WITH {STANDARD}, hand AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'Men' ELSE 'Women' END AS target_gender, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0 END) AS strict, avg(CASE WHEN quality = 1 OR toxic = 1 THEN 1.0 ELSE 0 END) AS broad FROM labels GROUP BY 1) SELECT target_gender, n_scored, n_flagged, round(flagged, 6) AS flagged, round(strict, 6) AS held_up_strict, round(broad, 6) AS held_up_broad, round(flagged * strict, 6) AS confirmed_strict, round(flagged * broad, 6) AS confirmed_broad FROM standard JOIN hand USING (target_gender)")
def gendered_heckles(spark, sf_dir):
    """Standardised flagged shares times the shares that a hand check upheld."""
    label = F.when(F.col("quality") == 1, "explicit").when(F.col("toxic") == 1, "trope").otherwise("no")
    hand = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 2 == 0, "Men").otherwise("Women").alias("target_gender"), label.alias("hand_label"))
    held = sp.held_up(hand, "target_gender", "hand_label", {"held_up_strict": ["explicit", "insult"], "held_up_broad": ["explicit", "insult", "trope", "family"]})
    d = _standard(spark, sf_dir).join(held, "target_gender")
    return rounded(d.withColumn("confirmed_strict", F.col("flagged") * F.col("held_up_strict")).withColumn("confirmed_broad", F.col("flagged") * F.col("held_up_broad")))


@query(f"WITH {HECKLES}, m AS (SELECT id, year, row_number() OVER (PARTITION BY year ORDER BY sha256(id || '|3'), id) AS r, CAST(round_even(count(*) OVER (PARTITION BY year) * (1.0::DOUBLE / 3), 0) AS BIGINT) AS take FROM d WHERE target_gender = 'Men' AND conv_id % 2 = 0) SELECT id, 3.0::DOUBLE AS sample_weight, 'early' AS draw FROM m WHERE r <= take UNION ALL SELECT id, 1.0, CASE WHEN conv_id % 2 = 0 THEN 'early' ELSE 'late' END FROM d WHERE target_gender = 'Women' AND (conv_id % 2 = 0 OR conv_id % 3 = 0)")
def heckle_draws(spark, sf_dir):
    d = _heckles(spark, sf_dir).select("id", "year", "target_gender", "protocol_name")
    early = sp.heckle_sample(d.where("protocol_name % 2 = 0"), "id", 3)
    late = d.where("protocol_name % 2 <> 0 AND protocol_name % 3 = 0 AND target_gender = 'Women'").withColumn("sample_weight", F.lit(1.0))
    return sp.two_draws(early, late).select("id", "sample_weight", "draw")


@query("SELECT l_returnflag AS protocol_type, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n_speeches, CAST(sum(l_linenumber) AS BIGINT) AS n_sentences FROM lineitem GROUP BY ALL")
def speech_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("protocol_type"), F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("n_sentences"))
    return sp.coverage(d, ["protocol_type", "year"])


@query(f"WITH {SPEECH}, a AS (SELECT n_name AS party, sum(sqrt(greatest(words, 1)) * CASE WHEN gate >= 0.5 THEN 1 ELSE 0 END) / sum(sqrt(greatest(words, 1))) AS x, sum(sqrt(greatest(words, 1)) * CASE WHEN y >= 5 THEN 1 ELSE 0 END) / sum(sqrt(greatest(words, 1))) AS d, count(*) AS n_speeches, any_value(r_name) AS bloc, n_name IN ('NATION_1', 'NATION_2', 'NATION_3') AS in_camp FROM s GROUP BY n_name HAVING count(*) >= 40) SELECT party, round(x, 6) AS share_attack, round(d, 6) AS share_defend, n_speeches, bloc, in_camp, row_number() OVER (ORDER BY in_camp, CASE WHEN in_camp THEN d ELSE -x END, party) AS place FROM a")
def flags_by_party(spark, sf_dir):
    """Shares of flags by party: outside of the camp by attack, then the camp by defence."""
    s = speeches(spark, sf_dir).select(F.col("n_name").alias("party"), F.col("r_name").alias("bloc"), F.col("gate").alias("attack"), (F.col("score") / 10).alias("defend"), F.col("words").alias("n_words"))
    out = sp.flags_by_party(s, "party", "bloc", ["attack", "defend"], ["NATION_1", "NATION_2", "NATION_3"])
    return rounded(out.withColumn("place", F.row_number().over(Window.orderBy("ord")).cast("bigint")).drop("ord"))  # a row for each party


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Men' WHEN 1 THEN 'Women' ELSE '' END AS gender, CASE WHEN c_nationkey IN (1, 2) THEN 'North' WHEN c_nationkey IN (3, 4) THEN 'South' WHEN c_nationkey = 0 THEN '' ELSE 'Elsewhere' END AS origin FROM customer")
def members_named(spark, sf_dir):
    k, place = F.col("c_custkey") % 4, F.when(F.col("c_nationkey") != 0, F.col("c_nationkey").cast("string"))
    raw = F.when(k == 0, "m").when(k == 1, "f").when(k == 2, "?")
    return table(spark, sf_dir, "customer").select("c_custkey", sp.mapped(raw, {"m": "Men", "f": "Women"}).alias("gender"), sp.origin(place, {"North": ["1", "2"], "South": ["3", "4"]}, "Elsewhere").alias("origin"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') || 'Q' || quarter(o_orderdate) AS quarter, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.25, 6) AS fraction, round(year(o_orderdate) + (dayofyear(o_orderdate) - 1) / dayofyear(make_date(year(o_orderdate), 12, 31)) - 0.5, 6) AS mid_year, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR * (o_orderkey % 9) AS middle FROM orders")
def date_fractions(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", display.quarter(day).alias("quarter"), display.year_fraction(day).alias("fraction"), display.mid_year_axis(day).alias("mid_year"), display.midpoint(day, F.date_add(day, (F.col("o_orderkey") % 9).cast("int"))).alias("middle")))


PRINTED = " ".join(f"WHEN share < {limit} THEN '{words}'" for limit, words in display.SHARES)


@query(f"""WITH n AS (SELECT o_orderkey, o_orderkey * o_orderkey * 3 AS n, (o_orderkey % 101) / 100.0 AS share, o_orderpriority AS p, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1e6 THEN format('{{:.1f}}m', n / 1e6) WHEN n >= 1e4 THEN format('{{:,}}', CAST(round_even(n / 1000.0, 0) AS BIGINT) * 1000) WHEN n >= 1e3 THEN format('{{:,}}', CAST(round_even(n / 100.0, 0) AS BIGINT) * 100) WHEN n >= 100 THEN CAST(CAST(round_even(n / 10.0, 0) AS BIGINT) * 10 AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS count,
 (['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve'])[o_orderkey % 13 + 1] AS word, CASE {PRINTED} END AS words, (o_orderkey % 101) || '%' AS percent, lpad(CAST(o_orderkey % 120 AS VARCHAR), CAST(greatest(2, length(CAST(o_orderkey % 120 AS VARCHAR))) AS INT), '0') AS padded,
 CASE p WHEN '1-URGENT' THEN CASE WHEN y >= 1997 THEN 'Urgent' ELSE 'Pressing' END WHEN '2-HIGH' THEN 'High' ELSE p END AS name FROM n""")
def printed_values(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", display.round_count(k * k * 3).alias("count"), display.number_word(k % 13).alias("word"), display.share_words((k % 101) / 100).alias("words"), display.percent((k % 101) / 100).alias("percent"), display.padded(k % 120).alias("padded"),
        display.display_name(F.col("o_orderpriority"), F.year("o_orderdate"), {"2-HIGH": "High"}, {"1-URGENT": (1997, "Pressing", "Urgent")}).alias("name"),
    )


@query("SELECT p_name, lower(replace(p_name, ' ', ' ')) AS key, count(*) AS n FROM part GROUP BY ALL")
def names_keyed(spark, sf_dir):
    """Keys of names that differ in dashes, quotes and spaces only."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    odd = F.concat(F.lit(' "'), F.replace("p_name", F.lit(" "), F.lit("–  ")), F.lit("'."))
    return p.select("p_name", F.lower(names.name_key(odd)).alias("key"), "n")


def names_resolved(spark, sf_dir):
    """Parts' names as speaker lines, resolved to the people that the distinct names stand for; tested against plain Python."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("person_id"), F.min("p_size").alias("size"))
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    people = names.with_variants(p.select(F.col("person_id").cast("string").alias("person_id"), (F.col("size") % 2 == 0).alias("is_mk"), F.lit("x").alias("party"), F.to_date(F.lit("1990-01-01")).alias("date_from"), F.to_date(F.lit("2030-01-01")).alias("date_to"), first.alias("first"), last.alias("last")), "first", "last")
    lines = table(spark, sf_dir, "part").select(names.name_key(F.concat(F.lit("the "), "p_name", F.lit(":"))).alias("key"), F.to_date(F.lit("2000-01-01")).alias("date"), F.lit(None).cast("string").alias("party"))
    return names.resolve(lines, people)


def stable_ids(spark, sf_dir):
    """Version 5 ids of names; tested against plain Python."""
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", names.stable_id(F.col("p_name"), uuid.NAMESPACE_URL).alias("id"))


QUERIES |= {"names_resolved": names_resolved, "stable_ids": stable_ids}

# Validation: nations are parties, years are waves; orders' priorities rate them.
CROSSWALK = [("1996", "EUROPE", "p1", "c1"), ("1997", "EUROPE", "p1", "c1"), ("1996", "ASIA", "p2", "c2"), ("1997", "ASIA", "p2", "c2"), ("1997", "AFRICA", "p3", "c3")]
CROSS_SQL = "w(wave, region, party, cluster_id) AS (VALUES " + ", ".join(str(r) for r in CROSSWALK) + ")"


def _waves(spark):
    c = spark.createDataFrame(CROSSWALK, "ches_year string, region string, ches_party_id string, cluster_id string")
    return c.withColumn("party_wave", F.concat_ws(":", "ches_year", "ches_party_id"))


EXPERT_SQL = "x AS (SELECT wave, party, scale, avg(rating) AS rating FROM (SELECT CAST(year(o_orderdate) AS VARCHAR) AS wave, 'p' || (o_custkey % 3 + 1) AS party, CASE WHEN o_orderpriority < '3' THEN 'lr' ELSE 'galtan' END AS scale, (o_orderkey % 11)::DOUBLE AS rating, o_custkey % 20 AS expert FROM orders) GROUP BY wave, party, scale, expert), c AS (SELECT wave, party, scale, avg(rating) AS ches, count(*) AS n_experts FROM x GROUP BY ALL)"


def _experts(spark, sf_dir):
    """Twenty experts rate each party: one is the customers of one remainder, and rates by the mean of what their orders say."""
    o = table(spark, sf_dir, "orders")
    said = o.select(F.year("o_orderdate").cast("string").alias("ches_year"), F.concat(F.lit("p"), (F.col("o_custkey") % 3 + 1).cast("string")).alias("ches_party_id"), F.when(F.col("o_orderpriority") < "3", "lr").otherwise("galtan").alias("scale"), (F.col("o_orderkey") % 11).cast("double").alias("rating"), (F.col("o_custkey") % 20).alias("expert"))
    return said.groupBy("ches_year", "ches_party_id", "scale", "expert").agg(F.avg("rating").alias("rating")).drop("expert")


@query(f"WITH {EXPERT_SQL} SELECT wave AS ches_year, party AS ches_party_id, scale, round(ches, 6) AS ches, n_experts FROM c")
def expert_cells(spark, sf_dir):
    return rounded(validation.expert_cells(_experts(spark, sf_dir), ["ches_year", "ches_party_id", "scale"], "rating"))


def _wave_frame(spark, sf_dir):
    s = speeches(spark, sf_dir)
    return s.join(F.broadcast(_waves(spark)), (F.col("year").cast("string") == F.col("ches_year")) & (F.col("r_name") == F.col("region")))  # five windows


def _wave_speeches(spark, sf_dir):
    """Speeches of party-waves on both scales, the scale being a slice."""
    both = F.explode(F.array(F.struct(F.lit("lr").alias("scale"), F.col("score").alias("value")), F.struct(F.lit("galtan").alias("scale"), (F.col("gate") * 10).alias("value"))))
    return _wave_frame(spark, sf_dir).select("*", both.alias("v")).select("ches_year", "party_wave", F.col("l_suppkey").alias("member"), "sitting", "weight", "v.scale", F.col("v.value").alias("score"))


def _wave_estimates(spark, sf_dir):
    return estimate.estimate_groups(_wave_speeches(spark, sf_dir), ["scale", "ches_year"], ["member"], "party_wave", "sitting")


def _wave_sql(scale: str, value: str) -> str:
    sql = _estimate_sql("party_wave").replace("AS r_name", "AS r_name")
    sql = sql.replace("FROM s GROUP BY ALL), \nm AS", "FROM s GROUP BY ALL), m AS").replace(SPEECH, SPEECH + f", {CROSS_SQL}, z AS (SELECT s.* EXCLUDE (y), {value} AS y, w.wave || ':' || w.party AS party_wave FROM s JOIN w ON w.wave = CAST(s.year AS VARCHAR) AND w.region = s.r_name)")
    return f"SELECT '{scale}' AS scale, CAST(year AS VARCHAR) AS ches_year, party_wave, estimate, se, n_speeches, sufficient FROM ({sql.replace('count(*) AS n, sum(w) AS w, sum(w*y) AS wy, sum(w*y*y) AS wyy, sum(w*w) AS ww FROM s', 'count(*) AS n, sum(w) AS w, sum(w*y) AS wy, sum(w*y*y) AS wyy, sum(w*w) AS ww FROM z')})"


@query(_wave_sql("lr", "y") + " UNION ALL " + _wave_sql("galtan", "gate * 10"))
def party_wave_estimates(spark, sf_dir):
    return rounded(_wave_estimates(spark, sf_dir).select("scale", "ches_year", "party_wave", "estimate", "se", "n_speeches", "sufficient"))


@query(f"WITH e AS ({_wave_sql('lr', 'y')} UNION ALL {_wave_sql('galtan', 'gate * 10')}), {CROSS_SQL}, {EXPERT_SQL} SELECT e.scale, e.party_wave, w.cluster_id, e.estimate AS x, round(ches, 6) AS y, n_experts FROM e JOIN w ON w.wave || ':' || w.party = e.party_wave JOIN c ON c.wave = w.wave AND c.party = w.party AND c.scale = e.scale WHERE n_experts >= 3 AND e.sufficient")
def validation_points(spark, sf_dir):
    """Party-waves with enough experts and enough speech; the scale is a key, so no scale has a plan of its own."""
    p = agreement.run(_wave_speeches(spark, sf_dir), _waves(spark).withColumn("bloc", F.lit("x")), _experts(spark, sf_dir), replicates=0)[0]
    return rounded(p.select("scale", "party_wave", "cluster_id", F.col("estimate").alias("x"), F.col("ches").alias("y"), "n_experts"))


@query("SELECT c_mktsegment || ':' || c_nationkey AS party_wave, arg_min(c_name, c_custkey) AS faction, arg_min(CASE WHEN c_acctbal < 0 THEN 'other' ELSE c_mktsegment END, c_custkey) AS bloc FROM customer GROUP BY 1")
def party_wave_first(spark, sf_dir):
    """The bloc of the first faction that a crosswalk names: the customers of a nation's segment, in the order of their keys."""
    c = table(spark, sf_dir, "customer")
    w = c.select(F.col("c_custkey").alias("at"), F.concat_ws(":", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("party_wave"), F.col("c_name").alias("faction"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("bloc"))
    return validation.first_factions(w, "at", ["faction"], F.lit("other"))


@query(f"WITH {SPEECH}, {CROSS_SQL} SELECT year, count(*) AS n FROM s WHERE EXISTS (SELECT 1 FROM w WHERE w.wave = CAST(s.year AS VARCHAR) AND w.region = s.r_name AND (w.party <> 'p2' OR s.l_suppkey IN (1, 2, 3))) GROUP BY year")
def units_in_windows(spark, sf_dir):
    """Units inside any window; a window may name speakers."""
    w = _waves(spark).withColumn("speaker_ids", F.when(F.col("ches_party_id") == "p2", "1; 2;3").otherwise("")).withColumn("date_from", F.lit(None).cast("int")).withColumn("date_to", F.lit(None).cast("int"))
    s = speeches(spark, sf_dir).select("year", F.col("year").cast("string").alias("wave"), F.col("r_name").alias("region"), F.col("l_suppkey").cast("string").alias("speaker_id"))
    return validation.inside_windows(s, w.withColumnRenamed("ches_year", "wave"), ["wave", "region"], None).groupBy("year").agg(F.count("*").alias("n"))


def validation_summary(spark, sf_dir):
    """r by scale with intervals from clusters, raters and the estimator's own replicates, and the blocs' floor; random, so only rows can be compared."""
    waves = _waves(spark).withColumn("bloc", F.lit("x"))
    return rounded(agreement.run(_wave_speeches(spark, sf_dir), waves, _experts(spark, sf_dir), least_clusters=2)[1])


QUERIES["validation_summary"] = validation_summary
