"""Queries of the transcript parser: conversations are printed as transcripts and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talkscale.functions import text as tx
from talkscale.operators import transcripts
from talkscale.plans.queries import QUERIES, query, table


def printed(spark, sf_dir):
    """(protocol_name, knesset, date, text): each turn of a conversation with tags, every fifth in the chair, after it a vote's result, a note and at times a heading."""
    c = table(spark, sf_dir, "conversations")
    t = F.col("turn")
    word = F.when(t % 5 == 0, "יור").when(t % 5 == 3, "קריאה").otherwise("דובר")
    tag = F.concat(F.lit("<< "), word, F.lit(" >>"))
    who = F.when((t % 5 == 0) & (t % 10 == 5), "").otherwise(F.concat("role", F.lit(":")))
    vote = F.when(t % 4 == 1, F.concat(F.lit("הצבעה מס' "), t.cast("string"), F.lit("\n\nfor it – 9\nagainst – 2\n\n"))).otherwise("")
    heading = F.when(t % 3 == 0, F.concat(F.lit("<< נושא >> Item "), t.cast("string"), F.lit(" << נושא >>\n"))).otherwise("")
    body = tx.collapse(F.coalesce("text", F.lit("")))
    lines = F.concat(F.lit(" "), tag, F.lit(" "), who, F.lit(" "), tag, F.lit("\n"), body, F.lit("\n\n"), vote, F.lit("(applause)\n"), heading, F.lit("1. a list\nwe go on now.\n"))
    spoken = F.array_sort(F.collect_list(F.struct("turn", lines.alias("lines"))))
    text = F.concat(F.lit("contents\n"), F.array_join(F.transform(spoken, lambda x: x["lines"]), ""))
    return c.groupBy(F.col("conv_id").cast("string").alias("protocol_name")).agg(text.alias("text")).select("protocol_name", F.lit(20).alias("knesset"), F.to_date(F.lit("2015-06-01")).alias("date"), "text")


@query(r"""WITH c AS (SELECT *, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no, turn % 5 = 0 AND turn % 10 = 5 AS bare FROM conversations),
l AS (SELECT *, list_filter([body, CASE WHEN turn % 3 <> 0 THEN '1. a list' END, CASE WHEN turn % 3 <> 0 OR (turn % 5 = 0 AND NOT bare) THEN 'we go on now.' END], lambda x: x IS NOT NULL AND x <> '') AS lines FROM c)
SELECT CAST(conv_id AS VARCHAR) AS protocol_name, CAST(no AS INT) AS turn, CASE WHEN turn % 5 = 0 THEN 'chair' WHEN turn % 5 = 3 THEN 'interjection' ELSE 'speaker' END AS kind, CASE WHEN bare THEN '' ELSE role || ':' END AS line, len(lines) AS n_lines, sha256(array_to_string(lines, chr(10))) AS hash FROM l""")
def transcript_turns(spark, sf_dir):
    t = transcripts.split_turns(printed(spark, sf_dir))
    return t.select("protocol_name", "turn", "kind", "line", F.size("lines").cast("bigint").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("hash"))


def transcript_rows(spark, sf_dir):
    """Sentence rows of the same transcripts; roles are persons, the assistant one of the plenary. Tested against plain Python."""
    people = spark.createDataFrame([("1", "assistant", True, "a", "2000-01-01"), ("2", "user", False, None, "2000-01-01")], "person_id string, person_name string, is_mk boolean, party string, a string")
    one = lambda: F.array("person_name")
    people = people.select("person_id", "person_name", "is_mk", "party", F.to_date("a").alias("date_from"), F.to_date(F.lit("2099-12-31")).alias("date_to"), one().alias("variants"), one().alias("last_keys"), F.array().cast("array<string>").alias("first_keys"))
    seats = people.where("is_mk").select("person_id", "date_from", "date_to", F.lit("a").alias("faction_id"), F.lit("A").alias("faction_name"), F.lit("G").alias("faction_general_name"))
    sides = seats.select("faction_id", "date_from", "date_to", F.lit("coalition").alias("status"))
    return transcripts.sentence_rows(printed(spark, sf_dir), people, seats, sides, uuid.NAMESPACE_URL)


QUERIES |= {"transcript_rows": transcript_rows}
