"""Tables on speeches: members, heckles, their samples and shares, coverage and parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkscale.operators import sampling, summaries


def mapped(column: Column, names: dict[str, str]) -> Column:
    """A value's name, empty where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), column), F.lit(""))


def origin(place: Column, regions: dict[str, list[str]], other: str) -> Column:
    """The region that lists a place; other for the rest, empty for none."""
    out = F.when(F.coalesce(place, F.lit("")) == "", "")
    for region, places in regions.items():
        out = out.when(place.isin(places), region)
    return out.otherwise(other)


def members(spark: SparkSession, lines: str, supplement: DataFrame | None, names: dict[str, dict[str, str]], regions: dict[str, list[str]], other: str) -> DataFrame:
    """Members from JSON lines, with the values of each mapped column named, and the rows of a supplement of the same columns."""
    raw = spark.read.schema("person_id string, " + ", ".join(f"{c} string" for c in names) + ", place_of_birth string").json(lines)
    out = raw.select(F.col("person_id").alias("speaker_id"), *[mapped(F.col(c), m).alias(c) for c, m in names.items()], origin(F.col("place_of_birth"), regions, other).alias("origin"))
    return out if supplement is None else out.unionByName(supplement.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in out.columns]))


def presiding_keys(units: DataFrame) -> DataFrame:
    """(protocol_name, speaker_id) of those who presided in a sitting."""
    return units.where(F.coalesce(F.col("is_chairman"), F.lit(False))).select("protocol_name", "speaker_id").distinct()


def heckler_kind(is_chair: Column, named: Column) -> Column:
    return F.when(F.coalesce(is_chair, F.lit(False)), "chair").when(F.coalesce(named, F.lit(False)), "member").otherwise("anonymous")


def interjections(turns: DataFrame, spoken: DataFrame, gender: DataFrame) -> DataFrame:
    """Heckles as units: turns (protocol_name, turn, speaker_id, named, text, context) of others inside speeches (speech_id, protocol_name, speaker_id, first_turn, last_turn, knesset, year, n_words). gender: speaker_id, gender, one row a member."""
    a = turns.select("protocol_name", "turn", F.col("speaker_id").alias("heckler_id"), F.col("named").alias("heckler_named"), F.col("text").alias("heckle"), "context")
    s = spoken.select("protocol_name", "speech_id", F.col("speaker_id").alias("target_id"), "first_turn", "last_turn", "knesset", "year", F.col("n_words").alias("speech_words"))
    inside = (F.col("turn") > F.col("first_turn")) & (F.col("turn") < F.col("last_turn")) & ~F.col("heckler_id").eqNullSafe(F.col("target_id"))
    d = a.join(s, "protocol_name").where(inside).drop("first_turn", "last_turn")
    of = lambda who: gender.select(F.col("speaker_id").alias(f"{who}_id"), F.col("gender").alias(f"{who}_gender"))
    d = d.join(of("target"), "target_id", "left").join(of("heckler"), "heckler_id", "left").withColumn("target_gender", F.coalesce("target_gender", F.lit("")))
    d = d.withColumn("heckler_gender", F.when(F.col("heckler_named"), F.coalesce("heckler_gender", F.lit(""))).otherwise(""))
    d = d.withColumn("n_words", F.size(F.filter(F.split("heckle", r"(?U)\s+"), lambda x: x != ""))).where("n_words >= 1")
    text = F.concat(F.lit("Speech being interrupted (last words): "), "context", F.lit("\n\nInterjection: "), "heckle")
    unit = F.concat_ws("|", F.lit("heckle"), F.col("protocol_name").cast("string"), F.col("turn").cast("string"))
    return d.withColumns({"unit_id": unit, "text": text, "speaker_id": F.col("heckler_id"), "faction_id": F.lit(""), "protocol_type": F.lit("plenary"), "is_chairman": F.lit(False), "date": F.make_date("year", F.lit(7), F.lit(1)), "n_chars": F.length(text)})


def real_heckles(d: DataFrame, chair: DataFrame) -> DataFrame:
    """Heckles at a man or woman by a named member who didn't preside in that sitting."""
    own = d.where(F.coalesce(F.col("heckler_named"), F.lit(False)) & F.col("target_gender").isin("Men", "Women"))
    return own.join(chair.select("protocol_name", F.col("speaker_id").alias("heckler_id")), ["protocol_name", "heckler_id"], "left_anti")


def heckle_sample(d: DataFrame, row: str, seed: int) -> DataFrame:
    """All heckles at women, and of those at men a third by year, with weights 1 and 3."""
    women = d.where("target_gender = 'Women'").withColumn("sample_weight", F.lit(1.0))
    men = sampling.share(d.where("target_gender = 'Men'"), ["year"], row, F.lit(1 / 3), seed).withColumn("sample_weight", F.lit(3.0))
    return women.unionByName(men)


def two_draws(early: DataFrame, late: DataFrame) -> DataFrame:
    """Both draws, each row with the one it came from."""
    return early.withColumn("draw", F.lit("early")).unionByName(late.withColumn("draw", F.lit("late")))


def facets(d: DataFrame, items: list[str], weight: str, sets: dict[str, tuple[list[str], Column]]) -> DataFrame:
    """Weighted shares of items at 0.5 or more for several sets of keys (facet: columns and row filter) in one pass: facet, the keys (null where a set lacks one), items, n_scored, n_weighted."""
    columns = list(dict.fromkeys(c for keys, _ in sets.values() for c in keys))
    places = [F.when(keep, F.struct(F.lit(name).alias("facet"), *[(F.col(c) if c in keys else F.lit(None)).cast("string").alias(c) for c in columns])) for name, (keys, keep) in sets.items()]
    each = d.select("*", F.explode(F.filter(F.array(*places), lambda x: x.isNotNull())).alias("_f"))
    shares = [F.try_divide(F.sum((F.col(i) >= 0.5).cast("int") * F.col(weight)), F.sum(weight)).alias(i) for i in items]
    return each.groupBy("_f").agg(*shares, F.count("*").alias("n_scored"), F.sum(weight).alias("n_weighted")).select("_f.*", *items, "n_scored", "n_weighted")


def standardised_share(d: DataFrame, group: str, stratum: str, flag: Column, weight: str) -> DataFrame:
    """Each group's flagged share with the strata weighted alike, over the strata that all groups have."""
    cell = d.groupBy(group, stratum).agg((F.sum(flag.cast("int") * F.col(weight)) / F.sum(weight)).alias("m"), F.count("*").alias("n"), F.sum(flag.cast("int")).alias("f"))
    whole = d.groupBy(stratum).agg(F.sum(weight).alias("w"), F.countDistinct(group).alias("k"))
    most = d.agg(F.countDistinct(group).alias("most"))
    return cell.join(whole, stratum).join(F.broadcast(most)).groupBy(group).agg(  # most is one row
        F.sum("n").alias("n_scored"), F.sum("f").alias("n_flagged"), F.try_divide(F.sum(F.when(F.col("k") == F.col("most"), F.col("m") * F.col("w"))), F.sum(F.when(F.col("k") == F.col("most"), F.col("w")))).alias("flagged")
    )


def held_up(hand: DataFrame, group: str, label: str, kinds: dict[str, list[str]]) -> DataFrame:
    """Shares of hand labels of each kind."""
    return hand.groupBy(group).agg(*[F.avg(F.col(label).isin(v).cast("double")).alias(k) for k, v in kinds.items()])


def coverage(d: DataFrame, keys: list[str]) -> DataFrame:
    return d.groupBy(*keys).agg(F.count("*").alias("n_speeches"), F.sum("n_sentences").alias("n_sentences"))


def flags_by_party(d: DataFrame, party: str, bloc: str, flags: list[str], camp: list[str], least: int = 40) -> DataFrame:
    """Weighted shares of flags for parties with enough speeches, their commonest bloc, in_camp, and ord: those outside of the camp by attack, then the camp by defence (flags: attack first, defence second)."""
    w = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    out = d.groupBy(party).agg(*[summaries.weighted_mean((F.col(f) >= 0.5).cast("double"), w).alias(f"share_{f}") for f in flags], F.count("*").alias("n_speeches"), F.mode(bloc, True).alias(bloc))
    out = out.where((F.col(party) != "") & (F.col("n_speeches") >= least)).withColumn("in_camp", F.col(party).isin(camp))
    first, second = (F.col(f"share_{f}") for f in flags[:2])
    return out.withColumn("ord", F.struct("in_camp", F.when(F.col("in_camp"), second).otherwise(-first).alias("by"), F.col(party).alias("name")))


def rates_per_1000(d: DataFrame, keys: list[str], words: str, counts: list[str]) -> DataFrame:
    """Counts per 1,000 words of each key, and the share of rows with any of the first count."""
    return d.groupBy(*keys).agg(F.count("*").alias("speeches"), F.sum(words).alias("words"), *[F.try_divide(1000 * F.sum(c), F.sum(words)).alias(f"{c}_per_kw") for c in counts], F.avg((F.col(counts[0]) > 0).cast("double")).alias("share_interrupted"))


def own_speech_out(d: DataFrame, named: DataFrame) -> DataFrame:
    """Rows whose speaker_id isn't among named."""
    return d.join(named.select("speaker_id"), "speaker_id", "left_anti")


def party_of_period(d: DataFrame, parties: DataFrame) -> DataFrame:
    """Add actor_name and bloc by faction and period; null keys match."""
    p = parties.dropDuplicates(["actor_id", "period"]).select("actor_id", F.col("period").alias("_p"), "actor_name", "bloc")
    return d.join(p, F.col("faction_id").eqNullSafe(F.col("actor_id")) & F.col("period").eqNullSafe(F.col("_p")), "left").drop("actor_id", "_p")
