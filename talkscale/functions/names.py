"""Keys of personal names. Normal form and fixed ids aren't in SQL, so they are Arrow-batched functions, meant for distinct names."""

from __future__ import annotations

import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE_FOR, DROPPED = "־–—-", "\"'`׳״’‘“”()[].,:;"


def nfc(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")

    return run(text)


def name_key(text: Column) -> Column:
    """A name without vowel points, punctuation or dashes."""
    bare = F.regexp_replace(nfc(text), r"[֑-ֽֿ-ׇ]", "")
    return F.trim(F.regexp_replace(F.translate(F.translate(bare, SPACE_FOR, " " * len(SPACE_FOR)), DROPPED, ""), r"(?U)\s+", " "))


def stable_id(name: Column, namespace: uuid.UUID) -> Column:
    """A version 5 UUID of a name's key."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: str(uuid.uuid5(namespace, x)), na_action="ignore")

    return run(F.coalesce(F.nullif(name_key(name), F.lit("")), name))


def bracketed(part: Column) -> Column:
    """A name part and, if it has brackets, what stands in them, as two spellings."""
    return F.filter(F.array(F.regexp_replace(part, r"\([^)]*\)", ""), F.nullif(F.regexp_extract(part, r"\(([^)]*)\)", 1), F.lit(""))), lambda x: x.isNotNull())


def with_variants(people: DataFrame, first: str, last: str, aliases: str | None = None) -> DataFrame:
    """Add variants (full names), last_keys and first_keys: every spelling of the first name, and each of its words, with every spelling of the last. Names in the array aliases are variants too."""
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    df = people.withColumn("_id", F.monotonically_increasing_id())
    each = df.select("_id", F.explode(bracketed(F.coalesce(F.col(first), F.lit("")))).alias("f"), bracketed(F.coalesce(F.col(last), F.lit(""))).alias("ls")).select("_id", "f", F.explode("ls").alias("l"))
    keyed = each.select("_id", name_key(F.col("f")).alias("f"), name_key(F.col("l")).alias("l"))
    full = F.transform(F.array_union(F.array("f"), words(F.col("f"))), lambda x: F.trim(F.concat(x, F.lit(" "), F.col("l"))))
    keys = keyed.groupBy("_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("l") != "", full))))).alias("variants"), F.array_sort(F.collect_set(F.nullif("l", F.lit("")))).alias("last_keys"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(words(F.col("f")))))).alias("first_keys")
    )
    if aliases:
        more = df.select("_id", F.explode(aliases).alias("x")).select("_id", name_key(F.col("x")).alias("x")).where("x <> ''").groupBy("_id").agg(F.collect_set("x").alias("_more"))
        both = F.array_sort(F.array_union("variants", F.coalesce("_more", F.array().cast("array<string>"))))
        keys = keys.join(more, "_id", "left").withColumn("variants", both).drop("_more")
    return df.join(keys, "_id").drop("_id")


def ratio(a: str, b: str) -> float:
    """Likeness of two names by their longest common blocks."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def speaker_key(line: Column) -> tuple[Column, Column]:
    """Of a printed speaker line the name's key without brackets and colon, and the bracketed parts."""
    clean = F.regexp_replace(F.trim(line), r"[:\s]+$", "")
    return name_key(F.regexp_replace(F.regexp_replace(clean, r"\([^)]*\)?", " "), r"\s+[–-]\s*$", "")), F.regexp_extract_all(clean, F.lit(r"\(([^)]*)\)"), F.lit(1))


LIKE_FIRST, LEAD, LIKE_FULL = 0.75, 0.15, 0.84  # fixed values: likenesses that a match needs


def grams(text: Column) -> Column:
    """The pairs of letters of a text, each with the number of times that it was there before, so that none is there twice."""
    pairs = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda x, i: F.concat(x, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda y: y == x)).cast("string")))


def near_candidates(asked: DataFrame, known: DataFrame, like: float = LIKE_FULL) -> DataFrame:
    """(a, b): the pairs of texts (column text of each) that may be like enough by ratio().

    Of lengths with the sum s the likeness needs m = ceil(like * s / 2) letters in common blocks. Between two blocks stands a
    letter outside of them, so there are at most s - 2m + 1 blocks, which hold m less that number of letter pairs: 3m - s - 1,
    at least one for any like over 0.8 but for single letters. So lengths bound each other, and of each text only the pairs
    of letters (rare ones first) that leave fewer than needed behind are looked up; then shared pairs are counted.
    """
    if not 0.8 < like <= 1:
        raise ValueError("a likeness over 0.8 is needed")
    short = like / (2 - like)  # of the longer length
    lists = [df.where("text IS NOT NULL").select("text").distinct().withColumn("grams", grams(F.col("text"))) for df in (asked, known)]
    common = lists[1].select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def first_grams(df: DataFrame, side: str) -> DataFrame:
        n = F.length("text")
        least = F.greatest(F.lit(1), F.ceil((1.5 * like - 1) * (n + F.ceil(short * n - 1e-9)) - 1 - 1e-9)).cast("int")
        ranked = df.select("text", F.explode("grams").alias("gram")).join(common, "gram", "left").groupBy("text").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")))["gram"].alias("grams"))
        kept = F.explode(F.slice("grams", F.lit(1), F.greatest(n - 1 - least + 1, F.lit(0))))
        return ranked.select(F.col("text").alias(side), F.col("grams").alias(f"grams_{side}"), kept.alias("gram"))

    one, two = first_grams(lists[0], "a"), first_grams(lists[1], "b")
    s, low, high = F.length("a") + F.length("b"), F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    m = F.ceil(like / 2 * s - 1e-9)
    near = one.join(two, "gram").where((low >= short * high - 1e-9) & (F.size(F.array_intersect("grams_a", "grams_b")) >= 3 * m - s - 1)).select("a", "b")
    same = lists[0].select(F.col("text").alias("a")).join(lists[1].select(F.col("text").alias("b")), F.col("a") == F.col("b"))
    return near.unionByName(same).distinct()


def near_names(asked: DataFrame, known: DataFrame, like: float = LIKE_FULL) -> DataFrame:
    """(a, b): the pairs of texts with a ratio() of like or more; an empty text is like none."""
    both = F.pandas_udf(lambda a, b: pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64"), "double")
    return near_candidates(asked, known, like).where(both("a", "b") >= like)


def resolve(lines: DataFrame, people: DataFrame) -> DataFrame:
    """(key, date, party, person_id, how): the person that a speaker line names, null if none or several do.

    lines: key (name_key), date, party (or null). people: person_id, is_mk, party, date_from, date_to (a row for each spell),
    variants, last_keys, first_keys. Only distinct lines are matched. First the longest tail of up to six words that is a full
    name; of several persons those in office that day, then of the party, then members, are preferred, and one must be
    left. Then a last name with a first name like enough. Then any name like enough, if all such are one person's.
    """
    asked = lines.select("key", "date", "party").distinct()
    words = F.filter(F.split("key", " "), lambda w: w != "")
    tails = asked.withColumn("w", words).select("key", "date", "party", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(6), F.size("w"))))).alias("k")).where(F.size("w") >= F.col("k"))
    tails = tails.withColumn("tail", F.array_join(F.slice("w", F.greatest(F.size("w") - F.col("k") + 1, F.lit(1)), F.col("k")), " "))
    held = ["key", "date", "party"]
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in held]
    in_office = F.coalesce(F.col("p.date_from") <= F.col("t.date"), F.lit(False)) & F.coalesce(F.col("t.date") <= F.col("p.date_to"), F.lit(False))

    def found(column: str, most: int) -> DataFrame:
        names = people.select("person_id", "is_mk", F.col("party").alias("own_party"), "date_from", "date_to", "first_keys", F.explode(column).alias("name")).alias("p")
        hit = tails.where(F.col("k") <= most).alias("t").join(names, F.col("t.tail") == F.col("p.name"))
        return hit.groupBy(*[F.col(f"t.{c}") for c in held], "k", "w", "person_id").agg(
            F.max(in_office).alias("active"), F.max(F.coalesce(in_office & (F.col("own_party") == F.col("t.party")), F.lit(False))).alias("own"), F.max("is_mk").alias("mk"), F.first("first_keys").alias("first_keys")
        )

    def narrowed(df: DataFrame, flags: list[str]) -> DataFrame:
        """Candidates that have each flag, where any of their group has it and more than one is left."""
        for flag in flags:
            w = Window.partitionBy(*held, "k")
            df = df.withColumn("_n", F.count("*").over(w)).withColumn("_any", F.max(flag).over(w)).where((F.col("_n") == 1) | ~F.col("_any") | F.col(flag)).drop("_n", "_any")
        return df.withColumn("left", F.count("*").over(Window.partitionBy(*held, "k")))

    exact = narrowed(found("variants", 6), ["active", "own", "mk"]).where("left = 1")
    exact = exact.groupBy(*held).agg(F.max_by("person_id", "k").alias("person_id")).withColumn("how", F.lit("name"))
    alike = F.pandas_udf(lambda a, b: pd.Series([max((ratio(x, y) for y in ys), default=0.0) for x, ys in zip(a, b, strict=True)]), "double")
    rest = lambda df, done: df.alias("l").join(done.alias("r"), same("l", "r"), "left_anti")
    last = rest(found("last_keys", 3).where("active"), exact)
    last = last.withColumn("before", F.coalesce(F.get("w", F.size("w") - F.col("k") - 1), F.lit(""))).withColumn("like", alike("before", "first_keys"))
    w = Window.partitionBy(*held, "k")
    last = narrowed(last, ["own"]).withColumn("rank", F.row_number().over(w.orderBy(F.col("like").desc(), "person_id"))).withColumn("second", F.max(F.when(F.col("rank") == 2, F.col("like"))).over(w))
    last = last.where((F.col("rank") == 1) & (F.col("second").isNull() | ((F.col("like") >= LIKE_FIRST) & (F.col("like") - F.col("second") >= LEAD))))
    last = last.groupBy(*held).agg(F.max_by("person_id", "k").alias("person_id")).withColumn("how", F.lit("last name"))
    # any name of those in office
    names = people.select("person_id", "date_from", "date_to", F.explode("variants").alias("name")).withColumn("plain", F.replace("name", F.lit(" "), F.lit(""))).withColumn("size", F.size(F.split("name", " ")))
    open_ = rest(rest(tails, exact), last).withColumn("joined", F.replace("tail", F.lit(" "), F.lit("")))
    pairs = near_names(open_.select(F.col("joined").alias("text")), names.select(F.col("plain").alias("text")))
    near = open_.alias("t").join(pairs, F.col("t.joined") == F.col("a")).join(names.alias("p"), (F.col("b") == F.col("p.plain")) & (F.abs(F.col("t.k") - F.col("p.size")) <= 1) & in_office)
    near = near.groupBy(*[F.col(f"t.{c}") for c in held]).agg(F.countDistinct("person_id").alias("n"), F.min("person_id").alias("person_id")).where("n = 1").drop("n").withColumn("how", F.lit("like"))
    done = exact.unionByName(last).unionByName(near)
    return asked.alias("l").join(done.alias("r"), same("l", "r"), "left").select("l.*", "person_id", "how")
