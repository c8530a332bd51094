"""Spells from raw lists of positions: offices, memberships and coalitions of people and groups over time, and ids that change on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ends of spells whose start or end is not given.
EVER, FOREVER = "1900-01-01", "2099-12-31"


def spells(positions: DataFrame, keys: list[str], start: str, end: str, kinds: list[str]) -> DataFrame:
    """(keys, kinds, date_from, date_to): positions of the same keys and kinds that overlap or follow on the next day are one spell.

    Positions of different kinds are kept apart, however they overlap. A null start is EVER, a null end FOREVER. Positions that
    end before they start are left out. A sweep over the starts of one key, with the latest end so far, by a window.
    """
    by = [*keys, *kinds]
    rows = positions.select(*by, F.coalesce(F.to_date(start), F.lit(EVER).cast("date")).alias("date_from"), F.coalesce(F.to_date(end), F.lit(FOREVER).cast("date")).alias("date_to")).where("date_from <= date_to")
    # a spell that is there very often, as in repeated lists, is one row for the sweep
    rows = rows.groupBy(*by, "date_from").agg(F.max("date_to").alias("date_to"))
    order = Window.partitionBy(*by).orderBy("date_from")
    before = F.max("date_to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col("date_from") > F.date_add(before, 1))).cast("int")
    return rows.withColumn("_n", F.sum(new).over(order)).groupBy(*by, "_n").agg(F.min("date_from").alias("date_from"), F.max("date_to").alias("date_to")).drop("_n")


def spells_of_events(events: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """(keys, value, date_from, date_to): events that set a value, each until the day before the next event with another one; the last stays open. Of events of one day the greatest value counts, a null value ends a spell and begins none."""
    day = events.groupBy(*keys, date).agg(F.max(value).alias(value))
    order = Window.partitionBy(*keys).orderBy(date)
    changed = day.withColumn("_last", F.lag(value).over(order)).withColumn("_first", F.row_number().over(order) == 1).where(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_last")))
    ends = F.coalesce(F.date_sub(F.lead(date).over(order), 1), F.lit(FOREVER).cast("date"))
    return changed.withColumn("date_to", ends).where(F.col(value).isNotNull()).select(*keys, value, F.col(date).alias("date_from"), "date_to")


def held_on(df: DataFrame, table: DataFrame, keys: list[str], date: str, column: str, default: Column | None = None) -> DataFrame:
    """df with column: that of the key's spell on the date (the one that began last, then the greatest), or default. Rows of df are known by all their columns; equal rows stay as many as they were."""
    rows = df.groupBy(*df.columns).agg(F.count("*").alias("_times"))
    s = table.select(*[F.col(k).alias(f"_{k}") for k in keys], "date_from", "date_to", F.col(column).alias("_value"))
    on = F.col(date).between(F.col("date_from"), F.col("date_to"))
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    best = rows.join(s, on, "left").groupBy(*df.columns, "_times").agg(F.max(F.struct("date_from", "_value")).alias("_best"))
    value = F.coalesce(F.col("_best._value"), default) if default is not None else F.col("_best._value")
    return best.select(*df.columns, value.alias(column), F.explode(F.sequence(F.lit(1).cast("bigint"), "_times")).alias("_i")).drop("_i")


def versioned(df: DataFrame, key: str, date: str, names: DataFrame, changes: DataFrame) -> DataFrame:
    """df with name: the key's name on the date.

    names: key and name. changes: key, since and name, for keys whose name is another one from a day on; of several the last
    that has begun counts. Null keys and unknown ones have no name.
    """
    since = F.lit(EVER).cast("date")
    all_ = names.select(F.col(key).alias("_k"), since.alias("since"), "name").unionByName(changes.select(F.col(key).alias("_k"), F.to_date("since").alias("since"), "name"))
    kinds = F.struct("since", "name")
    lists = all_.groupBy("_k").agg(F.array_sort(F.collect_list(kinds)).alias("_names"))  # the versions of one key
    begun = F.filter("_names", lambda v: v["since"] <= F.col(date))
    return df.join(lists, F.col(key) == F.col("_k"), "left").withColumn("name", F.when(F.size(begun) > 0, F.element_at(begun, -1)["name"])).drop("_k", "_names")


def people(persons: DataFrame, positions: DataFrame, member_kinds: list[int], serving_kinds: list[int], faction_kind: int, first_term: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(people, offices, memberships) of raw lists.

    persons: person_id, first, last, and full_name and is_member where another list knows them. positions: person_id, kind,
    faction_id, term, start, end. people: person_id, person_name, is_mk (a member by a position or by the other list). offices:
    spells of members and others who serve; memberships: spells in factions, from first_term on.
    """
    member = positions.where(F.col("kind").isin(member_kinds)).select("person_id").distinct().withColumn("_member", F.lit(True))
    full = F.trim(F.concat_ws(" ", F.trim("first"), F.trim("last")))
    named = persons.join(member, "person_id", "left").select(
        "person_id", F.coalesce(F.nullif(F.trim("full_name"), F.lit("")), full).alias("person_name"), (F.coalesce("_member", F.lit(False)) | F.coalesce("is_member", F.lit(False))).alias("is_mk")
    )
    offices = spells(positions.where(F.col("kind").isin([*member_kinds, *serving_kinds])), ["person_id"], "start", "end", [])
    own = positions.where((F.col("kind") == faction_kind) & F.col("faction_id").isNotNull() & (F.col("term") >= first_term))
    return named, offices, spells(own, ["person_id"], "start", "end", ["faction_id"])
