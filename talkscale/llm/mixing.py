"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a hash of their id. Each gets the virtual time at which its middle is served: the
source's words before it and half its own, divided by the source's target. A second pass over a source goes on counting where
the first ends. All items are range-sorted by that time and the queue is cut at the item whose middle passes the budget of
words, which is near time 1 for every source. A source then ends within half its largest document of its target: items that
begin before that band are taken, items that end after it are not, and between the two the queue decides.
The cut is kept as the last hash taken of each source and pass, so documents with their texts are never shuffled.

Null text has size 0, null source is a source of its own and comes last. Rows with the same doc_id and source are taken together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkscale.llm import kernels
from talkscale.llm.common import add_columns, join_by_hot_key, materialise, running_sums

#: Up to so many sources are broadcast (some 10 MB); beyond it they are joined by key.
BROADCAST_SOURCES = 65_536


def _turn(seed: int):
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))


def _key():
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, passes: int) -> DataFrame:
    """(source, source_size, n_docs, largest, target): share of all words dealt by weight; a target stops at passes times its source's size, and what is above goes to the others by weight."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.max("size").alias("largest"))
    sources = materialise(sources.withColumn("one", F.lit(1).cast("bigint")).withColumn("last", F.col("source").isNull()), "sources")
    ranked = running_sums(sources, [], ["last", "source"], "one", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    table = materialise(ranked.select("source", "source_size", "n_docs", "largest", weight.alias("weight"), (F.col("source_size") * float(passes)).alias("most")), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:  # each turn caps at least one more source, or ends
        full = F.col("weight") * level > F.col("most") if before is not None else F.lit(False)
        capped, open_ = table.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        before, level = level, (share * total - (capped or 0.0)) / open_ if open_ else float("inf")
    return table.select("source", "source_size", "n_docs", "largest", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def _plan(sized: DataFrame, weights: tuple[float, ...], share: float, passes: int, seed: int) -> tuple[DataFrame, int]:
    """For each source: target, source_size and cut_0.. (the last turn taken in each pass); the number of sources."""
    targets = materialise(source_targets(sized, weights, share, passes), "targets")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    queue = materialise(running_sums(materialise(sized.where("size > 0").select("source", "size", _turn(seed).alias("turn"), "doc_id"), "queue"), ["source"], ["turn", "doc_id", "size"], "size", "before"), "order")
    known = targets.select(_key().alias("key"), "source_size", "target", "n_docs", "largest")
    n_sources = known.count()
    keyed = queue.withColumn("key", _key())
    keyed = _with_sources(keyed, known, n_sources, sized.count())
    begins = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: F.struct(p.alias("epoch"), (p * F.col("source_size") + F.col("before")).alias("begin")))
    items = keyed.select("key", "turn", "size", "target", "largest", F.explode(begins).alias("i")).select("key", "turn", "size", "target", "largest", "i.*")
    items = items.withColumn("middle", (F.col("begin") + F.col("size") / 2) / F.col("target"))
    lined = running_sums(materialise(items, "items"), [], ["middle", "key", "turn", "epoch"], "size", "spent")
    due = F.col("begin") < F.col("target") - F.col("largest") / 2
    fits = F.col("begin") + F.col("size") <= F.col("target") + F.col("largest") / 2
    cuts = lined.where(due | fits & (F.col("spent") + F.col("size") / 2 <= budget)).groupBy("key").agg(*[F.max(F.when(F.col("epoch") == p, F.col("turn"))).alias(f"cut_{p}") for p in range(passes)])
    return materialise(known.join(cuts, "key", "left"), "plan"), n_sources


def _with_sources(rows: DataFrame, plan: DataFrame, n_sources: int, total: int) -> DataFrame:
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), "key", "left")
    return join_by_hot_key(rows, plan, "key", "n_docs", F.col("turn"), total)


def _copies(passes: int, seed: int):
    out = F.lit(0)
    for p in range(passes):
        out = out + F.coalesce((_turn(seed) <= F.col(f"cut_{p}")).cast("int"), F.lit(0))
    return out


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, passes: int = 2, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, size (its words), source_size, target (its source's words in the mix), taken (its words in the mix, each repeat counted)."""
    sized = materialise(add_columns(docs, ["doc_id", "source"], "text", "size bigint", lambda t: [kernels.word_counts(t)]), "sizes")
    plan, n = _plan(sized, weights, share, passes, seed)
    rows = _with_sources(sized.withColumn("key", _key()).withColumn("turn", _turn(seed)), plan, n, 0 if n <= BROADCAST_SOURCES else sized.count())
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(passes, seed)).cast("bigint").alias("taken"))


def take_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, passes: int = 2, seed: int = 1) -> DataFrame:
    """The documents of the mix, with docs' own columns; one taken twice is there twice. Documents without a word have no words to take and stay out."""
    sized = materialise(add_columns(docs, ["doc_id", "source"], "text", "size bigint", lambda t: [kernels.word_counts(t)]), "sizes")
    plan, n = _plan(sized, weights, share, passes, seed)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("worded")).where("worded")
    rows = rows.select("row", "doc_id", _key().alias("key"), _turn(seed).alias("turn"))
    joined = _with_sources(rows, plan, n, 0 if n <= BROADCAST_SOURCES else sized.count())
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), _copies(passes, seed))).alias("_copy")).select("row.*")
