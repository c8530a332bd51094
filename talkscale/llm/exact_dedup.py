"""Exact deduplication by two passes of Bloom filtering.

Pass 1 sets, in a blocked Bloom filter, the bits that at least two rows hit. Pass 2 probes it with every row: a row with
an unset bit has no equal and passes straight through; only the others are shuffled and grouped by the SHA-256 of their
normalised text, which is exact. All of it is DataFrame functions.

The filter takes bits_per_row bits a row up to max_blocks blocks of 4 KiB (32 MiB by default), so what is broadcast has a
fixed bound. Beyond about 17 million rows the bound makes it fuller: more unequal rows are shuffled, and results stay exact.

Null text counts as empty, and all empty texts are equal. Null doc_id sorts last. Of rows alike in length and doc_id one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkscale.llm.common import SPACES, discard, join_by_hot_key, materialise

BLOCK_BITS = 32768
PROBES = 3


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _place(hashed: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a hash, and its bits there."""
    other = F.xxhash64(hashed)
    return F.pmod(hashed, F.lit(blocks)).cast("int"), F.array(*[F.shiftrightunsigned(other, 15 * i).bitwiseAND(BLOCK_BITS - 1) for i in range(PROBES)])


def repeat_filter(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the bits that two or more of the hashes in column hashed hit."""
    block, bits = _place(F.col("hashed"), blocks)
    hit = hashes.select(block.alias("block"), F.explode(F.array_distinct(bits)).alias("bit")).groupBy("block", "bit").agg(F.count("*").alias("n")).where("n > 1")
    return hit.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def flag_repeats(rows: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """rows, with hashed, and maybe: false only if no other row has the same hash."""
    block, bits = _place(F.col("hashed"), blocks)
    found = rows.withColumn("_block", block).join(F.broadcast(bloom.withColumnRenamed("block", "_bloom_block")), F.col("_block") == F.col("_bloom_block"), "left")

    def is_set(i: int) -> Column:
        bit = F.element_at(bits, i + 1)
        byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.shiftright(byte, 0).bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0

    maybe = F.col("bits").isNotNull()
    for i in range(PROBES):
        maybe &= is_set(i)
    return found.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("_block", "_bloom_block", "bits")


def _blocks(n: int, bits_per_row: int, max_blocks: int) -> int:
    return max(1, min(max_blocks, -(-n * bits_per_row // BLOCK_BITS)))


def label_exact_copies(docs: DataFrame, bits_per_row: int = 16, max_blocks: int = 8192) -> DataFrame:
    """One row per document: doc_id, keep_id (the doc_id of the row that stays), group_size, kept, text_sha256. The longest original text stays, then the smallest doc_id."""
    text = normalised(F.col("text"))
    slim = materialise(
        docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), text.alias("_norm"))
        .select("doc_id", "points", F.sha2("_norm", 256).alias("text_sha256"))
        .select("*", F.xxhash64("text_sha256").alias("hashed"), F.monotonically_increasing_id().alias("row")),
        "dedup",
    )
    n = slim.count()
    blocks = _blocks(n, bits_per_row, max_blocks)
    bloom = materialise(repeat_filter(slim, blocks), "bloom")
    flagged = flag_repeats(slim, bloom, blocks)
    alone = flagged.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    rest = flagged.where("maybe").select("doc_id", "points", "text_sha256", "row")
    groups = rest.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("best"))
    joined = join_by_hot_key(rest, groups, "text_sha256", "group_size", F.col("row"), n)
    return alone.unionByName(joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256"))


def drop_exact_copies(docs: DataFrame, bits_per_row: int = 16, max_blocks: int = 8192) -> DataFrame:
    """docs without all but one of each group of equal texts, with docs' own columns. Rows that surely have no equal are never shuffled; the others meet in a group's partial winners, so a hot group is small after each task."""
    rows = docs.select(F.struct("*").alias("row"), normalised(F.col("text")).alias("_norm")).select("row", F.xxhash64(F.sha2("_norm", 256)).alias("hashed"), F.sha2("_norm", 256).alias("sha"))
    hashes = materialise(rows.select("hashed"), "hashes")
    blocks = _blocks(hashes.count(), bits_per_row, max_blocks)
    bloom = materialise(repeat_filter(hashes, blocks), "bloom")
    discard(hashes)
    flagged = flag_repeats(rows, bloom, blocks)
    best = F.struct((-F.length(F.coalesce("row.text", F.lit("")))).alias("p"), F.col("row.doc_id").isNull().alias("z"), F.col("row.doc_id").alias("d"))
    winners = flagged.where("maybe").groupBy("sha").agg(F.min_by("row", best).alias("row"))
    return flagged.where(~F.col("maybe")).select("row.*").unionByName(winners.select("row.*"))
