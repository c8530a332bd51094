"""Secrets, told apart by corpus-wide ownership: regular expressions find candidates in every text; their hashes are counted over distinct repositories and owners; a value that several owners hold is a copied example, one that a single owner holds looks live.

Kinds: assign, access, hex, and two that the method adds: key (a private key's header) and prefixed (tokens with a public
vendor prefix). Null and empty texts have no spans. A document without a repository or owner counts for no owner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkscale.llm.common import join_by_hot_key, materialise
from talkscale.llm.spans import digest, find_spans

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "key", "prefixed"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Owners from which on a value counts as a copied example. Two may share one live credential (a fork, a mirror, a company's
#: two accounts); for a third the likeliest cause is a text that all copied.
EXAMPLE_OWNERS = 3


def patterns(text: str) -> dict[str, tuple[Column, str]]:
    t = F.col(text)
    return {
        "assign": (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")), ASSIGN),
        "access": (F.contains(t, F.lit("AKIA")), "AKIA[A-Z0-9]+"),
        "hex": (F.lit(True), r"(?<![0-9a-f])[0-9a-f]{24,}+"),
        "key": (F.contains(t, F.lit("-----BEGIN ")), r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
        "prefixed": (F.contains(t, F.lit("_")) | F.contains(t, F.lit("-")), r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})"),
    }


def _secret(kind: str, value: Column) -> Column:
    return F.regexp_extract(value, ASSIGN, 1) if kind == "assign" else value


def find_candidates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, repo, owner, found: array of (kind, start, end, value) by start, then kind as listed; value is the credential itself."""
    df = docs.select("doc_id", F.col("repo").alias("repo"), F.col("owner").alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    df = find_spans(df, "text", patterns("text"))
    valid = {"assign": lambda v: F.length(v) >= 6, "access": lambda v: F.length(v) >= 20}

    def kept(i: int, kind: str) -> Column:
        own = F.transform(f"_spans_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), _secret(kind, s["value"]).alias("value")))
        return F.filter(own, lambda s: valid[kind](s["value"])) if kind in valid else own

    df = df.withColumns({f"_f_{k}": kept(i, k) for i, k in enumerate(KINDS)})
    return df.select("doc_id", "repo", "owner", F.array_sort(F.concat(*[F.col(f"_f_{k}") for k in KINDS])).alias("found"))


def scan_secrets(docs: DataFrame, repo: str = "source", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: doc_id and found: array of (start, rank, end, kind, hash, repos, owners, live). Only hashes (SHA-256) of credentials are written or returned; the span gives the place of the text itself. Repeated rows are rows of their own and one owner's; other columns of docs, whatever their names, aren't read."""
    named = docs.select("doc_id", F.col(repo).alias("repo"), F.col(owner).alias("owner"), "text")
    hashed = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"], 256).alias("hash")))
    rows = materialise(find_candidates(named).withColumn("found", hashed).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = rows.select("row", "repo", "owner", F.explode("found").alias("f")).select("row", "repo", "owner", "f", "f.hash")
    each = materialise(each, "hashes")
    spread = each.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    held = spread.groupBy("hash").agg(F.sum("n").alias("uses"), F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))
    held = materialise(held, "held")
    judged = join_by_hot_key(each, held, "hash", "uses", F.col("row"), each.count())
    found = judged.select("row", F.struct("f.start", "f.rank", "f.end", "f.kind", "f.hash", "repos", "owners", (F.col("owners") < example_owners).alias("live")).alias("f"))
    per_row = found.groupBy("row").agg(F.array_sort(F.collect_list("f")).alias("judged"))
    return rows.join(per_row, "row", "left").select("doc_id", F.coalesce("judged", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,hash:string,repos:bigint,owners:bigint,live:boolean>>")).alias("found"))


def secrets_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_example, one row per document."""
    count = lambda f: F.size(F.filter("found", f)).cast("bigint")
    of_kind = lambda k: count(lambda s: s["kind"] == k)
    return scan_secrets(docs).select(
        "doc_id", *[of_kind(k).alias(f"n_{k}") for k in BASE], F.sha2(digest(F.filter("found", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_example"),
    )
