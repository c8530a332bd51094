"""Where regular expressions match, by DataFrame functions alone: the text between the matches gives their places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkscale.llm.common import array_starts


def find_spans(df: DataFrame, text: str, patterns: dict[str, tuple[Column, str]], out: str = "_spans_") -> DataFrame:
    """Add for each kind an array of (kind, start, end, value), in code points and end exclusive: the leftmost matches that don't overlap. patterns: kind to a condition that any text with a match meets, and the pattern."""
    t = F.col(text)
    df = df.withColumns({f"_m_{k}": F.when(gate, F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, (gate, p) in patterns.items()})
    # a text without a match needs no second pass
    df = df.withColumns({f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.transform(F.split(t, p, -1), lambda x: F.length(x).cast("bigint"))).otherwise(F.array().cast("array<bigint>")) for k, (_, p) in patterns.items()})
    # text before a match, and match, by turns: the starts of the latter
    df = df.withColumns({f"_l_{k}": F.zip_with(f"_m_{k}", F.slice(f"_p_{k}", F.lit(1), F.size(f"_m_{k}")), lambda m, p: F.length(m).cast("bigint") + p) for k in patterns})
    df = df.withColumns({f"_s_{k}": array_starts(F.col(f"_l_{k}")) for k in patterns})
    df = df.withColumns({f"{out}{k}": _placed(k) for k in patterns})
    return df.drop(*[f"_{x}_{k}" for x in "mpls" for k in patterns])


def _placed(kind: str) -> Column:
    zipped = F.arrays_zip(F.col(f"_m_{kind}").alias("m"), F.col(f"_s_{kind}").alias("s"), F.slice(f"_p_{kind}", F.lit(1), F.size(f"_m_{kind}")).alias("p"))
    return F.transform(zipped, lambda z: F.struct(F.lit(kind).alias("kind"), (z["s"] + z["p"]).alias("start"), (z["s"] + z["p"] + F.length(z["m"])).alias("end"), z["m"].alias("value")))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
