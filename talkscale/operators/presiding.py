"""Who presides over a plenary, from set phrases of the chair. Phrases are columns; only the walk through a protocol's few turns of evidence is Python, a protocol to a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG_WORDS, EDGE, OPENING, LEAST_RUN = 40, 150, 80, 3

# Patterns of an address to the chair and of the chair's own phrases.
ADDRESS = r"""(?:אדוני|גברתי|גבירתי|כבוד)\s+היו(?:שבת?[-־– ]ראש|"ר|״ר)"""
STRONG = [
    "רשות הדיבור ל",
    r"אחרי[וה]\s*[-–—,]?\s*(?:חבר|השר|סגן|סגנית|ראש)",
    "תודה(?: רבה)? ל(?:חבר|שר|סגן|סגנית|מזכיר|ראש|יושב)",
    "מי בעד|מי נגד|מי נמנע|נא להצביע|ההצבעה החלה|אנחנו מצביעים",
    "הצבעה מס'|אין מתנגדים|אין נמנעים",
    "אני קובעת? (?:ש|כי)",
    "קוראת? אותך לסדר",
    "מתכבדת? (?:לפתוח|להזמין)|אני (?:פותח|פותחת|נועל|נועלת) את|ישיבה זו נעולה|הישיבה נעולה",
    "מזמינה? את (?:חבר|השר|סגן|סגנית|ראש|יושב)",
    r"שאילת[אה] מס'|נוכחת?\s*[;,–-]\s*לפרוטוקול",
    "(?:עוברים|נעבור|ניגשים|ניגש)(?: עכשיו| כעת| עתה)? ל(?:הצבעה|הצבעות|נושא|סעיף|הצע|שאילת|סדר|דיון)",
    "ממשיכים בסדר-היום",
    "נא לשבת|שאלה נוספת ל",
]
WEAK = r"(?U)^\W*תודה|בבקשה"
BARE = r"(?U)^\W*(?:תודה(?: רבה)?|בבקשה)\W*$"
VOCATIVE = "חברת? הכנסת|חברי הכנסת|השרה?|אדוני|גברתי|גבירתי|רבותי"


def with_phrases(turns: DataFrame, protocol: str, turn: str, speaker: str, text: str, words: str, valid: str) -> DataFrame:
    """Add _address (the turn opens by addressing the chair) and _formula (it, or the reply, sounds like the chair)."""
    order = Window.partitionBy(protocol).orderBy(turn)
    t, strong = F.coalesce(F.col(text), F.lit("")), "(?U)" + "|".join(STRONG)
    df = turns.withColumn("_address", F.left(t, F.lit(OPENING)).rlike("(?U)" + ADDRESS))
    replied: Column = F.coalesce(F.lead("_address").over(order) & ~F.lead(speaker).over(order).eqNullSafe(F.col(speaker)), F.lit(False))
    edges = F.concat(F.left(t, F.lit(EDGE)), F.lit(" "), F.right(t, F.lit(EDGE)))
    short = t.rlike(strong) | t.rlike(BARE) | (t.rlike(WEAK) & t.rlike(VOCATIVE)) | replied
    sounds = F.when(F.col(words) > LONG_WORDS, edges.rlike(strong)).otherwise(short)
    return df.withColumn("_formula", F.coalesce(F.col(valid) & (F.col(words) > 0) & ~F.col("_address") & sounds, F.lit(False)))


def floor_spans(who: np.ndarray, address: np.ndarray, formula: np.ndarray, flagged: np.ndarray) -> list[tuple[int, int, int]]:
    """(speaker, first, last exclusive): from an address to the chair a speaker is on the floor, until the first of two formulas of theirs in a row with no other's evidence between."""
    spans, opened, since, last = [], {}, {}, (-1, -1)
    for i in np.flatnonzero(address | formula | flagged).tolist():
        s = int(who[i])
        if address[i]:
            opened.setdefault(s, i)
            since[s] = i
        elif formula[i] and s in opened and last[0] == s and last[1] > since[s]:
            spans.append((s, opened.pop(s), last[1]))
        if formula[i]:
            last = (s, i)
        elif flagged[i] and s not in opened:
            last = (s, -1)  # evidence, but no formula
    return spans + [(s, at, len(who)) for s, at in opened.items()]


def stints(who: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Turns in the chair: runs of anchors of one speaker, the shortest dropped first and their neighbours joined, widened up to the next anchor of another."""
    all_, out = np.flatnonzero(anchor), np.zeros(len(who), bool)
    run_of = lambda at: np.cumsum(np.diff(who[at], prepend=-1) != 0) - 1
    kept = all_
    for least in range(2, LEAST_RUN + 1):
        while len(kept) and (weak := np.bincount(run := run_of(kept))[run] < least).any():
            kept = kept[~weak]
    if not len(kept):
        return out
    block, run = run_of(all_), run_of(kept)
    first, last = kept[np.searchsorted(run, np.arange(run[-1] + 1))], kept[np.searchsorted(run, np.arange(run[-1] + 1), "right") - 1]
    edges = np.searchsorted(block, np.arange(block[-1] + 1))  # where the blocks of anchors of one speaker begin
    for a, b in zip(first, last, strict=True):
        low, high = block[np.searchsorted(all_, a)], block[np.searchsorted(all_, b)]
        left = all_[edges[low] - 1] + 1 if low else 0
        right = all_[edges[high + 1]] if high < block[-1] else len(who)
        out[left:right] |= who[left:right] == who[a]
    return out


def presiding(turns: DataFrame, protocol: str, turn: str, speaker: str, text: str, words: str, valid: str, chair: str) -> DataFrame:
    """(protocol, turn, presiding): valid speakers in a stint, or flagged as chair, who aren't on the floor. Null flags count as false; turns without a speaker are one speaker's. A protocol is one group."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(turn)
        who = pd.factorize(df["who"], use_na_sentinel=False)[0]
        address, formula, good, chaired = (df[c].to_numpy(bool) for c in ("_address", "_formula", "good", "chaired"))
        flagged = chaired & good & (df["n"].to_numpy() > 0)
        floor = np.zeros(len(df), bool)
        for s, a, b in floor_spans(who, address, formula, flagged):
            floor[a:b] |= who[a:b] == s
        return df[[protocol, turn]].assign(presiding=good & (stints(who, (formula | flagged) & ~floor) | chaired) & ~floor)

    df = with_phrases(turns, protocol, turn, speaker, text, words, valid)
    flag = lambda c, out: F.coalesce(F.col(c), F.lit(False)).alias(out)
    df = df.select(protocol, turn, F.col(speaker).alias("who"), F.coalesce(F.col(words), F.lit(0)).alias("n"), flag(valid, "good"), flag(chair, "chaired"), "_address", "_formula")
    kinds = ", ".join(f"`{c}` {turns.schema[c].dataType.simpleString()}" for c in (protocol, turn))
    return df.groupBy(protocol).applyInPandas(one, f"{kinds}, presiding boolean")
