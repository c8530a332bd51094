"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

Of two words one edit apart, the shorter one's first half starts both or its second half ends both. So words are listed by
their first half in a dictionary sorted forward and by their second half in one sorted backward, once for the lengths m of
the shorter word that they may meet; words with the same half are a block. A block of more than `most` words is divided:
what its words don't share yet is halved again, forward and backward, until blocks are small or one code point is left,
where words of one alphabet can't be many. The sorted lists are range-partitioned and each task scans its range once,
block by block, comparing words within a block. Blocks without a word of length m hold no pair and go early.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only. Null texts have none; a null doc_id
counts as an empty string before the colon. Bytes that aren't UTF-8 part words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkscale.llm.common import discard, materialise, shuffle_partitions

#: One word in so many has a code point deleted.
NOISE = 31
#: Distinct words that a task holds before it hands on their counts; code points of a text whose runs are listed at once.
HELD, LISTED = 200_000, 1 << 20
#: Words of a block that are compared without dividing it; an alphabet of 90 letters makes at most about 180 with one code point left.
MOST = 256
#: Words up to this length are compared as rows of a table, longer ones one by one; comparisons made at once.
TABLE, COMPARED = 64, 1 << 17


def noisy_counts(docs: DataFrame, least_points: int = 7, least: int = 2) -> DataFrame:
    """(word, n): words of at least least_points code points with at least least occurrences in all texts, after the noise that the contract of op12 names."""
    found = re.compile("[a-zÀ-ÿ]{%d,}" % least_points).findall
    lazily = re.compile("[a-zÀ-ÿ]{%d,}" % least_points).finditer

    def run(batches):
        held: Counter[str] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                low = text.as_py().lower().decode("utf-8", "replace")  # bytes.lower() is for A-Z alone
                own = Counter(found(low) if len(low) <= LISTED else (m[0] for m in lazily(low)))
                base = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), base)
                    if h % NOISE == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least_points:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield rows()
                    held = Counter()
        yield rows()

    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the half of what is open put to the front, and to the end. front and back are what a block's words share, m the length of its shorter words."""
    open_ = F.col("m") - F.length("front") - F.length("back")
    half = F.floor(open_ / 2).cast("int")
    forward = F.struct(F.substring("word", F.lit(1), F.length("front") + half).alias("front"), F.col("back"))
    backward = F.struct(F.col("front"), F.substring("word", F.length("word") - F.length("back") - half + 1, F.length("back") + half).alias("back"))
    others = [c for c in rows.columns if c not in ("front", "back")]
    return rows.select(*others, F.explode(F.array(forward, backward)).alias("_h")).select(*others, "_h.*")


def blocks(words: DataFrame, most: int = MOST) -> DataFrame:
    """(m, front, back, word, n): every two words one edit apart are in a block (m, front, back) together. A block has at most `most` words, or words with all but one code point in common."""
    long = F.length("word")
    todo = words.select("word", "n", F.explode(F.array(long, long - 1)).alias("m"), F.lit("").alias("front"), F.lit("").alias("back")).where("m > 0")
    made, key = None, ["m", "front", "back"]
    while True:
        rows = materialise(_halves(todo), "halves")
        sizes = rows.groupBy(*key).agg(F.count("*").alias("held"), F.max(F.length("word") == F.col("m")).alias("short")).where("held > 1 AND short")
        over = (F.col("held") > most) & (F.col("m") - F.length("front") - F.length("back") > 1)
        sizes = materialise(sizes.withColumn("over", over), "blocks")
        ready = rows.join(sizes.where("NOT over").select(*key), key)
        made = ready if made is None else made.unionByName(ready)
        todo = rows.join(sizes.where("over").select(*key), key, "left_semi")
        if not sizes.where("over").head(1):
            return made


def _apart(u: str, v: str) -> bool:
    """Whether one edit turns u into v; v is as long, or one longer."""
    if u == v:
        return False
    k = next((i for i, (x, y) in enumerate(zip(u, v, strict=False)) if x != y), len(u))
    return u[k + (len(u) == len(v)) :] == v[k + 1 :]


def _near(words: list[str], m: int, x: np.ndarray, y: np.ndarray, table: np.ndarray | None) -> np.ndarray:
    """Which words x[i], of length m, are one edit apart from y[i], of length m or m + 1."""
    if table is None:
        return np.fromiter((_apart(words[i], words[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
    u, v = table[x], table[y]
    differ = u[:, :m] != v[:, :m]
    same = v[:, m] == 0
    # an inserted code point: up to it the words agree, after it they agree when moved by one
    moved = u[:, :m] != v[:, 1:]
    head = np.where(differ.any(1), differ.argmax(1), m)
    tail = np.where(moved.any(1), m - moved[:, ::-1].argmax(1), 0)
    return np.where(same, differ.sum(1) == 1, tail <= head)


def _pairs_of(words: list[str], m: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs one edit apart inside blocks of words of length m or m + 1; starts: where each block begins, and the end."""
    long = np.array([len(w) for w in words])
    table = None
    if m <= TABLE:
        table = np.frombuffer("".join(w.ljust(m + 1, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), m + 1)
    size = np.diff(starts)[np.searchsorted(starts, np.arange(len(words)), "right") - 1]
    first = np.repeat(starts[:-1], np.diff(starts))
    short, out = np.flatnonzero(long == m), []
    ends = np.cumsum(size[short])
    low = 0
    while low < len(short):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COMPARED, "right")))
        mine = short[low:high]
        x = np.repeat(mine, size[mine])
        y = np.arange(len(x)) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine]) + np.repeat(first[mine], size[mine])
        once = (long[y] > m) | (x < y)
        x, y = x[once], y[once]
        near = _near(words, m, x, y, table)
        out.append((x[near], y[near]))
        low = high
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in out)]), np.concatenate([none, *(b for _, b in out)])


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n): the pairs of words (with their n) one inserted, deleted or replaced code point apart, both ways round."""
    key = ["m", "front", "back"]

    def scanned(columns: list[pa.Array]):
        m, front, back, word, n = columns
        new = np.ones(len(word), bool)
        rows = list(zip(m.to_pylist(), front.to_pylist(), back.to_pylist(), strict=True))
        new[1:] = [a != b for a, b in zip(rows, rows[1:], strict=False)]
        lengths, begin = np.array(m), np.flatnonzero(new)
        words_, x, y = word.to_pylist(), [], []
        for value in np.unique(lengths):  # sorted by m, so these are ranges
            low, high = np.searchsorted(lengths, [value, value + 1])
            starts = np.append(begin[(begin >= low) & (begin < high)], high) - low
            a, b = _pairs_of(words_[low:high], int(value), starts)
            x.append(a + low)
            y.append(b + low)
        x, y = np.concatenate(x), np.concatenate(y)
        return pa.RecordBatch.from_arrays([word.take(pa.array(x)), n.take(pa.array(x)), word.take(pa.array(y)), n.take(pa.array(y))], names=["word", "n", "near", "near_n"])

    def run(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks().to_batches()[0]
            # the last block may go on in the next batch
            last, k = [c[-1].as_py() for c in here.columns[:3]], here.num_rows - 1
            while k and [c[k - 1].as_py() for c in here.columns[:3]] == last:
                k -= 1
            left = here.slice(k)
            if k:
                yield scanned([c.slice(0, k) for c in here.columns])
        if left is not None:
            yield scanned(left.columns)

    made = blocks(words, most).select(*key, "word", "n")
    order = ["m", "front", F.reverse("back")]
    ranged = made.repartitionByRange(shuffle_partitions(words.sparkSession), *order).sortWithinPartitions(*order, "word")
    pairs = ranged.mapInArrow(run, "word string, n bigint, near string, near_n bigint").distinct()  # both halves may find a pair
    pairs = materialise(pairs, "pairs")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where following form from word to word ends. Each round follows twice as many; n grows along the way, so there is no circle."""
    to = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = to.select(F.col("word").alias("at"), F.col("root").alias("next"))
        step = materialise(to.join(further, to["root"] == further["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        moved = step.where("moved").head(1)
        discard(to)
        to = step
        if not moved:
            return to.select("word", "root")


def spelling_variants(docs: DataFrame, least_points: int = 7, least: int = 2, times: int = 10, most: int = MOST) -> DataFrame:
    """One row per word: word, n, n_near, form (its most frequent near word, if that has times its n), form_n, root (the last form)."""
    words = materialise(noisy_counts(docs, least_points, least), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words, most).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    kept: Column = -F.col("best.less") >= times * F.col("n")
    near = materialise(near.select("word", "n_near", F.when(kept, F.col("best.form")).alias("form"), F.when(kept, -F.col("best.less")).alias("form_n")), "near")
    roots = last_forms(near.where("form IS NOT NULL"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")
