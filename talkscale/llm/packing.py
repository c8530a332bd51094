"""Packing of tokenised documents into sequences by minimum bin slack.

Bins are filled one after the other: the longest piece left opens the bin, and a subset-sum over the lengths left, held as
the bits of an integer, finds the fullest combination beside it. Pieces of one length are alike, so the search needs only
the number of pieces of each length, at most `capacity` numbers whatever the input. A combination is repeated while the
counts allow it. The plan says which ranks of each length go where; ranks come from running sums, so no task holds a length.

Null and empty texts are one end token. Documents with the same id are packed each.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkscale.llm.common import materialise, running_sums

CAPACITY = 2048
#: Distinct words whose ids a Python worker keeps; beyond that it keeps those of the texts at hand.
CACHE_WORDS = 800_000


#: ASCII signs that may end a word; the apostrophe isn't one, since the tokenizer knows contractions.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Lower-case words of letters of ASCII and Latin-1 alone.
LETTERS = re.compile(rb"(?:[a-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+").fullmatch


def ends_in_letter(stem: bytes) -> bool:
    """Whether the last character is a letter of ASCII or Latin-1; those stay one letter in lower case."""
    last = stem[-1]
    return 97 <= last <= 122 or 65 <= last <= 90 or (last > 127 and stem[-2] == 0xC3 and stem[-2:].decode().isalpha())


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases and never joins what ASCII white space parts, nor a letter and the signs after it: distinct words are encoded once, and without their last signs."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each task has its own core; threads only add memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        #: By id, whether a token ends its word; None if the tokenizer doesn't mark that.
        self.closes: np.ndarray | None = None
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def learn(self, words: list[bytes]) -> None:
        plain = [w for w in words if self.closes is not None and LETTERS(w)]
        for at in range(0, len(plain), 1024):
            # each of these words is one run of letters, so its last token is the first that ends a word
            some = plain[at : at + 1024]
            ids = np.asarray(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            data = ids.tobytes()
            self.known.update(zip(some, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        rest = [w for w in words if w not in self.known]
        for word, got in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            ids = got.ids
            self.known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow string array's texts, one after the other, and where each text's begin (one bound more than texts)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        # names of special tokens are written <|...|> and keep their case
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = lists.flatten().cast(pa.binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = set(filterfalse(self.known.__contains__, words))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {w: self.known[w] for w in words if w not in new}
        whole, parted = [], []
        for word in new:
            stem = word.rstrip(SIGNS)
            if stem and len(stem) < len(word) and b"<|" not in word and ends_in_letter(stem):
                parted.append((word, stem, word[len(stem) :]))
            else:
                whole.append(word)
        self.learn(whole)
        self.learn(list({part for _, *parts in parted for part in parts}.difference(self.known)))
        for word, stem, signs in parted:
            self.known[word] = self.known[stem] + self.known[signs]
        own = list(map(self.known.__getitem__, words))
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        data, code = np.frombuffer(b"".join(own), "<u4"), coded.indices.to_numpy()
        count = size[code]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = data[np.repeat((np.cumsum(size) - size)[code] - ends[:-1], count) + np.arange(ends[-1])]
        return ids, ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def row_ranges(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes together, each of one row at least."""
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // limit)) + 1
    bounds = [0, *cuts.tolist(), len(sizes)]
    return [(x, y) for x, y in zip(bounds[:-1], bounds[1:], strict=True) if x < y]


_encoders: dict[str, WordEncoder] = {}


def cut_into_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each document and the end id, cut every `capacity` ids."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("piece int, start bigint, length bigint, ids_crc32 bigint").fields])
    stop = np.asarray([end], "<u4").tobytes()

    def run(batches):
        import pyarrow.compute as pc

        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordEncoder(tokenizer))
        for batch in batches:
            doc_ids, column = batch.columns
            for low, high in row_ranges(pc.binary_length(column).to_numpy(zero_copy_only=False), 1 << 22):
                ids, bounds = encoder.encode(column.slice(low, high - low))
                bounds, rows = bounds.tolist(), []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    for k, at in enumerate(range(a, b + 1, capacity)):
                        piece = ids[at : min(at + capacity, b)].tobytes()
                        if at + capacity > b:
                            piece += stop
                        rows.append((low + i, k, at - a, len(piece) // 4, zlib.crc32(piece)))
                row, piece, start, length, crc = (list(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as counts has it, whose sum is the largest that is not above room; longer ones first."""
    if room <= 0:
        return []
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left > 0:
            take = min(group, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, group = left - take, group * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """(length, rank, bin, each, offset): from rank on, pieces of this length go `each` to a bin from bin on, side by side from offset."""
    left, given, rows, bins = dict(sorted(counts.items())), Counter(), [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        pattern = Counter([longest, *rest])
        times, offset = min(left[k] // n for k, n in pattern.items()), 0
        for length, each in sorted(pattern.items(), reverse=True):
            rows.append((length, given[length], bins, each, offset))
            offset += length * each
            given[length] += each * times
            left[length] -= each * times
            if not left[length]:
                del left[length]
        bins += times
    return pd.DataFrame(rows, columns=["length", "rank", "bin", "each", "offset"], dtype="int64").sort_values(["length", "rank"], ignore_index=True)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents of more than `capacity` ids are cut."""
    pieces = materialise(cut_into_pieces(docs, tokenizer, capacity, end).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_bins(counts, capacity)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({c: plan[c].to_numpy() for c in plan.columns})  # some rows for each length
    ranked = running_sums(pieces.withColumn("one", F.lit(1).cast("bigint")), ["length"], ["doc_id", "piece", "row"], "one", "rank")

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shared.value
        key = p["length"] << 40 | p["rank"]
        i = np.searchsorted(key, (length.to_numpy() << 40) | rank.to_numpy(), "right") - 1
        k = rank.to_numpy() - p["rank"][i]
        return pd.DataFrame({"sequence_id": p["bin"][i] + k // p["each"][i], "offset": p["offset"][i] + k % p["each"][i] * length.to_numpy()})

    return ranked.withColumn("_at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_at.*")
