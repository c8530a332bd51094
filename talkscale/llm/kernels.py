"""Vectorised kernels over the bytes of Arrow string columns: words, hashes, shingles. One pass over slices of bounded size; no Python string is made."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel works on at once; a longer text is a slice of its own. A kernel holds some 70 bytes for each of them, in every worker of an executor.
SLICE = 512 << 10

_random = np.random.Generator(np.random.PCG64(20240229))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_CODE_LOWER = _CODE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_TURNS = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, SLICE + 1)
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts(NamedTuple):
    """Rows low to high of a column: their bytes, and where each starts in them."""

    low: int
    high: int
    data: np.ndarray
    starts: np.ndarray


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[Texts]:
    """Cut a string column without nulls into runs of rows of about limit bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield Texts(low, high, whole[at[low] : at[high]], at[low : high + 1] - at[low])
        low = high


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    #: Word numbers at which each text begins, and the number of all words.
    first: np.ndarray


def words(t: Texts) -> Words:
    """Runs of bytes that are no white space, text by text."""
    solid = ~_SPACE[t.data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    inner = t.starts[:-1][t.starts[:-1] < len(solid)]
    begin[inner] = solid[inner]
    last = t.starts[1:][t.starts[1:] > t.starts[:-1]] - 1
    end[last] = solid[last]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, t.starts))


class Hashes:
    """Hashes of any runs of bytes of a slice."""

    def __init__(self, data: np.ndarray, lower: bool) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_CODE_LOWER if lower else _CODE)[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words inside a text, and the word that each begins with."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:n] * _TURNS[0]
    for k in range(1, size):
        out = out + hashes[k : n + k] * _TURNS[k]
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(left >= size)
    return mix(out[at]), at


def by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values from each bound to the next."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[bounds])


def owner(bounds: np.ndarray) -> np.ndarray:
    """The text of each element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def keyed(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes made different from text to text."""
    return mix(hashes + text.astype(np.uint64) * _TURNS[63])


def quality_counts(t: Texts, span: int = 5) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_upper, n_lines (those with a word), n_dup_lines, n_repeat_words."""
    w = words(t)
    text = owner(t.starts)
    points = (t.data & 0xC0) != 0x80
    spaces = _SPACE[t.data]
    symbols = np.zeros(256, bool)
    symbols[list(b"#*$%&|<>")] = True
    h = Hashes(t.data, lower=False)
    # lines: each text ends one, as does each \n
    breaks = np.flatnonzero(t.data == 10)
    line_ends = np.sort(np.concatenate([breaks, t.starts[1:]]), kind="stable")
    line_text = np.concatenate([text[breaks], np.arange(len(t.starts) - 1)])[np.argsort(np.concatenate([breaks, t.starts[1:]]), kind="stable")]
    line_text = np.sort(line_text, kind="stable")
    begin = np.zeros(len(line_ends), np.int64)
    if len(line_ends) > 1:
        same = line_text[1:] == line_text[:-1]
        begin[1:] = np.where(same, line_ends[:-1] + 1, t.starts[line_text[1:]])
    begin[0] = 0
    full = np.searchsorted(w.starts, begin) < np.searchsorted(w.starts, line_ends)
    keys = keyed(h.of(begin[full], line_ends[full]), line_text[full])
    _, where = np.unique(keys, return_index=True)
    n_texts = len(t.starts) - 1
    n_lines, distinct = np.bincount(line_text[full], minlength=n_texts), np.bincount(line_text[full][where], minlength=n_texts)
    # words in repeated windows
    win, at = windows(h.of(w.starts, w.ends), w.first, span)
    word_text = owner(w.first)
    covered = np.zeros(len(w.starts), bool)
    if len(win):
        _, which, times = np.unique(keyed(win, word_text[at]), return_inverse=True, return_counts=True)
        marks = np.zeros(len(w.starts) + span, np.int64)
        marks[at[times[which] > 1]] = 1
        sums = np.concatenate([[0], np.cumsum(marks)])
        i = np.arange(len(w.starts))
        covered = sums[i + 1] - sums[np.maximum(i + 1 - span, 0)] > 0
    return {
        "n_words": np.diff(w.first),
        "word_chars": by_text(points & ~spaces, t.starts),
        "n_symbols": by_text(symbols[t.data], t.starts),
        "n_upper": by_text((t.data >= 65) & (t.data <= 90), t.starts),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": by_text(covered, w.first),
    }


def word_counts(t: Texts) -> np.ndarray:
    return np.diff(words(t).first)


def shingle_sets(t: Texts, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted, distinct hashes of its lower-cased runs of size words; all words as one run if there are fewer; none without words."""
    w = words(t)
    h = Hashes(t.data, lower=True).of(w.starts, w.ends)
    win, at = windows(h, w.first, size)
    cut = np.searchsorted(at, w.first)
    for i in range(len(t.starts) - 1):
        own = win[cut[i] : cut[i + 1]]
        if not len(own) and w.first[i] < w.first[i + 1]:
            few = h[w.first[i] : w.first[i + 1]]
            own = mix((few * _TURNS[: len(few)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(few)))
        yield np.unique(own)
