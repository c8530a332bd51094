"""Language-model scoring by a gated recurrent network in numpy.

The model reads a document word by word (a GRU) and gives the next word's probability as class times word in class. The
WORDS commonest words are dealt to classes by frequency, with a softmax over classes and one inside each class; all other
words are one more class, inside which they have their smoothed unigram probability. Counts, vocabulary and smoothing come
from every word of every training document. The weights are trained by truncated backpropagation on every word of every
training document: consecutive windows of BPTT words hand on their state from the first word to the end, as in scoring.
Training is parallel: in each of ROUNDS rounds every TRAINER_DOCS documents train a copy (fewer if they are long, so that a
copy meets about TRAINER_TOKENS tokens at most), and copies are averaged in a tree.
A document's score carries the state from its first word to its end, whatever its length.

Training documents are those whose crc32(doc_id as text) mod 10 is not 0; a null doc_id is read as the empty text.
Null and empty texts are one end token. Words are known by 64-bit hashes. At most KNOWN counts are broadcast; words beyond
them meet their counts in a join.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkscale.llm import kernels
from talkscale.llm.common import materialise

WORDS, CLASS, HIDDEN, KNOWN = 4096, 64, 16, 262_144
BPTT, BATCH, ROUNDS, TRAINER_DOCS, TRAINER_TOKENS, RATE = 32, 192, 3, 4000, 8_000_000, 0.2
START, END = 1, 2
FAN, CHUNK, ROWS = 16, 32, 1024

Model = dict[str, np.ndarray]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


class Net:
    """The network over word numbers 0..m-1, m for any other word and, as input only, m + 1 for the start."""

    def __init__(self, counts: np.ndarray, rest: float, seed: int = 7) -> None:
        """counts: smoothed counts of the m words, commonest first; rest: smoothed count of all others."""
        self.m = m = len(counts)
        self.classes = -(-m // CLASS)
        rng = np.random.Generator(np.random.PCG64(seed))
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        mass = np.array([counts[c * CLASS : (c + 1) * CLASS].sum() for c in range(self.classes)] + [rest])
        inside = np.concatenate([np.log(counts[c * CLASS : (c + 1) * CLASS] / mass[c]) for c in range(self.classes)]) if m else np.zeros(0)
        self.p: Model = {
            "X": small(m + 2, 3 * HIDDEN),
            "U": small(HIDDEN, 3 * HIDDEN),
            "W": np.zeros((self.classes + 1, HIDDEN), np.float32),
            "w": np.log(mass / mass.sum()).astype(np.float32),
            "O": np.zeros((m, HIDDEN), np.float32),
            "o": inside.astype(np.float32),
        }

    def step(self, ids: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        # the update gates, reset gates and candidates of all rows lie apart, so that each is one run of memory
        a = np.take(self.p["X"].reshape(-1, HIDDEN), 3 * ids + np.arange(3)[:, None], axis=0)
        g = np.matmul(h, self._gates())
        gates = np.add(a[:2], g[:2], out=g[:2])
        np.reciprocal(np.add(np.exp(np.negative(gates, out=gates), out=gates), 1, out=gates), out=gates)
        z, r = gates
        c = r * g[2]
        np.tanh(np.add(c, a[2], out=c), out=c)
        if keep is not None:
            keep.append((ids, h, z, r, c, g[2]))
        out = h - c
        out *= z
        out += c
        return out

    def _gates(self) -> np.ndarray:
        return np.ascontiguousarray(self.p["U"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))

    def output(self, h: np.ndarray, ids: np.ndarray, grads: Model | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each of ids after state h; with grads also adds the loss's gradients there and returns that of h."""
        W, w, O, o = (self.p[k] for k in "WwOo")  # noqa: E741
        cls = np.minimum(ids // CLASS, self.classes).astype(number_type(self.classes))  # numbers of 16 bits are sorted by counting
        cls[ids >= self.m] = self.classes
        order = np.argsort(cls, kind="stable")
        h, ids, cls = h[order], ids[order], cls[order]
        cuts = np.searchsorted(cls, np.arange(self.classes + 1))
        reach = np.abs(h).max(initial=0)
        small, small_inside = (bool(np.max(np.abs(y) + reach * np.abs(Y).sum(1), initial=0) < 80) for Y, y in ((W, w), (O, o)))  # e^80 and e^-80 are numbers of single precision
        got, dh = np.empty(len(h), h.dtype), None if grads is None else np.empty_like(h)
        for low in range(0, len(h), ROWS):
            part = slice(low, low + ROWS)
            got[part], b = self._choose(h[None, part], cls[None, part], W[None], w[None], small, None if grads is None else 1)
            if grads is not None:
                dh[part] = b[0].T @ W
                grads["W"] += b[0] @ h[part]
                grads["w"] += b[0].sum(1)
        if grads is not None:
            self._inside(h[: cuts[-1]], ids[: cuts[-1]], cuts, small_inside, got, dh, grads)
        else:
            for c in np.flatnonzero(np.diff(cuts)).tolist():
                own = slice(c * CLASS, (c + 1) * CLASS)
                for low in range(cuts[c], cuts[c + 1], ROWS):
                    part = slice(low, min(low + ROWS, cuts[c + 1]))
                    got[part] += self._choose(h[None, part], ids[None, part] % CLASS, O[None, own], o[None, own], small_inside)[0][0]
        out = np.empty_like(got)
        out[order] = got
        if grads is None:
            return out, None
        back = np.empty_like(dh)
        back[order] = dh
        return out, back

    @staticmethod
    def _choose(x: np.ndarray, own: np.ndarray, W: np.ndarray, w: np.ndarray, small: bool, real: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of the choices own (c, n) under softmax(W x + w) for c times n states x; with real also the loss's gradients of W x + w, none where real is 0. Choices are rows, so that largest ones and sums are taken over many states at once. If W x + w is small, its powers are taken as they are."""
        b = W @ x.transpose(0, 2, 1)
        b += w[:, :, None]
        if not small:
            b -= b.max(1, keepdims=True)
        (c, k, n), flat = b.shape, b.reshape(-1)
        at = (np.arange(c)[:, None] * k + own) * n + np.arange(n)
        hit = flat[at]
        np.exp(b, out=b)
        s = np.ones(k, b.dtype) @ b
        if real is not None:
            b *= (real / s)[:, None]
            flat[at] -= real
        return hit - np.log(s), b

    def _inside(self, h: np.ndarray, ids: np.ndarray, cuts: np.ndarray, small: bool, out: np.ndarray, dh: np.ndarray, grads: Model) -> None:
        """Words inside their classes, with gradients. A training window has few words of a class, so the words, by class in order, are cut into chunks of at most CHUNK words of one class, and ROWS words are computed together."""
        if not len(h):
            return
        counts = np.diff(cuts)
        chunks = -(-counts // CHUNK)
        of_chunk = np.repeat(np.arange(self.classes), chunks)
        slot = np.arange(len(h)) + np.repeat((np.cumsum(chunks) - chunks) * CHUNK - cuts[:-1], counts)
        high, n = self.classes * CLASS, h.shape[1]
        O, o = self.p["O"], self.p["o"]  # noqa: E741
        small &= high == self.m
        if high > self.m:
            O, o = np.concatenate([O, np.zeros((high - self.m, n), O.dtype)]), np.append(o, np.full(high - self.m, -np.inf, o.dtype))  # noqa: E741
        O, o = O.reshape(-1, CLASS, n), o.reshape(-1, CLASS)  # noqa: E741
        of_O, of_o = np.zeros_like(O), np.zeros_like(o)
        x, own, real = np.zeros((len(of_chunk) * CHUNK, n), h.dtype), np.zeros(len(of_chunk) * CHUNK, np.int64), np.zeros(len(of_chunk) * CHUNK, h.dtype)
        x[slot], own[slot], real[slot] = h, ids % CLASS, 1
        x, own, real = x.reshape(-1, CHUNK, n), own.reshape(-1, CHUNK), real.reshape(-1, CHUNK)
        logs, d, ones = np.empty_like(real), np.empty_like(x), np.ones(CHUNK, h.dtype)
        for low in range(0, len(x), ROWS // CHUNK):
            part = slice(low, low + ROWS // CHUNK)
            of = of_chunk[part]
            weights = O[of]
            logs[part], b = self._choose(x[part], own[part], weights, o[of], small, real[part])
            d[part] = b.transpose(0, 2, 1) @ weights
            first = np.flatnonzero(np.diff(of, prepend=-1))
            of_O[of[first]] += np.add.reduceat(b @ x[part], first)
            of_o[of[first]] += np.add.reduceat(b @ ones, first)
        out[: len(h)] += logs.reshape(-1)[slot]
        dh[: len(h)] += d.reshape(-1, n)[slot]
        grads["O"] += of_O.reshape(-1, n)[: self.m]
        grads["o"] += of_o.reshape(-1)[: self.m]

    def score(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of each document: ids[start : start + length], in windows that hand on the state."""
        order = np.argsort(-lengths, kind="stable")
        size, begin = lengths[order], starts[order]
        h, before = np.zeros((len(order), HIDDEN), np.float32), np.full(len(order), self.m + 1)
        total, t, falling = np.zeros(len(order)), 0, -size
        while len(size) and t < size[0]:
            active = int(np.searchsorted(falling, -t))
            states, wanted, rows = [], [], []
            for t in range(t, t + max(16, min(1024, 65_536 // active))):  # noqa: B020
                k = int(np.searchsorted(falling, -t))
                if not k:
                    break
                h[:k] = self.step(before[:k], h[:k])
                before[:k] = ids[begin[:k] + t]
                states.append(h[:k].copy())
                wanted.append(before[:k].copy())
                rows.append(np.arange(k))
            t += 1
            got, _ = self.output(np.concatenate(states), np.concatenate(wanted))
            total += np.bincount(np.concatenate(rows), got, minlength=len(order))
        out = np.empty(len(order))
        out[order] = total
        return out

    def train(self, docs: list[np.ndarray], rate: float = RATE) -> int:
        """One pass of Adagrad over documents: word numbers with the end. Returns the number of tokens learnt from.

        BATCH lanes read one document after another, each from its first word to its end, in windows of BPTT words. The
        state goes on from window to window and is empty at the start of a document.
        """
        if not docs:
            return 0
        lanes, sizes = self._lanes(docs)
        seen = {k: np.full_like(v, 1e-6) for k, v in self.p.items()}
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        h, done = np.zeros((len(sizes), HIDDEN), np.float32), 0
        for at in range(0, int(sizes[0]), BPTT):
            k = int(np.searchsorted(-sizes, -at))  # lanes that have not ended
            window, ids = self._window(docs, lanes[:k], at, min(BPTT, int(sizes[0]) - at))
            ids = ids.ravel()
            fresh, h = window == self.m + 1, h[:k]
            resets = fresh.any(1).tolist()
            kept: list = []
            states = []
            for t, now in enumerate(window):
                if resets[t]:
                    h = np.where(fresh[t][:, None], np.float32(0), h)
                h = self.step(now, h, kept)
                states.append(h)
            hs, real = np.concatenate(states), np.flatnonzero(ids >= 0)
            if len(real) == len(ids):
                _, d = self.output(hs, ids, grads)
            else:
                d = np.zeros_like(hs)
                _, d[real] = self.output(hs[real], ids[real], grads)
            self._back(kept, d.reshape(len(kept), k, HIDDEN), grads)
            done += len(real)
            scale = np.float32(1 / max(len(real), 1) ** 0.5)
            for name, g in grads.items():
                rows = np.unique(window) if name == "X" else slice(None)  # other rows have no gradient
                own = g[rows] * scale
                total = own * own
                total += seen[name][rows]
                seen[name][rows] = total
                own *= rate
                own /= np.sqrt(total, out=total)
                self.p[name][rows] -= own
                g[rows] = 0
        return done

    def _lanes(self, docs: list[np.ndarray]) -> tuple[list[tuple[list[int], list[int]]], np.ndarray]:
        """The documents of each lane, in their order, with where each begins and the last ends; and the lanes' lengths, longest first."""
        heap = [(0, i) for i in range(min(BATCH, len(docs)))]
        lanes: list[list[int]] = [[] for _ in heap]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            load, lane = heap[0]
            heapq.heapreplace(heap, (load + len(docs[i]), lane))
            lanes[lane].append(i)
        placed = [(sorted(own), list(itertools.accumulate((len(docs[i]) for i in sorted(own)), initial=0))) for own in lanes]
        placed.sort(key=lambda own: -own[1][-1])
        return placed, np.array([starts[-1] for _, starts in placed])

    def _window(self, docs: list[np.ndarray], lanes: list[tuple[list[int], list[int]]], at: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Words given and wanted at times at to at + steps (rows) in each lane. -1 pads what is wanted. Made for one window only, so a long text takes no room beside lanes that have ended."""
        wanted = np.full((len(lanes), steps + 1), -1, np.int32)  # from the word before the window on
        firsts = []
        for lane, (own, starts) in enumerate(lanes):
            row = wanted[lane]
            for j in range(bisect.bisect_right(starts, at) - 1, len(own)):
                begin = starts[j]
                if begin >= at + steps:
                    break
                low = max(at - 1, begin)
                part = docs[own[j]][low - begin : at + steps - begin]
                row[low - at + 1 : low - at + 1 + len(part)] = part
                if begin >= at:
                    firsts.append((begin - at) * len(lanes) + lane)
        given, wanted = np.ascontiguousarray(wanted[:, :-1].T), np.ascontiguousarray(wanted[:, 1:].T)
        given[wanted < 0] = self.m
        given.ravel()[firsts] = self.m + 1
        return given, wanted

    def _back(self, kept: list, d: np.ndarray, grads: Model) -> None:
        (steps, k, n), U = d.shape, np.ascontiguousarray(self._gates().transpose(0, 2, 1))
        das, dgs, hs = np.empty((3, steps, k, n), d.dtype), np.empty((steps, k, n), d.dtype), np.empty_like(d)
        flat = np.concatenate([x[0] for x in kept])
        fresh = (flat == self.m + 1).reshape(steps, k)
        resets = fresh.any(1).tolist()
        dh = np.zeros_like(d[0])
        for t in range(steps - 1, -1, -1):
            _, h, z, r, c, gc = kept[t]
            hs[t] = h
            dh += d[t]
            dz, dr, dc = das[:, t]
            keep = dh * z
            np.multiply(c, c, out=dc)
            np.subtract(1, dc, out=dc)
            dc *= dh - keep
            np.multiply(dc, r, out=dgs[t])
            np.subtract(1, r, out=dr)
            dr *= dgs[t]
            dr *= gc
            np.subtract(h, c, out=dz)
            dz *= keep
            dz *= 1 - z
            dh = keep
            dh += dz @ U[0]
            dh += dr @ U[1]
            dh += dgs[t] @ U[2]
            if resets[t]:
                dh[fresh[t]] = 0
        ht = hs.reshape(-1, n).T
        for i, of_gate in enumerate((das[0], das[1], dgs)):
            grads["U"][:, i * n : (i + 1) * n] += ht @ of_gate.reshape(-1, n)
        order = np.argsort(flat.astype(number_type(self.m)), kind="stable")
        cuts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        rows = np.take(das.reshape(-1, n), order[:, None] + len(flat) * np.arange(3), axis=0)
        grads["X"][flat[order[cuts]]] += np.add.reduceat(rows.reshape(-1, 3 * n), cuts, axis=0)

    def dump(self) -> bytes:
        return b"".join(self.p[k].astype("<f4").tobytes() for k in sorted(self.p))

    def load(self, data: bytes) -> None:
        flat, at = np.frombuffer(data, "<f4"), 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).copy()
            at += n


def _tokens(t: kernels.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where those of each text begin. Made from SLICE bytes of text at once, whatever t holds, so that what a kernel needs stays in the cache."""
    hashes, first, low, n = [], [np.zeros(1, np.int64)], 0, len(t.starts) - 1
    while low < n:
        begin = t.starts[low]
        high = max(low + 1, int(np.searchsorted(t.starts, begin + kernels.SLICE, "right")) - 1)
        data = t.data[begin : t.starts[high]]
        w = kernels.words(kernels.Texts(low, high, data, t.starts[low : high + 1] - begin))
        hashes.append(kernels.Hashes(data, lower=True).of(w.starts, w.ends))
        first.append(w.first[1:] + first[-1][-1])
        low = high
    return np.concatenate(hashes).view(np.int64), np.concatenate(first)


class Numbers:
    """Numbers of the tokens given, in their order, and len(tokens) for all others. As tokens are hashes, a few share their first bits, by which they are found."""

    def __init__(self, tokens: np.ndarray) -> None:
        self.other, self.shift = len(tokens), np.uint64(63 - len(tokens).bit_length())
        order = np.argsort(tokens.view(np.uint64), kind="stable")
        self.tokens, self.number = np.append(tokens[order], np.int64(0)), np.append(order, self.other)
        heads = tokens[order].view(np.uint64) >> self.shift
        self.first = np.searchsorted(heads, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def of(self, tokens: np.ndarray) -> np.ndarray:
        head = (tokens.view(np.uint64) >> self.shift).view(np.int64)
        at = self.first[head]
        found = self.tokens[at] == tokens
        out = np.where(found, self.number[at], self.other)
        left = np.flatnonzero(~found)
        at, end = at[left] + 1, self.first[head[left] + 1]
        while len(left):
            going = at < end
            left, at, end = left[going], at[going], end[going]
            found = self.tokens[at] == tokens[left]
            out[left[found]] = self.number[at[found]]
            left, at, end = left[~found], at[~found] + 1, end[~found]
        return out


def gather(docs: DataFrame) -> DataFrame:
    """(token, n): partial counts of all tokens of training documents."""

    def run(batches):
        def counts(found):
            tokens, n = np.concatenate([u for u, _ in found]), np.concatenate([c for _, c in found])
            tokens, which = np.unique(tokens, return_inverse=True)
            n = np.bincount(which, n, minlength=len(tokens)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n)], names=["token", "n"])

        for batch in batches:
            found, held = [(np.array([END]), np.array([batch.num_rows]))], 0
            for t in kernels.slices(batch.column(0)):
                found.append(np.unique(_tokens(t)[0], return_counts=True))
                held += len(found[-1][0])
                if held > 3_000_000:
                    yield counts(found)
                    found, held = [], 0
            if found:
                yield counts(found)

    return docs.where(~held_out()).select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "token bigint, n bigint")


def encode(docs: DataFrame, words: np.ndarray) -> DataFrame:
    """Of training documents: (turn, size, ids), all words of each and its end as the numbers that the network reads, in two bytes each (four for larger vocabularies)."""
    shared = docs.sparkSession.sparkContext.broadcast(Numbers(words))
    kind = number_type(len(words))

    def run(batches):
        numbers = shared.value
        end = int(numbers.of(np.array([END]))[0])
        for batch in batches:
            turns, column = batch.columns
            for t in kernels.slices(column):
                hashes, first = _tokens(t)
                lengths = np.diff(first) + 1
                ends = np.cumsum(lengths)
                flat = np.full(len(hashes) + len(lengths), end, kind)
                inner = np.ones(len(flat), bool)
                inner[ends - 1] = False
                flat[inner] = numbers.of(hashes)
                data, at = flat.tobytes(), [0, *(ends * kind.itemsize).tolist()]
                ids = pa.array([data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([turns.slice(t.low, t.high - t.low), pa.array(lengths, pa.int64()), ids], names=["turn", "size", "ids"])

    # repeated ids differ by their texts; rows without an id by their place, so that no number of them meets in one trainer
    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    turn = F.xxhash64(F.lit("run"), F.col("doc_id").cast("string"), F.xxhash64("text"), place).bitwiseAND(2**62 - 1)
    return docs.where(~held_out()).select(turn.alias("turn"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "turn bigint, size bigint, ids binary")


def number_type(m: int) -> np.dtype:
    return np.dtype("<u2" if m + 1 < 2**16 else "<u4")


def commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and counts above a count that at most `most` tokens reach, commonest first. Found by a histogram of some hundred buckets, so that no more rows come to the driver."""
    bucket = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    left, least = most, None
    for b, n in sorted((tuple(r) for r in counts.groupBy(bucket.alias("b")).count().collect()), reverse=True):
        if n > left:
            break
        left, least = left - n, b
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(bucket >= least).select("token", "n").toArrow()
    tokens, n = got["token"].to_numpy(), got["n"].to_numpy()
    order = np.lexsort((tokens, -n))
    return tokens[order], n[order]


def train(encoded: DataFrame, net: Net) -> int:
    """Train net's weights on all tokens of encoded documents (turn, size, ids). Returns the number of tokens learnt from."""
    m, kind = net.m, number_type(net.m)
    n_docs, n_tokens = encoded.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    trainers = max(1, round(n_docs / ROUNDS / TRAINER_DOCS), math.ceil(n_tokens / ROUNDS / TRAINER_TOKENS))
    context = encoded.sparkSession.sparkContext
    schema = T.StructType.fromDDL("trainer bigint, docs bigint, tokens bigint, weights binary")
    learnt = 0
    for turn in range(ROUNDS):
        shared = context.broadcast(net)

        def one(table: pa.Table) -> pa.Table:
            table = table.sort_by("turn")
            docs = [np.frombuffer(x.as_buffer(), kind) for x in table["ids"]]
            own = Net(np.ones(m), 1.0)
            own.load(shared.value.dump())
            tokens = own.train(docs)
            return pa.table({"trainer": table["trainer"][:1].cast(pa.int64()), "docs": pa.array([len(docs)], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "weights": pa.array([own.dump()], pa.binary())})

        def average(table: pa.Table) -> pa.Table:
            docs = table["docs"].to_numpy()
            total = sum(np.frombuffer(w.as_py(), "<f4") * float(n) for w, n in zip(table["weights"], docs, strict=True)) / docs.sum()
            return pa.table({"trainer": table["next"][:1], "docs": pa.array([int(docs.sum())], pa.int64()), "tokens": pa.array([sum(table["tokens"].to_pylist())], pa.int64()), "weights": pa.array([total.astype("<f4").tobytes()], pa.binary())})

        part = encoded.where(F.pmod(F.xxhash64("turn"), F.lit(ROUNDS)) == turn).withColumn("trainer", F.pmod(F.xxhash64(F.lit("trainer"), "turn"), F.lit(trainers)))
        models = materialise(part.groupBy("trainer").applyInArrow(one, schema), "models")
        left = trainers
        while left > 1:
            models = materialise(models.withColumn("next", F.floor(F.col("trainer") / FAN)).groupBy("next").applyInArrow(average, schema), "models")
            left = -(-left // FAN)
        got = models.select("weights", "tokens").head(1)
        if got:
            net.load(bytes(got[0][0]))
            learnt += got[0][1]
    return learnt


def score_texts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    counts = materialise(gather(docs).groupBy("token").agg(F.sum("n").alias("n")), "counts")
    size = counts.agg(F.sum("n"), F.count("*")).first()
    total, distinct = size[0] or 0, size[1]
    tokens, known = commonest(counts, KNOWN)
    m = min(WORDS, len(tokens))
    rest = (total - int(known[:m].sum())) + 0.1 * (distinct - m + 1)
    whole = total + 0.1 * (distinct + 1)
    net = Net(known[:m] + 0.1, rest)
    train(materialise(encode(docs, tokens[:m]), "encoded"), net)
    shared = spark.sparkContext.broadcast((net, Numbers(tokens), known))

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("held_out boolean, n_tokens bigint, n_known bigint, base double, model double, others array<struct<token:bigint,n:bigint>>").fields])

    def run(batches):
        model, number_of, n_of = shared.value
        base_log = np.log10(np.append(n_of + 0.1, 1.0))  # an unknown word's share is joined later
        for batch in batches:
            ids, held, column = batch.columns
            for t in kernels.slices(column, 8 << 20):
                hashes, first = _tokens(t)
                n_docs = len(first) - 1
                # the tokens of each document and its end
                lengths = np.diff(first) + 1
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                flat = np.full(len(hashes) + n_docs, END)
                inner = np.ones(len(flat), bool)
                inner[starts + lengths - 1] = False
                flat[inner] = hashes
                found = number_of.of(flat)
                doc = np.repeat(np.arange(n_docs), lengths)
                base = np.bincount(doc, base_log[found], minlength=n_docs) - lengths * math.log10(whole)
                numbers = np.minimum(found, model.m)
                score = model.score(numbers, starts, lengths) / math.log(10)
                rare = found >= model.m
                score += np.bincount(doc, np.where(rare, base_log[found] - math.log10(rest), 0.0), minlength=n_docs)
                other = np.flatnonzero(found == len(n_of))
                n_known = lengths - np.bincount(doc[other], minlength=n_docs)
                of, word = doc[other], flat[other]
                order = np.lexsort((word, of))
                of, word = of[order], word[order]
                new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(word, prepend=0) != 0))
                times = np.diff(new, append=len(of))
                ends = np.searchsorted(of[new], np.arange(n_docs + 1))
                structs = pa.StructArray.from_arrays([pa.array(word[new], pa.int64()), pa.array(times, pa.int64())], names=["token", "n"])
                others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
                part = slice(t.low, t.high)
                yield pa.RecordBatch.from_arrays([ids[part], held[part], pa.array(lengths), pa.array(n_known), pa.array(base), pa.array(score), others], names=schema.names)

    rows = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    each = rows.select("row", F.explode("others").alias("o")).select("row", "o.token", F.col("o.n").alias("times"))
    joined = each.join(counts.where(~F.col("token").isin(START)).select("token", "n"), "token", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("found")
    )
    more, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return rows.join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + found).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score")
    )
