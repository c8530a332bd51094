"""Near duplicates by SimHash fingerprints: a self-join of their binary trie.

A fingerprint has a bit for each of the 64 bits that over half of a text's shingle hashes have set. The distinct
fingerprints are leaves of a binary trie, cut into nodes of at most `most` fingerprints; where a node holds more, it is
split STRIDE levels deeper, however often that takes. Pairs of nodes are walked down together from the root: their
differing bits add up, and a pair goes once they exceed the error budget. Spark walks the upper levels as joins of node
pairs with their children; each pair of cut nodes that is left is one row with both nodes' fingerprints, and the walk goes
on inside, level by level, down to pairs of small nodes whose fingerprints are compared.

Only components are asked for, so a pair of nodes whose fingerprints lie in one component already goes too: families of
near copies, however large, are joined by sorting first and cost no pairs. A task returns the links that joined something,
at most one for each of its fingerprints. Copies share a fingerprint and are never expanded.

Null and empty texts have fingerprint zero, which links like any other. Null doc_id counts last in a component: its id is
null only if all are. Repeated doc_ids each have their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkscale.llm import kernels
from talkscale.llm.common import add_columns, discard, join_by_hot_key, materialise, shuffle_partitions
from talkscale.llm.jaccard import connected

STRIDE = 4
#: Pairs of nodes with so many pairs of fingerprints at most are compared; pairs of nodes that are walked at once; hashes made at once.
COMPARED, WALKED, HASHED = 64, 1 << 17, 1 << 20
#: Bounds of the number of fingerprints in a node that is handed to a task.
LEAST, MOST = 2048, 65536


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits that over half of them have; zero for an empty run."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    parts = -(-n[full] // 255)  # so many ones fit in a byte
    first = np.cumsum(parts) - parts
    run = np.repeat(np.arange(len(full)), parts)
    cuts = bounds[:-1][full][run] + 255 * (np.arange(len(run)) - first[run])
    ones = np.zeros((len(full), 8, 8), np.int64)  # byte, bit
    for bit in range(8):
        lanes = np.add.reduceat(hashes >> np.uint64(bit) & np.uint64(0x0101010101010101), cuts)
        ones[:, :, bit] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    over = 2 * ones.reshape(len(full), 64) > n[full][:, None]
    out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _prints(size: int):
    def kernel(t):
        w = kernels.words(t)
        long = w.ends - w.starts
        solid = np.concatenate([[0], np.cumsum(long)])
        # the words in lower case, each with one space behind it
        joined = np.full(int(solid[-1]) + len(long), 32, np.uint8)
        within = np.arange(int(solid[-1])) + np.repeat(w.starts - solid[:-1], long)
        joined[np.arange(int(solid[-1])) + np.repeat(np.arange(len(long)), long)] = kernels._LOWER[t.data[within]]
        begin = solid[:-1] + np.arange(len(long))
        end = begin + long
        data, count = joined.tobytes(), np.diff(w.first)
        shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
        bounds = np.concatenate([[0], np.cumsum(shingles)])
        text = np.repeat(np.arange(len(count)), shingles)
        at = w.first[:-1][text] + np.arange(len(text)) - bounds[:-1][text]
        low, high = begin[at], end[np.minimum(at + size, w.first[1:][text]) - 1]
        hashes = np.empty(len(at), np.uint64)
        digest = xxhash.xxh64_intdigest
        for k in range(0, len(at), HASHED):
            hashes[k : k + HASHED] = [digest(data[a:b], 42) for a, b in zip(low[k : k + HASHED].tolist(), high[k : k + HASHED].tolist(), strict=True)]
        return [majority(hashes, bounds).view(np.int64)]

    return kernel


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, print) of each document: the bits that over half of its shingles' hashes have, as a BIGINT."""
    return add_columns(docs, ["doc_id"], "text", "print bigint", _prints(size))


class Forest:
    """Components of n elements, each known by its smallest one."""

    def __init__(self, n: int) -> None:
        self.top, self.version = np.arange(n), 0

    def join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Join the components of x[i] and y[i]; which i did join something."""
        left, used = np.arange(len(x)), []
        while True:
            a, b = self.top[x[left]], self.top[y[left]]
            apart = a != b
            left, low, high = left[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            if not len(left):
                return np.concatenate(used) if used else np.zeros(0, np.int64)
            hook, where = np.unique(high, return_index=True)
            used.append(left[where])
            up = np.arange(len(self.top))
            up[hook] = low[where]  # always smaller, so no circle
            while True:
                further = up[up]
                if (further == up).all():
                    break
                up = further
            self.top, self.version = up[self.top], self.version + 1


class Trie:
    """Levels of the binary trie over sorted fingerprints: of each node where it starts, and its children by bit (-1: none). base is where its fingerprints stand in the forest."""

    def __init__(self, prints: np.ndarray, base: int) -> None:
        self.prints, self.base = prints, base
        self.starts, self.kids, self.tops = [np.zeros(1, np.int64)], [], {}

    def level(self, depth: int) -> np.ndarray:
        while len(self.starts) <= depth:
            d = len(self.starts)
            head = self.prints >> np.uint64(64 - d)
            starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
            parent = np.searchsorted(self.starts[-1], starts, "right") - 1
            kids = np.full((2, len(self.starts[-1])), -1)
            kids[(head[starts] & np.uint64(1)).astype(int), parent] = np.arange(len(starts))
            self.starts.append(starts)
            self.kids.append(kids)
        return self.starts[depth]

    def sizes(self, depth: int) -> np.ndarray:
        return np.diff(np.append(self.level(depth), len(self.prints)))

    def joined(self, depth: int, forest: Forest) -> np.ndarray:
        """Of each node the component that all its fingerprints lie in, or a number of its own below zero."""
        known = self.tops.get(depth)
        if known is None or known[0] != forest.version:
            own, starts = forest.top[self.base : self.base + len(self.prints)], self.level(depth)
            low, high = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
            known = self.tops[depth] = forest.version, np.where(low == high, low, -1 - self.base - np.arange(len(starts)))
        return known[1]


def _neighbours(prints: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Links found by sorting alone: fingerprints that stand side by side in the order of their bits, turned by some places."""
    found = []
    for turn in range(0, 64, 8):
        order = np.argsort(prints << np.uint64(turn) | prints >> np.uint64(64 - turn) if turn else prints, kind="stable")
        a, b = order[:-1], order[1:]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= errors
        found.append((a[near], b[near]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def joining_links(a: np.ndarray, b: np.ndarray | None, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all components of fingerprints at most errors bits apart: between a and b, or inside a where b is None. Inside a and b alone none is returned then."""
    one = Trie(np.sort(a), 0)
    two = one if b is None else Trie(np.sort(b), len(a))
    prints = one.prints if b is None else np.concatenate([one.prints, two.prints])
    forest, out = Forest(len(prints)), []

    def join(x: np.ndarray, y: np.ndarray) -> None:
        i = forest.join(x, y)
        out.append((prints[x[i]], prints[y[i]]))

    x, y = _neighbours(prints, errors)
    if b is not None:
        inside = (x < len(a)) == (y < len(a))
        forest.join(x[inside], y[inside])
        x, y = x[~inside], y[~inside]
    join(x, y)
    zero = np.zeros(1, np.int64)
    todo = [(0, zero, zero, zero)]
    while todo:
        depth, i, j, d = todo.pop()
        if len(i) > WALKED:
            todo += [(depth, i[k : k + WALKED], j[k : k + WALKED], d[k : k + WALKED]) for k in range(0, len(i), WALKED)]
            continue
        open_ = one.joined(depth, forest)[i] != two.joined(depth, forest)[j]
        if b is None:
            open_ |= (i == j) & (one.joined(depth, forest)[i] < 0)
        i, j, d = i[open_], j[open_], d[open_]
        n, m = one.sizes(depth)[i], two.sizes(depth)[j]
        small = n * m <= COMPARED
        if depth == 64:
            small[:] = True
        if small.any():
            pairs = (n * m)[small]
            row, k = np.repeat(np.flatnonzero(small), pairs), np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            x, y = one.level(depth)[i[row]] + k // m[row], two.level(depth)[j[row]] + k % m[row]
            near = np.bitwise_count(one.prints[x] ^ two.prints[y]) <= errors
            join(x[near], y[near] + two.base)
        i, j, d = i[~small], j[~small], d[~small]
        if not len(i):
            continue
        one.level(depth + 1), two.level(depth + 1)
        steps = []
        for p in (0, 1):
            for q in (0, 1):
                s, t, e = one.kids[depth][p][i], two.kids[depth][q][j], d + (p != q)
                good = (s >= 0) & (t >= 0) & (e <= errors)
                if b is None and p > q:
                    good &= i != j  # of a node with itself one order of its children is enough
                steps.append((s[good], t[good], e[good]))
        todo.append((depth + 1, *(np.concatenate(c) for c in zip(*steps, strict=True))))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _head(bits: Column | str, depth: int) -> Column:
    return F.shiftrightunsigned(bits, 64 - depth) if depth else F.lit(0).cast("bigint")


def cut(prints: DataFrame, n: int, most: int) -> DataFrame:
    """(depth, node, prints): the trie's nodes of at most most fingerprints as sorted arrays; node is their first depth bits. Nodes that hold more are cut STRIDE levels deeper. prints: n distinct fingerprints in column print."""
    depth = 0
    while n > most << depth and depth < 64:
        depth += STRIDE
    made, left = None, prints
    while True:
        at = materialise(left.select("print", _head("print", depth).alias("node")), "trie")
        sizes = at.groupBy("node").agg(F.count("*").alias("held"))
        ready = at.join(sizes.where(F.col("held") <= most), "node") if depth < 64 else at
        ready = materialise(ready.groupBy(F.lit(depth).alias("depth"), "node").agg(F.array_sort(F.collect_list("print")).alias("prints")), "nodes")
        made = ready if made is None else made.unionByName(ready)
        left = materialise(at.join(sizes.where(F.col("held") > most), "node", "left_semi").select("print"), "open") if depth < 64 else None
        discard(at)
        if left is None or not left.head(1):
            return made
        depth += STRIDE


def node_pairs(nodes: DataFrame, deepest: int, errors: int) -> DataFrame:
    """(d, a, e, b): the pairs of nodes (depth and bits of each) whose common bits differ in at most errors places, found by walking pairs down from the root."""
    above = lambda bits, by: F.call_function("shiftrightunsigned", F.col(bits) if isinstance(bits, str) else bits, by.cast("int"))
    step = lambda x: F.struct(x.alias("depth"), above("node", F.col("depth") - x).alias("node"), (x + STRIDE).alias("next"), above("node", F.col("depth") - x - STRIDE).alias("child"))
    steps = F.transform(F.sequence(F.lit(0), F.col("depth") - STRIDE, F.lit(STRIDE)), step)
    slim = nodes.select("depth", "node")
    inner = slim.where("depth > 0").select(F.explode(steps).alias("s")).select("s.*").distinct()
    kids = materialise(inner.unionByName(slim.select("depth", "node", F.col("depth").alias("next"), F.col("node").alias("child"))), "kids")
    side = lambda d, a: kids.select(F.col("depth").alias(d), F.col("node").alias(a), F.col("next").alias(f"{d}_"), F.col("child").alias(f"{a}_"))
    spark = nodes.sparkSession
    walked = spark.range(1).select(F.lit(0).alias("d"), F.lit(0).cast("bigint").alias("a"), F.lit(0).alias("e"), F.lit(0).cast("bigint").alias("b"))
    for _ in range(0, deepest, STRIDE):
        below = walked.join(side("d", "a"), ["d", "a"]).join(side("e", "b"), ["e", "b"])
        common = F.least("d_", "e_")
        differ = F.bit_count(above("a_", F.col("d_") - common).bitwiseXOR(above("b_", F.col("e_") - common)))
        twice = (F.col("d") == F.col("e")) & (F.col("a") == F.col("b")) & (F.col("a_") > F.col("b_"))
        walked = materialise(below.where((differ <= errors) & ~twice).select(F.col("d_").alias("d"), F.col("a_").alias("a"), F.col("e_").alias("e"), F.col("b_").alias("b")), "walked")
    return walked


def links(prints: DataFrame, errors: int, most: int | None = None) -> DataFrame:
    """(a, b): links that join the components of fingerprints (distinct, in column print) at most errors bits apart."""
    n = prints.count()
    if most is None:  # enough pairs of nodes for all tasks, and small enough for one
        most = min(MOST, max(LEAST, n // (2 * shuffle_partitions(prints.sparkSession))))
    nodes = cut(prints, n, most)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    pairs = node_pairs(nodes, deepest, errors)
    own = lambda d, a, p: nodes.select(F.col("depth").alias(d), F.col("node").alias(a), F.col("prints").alias(p))
    rows = pairs.join(own("d", "a", "left"), ["d", "a"]).join(own("e", "b", "right"), ["e", "b"])
    rows = rows.select("left", F.when((F.col("d") != F.col("e")) | (F.col("a") != F.col("b")), F.col("right")).alias("right"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (c[k].values for c in batch.columns)
                x, y = joining_links(*(None if v is None else v.to_numpy(zero_copy_only=False).view(np.uint64) for v in (a, b)), errors)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    # a row is a pair of nodes and takes some time, so rows are dealt out evenly
    return rows.repartition(4 * shuffle_partitions(prints.sparkSession), F.element_at("left", 1), F.element_at("right", 1)).mapInArrow(run, "a bigint, b bigint")


def link_near_copies(docs: DataFrame, size: int = 5, errors: int = 3, most: int | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id that links reach). Two documents link if their fingerprints over size-word shingles differ in at most errors bits; most bounds a trie node that a task takes."""
    marked = materialise(fingerprints(docs, size), "prints")
    own = materialise(marked.groupBy("print").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")), "distinct")
    edges = materialise(links(own.select("print"), errors, most), "links")
    roots = connected(edges).select(F.col("node").alias("print"), "root")
    discard(edges)
    placed = materialise(own.join(roots, "print"), "placed")  # those that link; the others are components of their own
    tops = placed.groupBy("root").agg(F.min("first").alias("top"), F.count("*").alias("prints"))
    joined = join_by_hot_key(placed.select("print", "root"), tops, "root", "prints", F.col("print"), placed.count())
    named = own.join(joined.select("print", F.struct("top").alias("t")), "print", "left").select("print", "docs", F.when(F.col("t").isNotNull(), F.col("t.top")).otherwise(F.col("first")).alias("component_id"))
    out = join_by_hot_key(marked.withColumn("row", F.monotonically_increasing_id()), named, "print", "docs", F.col("row"), marked.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
