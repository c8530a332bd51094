"""SimHash links, spelling variants and hard negatives against plain Python versions, on the smallest tables and on odd rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from talkscale.llm import negatives, simhash, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module", params=["docs", "odd", "empty"])
def table(request):
    return request.getfixturevalue(request.param)


def fingerprint(text, size):
    words = WORD.findall(lower(text))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(n, links, ids):
    """For each of n nodes the smallest id, null last, of its component."""
    top = list(range(n))

    def find(i):
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for a, b in links:
        top[find(a)] = find(b)
    best = {}
    for i in range(n):
        if ids[i] is not None:
            best[find(i)] = min(ids[i], best.get(find(i), ids[i]))
    return [best.get(find(i)) for i in range(n)]


def test_simhash(table):
    rows, most = table.collect(), 20
    prints = [fingerprint(r.text, 3) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    want = [(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, smallest(len(rows), links, [r.doc_id for r in rows]), strict=True)]
    got = simhash.link_near_copies(table, size=3, most=most).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_majority():
    rng = np.random.default_rng(0)
    sizes = np.array([0, 1, 2, 255, 256, 3000, 0, 7])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 2**64, bounds[-1], dtype=np.uint64)
    for i, got in enumerate(simhash.majority(hashes, bounds)):
        own = [int(h) for h in hashes[bounds[i] : bounds[i + 1]]]
        assert int(got) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


@pytest.mark.parametrize("kind", ["even", "low bits", "high bits", "few bits", "families"])
def test_trie_in_a_task(kind):
    """Links between parts of any fingerprints join what all links join, and each is one."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 300):
        prints = rng.integers(0, 2**64, n, dtype=np.uint64)
        if kind in ("low bits", "high bits"):
            prints = prints & np.uint64(0xFFF) if kind == "low bits" else prints >> np.uint64(52) << np.uint64(52)
        elif kind == "few bits":
            prints = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4, n)).astype(np.uint64), axis=0)
        elif kind == "families":
            prints = prints[rng.integers(0, 1 + n // 50, n)]
            for _ in range(4):
                prints = prints ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        prints = np.unique(prints)
        want, got = simhash.Forest(len(prints)), simhash.Forest(len(prints))
        for i in range(len(prints)):
            near = np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 3)
            want.join(np.full(len(near), i), near)
        parts = [p for k in range(3) if len(p := prints[prints % np.uint64(3) == k])]
        for i, a in enumerate(parts):
            for b in (None, *parts[i + 1 :]):
                x, y = simhash.joining_links(a, b, 3)
                assert (np.bitwise_count(x ^ y) <= 3).all() and len(x) < len(a) + len(b if b is not None else ())
                got.join(np.searchsorted(prints, x), np.searchsorted(prints, y))
        assert (want.top == got.top).all()


def test_trie_of_a_large_family(spark):
    """A node with all fingerprints is cut as deep as needed; a family makes no more links than members."""
    rng = np.random.default_rng(2)
    prints = np.unique(np.uint64(0xABCDEF0123456789) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 20, (3, 3000)).astype(np.uint64), axis=0))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print bigint").repartition(4)
    nodes = simhash.cut(df, len(prints), 64)
    got = {(r.depth, r.node): r.prints for r in nodes.collect()}
    assert sorted(x for own in got.values() for x in own) == sorted(prints.view(np.int64).tolist()) and max(map(len, got.values())) <= 64
    links = simhash.links(df, 3, most=64).collect()
    forest = simhash.Forest(len(prints))
    ends = [np.searchsorted(prints, np.array([r[k] for r in links], np.int64).view(np.uint64)) for k in (0, 1)]
    forest.join(*ends)
    assert len(set(forest.top.tolist())) == 1


def apart(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    n = collections.Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    near = {w: [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_length[k] if apart(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), n[w], len(near[w]), form[w] and n[form[w]]) for w in n]


def test_spelling_variants(table):
    got = spelling.spelling_variants(table, most=20)
    assert sorted(map(tuple, got.collect())) == sorted(variants(table.collect()))


def test_spelling_blocks(spark):
    """Dense words with accents, long ones, chains of forms: all pairs are found whatever a block may hold."""
    rnd = random.Random(4)
    words = {"".join(rnd.choice("aéz") for _ in range(rnd.choice((7, 8, 9)))) for _ in range(500)} | {"x" * k for k in range(60, 70)} | {"y" * 3000, "y" * 3001, "y" * 2999 + "z"}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint").repartition(4)
    want = {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and apart(a, b)}
    for most in (2, 50):
        got = [(r.word, r.near) for r in spelling.near_words(df, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(12)], "word string, form string")
    assert {r.root for r in spelling.last_forms(chain).collect()} == {"w12"}


def mined(rows):
    kept = []
    for vec_id, x, label in rows:
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((vec_id, [math.floor(256 * float(c)) for c in x], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    last = lambda v: math.inf if v is None else v
    out = []
    for i, (a, u, label) in enumerate(kept):
        if a is None or a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(u, v, strict=False)), last(b), c, j) for j, (b, v, c) in enumerate(kept) if j != i]
        for less, b, *_ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted(s for s in scored if s[2] != label and -30 * less <= -100 * s[0] <= -90 * less)[:10]
            out += [(a, b, k + 1, s[1], -less, -s[0]) for k, s in enumerate(fits)]
    return sorted(out)


def found(df):
    none = lambda v: math.inf if v is None else v
    return sorted((r.anchor_id, none(r.positive_id), r.rank, none(r.negative_id), r.positive_score, r.negative_score) for r in negatives.mine_hard_negatives(df).collect())


EMBEDDINGS = "vec_id bigint, embedding array<float>, label int, key bigint, rank int, v string"


@pytest.fixture
def small_lists(monkeypatch):
    """Many lists of many blocks, few of which are visited at first."""
    for name, value in (("BLOCK", 8), ("COVERED", 2), ("BATCH", 4), ("FIRST", 2)):
        monkeypatch.setattr(negatives, name, value)


def test_hard_negatives(spark, small_lists):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert found(df) == mined([(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_hard_negatives_of_odd_rows(spark, small_lists):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(c) for c in rng.normal(size=3)], int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, [1.0, 0.5, 0.25], i % 2) for i in range(60)]  # one vector, very often
    rows += [(300, [0.0, 0.0, 0.0], 0), (400, [1.0], 1), (500, [], 1), (600, None, 1), (700, [1.0, 1.0, 1.0], None), (800, [1.0, None, 1.0], 1), (900, [float("nan"), 1.0, 1.0], 1), (1000, [float("inf"), 1.0, 1.0], 1)]
    rows += [(None, [1.0, 0.5, 0.25], 1), (None, [1.0, 0.5, 0.25], 2), (1100, [1000.0, -2000.0, 3.0], 2), (-100, [0.5, 0.5, 0.5], -3), *rows[:3], rows[100]]
    df = spark.createDataFrame([(*r, 1, 2, "v") for r in rows], EMBEDDINGS).repartition(5)
    assert found(df) == mined(rows)
    assert found(df.where("vec_id IS NULL")) == found(df.limit(0)) == []
    huge = spark.createDataFrame([(100, [3e38, 1.0], 1, 1, 2, "v")], EMBEDDINGS)
    assert found(df.unionByName(huge)) == mined(rows)  # takes no part, as stated


def test_bounds_hold(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (500, 8))
    df = spark.createDataFrame([(i, i, 0, [int(c) for c in v]) for i, v in enumerate(x)], "key bigint, vec_id bigint, label bigint, v array<int>")
    lists, blocks = negatives.indexed(df)
    a = rng.integers(-300, 300, (20, 8))
    least, most = lists.bounds(a)
    seen = 0
    for r in blocks.select("list", "rows.v").collect():
        score = a @ np.array(r.v).T
        seen += len(r.v)
        assert (score >= least[:, r["list"], None]).all() and (score <= most[:, r["list"], None]).all()
    assert seen == 500
