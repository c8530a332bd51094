"""Exact self-join of documents by the Jaccard similarity of their word shingles: a grouped prefix join.

Equal sets are one class from the start. Shingles are ordered by their number of classes, rare ones first; two sets that
link must share one of the first n - ceil(t n) + 1 of each. Counting all shingles isn't needed: those with a hash below a
cut (twice the prefix's share) come first in the order, by count, then the others by hash, and only the first are counted.
A class whose prefix holds only shingles of its own links with nothing and is done.

Classes with the same size and the same shared prefix form a group, and postings list groups. Families of near copies are
joined first, at linear cost: in each of PIVOT_ROUNDS rounds every item of a posting is held against the posting's PIVOTS
pivots, and pairs that lie in one component already or whose sketches differ too much go no further. Then items outside of
a posting's largest component are held against its other items: pairs of different components that pass the filters of size,
position and sketch are expanded to members and verified on the whole sets, so components are exact.

Null and empty texts have no shingles and link with nothing. A text of fewer words than a shingle is one shingle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkscale.llm import kernels
from talkscale.llm.common import add_columns, discard, materialise

#: Up to so many classes (16 bytes each and their ids) are broadcast to pick whole sets; beyond it they are joined by key.
BROADCAST_CLASSES = 200_000
#: Rounds of pivots, and pivots of a posting in each; what they don't join is left to the comparison of all items that may link.
PIVOT_ROUNDS, PIVOTS = 3, 8
#: A posting knows up to so many tokens that stand before it in the prefix.
FIRST = 16
#: Words of 64 parity bits in a set's sketch; two sets differ in at least as many shingles as their sketches in bits.
SKETCH = 8
BITS = [f"b{i}" for i in range(SKETCH)]


def _needed(n, percent: int):
    """The least intersection of a set of n with any that it links with."""
    return (percent * n + 99) // 100


def _cut(percent: int) -> int:
    return min(int(2 * (100 - percent) / 100 * 2**63), 2**63 - 1)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _sets(t: kernels.Texts, size: int):
    """Sorted 63-bit hashes and a 16-byte fingerprint of each text's set."""
    for s in kernels.shingle_sets(t, size):
        s = np.unique(s >> np.uint64(1))
        a, b = kernels.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), kernels.mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
        yield s.astype(np.int64), np.array([a, b, len(s)], "<u8").tobytes()[:20]


def _first_part(size: int, percent: int):
    cut = _cut(percent)

    def kernel(t):
        parts, prints, counts, below, sketches = [], [], [], [], []
        for s, mark in _sets(t, size):
            n = len(s)
            low = int(np.searchsorted(s, cut))
            parts.append(s[: max(low, n - int(_needed(n, percent)) + 1) if n else 0])
            prints.append(mark)
            counts.append(n)
            below.append(low)
            parity = np.bincount((s >> 8) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
            sketches.append(np.packbits(parity.astype(np.uint8)).view("<i8"))
        return [counts, below, pa.array(prints, pa.binary()), _lists(parts), *np.array(sketches).reshape(-1, SKETCH).T]

    return kernel


def _whole(size: int):
    def kernel(t):
        both = list(_sets(t, size))
        return [pa.array([m for _, m in both], pa.binary()), _lists([s for s, _ in both])]

    return kernel


def _may_link(n1: Column, n2: Column, percent: int) -> Column:
    return percent * F.greatest(n1, n2) <= 100 * F.least(n1, n2)


def _may_differ(n1: Column, n2: Column, sketch1, sketch2, percent: int) -> Column:
    """Whether the sketches allow as few differences as a link does."""
    bits = sum((F.bit_count(sketch1(b).bitwiseXOR(sketch2(b))) for b in BITS), F.lit(0))
    overlap = F.ceil((n1 + n2) * percent / (100 + percent) - 1e-9)
    return bits <= n1 + n2 - 2 * overlap


def _items_may_differ(n1: Column, n2: Column, item1, item2, percent: int) -> Column:
    """The same of items of several sets: bits that all sets of one have and none of the other differ between any two."""
    apart = lambda x, y, b: x(f"all_{b}").bitwiseAND(F.bitwise_not(y(f"any_{b}")))
    bits = sum((F.bit_count(apart(item1, item2, b).bitwiseOR(apart(item2, item1, b))) for b in BITS), F.lit(0))
    overlap = F.ceil((n1 + n2) * percent / (100 + percent) - 1e-9)
    return bits <= n1 + n2 - 2 * overlap


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of edges (a, b). Each round hooks a node to its smallest neighbour and contracts the edges, so that those inside what is joined already go at once."""
    left = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    roots = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("up"))
        up = hooks.select(F.col("node").alias("at"), F.col("up").alias("next"))
        hooks = materialise(hooks.join(up, hooks["up"] == up["at"], "left").select("node", F.coalesce("next", "up").alias("up")), "hooks")
        one, two = hooks.select(F.col("node").alias("a"), F.col("up").alias("ua")), hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        rest = left.join(one, "a").join(two, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        rest = materialise(rest, "edges")
        if roots is None:
            roots = hooks.select("node", F.col("up").alias("root"))
        else:
            step = hooks.select(F.col("node").alias("at"), "up")
            roots = materialise(roots.join(step, roots["root"] == step["at"], "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        discard(left)
        left = rest
        if not left.head(1):
            return roots


class _Join:
    """One run of the join; tables are written, so that each is made once."""

    def __init__(self, docs: DataFrame, size: int, percent: int) -> None:
        self.docs, self.size, self.percent = docs, size, percent
        sets = materialise(add_columns(docs, ["doc_id"], "text", "n bigint, below bigint, mark binary, part array<bigint>, " + ", ".join(f"{b} bigint" for b in BITS), _first_part(size, percent)), "sets")
        classes = sets.where("n > 0").groupBy("mark").agg(F.min("doc_id").alias("first_doc"), *[F.first(c).alias(c) for c in ("n", "below", "part", *BITS)])
        self.classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
        self.sets = materialise(sets.select("doc_id", "n", "mark"), "sizes")
        discard(sets)

    def prefixes(self) -> DataFrame:
        """(class, n, alone, prefix): the shared shingles of each prefix in order, and how many unshared come first; classes without any are left out."""
        tokens = self.classes.select("class", F.explode("part").alias("token"))
        shared = tokens.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1")
        low = F.col("token") < _cut(self.percent)
        kept = tokens.join(shared, "token").groupBy("class").agg(
            F.sort_array(F.collect_list(F.when(low, F.struct("classes", "token")))).alias("low"), F.sort_array(F.collect_list(F.when(~low, F.col("token")))).alias("high")
        )
        joined = self.classes.select("class", "n", "below").join(kept, "class")
        length = F.col("n") - F.floor((self.percent * F.col("n") + 99) / 100) + 1
        alone = F.col("below") - F.size("low")
        room = F.greatest(length - alone, F.lit(0)).cast("int")
        low_tokens = F.transform("low", lambda x: x["token"])
        prefix = F.when(F.col("below") >= length, F.slice(low_tokens, F.lit(1), room)).otherwise(F.concat(low_tokens, F.col("high")))
        return joined.select("class", "n", alone.alias("alone"), prefix.alias("prefix")).where(F.size("prefix") > 0)

    def whole_sets(self, members: DataFrame) -> DataFrame:
        wanted = members.select("class").join(self.classes, "class").select("class", F.col("mark").alias("_mark"), F.col("first_doc").alias("_doc"))
        if members.count() <= BROADCAST_CLASSES:
            wanted = F.broadcast(wanted)
        found = add_columns(self.docs, ["doc_id"], "text", "mark binary, tokens array<bigint>", _whole(self.size))
        found = found.join(wanted, (found["mark"] == F.col("_mark")) & found["doc_id"].eqNullSafe(F.col("_doc")))
        return materialise(found.groupBy("class").agg(F.first("tokens").alias("tokens")), "whole")

    def verify(self, pairs: DataFrame, whole: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link. Only sets that a pair needs are moved."""
        pairs = materialise(pairs.distinct(), "pairs")
        needed = materialise(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "needed")
        own = whole.join(needed, "class", "left_semi")
        left, right = own.select(F.col("class").alias("a"), F.col("tokens").alias("ta")), own.select(F.col("class").alias("b"), F.col("tokens").alias("tb"))
        both = F.size(F.array_intersect("ta", "tb")).cast("bigint")
        links = materialise(pairs.join(left, "a").join(right, "b").where(100 * both >= self.percent * (F.size("ta") + F.size("tb") - both)).select("a", "b"), "links")
        discard(pairs)
        discard(needed)
        return links

    def components(self) -> DataFrame:
        """(node, root) of all classes that share a prefix's shingle with another; the root is the smallest class of the component."""
        prefixes = materialise(self.prefixes(), "prefixes")
        groups = prefixes.groupBy("n", "prefix").agg(F.min("class").alias("group"), F.min("alone").alias("alone"))
        groups = materialise(groups, "groups")
        members = prefixes.join(groups.select("n", "prefix", "group"), ["n", "prefix"]).select("class", "group", "n")
        members = materialise(members.join(self.classes.select("class", *BITS), "class"), "members")
        postings = groups.select("group", "n", F.posexplode("prefix").alias("i", "token"), "alone", "prefix")
        before = F.when(F.col("i") <= FIRST, F.slice("prefix", F.lit(1), F.col("i"))).otherwise(F.array().cast("array<bigint>"))
        postings = materialise(postings.select("token", "group", (F.col("i") + F.col("alone")).alias("at"), before.alias("before")), "postings")
        whole = self.whole_sets(members)
        items = members.withColumn("root", F.col("class"))
        # each group's members with its first one: copies that differ in few shingles, all of them beyond the prefix
        firsts = members.where("class <> group").select("group", "class", "n", *BITS).join(members.where("class = group").select(F.col("group"), *[F.col(b).alias(f"f_{b}") for b in BITS]), "group")
        edges = firsts.where(_may_differ(F.col("n"), F.col("n"), F.col, lambda b: F.col(f"f_{b}"), self.percent)).select(F.col("group").alias("a"), F.col("class").alias("b"))
        for turn in range(PIVOT_ROUNDS):
            listed = self._listed(postings.drop("before"), items)
            pairs = self._pivots(listed, turn)
            links = self.verify(pairs if turn else pairs.unionByName(edges), whole)
            discard(listed)
            items = self._joined(items, links)
        listed = self._listed(postings, items)
        links = self.verify(self._across(listed, items), whole)
        for spent in (listed, postings, whole):
            discard(spent)
        items = self._joined(items, links)
        return items.select(F.col("class").alias("node"), "root")

    def _joined(self, items: DataFrame, links: DataFrame) -> DataFrame:
        """items with the roots that links between classes (a, b) leave. Of components so far only their roots matter."""
        if not links.head(1):
            return items
        ends = items.select("class", "root")
        edges = links.join(ends.select(F.col("class").alias("a"), F.col("root").alias("ra")), "a").join(ends.select(F.col("class").alias("b"), F.col("root").alias("rb")), "b")
        roots = connected(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
        return materialise(items.join(roots, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"), "items")

    def _listed(self, postings: DataFrame, items: DataFrame) -> DataFrame:
        """Postings of more than one component: token and its items (group, root), the members of a group that lie in one component, with the bits that all or any of them have; major tells whether the root is the posting's most frequent one."""
        alike = [F.bit_and(b).alias(f"all_{b}") for b in BITS] + [F.bit_or(b).alias(f"any_{b}") for b in BITS]
        listed = materialise(postings.join(items.groupBy("group", "n", "root").agg(F.min("class").alias("class"), *alike), "group"), "listed")
        per_root = listed.groupBy("token", "root").agg(F.count("*").alias("m"))
        most = per_root.groupBy("token").agg(F.max(F.struct("m", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
        most = most.select("token", F.col("most.root").alias("major"))
        still = materialise(listed.join(most, "token").withColumn("major", F.col("root") == F.col("major")), "open")
        discard(listed)
        return still

    def _pivots(self, listed: DataFrame, seed: int) -> DataFrame:
        """(a, b): each item of a posting with those of the posting's PIVOTS pivots of about its size that lie in other components and may link."""
        band = F.floor(F.log(F.col("n").cast("double")) / 0.2 + 0.5 * seed)  # the bounds between bands move from round to round
        keyed = listed.withColumn("band", band)
        # some copies have too many edits to be good pivots, so the same family takes others at other tokens
        turn = F.xxhash64(F.lit(seed), F.col("class"), F.col("token") % (8 if seed else 1))
        held = ["class", "n", "root", *[f"{k}_{b}" for k in ("all", "any") for b in BITS]]
        first = keyed.groupBy("token", "band", F.pmod(turn, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(turn.alias("turn"), *held)).alias("pivot"))
        pivots = first.groupBy("token", "band").agg(F.collect_list("pivot").alias("pivots"))  # at most one for each slot
        fits = lambda p: (F.col("root") != p["root"]) & _may_link(F.col("n"), p["n"], self.percent) & _items_may_differ(F.col("n"), p["n"], F.col, lambda c: p[c], self.percent)
        near = keyed.join(pivots, ["token", "band"]).select("class", F.explode(F.filter("pivots", fits)["class"]).alias("p"))
        return near.select(F.least("class", "p").alias("a"), F.greatest("class", "p").alias("b"))

    def _across(self, listed: DataFrame, items: DataFrame) -> DataFrame:
        """(a, b): the pairs of members of a posting's items that lie in different components and pass the filters of size, position and sketch.

        Of two items one isn't in the posting's most frequent component, so only these are held against the rest. The band
        of sizes is part of the key. A pair is made at the first token that the two prefixes share (and at any that stands
        behind FIRST others).
        """
        band = F.floor(F.log(F.col("n").cast("double")) / max(math.log(100 / self.percent) * (1 + 1e-9), 1e-3))  # sizes that may link are one band apart at most
        one = listed.where("NOT major").withColumn("band", band).alias("x")
        two = listed.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("y")
        x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
        overlap = F.ceil((x("n") + y("n")) * self.percent / (100 + self.percent) - 1e-9)
        after = F.least(x("n") - x("at"), y("n") - y("at"))
        order = y("major") | (x("group") < y("group")) | ((x("group") == y("group")) & (x("root") < y("root")))
        like = _may_link(x("n"), y("n"), self.percent) & (after >= overlap) & _items_may_differ(x("n"), y("n"), x, y, self.percent) & ~F.arrays_overlap(x("before"), y("before"))
        near = one.join(two, (x("token") == y("token")) & (x("band") == y("band")) & (x("root") != y("root")) & order & like)
        near = near.select(x("group").alias("g"), x("root").alias("r"), y("group").alias("h"), y("root").alias("s")).distinct()
        side = lambda g, r, c, p: items.select(F.col("group").alias(g), F.col("root").alias(r), F.col("class").alias(c), F.col("n").alias(f"{p}n"), *[F.col(b).alias(f"{p}{b}") for b in BITS])
        left, right = side("g", "r", "a", "l"), side("h", "s", "b", "r_")
        first = near.join(left, ["g", "r"])
        like = _may_differ(F.col("ln"), F.col("r_n"), lambda c: F.col(f"l{c}"), lambda c: F.col(f"r_{c}"), self.percent)
        return first.join(right, (first["h"] == right["h"]) & (first["s"] == right["s"]) & like).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def link_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach). Two documents link if 100 * intersection >= percent * union of their sets of size-word shingles, words lower-cased in A-Z."""
    run = _Join(docs, size, percent)
    roots = run.components()
    placed = run.classes.select("class", "mark", "first_doc").join(roots, F.col("class") == F.col("node"), "left").select("mark", "first_doc", F.coalesce("root", "class").alias("root"))
    placed = materialise(placed, "placed")
    tops = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    labelled = placed.join(tops, "root").select("mark", "component_id")
    sizes = run.sets.select("doc_id", "n", "mark")
    # one row per set; copies of a set may be many, so its hot keys go by broadcast
    from talkscale.llm.common import join_by_hot_key

    counted = labelled.join(sizes.groupBy("mark").agg(F.count("*").alias("docs")), "mark").withColumn("mark", F.hex("mark"))
    joined = join_by_hot_key(sizes.withColumn("mark", F.hex("mark")), counted, "mark", "docs", F.col("doc_id"), sizes.count())
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but one row of each component, with docs' own columns. The row with the smallest doc_id stays, one without a doc_id only if no other is there. Rows are known by a key written with them, so doc_id may repeat or be null."""
    keyed = materialise(docs.select(F.struct("*").alias("own"), F.monotonically_increasing_id().alias("key")), "keyed")
    linked = link_near_copies(keyed.select(F.col("key").alias("doc_id"), F.col("own.text").alias("text")), size, percent)
    linked = materialise(linked.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")), "linked")
    # most components are single rows, which need no further look
    several = linked.where("key <> component").select("component").distinct()
    members = linked.join(several, "component", "left_semi").join(keyed.select("key", F.col("own.doc_id").alias("doc_id")), "key")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    stays = members.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.key").alias("key"))
    dropped = materialise(members.select("key").join(stays, "key", "left_anti"), "dropped")
    if dropped.count() <= BROADCAST_CLASSES:
        dropped = F.broadcast(dropped)
    return keyed.join(dropped, "key", "left_anti").select("own.*")
