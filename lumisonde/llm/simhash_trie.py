"""Near-duplicates by SimHash: a self-join of binary tries that visits pairs of nodes together.

*Codes.* A document's shingles are hashed; a bit of its code is 1 if set in over half
of the hashes. Equal codes are one node of the graph from here on, so exact copies
cost one row however many there are.

*Anchors.* Each anchor is a list of bits. Two codes meet in an anchor's table if they
agree on these bits. ``covering_anchors`` loses no pair within the budget: of so many
blocks, some choice of (blocks - budget) must be free of differences.
``sampled_anchors`` serves budgets too wide for that; its recall is a matter of chance
and of the number of anchors.

*Trie join.* The sorted codes of one key are a binary trie whose nodes are ranges.
Starting with the pair (root, root), a pair of nodes is replaced by the pairs of their
children; the bits in which the two paths differ add up, and a pair over the budget is
dropped with all below it. Pairs whose codes are all known to be connected are dropped
too, so a cluster of near copies is not expanded into all of its pairs. A task emits a
spanning forest: one row per code at most.

*Heavy keys.* A key with more codes than ``heavy`` is dealt out over its pairs of child
nodes eight bits further down, again and again, so no task holds an unbounded group.

*Near copies by similarity.* ``drop_near_copies`` uses codes only to propose. Its nodes are
distinct sets of shingles. Nodes meet if a band of minimum hashes is equal, which a pair
at the similarity asked for misses with probability MISSED at most. First each node is
paired with the least and the largest node of a band, and with the one that meets most others; then, by the trie join, with all
others it meets that are within a wide budget of bits and not connected yet; these rows carry their
sets, as a large band has many pairs and few of them are links. Every pair proposed is verified
by the exact Jaccard similarity of the two sets, and only verified pairs are links.

*Components.* Links from all tables are joined by alternating large-star and small-star
steps; each step is written to the shared folder.

Defined cases: null text counts as empty; a text without words has code zero and links
like any other; a text with fewer words than a shingle hashes the whole sequence;
repeated rows share a component; a null doc_id never is a component's smallest, and a
component of null ids only has component_id null; an empty table gives an empty table;
other columns are ignored by ``components`` and carried by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumisonde.llm.common import filter_of, fresh, split_by, words, written

SEED = 42
#: Codes of one key that one task takes at once; beyond, the key is dealt out over pairs of child nodes.
HEAVY = 20_000
#: Rows that a task joins in one go (whole keys), and node pairs that it expands in one go.
CHUNK_ROWS, CHUNK_PAIRS = 50_000, 100_000
#: The same for rows that carry their sets.
CHUNK_SETS = 5_000
#: Pairs of nodes with so few pairs of codes are compared code by code.
LEAF_PAIRS = 64

Anchors = list[list[int]]


def covering_anchors(bits: int, budget: int, blocks: int) -> Anchors:
    """Anchors of which any two codes within the budget share one: all choices of (blocks - budget) blocks."""
    if blocks <= budget:
        raise ValueError("more blocks than differing bits are needed")
    parts = [list(map(int, p)) for p in np.array_split(np.arange(bits), blocks)]
    return [sum(c, []) for c in combinations(parts, blocks - budget)]


def sampled_anchors(bits: int, size: int, tables: int, seed: int = 1) -> Anchors:
    """So many random choices of bits."""
    rng = np.random.default_rng(seed)
    return [sorted(map(int, rng.choice(bits, size, replace=False))) for _ in range(tables)]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w])
    k = min(shingle, len(w))
    starts = np.concatenate(([0], ends[: len(w) - k])).tolist()
    hashed = xxhash.xxh64_digest
    return np.frombuffer(b"".join([hashed(joined[s:e], SEED) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]), ">u8").astype(np.uint64)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Further 64 bits from each hash, by the finalizer of splitmix64."""
    z = h + np.uint64((lane * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """The code, eight bytes a lane, most significant bit first. The first lane uses the hashes as they are."""
    out, step = [], 1 << 16
    for lane in range(lanes):
        total = np.zeros(64, np.int64)
        for a in range(0, len(hashes), step):
            h = hashes[a : a + step] if not lane else _mixed(hashes[a : a + step], lane)
            total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
        out.append(np.packbits(2 * total > len(hashes)).tobytes())
    return b"".join(out)


def codes(docs: DataFrame, shingle: int, lanes: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (xxhash64 of the text), code per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [simhash(shingle_hashes(t, shingle), lanes) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["h"], pa.array(found, pa.binary())], names=["doc_id", "h", "code"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id long, h long, code binary")


# -- the join of tries, within a task ---------------------------------------------------


def _unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Makes label[i] the smallest index connected with i, given links u-v and labels so far."""
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its number and its members."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _near(words_: np.ndarray, i: np.ndarray, j: np.ndarray, budget: int) -> np.ndarray:
    return np.bitwise_count(words_[i] ^ words_[j]).sum(1, dtype=np.int32) <= budget


def trie_links(words_: np.ndarray, roots: np.ndarray, budget: int) -> np.ndarray:
    """label[i]: the smallest row that row i is connected with by steps of at most budget bits, between the pairs of ranges given.

    words_: (rows, lanes) of uint64, sorted within each range; roots: rows of
    (a_lo, a_hi, b_lo, b_hi), where a range paired with itself stands for its own pairs.
    """
    label = np.arange(len(words_))
    own = roots[(roots[:, 0] == roots[:, 2]) & (roots[:, 1] - roots[:, 0] > 1)]
    _, i = _expand(own[:, 0], own[:, 1] - own[:, 0] - 1)
    i = i[_near(words_, i, i + 1, budget)]  # neighbours in the order of the trie first: most of a cluster hangs together by them
    _unite(label, i, i + 1)
    for i, j in trie_pairs(words_, roots, budget, label):
        _unite(label, i, j)
    return label


def trie_pairs(words_: np.ndarray, roots: np.ndarray, budget: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of all pairs of rows within the budget whose labels differ, each pair once or twice; the labels may be united between batches."""
    lanes = words_.shape[1]
    ones: dict[int, np.ndarray] = {}
    stack = [(0, np.column_stack((roots, np.zeros(len(roots), np.int64))))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > CHUNK_PAIRS:
            stack += [(depth, pairs[CHUNK_PAIRS:])]
            pairs = pairs[:CHUNK_PAIRS]
        turns = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        a0, a1, b0, b1, d = pairs.T
        joined = (turns[a1 - 1] == turns[a0]) & (turns[b1 - 1] == turns[b0]) & (label[a0] == label[b0])
        pairs = pairs[~joined]
        a0, a1, b0, b1, d = pairs.T
        small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (depth == 64 * lanes)
        if small.any():
            s = pairs[small]
            owner, i = _expand(s[:, 0], s[:, 1] - s[:, 0])
            inner, j = _expand(s[owner, 2], (s[:, 3] - s[:, 2])[owner])
            i = i[inner]
            open_ = (i != j) & (label[i] != label[j])
            i, j = i[open_], j[open_]
            hit = _near(words_, i, j, budget)
            yield i[hit], j[hit]
            pairs = pairs[~small]
        if not len(pairs):
            continue
        if depth not in ones:
            if len(ones) > 32:
                ones.clear()
            bit = (words_[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        c = ones[depth]
        a0, a1, b0, b1, d = pairs.T
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = a0 == b0
        children = np.concatenate(
            [
                np.column_stack((a0, am, b0, bm, d)),
                np.column_stack((am, a1, bm, b1, d)),
                np.column_stack((a0, am, bm, b1, d + 1)),
                np.column_stack((am, a1, b0, bm, d + 1))[~same],
            ]
        )
        children = children[(children[:, 1] > children[:, 0]) & (children[:, 3] > children[:, 2]) & (children[:, 4] <= budget)]
        children = children[(children[:, 0] != children[:, 2]) | (children[:, 1] - children[:, 0] > 1)]
        if len(children):
            stack.append((depth + 1, children))


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of distinct numbers share so much of all their numbers."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) / len(y) < similarity:
        return False
    c = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return c / (len(x) + len(y) - c) >= similarity


#: Bins of the histograms that bound what two sets share, and pairs that are bounded at once.
BINS, BOUNDED = 256, 16_384


def histograms(sets: np.ndarray) -> np.ndarray:
    """How many numbers of each set fall into each bin; a set with more than fit in 16 bits has none and is not bounded."""
    out = np.zeros((len(sets), BINS), np.uint16)
    for k, s in enumerate(sets):
        n = np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS)
        out[k] = n if n.max(initial=0) < 1 << 16 else 0
    return out


def may_be_alike(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, bins: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs of sets can have a similarity: by their sizes, and by the most that they can share, which is the sum of the smaller counts of each bin."""
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    may = (small > 0) & (small >= similarity * large)
    for a in range(0, len(i), BOUNDED):
        at = a + np.flatnonzero(may[a : a + BOUNDED])
        shared = np.minimum(bins[i[at]], bins[j[at]]).sum(1, dtype=np.int64)
        counted = bins[i[at]].any(1) & bins[j[at]].any(1)
        may[at] = ~counted | (shared >= similarity * (sizes[i[at]] + sizes[j[at]] - shared) * (1 - 1e-12))
    return may


def _join_sorted(budget: int, lanes: int, chunk_rows: int, similarity: float = 0.0):
    """Rows sorted by group, side and code to (u, v): links of a spanning forest per group.

    With a similarity, rows also have a node, its component so far, and its set; a link is then a pair with that similarity.
    """
    known = similarity > 0

    def links(group: np.ndarray, side: np.ndarray, raw: np.ndarray, name: np.ndarray, part: np.ndarray, sets: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        ends = np.append(starts[1:], len(group))
        cross = side[starts] > 0  # side 0: a group paired with itself; sides 1 and 2: one with the other
        mid = ends - np.add.reduceat((side == 2).astype(np.int64), starts)
        roots = np.column_stack((starts, np.where(cross, mid, ends), np.where(cross, mid, starts), ends))
        roots = roots[(roots[:, 1] > roots[:, 0]) & (ends - starts > 1)]
        codes_ = raw.view(">u8").astype(np.uint64).reshape(-1, lanes)
        pick = lambda rows: pa.array([x.tobytes() for x in name[rows]], pa.binary())
        if known:
            found = []
            sizes, bins = np.array([len(x) for x in sets], np.int64), histograms(sets)
            for i, j in trie_pairs(codes_, roots, budget, part):
                may = may_be_alike(i, j, sizes, bins, similarity)  # all pairs, as arrays; what is left is compared
                for a, b in zip(i[may].tolist(), j[may].tolist()):
                    if part[a] != part[b] and _alike(sets[a], sets[b], similarity):
                        found.append((a, b))
                        part[part == part[b]] = part[a]
            u, v = (np.array(x, np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pick(u), pick(v)], names=["u", "v"])
            return
        label = trie_links(codes_, roots, budget)
        u = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pick(u), pick(label[u])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def together() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*held, strict=True)]

        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(b.num_rows, -1)
            name = np.frombuffer(b"".join(b["node"].to_pylist()), np.uint8).reshape(b.num_rows, -1) if known else raw
            part = b["part"].to_numpy().copy() if known else np.zeros(b.num_rows, np.int64)
            sets = np.empty(b.num_rows, object)
            if known:
                flat, ends = b["s"].flatten().to_numpy().view(np.uint64), np.cumsum(b["s"].value_lengths().to_numpy()).tolist()
                for k, (a, z) in enumerate(zip([0, *ends], ends)):
                    sets[k] = flat[a:z]
            held.append((b["grp"].to_numpy(), b["side"].to_numpy(zero_copy_only=False).astype(np.int64), raw, name, part, sets))
            rows += b.num_rows
            if rows >= chunk_rows:
                all_ = together()
                group = all_[0]
                last = int(np.searchsorted(-(group[::-1] == group[-1]).astype(np.int8), 0, "left"))
                cut = len(group) - last  # the last group may go on
                if cut:
                    yield from links(*(x[:cut] for x in all_))
                held, rows = [tuple(x[cut:] for x in all_)], last
        if rows:
            yield from links(*together())

    return run


def _keyed(nodes: DataFrame, anchors: Anchors) -> DataFrame:
    """(grp, side, code) per node and anchor; grp is a hash of the anchor's number and the bits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            code = b["code"]
            bits = np.unpackbits(np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)
            for t, anchor in enumerate(anchors):
                key = bits[:, anchor].astype(np.int64) @ (1 << np.arange(len(anchor), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(key), code], names=["t", "k", "code"])

    made = nodes.select("code").mapInArrow(run, "t int, k long, code binary")
    return made.select(F.xxhash64("t", "k").alias("grp"), F.lit(0).cast("byte").alias("side"), "code")


def _byte(code: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(code, i + 1, 1)), 16, 10).cast("int")


def _dealt(rows: DataFrame, budget: int, heavy: int, lanes: int) -> DataFrame:
    """Deals heavy groups out over pairs of child nodes, a byte of the code at a time.

    A row goes to the pairs of its own child with each child that differs in no more bits
    than the budget has left. Pairs of which one side is empty are dropped.
    """
    light = None
    carried = [c for c in rows.columns if c not in ("grp", "side")]
    rows = rows.withColumn("used", F.lit(0))
    for i in range(8 * lanes + 1):
        sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("side").alias("lo"), F.max("side").alias("hi"))
        sizes = written(sizes.where("size > 1 and (lo = 0 or lo < hi)").select("grp", "size"), "sizes")
        large = sizes.where(F.col("size") > heavy).select("grp")
        last = i == 8 * lanes or large.isEmpty()
        if last and light is None:
            return rows.drop("used")
        rest = rows.join(sizes.where(F.col("size") <= heavy) if not last else sizes, "grp", "left_semi").drop("used")
        light = rest if light is None else light.unionByName(rest)
        if last:
            return light
        own = rows.join(large, "grp", "left_semi").withColumn("b", _byte(F.col("code"), i))
        near = F.array(*[F.lit(x) for x in sorted(range(256), key=lambda x: (bin(x).count("1"), x)) if bin(x).count("1") <= budget])
        own = own.withColumn("x", F.explode(F.filter(near, lambda x: F.bit_count(x) + F.col("used") <= budget)))
        other = F.col("b").bitwiseXOR(F.col("x"))
        second = (F.col("side") == 2) | ((F.col("side") == 0) & (F.col("b") > other))
        p, q = F.when(second, other).otherwise(F.col("b")), F.when(second, F.col("b")).otherwise(other)
        side = F.when((F.col("side") == 0) & (F.col("x") == 0), 0).otherwise(F.when(second, 2).otherwise(1))
        used = (F.col("used") + F.bit_count("x")).cast("int")
        rows = written(own.select(F.xxhash64("grp", p, q, F.lit(i)).alias("grp"), side.cast("byte").alias("side"), *carried, used.alias("used")), "dealt")
    return light


def links(nodes: DataFrame, anchors: Anchors, budget: int, lanes: int = 1, heavy: int = HEAVY) -> DataFrame:
    """(u, v) between distinct codes: a spanning forest, per table, of all links within the budget."""
    rows = _dealt(_keyed(nodes, anchors), budget, heavy, lanes)
    ready = rows.repartition("grp").sortWithinPartitions("grp", "side", "code")
    return ready.mapInArrow(_join_sorted(budget, lanes, CHUNK_ROWS), "u binary, v binary")


def connected(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, root) of every node with a link, root being the smallest node of the component: alternating stars."""
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("u"), F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "stars")
        ends = new.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(new.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        e = new
        if ends.where("up > 1 or (up > 0 and down > 0)").isEmpty():  # every node hangs on one centre, and no centre on another
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("the components did not settle")


def assign(found: DataFrame, anchors: Anchors, budget: int, lanes: int = 1, heavy: int = HEAVY) -> DataFrame:
    """found (doc_id, h, code) with component_id, the smallest doc_id reachable, and root, the component's smallest code."""
    nodes = written(found.groupBy("code").agg(F.min("doc_id").alias("least")), "codes")
    roots = connected(links(nodes, anchors, budget, lanes, heavy))
    placed = nodes.join(roots, nodes["code"] == roots["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(ids, "root").select("code", "root", "component_id")
    return found.join(placed, "code")


def components(docs: DataFrame, shingle: int = 3, budget: int = 2, blocks: int = 4, heavy: int = HEAVY) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per document; loses no link."""
    found = written(codes(docs, shingle), "fingerprints")
    out = assign(found, covering_anchors(64, budget, blocks), budget, 1, heavy)
    return out.select("doc_id", F.lower(F.hex("code")).alias("fingerprint"), "component_id")


#: Documents that share 0.8 of their shingles: cosine 2J/(1+J) = 0.889, so 15.2 % of a code's bits differ on average. The budget
#: lies DEVIATIONS above that, as sets of four and five shingles differ in 18.8 %.
LANES, SIMILARITY, DEVIATIONS = 4, 0.8, 6
#: Minimum hashes of a band, and the probability with which a pair just at the similarity may have no band in common.
BAND, MISSED = 5, 1e-4


def bit_budget(similarity: float, lanes: int) -> int:
    """Bits of a code in which two documents of that Jaccard similarity differ on average."""
    return int(64 * lanes * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_budget(similarity: float, lanes: int) -> int:
    """The average and so many standard deviations more."""
    mean = bit_budget(similarity, lanes)
    return int(mean + DEVIATIONS * (mean * (1 - mean / (64 * lanes))) ** 0.5)


def bands_of(similarity: float) -> int:
    """The number of bands that two documents of that similarity all miss with probability MISSED at most."""
    return int(np.ceil(np.log(MISSED) / np.log(1 - similarity**BAND))) if similarity < 1 else 1


def band_keys(shingles: np.ndarray, bands: int) -> list[int]:
    """A key per band: a hash of its minimum hashes and its number; none for an empty set."""
    if not len(shingles):
        return []
    odd = np.random.default_rng(SEED).integers(2**63, size=bands * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(odd), 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[a : a + 1024, None] * odd).min(0), out=least)
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[8 * BAND * t : 8 * BAND * (t + 1)], t) - 2**63 for t in range(bands)]


def sketches(docs: DataFrame, shingle: int, lanes: int, bands: int) -> DataFrame:
    """doc_id, h (xxhash64 of the text), node (digest of the set of shingles), code of the set, keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (np.unique(shingle_hashes(t, shingle)) for t in b["text"].to_pylist())
            found = [(xxhash.xxh3_128_digest(s.tobytes()), simhash(s, lanes), band_keys(s, bands)) for s in sets]
            node, code, keys = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            cols = [b["doc_id"], b["h"], pa.array(node, pa.binary()), pa.array(code, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "node", "code", "keys"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return slim.mapInArrow(run, "doc_id long, h long, node binary, code binary, keys array<long>")


def _row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), F.xxhash64(docs["text"]))


def _same_row(docs: DataFrame, i: str, h: str) -> Column:
    return (F.xxhash64(docs["text"]) == F.col(h)) & docs["doc_id"].cast("long").eqNullSafe(F.col(i))


def shingle_sets(docs: DataFrame, found: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, s): the distinct shingle hashes of each of the nodes, from one of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["node"], pa.array(s, pa.list_(pa.int64()))], names=["node", "s"])

    one = found.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("x"))
    one = written(one.select("node", F.col("x.doc_id").alias("i"), F.col("x.h").alias("g")), "texts")
    slim, _ = split_by(docs.select("doc_id", "text"), _row_hash(docs), filter_of(one, F.xxhash64("i", "g")))
    texts = slim.join(one, _same_row(slim, "i", "g")).select("node", "text")
    return written(texts.mapInArrow(run, "node binary, s array<long>"), "shingles")  # a row that repeats is there twice; links are made distinct


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The distinct (u, v) of which the Jaccard similarity of the two sets is at least that."""
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    both = both.select("u", "v", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("c"))
    return written(both.where(F.col("c") / (F.col("n") + F.col("m") - F.col("c")) >= similarity).select("u", "v").distinct(), "verified")


def similar(docs: DataFrame, found: DataFrame, shingle: int, similarity: float, lanes: int, heavy: int = HEAVY) -> DataFrame:
    """(u, v) of nodes with at least that similarity, enough of them to connect all that such pairs connect."""
    nodes = found.groupBy("node").agg(F.first("code").alias("code"), F.first("keys").alias("keys"))
    rows = nodes.select("node", "code", F.explode("keys").alias("grp"))
    ends = rows.groupBy("grp").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    rows = written(rows.join(ends, "grp"), "met")
    # the node that meets most others: among copies of one text that text, to which all are closer than to each other
    met = rows.select("grp", "node").join(rows.groupBy("node").agg(F.sum("size").alias("met")), "node")
    centre = met.groupBy("grp").agg(F.max(F.struct("met", "node")).alias("x")).select("grp", F.col("x.node").alias("centre"))
    sets = shingle_sets(docs, found, rows.select("node").distinct(), shingle)
    stars = rows.join(centre, "grp").select(F.col("node").alias("u"), F.explode(F.array("lo", "hi", "centre")).alias("v")).where("u <> v")
    sure = verified(stars, sets, similarity)
    roots = connected(sure)
    # among three nodes or fewer the pairs above are all pairs
    rows = rows.where("size > 3").select("grp", "node", "code").join(roots, "node", "left")
    rows = rows.select("grp", F.lit(0).cast("byte").alias("side"), "code", "node", F.xxhash64(F.coalesce("root", "node")).alias("part"))
    mixed = rows.groupBy("grp").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("grp")
    rows = written(rows.join(mixed, "grp", "left_semi"), "open")
    budget = wide_budget(similarity, lanes)
    ready = _dealt(rows, budget, heavy, lanes).join(sets.dropDuplicates(["node"]), "node").repartition("grp").sortWithinPartitions("grp", "side", "code")
    more = ready.select("grp", "side", "code", "node", "part", "s").mapInArrow(_join_sorted(budget, lanes, CHUNK_SETS, similarity), "u binary, v binary")
    return sure.unionByName(more.distinct())


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY, lanes: int = LANES) -> DataFrame:
    """docs without near copies: of each component of documents that share so much of their shingles the one with the smallest doc_id stays.

    Rows with the same doc_id and text are one document and stay or go together.
    """
    found = written(sketches(docs, shingle, lanes, bands_of(similarity)), "fingerprints")
    roots = connected(similar(docs, found, shingle, similarity, lanes))
    placed = found.select("doc_id", "h", "node").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "doc_id", "h")
    # the document that stays: smallest doc_id, then smallest hash of the text
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    stays = placed.groupBy("root").agg(F.min(rank).alias("best")).select("root", "best.*")
    gone = placed.join(stays.select("root", F.col("doc_id").alias("d"), F.col("h").alias("g")), "root")
    gone = written(gone.where(~(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))).select("doc_id", "h").distinct(), "dropped")
    maybe, stay = split_by(docs, _row_hash(docs), filter_of(gone, F.xxhash64("doc_id", "h")))
    i, h = fresh(docs, "gone_id", "gone_h")
    gone = gone.toDF(i, h)
    return stay.unionByName(maybe.join(gone, _same_row(maybe, i, h), "left_anti"))
