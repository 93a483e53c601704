"""SimHash near-dedup with vantage-point trees.

Fingerprints link at ``RADIUS`` or fewer differing bits. Their 64 bits are cut into ``RADIUS + k`` blocks; two linked
fingerprints agree wholly on k blocks at least. The Hamming distance on k blocks is a pseudo-metric, so each choice of k is one
vantage-point tree whose remaining radius is 0: the triangle bound sends a fingerprint to exactly one branch of each, and
these branches are the shards. k grows with the number of fingerprints (``cuts``), so that a branch has some ``CROWD`` of them at
most if their bits are spread; every k finds all links. A branch of more than ``BRANCH`` fingerprints is partitioned again by the distance to a
vantage fingerprint, in rings of ``2 * RADIUS`` distances; fingerprints within the radius of a ring's boundary also go to
the ring beyond it. Inside a shard a vantage-point tree in memory finds the exact pairs: a query goes down every branch
that the triangle bound can't exclude, in whole arrays of queries. Only a spanning forest of the pairs found leaves a shard.
Components come from alternating large-star and small-star steps, each cut by a table in the shared folder.

``near_dedup``, the stage for corpora, joins texts whose distinct five-word shingles have a Jaccard similarity of ``ALIKE`` (4 / 5) or
more. Fingerprints only propose pairs: those of ``WIDE_WORDS`` words of 64 bits that differ in ``WIDE_RADIUS`` bits at most (a pair
of similarity 0.8 differs in some 38) and meet in one of ``TREES`` trees over ``TREE_BITS`` bits each, drawn with a fixed seed;
a leaf is searched by a vantage-point tree (``vantage_pairs``), exact at that radius, which cuts clusters of near copies off from other texts;
``forest`` gives more bits to over 2**20 texts, so that leaves stay as small, and as many more trees as keep the chance to meet.
Every proposed pair is told by the Jaccard similarity of its shingles themselves. A leaf with more than ``PAIRS`` pairs a text
proposes none: its texts' sets of shingles are brought to the leaf and told there, all against all, as products of incidence
matrices, and only links between components leave it; a leaf of over ``SLICE`` texts is dealt to tasks by pairs of slices. So no
link is wrong (but for equal 64-bit hashes), and one is missed only if its pair meets in no tree. Texts with equal sets of
shingles are one node.

Equal fingerprints are one node from the start, so thousands of copies cost one row. Nulls: a null text has no words and
the fingerprint zero. Nodes are fingerprints, so a row without a doc_id links others, and has its component's smallest doc_id (null
if no row of the component has one). Repeated rows get equal results.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, keep_rows, materialize, mixed, raw_name, rows_of, table

RADIUS, SHINGLE, SEED = 4, 4, 42
BRANCH, LEAF, SHARDS, CROWD = 50_000, 64, 128, 1024
WIDE_SHINGLE, WIDE_WORDS, WIDE_RADIUS, TREES, TREE_BITS, PAIRS = 5, 4, 58, 64, 14, 32
ALIKE = (4, 5)
RING = 64 * WIDE_WORDS // 4  # unrelated fingerprints differ in twice as many bits
LEAF_ROWS, SLICE = 50_000, 16_384  # rows of a task's group of leaves, and of a slice of a hot leaf


@lru_cache
def _drawn(trees: int, bits: int) -> np.ndarray:
    return np.stack([np.random.default_rng(k).permutation(64 * WIDE_WORDS)[:bits] for k in range(trees)])


def forest(texts: int) -> tuple[int, int, int]:
    """(trees, bits of a leaf, groups of leaves of a tree) for so many texts."""
    bits = max(TREE_BITS, min(30, (max(1, texts) - 1).bit_length() - 6))
    meet = (1 - 38 / (64 * WIDE_WORDS)) ** bits
    return max(TREES, int(np.ceil(np.log(0.001) / np.log(1 - meet)))), bits, max(16, texts // LEAF_ROWS)


KEY, WIDE = ("key0", "key1"), tuple(f"fp{k}" for k in range(WIDE_WORDS))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 of each ``k``-word shingle of the lower-cased text; of all words if they are fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        bits = np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    return majority(shingles(text, k))


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """The words of the wide fingerprint of distinct shingles."""
    return np.array([majority(mixed(h ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1))) for k in range(WIDE_WORDS)], np.uint64)


def leaves_of(points: np.ndarray, trees: int = TREES, depth: int = TREE_BITS) -> np.ndarray:
    """The leaf of each wide fingerprint in each of the first trees."""
    out = np.zeros((len(points), trees), np.int32)
    for at in range(0, len(points), 1024):
        bits = np.unpackbits(np.ascontiguousarray(points[at : at + 1024]).view(np.uint8).reshape(-1, 8 * WIDE_WORDS), axis=1, bitorder="little")
        for k, drawn in enumerate(_drawn(trees, depth).T):
            out[at : at + 1024] |= bits[:, drawn].astype(np.int32) << k
    return out


def set_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles, as two longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), "<i8").tolist())


def _wide(batches):
    for batch in batches:
        ids, raws, keys, words = [], [], [], []
        for doc_id, text in rows_of(batch):
            h = np.unique(shingles(text, WIDE_SHINGLE))
            ids.append(doc_id)
            raws.append(raw_name(text or b""))
            keys.append(set_key(h))
            words.append(wide_fingerprint(h))
        k, w = np.array(keys, np.int64).reshape(-1, 2), np.array(words, np.uint64).reshape(-1, WIDE_WORDS).view(np.int64)
        columns = [pa.array(ids, pa.int64()), pa.array(raws, pa.binary()), *(pa.array(x) for x in k.T), *(pa.array(x) for x in w.T)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "raw", *KEY, *WIDE])


def _sets(batches):
    """The distinct shingles of representatives' texts."""
    for batch in batches:
        rows = list(rows_of(batch))
        sets = [np.unique(shingles(text, WIDE_SHINGLE)).view(np.int64) for _, text in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])


def _fingerprints(batches):
    for batch in batches:
        ids, prints = [], []
        for doc_id, text in rows_of(batch):
            ids.append(doc_id)
            prints.append(fingerprint(text))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    return documents(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


class _Forest:
    """Components of the points of a shard: ``label`` is always each point's smallest known companion."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        differ = a != b
        if not differ.any():
            return
        pairs = np.unique(np.stack([np.minimum(a, b)[differ], np.maximum(a, b)[differ]], 1), axis=0)
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x, y in pairs.tolist():
            if (x := root(x)) != (y := root(y)):
                up[max(x, y)] = min(x, y)
        move = np.arange(len(self.label))
        for x in up:
            move[x] = root(x)
        self.label = move[self.label]


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, whose words are the last axis."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _search(points: np.ndarray, own: np.ndarray, asked: np.ndarray, radius: int, forest: _Forest) -> None:
    """Union the points ``asked`` with those of the tree over ``own`` within the radius."""
    if not len(own) or not len(asked):
        return
    if len(own) > LEAF:
        vantage = points[own[len(own) // 2]]
        d = _far(points[own], vantage)
        edge = int(np.median(d))
        if edge < d.max():
            q = _far(points[asked], vantage)
            _search(points, own[d <= edge], asked[q <= edge + radius], radius, forest)
            _search(points, own[d > edge], asked[q > edge - radius], radius, forest)
            return
    for at in range(0, len(own), LEAF):
        leaf = own[at : at + LEAF]
        for to in range(0, len(asked), 4096):
            some = asked[to : to + 4096]
            a, b = np.nonzero(_far(points[some][:, None], points[leaf][None, :]) <= radius)
            forest.union(some[a], leaf[b])


def links_in(points: np.ndarray, blocks: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each point (a row of words), the position of the smallest point it is linked with among those of its block."""
    forest, order = _Forest(len(points)), np.argsort(blocks, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
        if 1 < len(own) <= LEAF:
            a, b = np.nonzero(np.triu(_far(points[own][:, None], points[own][None, :]) <= radius, 1))
            if len(a):
                forest.union(own[a], own[b])
        elif len(own) > LEAF:
            _search(points, own, own, radius, forest)
    return forest.label


def _shard(radius: int, columns: tuple[str, ...] = ("fp",)):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep", ignore_index=True)
        points = np.stack([frame[c].to_numpy() for c in columns], 1).view(np.uint64)
        label = links_in(points, frame["leaf"].to_numpy(), radius)
        rep = frame["rep"].to_numpy()
        linked = label != np.arange(len(label))
        return pd.DataFrame({"u": rep[linked], "v": rep[label[linked]]})

    return run


def cuts(size: int, radius: int = RADIUS) -> list[int]:
    """The bits of each tree, as masks: each choice of k of ``radius + k`` blocks, with the smallest k (1 to 3) that spreads
    ``size`` fingerprints enough. Two that differ in ``radius`` bits at most agree on one of the masks."""
    for k in (1, 2, 3):
        edges = [64 * x // (radius + k) for x in range(radius + k + 1)]
        blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
        masks = [sum(own) for own in combinations(blocks, k)]
        if size <= CROWD << min(m.bit_count() for m in masks):
            break
    return masks


def links(reps: DataFrame, radius: int = RADIUS, branch: int = BRANCH, size: int | None = None) -> DataFrame:
    """(u, v), u > v: links between the ``rep`` of distinct fingerprints ``fp`` that have the components of all links.

    ``size`` decides how many trees there are (the number of rows, if not given)."""
    size = reps.count() if size is None else size
    signed = lambda mask: mask - (1 << 64 if mask >> 63 else 0)
    leaves = F.array(*[F.struct(F.lit(k).alias("tree"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("leaf")) for k, m in enumerate(cuts(size, radius))])
    rows = reps.select("fp", "rep", F.explode(leaves).alias("b")).select("fp", "rep", "b.tree", "b.leaf")
    large = rows.groupBy("tree", "leaf").agg(F.count("*").alias("n"), F.min("fp").alias("vantage")).where(F.col("n") > branch).drop("n")
    d = F.expr("bit_count(fp ^ vantage)")
    width = 2 * radius
    ring = F.when(F.col("vantage").isNull(), F.array(F.lit(0))).otherwise(
        F.array_distinct(F.array(*[F.floor((d + F.lit(x)) / width).cast("int") for x in (0, -radius, radius)]))
    )
    rows = rows.join(large, ["tree", "leaf"], "left").select("fp", "rep", "tree", "leaf", F.explode(ring).alias("ring"), F.col("vantage").isNotNull().alias("split"))
    # small leaves share a task's call; a split branch has one for each ring
    shard = F.when(F.col("split"), F.col("leaf")).otherwise(F.pmod(F.xxhash64("leaf"), F.lit(max(SHARDS, size // LEAF_ROWS))))
    return rows.groupBy("tree", "split", shard.alias("shard"), "ring").applyInPandas(_shard(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): the smallest node it is connected with."""
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = materialize(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = now


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(fingerprints(docs))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius))
    named = materialize(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # written, so that the join below can split the partition of a fingerprint that many documents share
    named = materialize(named.join(ids, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def vantage_pairs(points: np.ndarray, leaf: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], int]:
    """(a, b) within the wide radius of one leaf, hot leaves (points, leaf) of over ``LEAF`` points and ``bound`` pairs a point,
    and how many distances were taken. ``leaf`` is sorted.

    Each leaf is a vantage-point tree, and all trees grow a level at a time. The first point of a branch is its vantage; its
    distances to the others tell its own pairs, and the rest is cut in a ring around it and what is beyond, if these
    are more than the radius apart, as by the triangle bound no pair joins them then. No cut can be made where distances are closer."""
    _, at, size = np.unique(leaf, return_index=True, return_counts=True)
    own = np.repeat(np.arange(len(size)), size)  # a point's leaf, by number
    found, hot, taken = np.zeros(len(size), np.int64), np.zeros(len(size), bool), 0
    left, branch, all_a, all_b = np.arange(len(leaf)), own, [], []
    while len(left):
        head = np.flatnonzero(np.diff(branch, prepend=-1))
        vantage = np.repeat(left[head], np.diff(np.append(head, len(left))))
        rest = left != vantage
        left, branch, vantage = left[rest], branch[rest], vantage[rest]
        if not len(left):
            break
        d = _far(points[left], points[vantage])
        taken += len(d)
        near = d <= WIDE_RADIUS
        all_a.append(vantage[near])
        all_b.append(left[near])
        found += np.bincount(own[left[near]], minlength=len(size))
        hot = (size > LEAF) & (found > bound * size)
        inner, head = d <= RING, np.flatnonzero(np.diff(branch, prepend=-1))
        edge, beyond = np.maximum.reduceat(np.where(inner, d, -1), head), np.minimum.reduceat(np.where(inner, 1 << 30, d), head)
        apart = (beyond - edge > WIDE_RADIUS) & (edge >= 0) & (beyond < 1 << 30)
        nth = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(left))))
        branch = 2 * nth + (apart[nth] & ~inner)
        keep = ~hot[own[left]]
        left, branch = left[keep], branch[keep]
        if apart.any():
            order = np.argsort(branch, kind="stable")
            left, branch = left[order], branch[order]
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (all_a, all_b))
    fine = ~hot[own[a]]
    return a[fine], b[fine], [(int(size[k]), int(leaf[at[k]])) for k in np.flatnonzero(hot)], taken


def _propose(bound: int, depth: int = TREE_BITS):
    """Pairs (u, v) of a shard to be told by their shingles. A leaf of more than ``bound`` pairs a point gives a row
    (its number of points, leaf, tree, hot) in place of pairs."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["leaf", "rep"], ignore_index=True)
        points = np.stack([frame[c].to_numpy() for c in WIDE], 1).view(np.uint64)
        leaf, rep, tree = frame["leaf"].to_numpy(), frame["rep"].to_numpy(), int(frame["tree"].iloc[0])
        a, b, hot, _ = vantage_pairs(points, leaf, bound)
        if len(a) and tree:  # a pair is proposed by the first tree in which it meets
            used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
            before = leaves_of(points[used], tree, depth)
            x, y = where[: len(a)], where[len(a) :]
            fresh = np.concatenate([~(before[x[k : k + 65536]] == before[y[k : k + 65536]]).any(axis=1) for k in range(0, len(a), 65536)])
            a, b = a[fresh], b[fresh]
        u, v = np.maximum(rep[a], rep[b]), np.minimum(rep[a], rep[b])
        return pd.DataFrame({
            "u": np.concatenate([u, np.array([n for n, _ in hot], np.int64)]), "v": np.concatenate([v, np.array([x for _, x in hot], np.int64)]),
            "tree": np.full(len(u) + len(hot), tree, np.int32), "hot": np.arange(len(u) + len(hot)) >= len(u),
        })

    return run


def shared_counts(sets: list[np.ndarray], rows: slice, others: slice, width: int = 4096) -> np.ndarray:
    """How many shingles each of some sets shares with each of others; only shingles that two sets have are looked at."""
    some, more = sets[rows], sets[others]
    values, place, uses = np.unique(np.concatenate([*some, *more, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    column = np.cumsum(uses > 1) - 1
    out = np.zeros((len(some), len(more)), np.float32)
    row = np.repeat(np.arange(len(some) + len(more)), [len(x) for x in [*some, *more]])
    both = uses[place] > 1
    row, col = row[both], column[place[both]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    edges = np.searchsorted(col, np.arange(0, (int(col[-1]) + 1 if len(col) else 0) + width, width))
    for a, b in zip(edges, edges[1:]):
        there = np.zeros((len(some) + len(more), width), np.float32)
        there[row[a:b], col[a:b] % width] = 1
        out += there[: len(some)] @ there[len(some) :].T
    return out


def _tell_hot(frame: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of a hot leaf's texts (rep, comp, shingles), a spanning forest of them."""
    frame = frame.sort_values("rep", ignore_index=True)
    sets, comp = frame["shingles"].tolist(), frame["comp"].to_numpy()
    size = np.array([len(x) for x in sets], np.float32)
    forest = _Forest(len(sets))
    _, start, back = np.unique(comp, return_index=True, return_inverse=True)
    forest.union(np.arange(len(sets)), start[back])
    for a in range(0, len(sets), 512):
        for b in range(a, len(sets), 512):
            if len(np.unique(forest.label[np.r_[a : min(a + 512, len(sets)), b : min(b + 512, len(sets))]])) == 1:
                continue
            n = shared_counts(sets, slice(a, a + 512), slice(b, b + 512))
            x, y = np.nonzero((ALIKE[0] + ALIKE[1]) * n >= ALIKE[0] * (size[a : a + 512, None] + size[None, b : b + 512]))
            forest.union(a + x, b + y)
    to = comp[forest.label]
    pairs = np.unique(np.stack([comp, to], 1)[comp != to], axis=0).reshape(-1, 2)
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def shingle_sets(used: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, shingles of the representatives ``used``; written."""
    named = reps.join(used, "rep").select("rep", F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"))
    raw = F.unhex(F.substring(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256), 1, 32))
    texts = documents(docs).withColumn("raw", raw).join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw")))
    return materialize(texts.select("rep", "text").mapInArrow(_sets, "rep long, shingles array<long>").dropDuplicates(["rep"]))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of representatives whose shingles have a Jaccard similarity of ``ALIKE`` or more."""
    both = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v")
    both = both.select("u", "v", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("i"))
    return materialize(both.where(F.col("i") * ALIKE[1] >= (F.col("n") - F.col("i")) * ALIKE[0]).select("u", "v").distinct())


def _similar(docs: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, raw, key0, key1), and the sets of shingles (key0, key1, doc_id, component)."""
    prints = materialize(documents(docs).mapInArrow(_wide, "doc_id long, raw binary, " + ", ".join(f"{w} long" for w in (*KEY, *WIDE))))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("first")
    reps = prints.groupBy(*KEY).agg(first, *[F.any_value(w).alias(w) for w in WIDE]).select(*KEY, "first.doc_id", "first.raw", *WIDE)
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()))  # a set's number: written, so it stays
    points = reps.select("rep", *WIDE)
    trees, depth, groups = forest(points.count())

    def leaves(batches):
        for batch in batches:
            points = np.stack([batch.column(k + 1).to_numpy() for k in range(WIDE_WORDS)], 1).view(np.uint64)
            found = pa.FixedSizeListArray.from_arrays(pa.array(leaves_of(points, trees, depth).ravel()), trees).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=["rep", *WIDE, "leaves"])

    rows = points.mapInArrow(leaves, "rep long, " + ", ".join(f"{w} long" for w in WIDE) + ", leaves array<int>").select("rep", *WIDE, F.posexplode("leaves").alias("tree", "leaf"))
    proposed = materialize(rows.groupBy("tree", (F.col("leaf") % groups).alias("shard")).applyInPandas(_propose(bound, depth), "u long, v long, tree int, hot boolean"))
    pairs = materialize(proposed.where("not hot").select("u", "v").distinct())
    slices = F.ceil(F.col("u") / SLICE).cast("int").alias("slices")
    hot = materialize(proposed.where("hot").select("tree", F.col("v").cast("int").alias("leaf"), slices))
    crowded = materialize(rows.select("rep", "tree", "leaf").join(hot, ["tree", "leaf"]))
    used = pairs.select(F.col("u").alias("rep")).union(pairs.select("v")).union(crowded.select("rep")).distinct()
    sets = shingle_sets(used, reps, docs)
    links = alike(pairs, sets)
    found = components(links)
    if not hot.isEmpty():
        found = materialize(found)
        own = F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int")
        again = crowded.join(found, F.col("rep") == F.col("node"), "left").select("rep", "tree", "leaf", F.coalesce("root", "rep").alias("comp"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
        again = again.withColumn("part", F.least("own", "other") * 100_000 + F.greatest("own", "other")).select("rep", "tree", "leaf", "part", "comp")
        more = again.join(sets, "rep").groupBy("tree", "leaf", "part").applyInPandas(_tell_hot, "u long, v long")
        found = components(links.union(more.distinct()))
    named = materialize(reps.join(found, reps["rep"] == found["node"], "left").select(*KEY, "doc_id", F.coalesce("root", "rep").alias("component")))
    return prints.select("doc_id", "raw", *KEY), named


def similar_groups(docs: DataFrame, bound: int = PAIRS) -> DataFrame:
    """doc_id, component_id of each row: components of texts whose five-word shingles are alike (null: no row of it has a doc_id)."""
    prints, named = _similar(docs, bound)
    ids = materialize(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return prints.join(named.drop("doc_id").join(ids, "component"), list(KEY)).select("doc_id", "component_id")


def near_dedup(docs: DataFrame, bound: int = PAIRS) -> DataFrame:
    """The documents that stay, with all their columns: of each component of similar texts one row, that with the smallest
    doc_id (null is the largest; of several texts of that doc_id the one with the smallest SHA-256)."""
    prints, named = _similar(docs, bound)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")).alias("first")
    keep = prints.join(named.drop("doc_id"), list(KEY)).groupBy("component").agg(first)
    return keep_rows(docs, keep.select("first.doc_id", "first.raw"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op10_simhash": op10_simhash}, {}
