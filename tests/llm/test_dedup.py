import hashlib
import os
import random
import re
from dataclasses import replace

import duckdb
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import exact_dedup, simhash, substring, suffix_array
from quillspark.llm.repeats import decided, pack, unpack, without_repeats
from quillspark.llm.windows import segments, sliding_min
from tests.llm.helpers import docs, rows, tokens, words

LAST = (1 << 63) - 1


def repeats(data, tokenise, join, window, within):
    """By brute force: {(doc_id, text): (tokens, removed, spans, sha256)}."""
    order = sorted({(LAST if r[0] is None else r[0], r[1] or "") for r in data})
    first, out = {}, {}
    for d, t in order:
        x = tokenise(t)
        for i in range(len(x) - window + 1):
            first[tuple(x[i : i + window])] = min(first.get(tuple(x[i : i + window]), (d, i)), (d, i))
    for d, t in order:
        x = tokenise(t)
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            at = first[tuple(x[i : i + window])]
            if at < (d, i) if within else at[0] < d:
                gone[i : i + window] = [True] * window
        kept = join([y for y, g in zip(x, gone) if not g])
        out[d, t] = (len(x), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


CASES = {
    "substring": (substring.substring_dedup, lambda t: t.encode().split(), b" ".join, 13, False),
    "suffix": (suffix_array.suffix_dedup, lambda t: t.encode(), bytes, 100, True),
}


@pytest.mark.parametrize("name", CASES)
def test_repeats_against_brute_force(spark, name):
    run, tokenise, join, window, within = CASES[name]
    got = run(docs(spark)).collect()
    want = repeats(rows(), tokenise, join, window, within)
    assert len(got) == len(rows())
    by_id = {}
    for (d, _), v in want.items():
        by_id.setdefault(None if d == LAST else d, set()).add(v)
    for r in got:
        assert tuple(r)[1:5] in by_id[r.doc_id]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    assert run(docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", CASES)
def test_repeats_of_periodic_and_overlapping_texts(spark, name):
    run, tokenise, join, window, within = CASES[name]
    r = random.Random(5)
    pool = [" ".join(r.choice(["ab", "c", "dd"]) for _ in range(40)) for _ in range(6)]
    data = [(k, " ".join(r.choice(pool)[r.randrange(9) :] for _ in range(r.randrange(1, 6)))) for k in range(60)]
    want = repeats(data, tokenise, join, window, within)
    got = run(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == {d: v for (d, _), v in want.items()}


@pytest.mark.parametrize("kind", [substring.KIND, suffix_array.KIND])
def test_hot_minimizers_give_the_same(spark, kind):
    r = random.Random(8)
    common = " ".join(f"c{k}" for k in range(10)) + " and a phrase that all of the documents hold"
    own = [" ".join(f"w{r.randrange(40)}" for _ in range(30)) for _ in range(12)]
    data = [(k, f"{r.choice(own)} {common} {r.choice(own)}") for k in range(40)] + [(3, "again " + common)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    rows = [sorted(map(str, without_repeats(d, replace(kind, hot=hot)).drop("kept").collect())) for hot in (1, 1000)]
    assert rows[0] == rows[1]


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 9))
def test_sliding_min(values, width):
    v = np.array(values, np.uint64)
    if len(v) >= width:
        assert sliding_min(v, width).tolist() == [min(values[i : i + width]) for i in range(len(v) - width + 1)]
    key, first, count = segments(v, width + 4, 5)
    assert count.sum() == max(0, len(v) - width + 1)


def test_pack_round_trip():
    a, b = np.array([1, 1 << 60], "<u8"), np.array([3, 200], "u1")
    x, y = unpack([pack([a, b]), pack([a, b])], ("<u8", "u1"))
    assert x.tolist() == a.tolist() * 2 and y.tolist() == b.tolist() * 2


@settings(max_examples=60)
@given(st.lists(st.lists(st.sampled_from("ab"), min_size=12, max_size=12).map(lambda x: "".join(x).encode()), max_size=80))
def test_blind_trie(texts):
    trie = suffix_array.BlindTrie()
    for k, t in enumerate(texts):
        trie.add(t, k)
    got = list(trie.ordered())
    want = sorted(range(len(texts)), key=lambda k: (texts[k], k))
    assert [m for m, _ in got] == want
    assert [s for _, s in got[1:]] == [len(os.path.commonprefix([texts[a], texts[b]])) for a, b in zip(want, want[1:])]


@settings(max_examples=60)
@given(st.text("abc", min_size=40, max_size=400), st.sampled_from([8, 16]))
def test_multikey_quicksort(text, depth):
    data = text.encode()
    starts = np.arange(len(data) - 24)
    order, begins = suffix_array.multikey_quicksort(np.frombuffer(data, np.uint8), starts, depth)
    assert order.tolist() == sorted(starts.tolist(), key=lambda k: (data[k : k + depth], k))
    assert begins.tolist() == [k == 0 or data[a : a + depth] != data[b : b + depth] for k, (a, b) in enumerate(zip(order, [0, *order]))]


@settings(max_examples=60)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=8, max_size=40))
def test_suffix_array(parts):
    data = "".join(p * 3 for p in parts).encode() + b"x" * 40
    starts = np.arange(len(data) - 40)
    order, shared = suffix_array.suffix_array(np.frombuffer(data, np.uint8), starts, 40)
    assert order.tolist() == sorted(starts.tolist(), key=lambda k: (data[k : k + 40], k))
    for a, b, n in zip(order, order[1:], shared[1:]):
        real = len(os.path.commonprefix([data[a : a + 40], data[b : b + 40]]))
        assert n == real or n == 0 and real < suffix_array.SHALLOW


def _thue_morse(letters):
    x = "a"
    while len(x) < letters:
        x += x.translate({97: "b", 98: "a"})
    return x, x.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("letters", [512, 1024, 2048, 4096])
def test_words_on_which_polynomial_hashes_collide(spark, letters):
    frame = "one two three four five six {} eight nine ten eleven twelve thirteen"
    data = [(k, frame.format(x)) for k, x in enumerate(_thue_morse(letters), 1)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.substring_dedup(d).collect()} == {1: 0, 2: 0}
    want = repeats(data, *CASES["suffix"][1:])
    assert {r.doc_id: tuple(r)[1:5] for r in suffix_array.suffix_dedup(d).collect()} == {k: v for (k, _), v in want.items()}


def test_rows_of_one_id_with_different_texts(spark):
    a, b = words(40, 21), words(40, 22)
    data = [(1, a), (2, a + " " + b), (2, b + " " + a), (3, b), (2, "short")]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring.substring_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(1, 40, 0), (2, 80, 40), (3, 40, 40), (2, 1, 0)}


@pytest.mark.parametrize("name", CASES)
def test_very_long_documents(spark, name):
    """A megabyte of words and one without a single space, next to short texts that repeat a part of them."""
    run, tokenise, join, window, within = CASES[name]
    long, solid = words(160_000, 31, 50_000), "".join(words(200_000, 32, 50_000).split())
    data = [(1, long), (2, "before " + long[500_000:501_000] + " after"), (3, solid), (4, solid[:200] + words(30, 33)), (5, long)]
    want = repeats(data, tokenise, join, window, within)
    got = run(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in got} == {d: v for (d, _), v in want.items()}


def test_who_decides(spark):
    """Names decide copies, the method what differs around a minimizer; together they are all windows that repeat."""
    a, b = words(300, 41), words(9, 42)
    data = [(1, a), (2, a), (3, "x " + b + " " + a[:200] + " y"), (4, "z " + b + " " + a[:200] + " q")]
    got = decided(spark.createDataFrame(data, "doc_id long, text string"), substring.KIND)
    gone = 288 + sum(len(w) - 12 for w in [a[:200].split()]) * 2
    assert got["judged"] > 0 and got["named"] + got["found"] >= gone - 2


@settings(max_examples=40)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=20), min_size=1, max_size=8))
def test_suffix_automaton(sequences):
    automaton = substring.SuffixAutomaton()
    for k, s in enumerate(sequences):
        automaton.add(s, k)
    automaton.finish()
    for k, s in enumerate(sequences):
        for at, least in automaton.statistics(s, 3):
            gram = s[at - 2 : at + 1]
            assert least == min(i for i, t in enumerate(sequences) if any(t[j : j + 3] == gram for j in range(len(t) - 2)))


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(docs(spark)).collect()
    assert len(got) == len(rows())
    groups = {}
    for r in rows():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), []).append(r)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        own = by_sha[r.text_sha256]
        keep = max(own, key=lambda x: (len(x[1] or ""), x[0] is not None, -(x[0] or 0)))[0]
        assert (r.keep_id, r.group_size) == (keep, len(own)) and (not r.kept or r.doc_id == keep)
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(by_sha)  # one row of each group
    left = exact_dedup.exact_dedup(docs(spark))
    assert left.columns == docs(spark).columns and left.count() == len(by_sha)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0 and exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_rows_of_one_id(spark):
    least = -(1 << 63)
    long = words(120_000, 51, 90_000)
    data = [(1, "a b"), (1, "a b"), (1, "ab"), (2, "x"), (2, "y"), (3, "y "), (least, "q"), (4, "q"), (None, "n"), (None, "n "), (5, long), (6, long.replace(" ", "\n")), (7, long + "!")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(d).collect()}
    assert got == {(1, 1, 3, True), (1, 1, 3, False), (2, 2, 1, True), (2, 3, 2, False), (3, 3, 2, True), (least, least, 2, True), (4, least, 2, False),
                   (None, None, 2, False), (None, None, 2, True), (5, 5, 2, True), (6, 5, 2, False), (7, 7, 1, True)}
    want = [(1, "a b"), (2, "x"), (3, "y "), (least, "q"), (None, "n "), (5, long), (7, long + "!")]
    assert sorted(map(tuple, exact_dedup.exact_dedup(d).collect()), key=str) == sorted(want, key=str)


def test_chunks_are_stored_once(spark):
    """Texts that share chunks have the same identifiers for them, and an identifier leads to its chunk's bytes."""
    base = "".join(map(str, range(9000)))
    data = [(1, base), (2, "in front " + base), (3, base + " behind"), (4, base), (5, ""), (6, None)]
    d = exact_dedup.chunked(spark.createDataFrame(data, "doc_id long, text string"))
    store = exact_dedup.chunk_store(d)
    row = {r.row: r for r in d.collect()}
    chunks = {tuple(r.chunk_id): r for r in store.collect()}
    digests = [x for r in row.values() for x in r.digests]
    assert len(chunks) == len(set(map(bytes, digests))) < len(digests) / 3 and sum(r.uses for r in chunks.values()) == len(digests)
    for r in exact_dedup.recipes(d, store).collect():
        assert [bytes(chunks[tuple(x)].digest) for x in r.recipe] == [bytes(x) for x in row[r.row].digests]
        assert all(row[x.row].digests[x["at"]] == chunks[tuple(x)].digest for x in r.recipe)


def test_chunks_depend_on_content_alone():
    data = "".join(map(str, range(30000))).encode()
    own = exact_dedup.digests_of(data)
    shifted = exact_dedup.digests_of(b"something before" + data)
    assert len(set(own) & set(shifted)) > 0.9 * len(own)
    assert exact_dedup.cuts(b"") == [] and exact_dedup.cuts(b"abc") == [3] and max(np.diff([0, *exact_dedup.cuts(b"a" * 100000)])) <= exact_dedup.MOST


def test_exact_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.sql(exact_dedup.SQL).fetchall())
    assert sorted(map(tuple, exact_dedup.op5_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want


def _print(text):
    w = tokens(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints, radius):
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in prints}


def test_simhash_against_brute_force(spark):
    got = simhash.near_groups(docs(spark)).collect()
    prints = {r[0]: _print(r[1]) for r in rows() if r[0] is not None}
    want = _components(prints, simhash.RADIUS)
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    assert {r.component_id for r in got if r.doc_id is None} == {0}
    assert simhash.near_groups(docs(spark, [])).count() == 0


def test_simhash_of_a_whole_table_against_brute_force(spark):
    """Every pair of sf0.01, with plain fingerprints."""
    sf = "/root/testdata/sf0.01"
    prints = {r.doc_id: _print(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = _components(prints, simhash.RADIUS)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op10_simhash(spark, sf).collect()}
    assert got == {k: (f"{x:016x}", want[k]) for k, x in prints.items()} and len(set(want.values())) < len(want)


def test_rows_without_doc_id_link_others(spark, monkeypatch):
    """00 (doc 1), 0f (no doc_id) and ff (doc 2) are one component; one without any doc_id has none."""
    data = [(1, 0), (None, 0x0F), (2, 0xFF), (5, -1), (None, 0x0F0F0F0F0F), (None, 0x0F0F0F0F0E), (None, -1)]
    monkeypatch.setattr(simhash, "fingerprints", lambda d: spark.createDataFrame(data, "doc_id long, fp long"))
    got = sorted(((r.fingerprint, r.doc_id, r.component_id) for r in simhash.near_groups(docs(spark)).collect()), key=str)
    name = lambda fp: f"{fp & (1 << 64) - 1:016x}"
    want = {0: 1, 0x0F: 1, 0xFF: 1, -1: 5, 0x0F0F0F0F0F: None, 0x0F0F0F0F0E: None}
    assert got == sorted(((name(fp), d, want[fp]) for d, fp in data), key=str)


@pytest.mark.parametrize("size", [10, 1 << 23, 1 << 33])
def test_linked_fingerprints_agree_on_a_mask(size):
    r = random.Random(size)
    masks = simhash.cuts(size)
    assert len(masks) == {10: 5, 1 << 23: 15, 1 << 33: 35}[size]
    for _ in range(500):
        flips = sum(1 << b for b in r.sample(range(64), simhash.RADIUS))
        assert any(not flips & m for m in masks)


@pytest.mark.parametrize("branch, size", [(50_000, None), (20, None), (50_000, 1 << 23), (50_000, 1 << 33)])
def test_links_of_dense_clusters(spark, monkeypatch, branch, size):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 1 << 62)  # few shards, whatever the size
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(20)]
    prints = {}
    for k in range(600):
        x = centres[k % 20]
        for _ in range(r.randrange(0, 7)):
            x ^= 1 << r.randrange(64)
        prints[k] = x
    first = {}
    for k, x in prints.items():
        first.setdefault(x, k)
    reps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, k) for x, k in first.items()], "fp long, rep long")
    found = {r.node: r.root for r in simhash.components(simhash.links(reps, branch=branch, size=size)).collect()}
    want = _components({k: prints[k] for k in first.values()}, simhash.RADIUS)
    assert {k: found.get(k, k) for k in want} == want


def test_similar_texts_are_found(spark):
    """Texts whose five-word shingles are 0.85 alike or more meet; others don't."""
    r = random.Random(9)
    data, pairs = [], []
    for k in range(120):
        w = [f"w{r.randrange(900)}" for _ in range(r.randrange(120, 400))]
        other = list(w)
        for at in range(r.randrange(5), len(w), r.choice([12, 70, 100, 150])):
            other[at] = f"w{r.randrange(900)}"
        s, t = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, other))
        pairs.append((2 * k, len(s & t) / len(s | t)))
        data += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other).upper())]
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    near = [got[k + 1] == k for k, j in pairs if j >= 0.85]
    assert len(near) > 30 and sum(near) / len(near) >= 0.9
    assert not any(got[k + 1] == k for k, j in pairs if j < 0.6)
    assert len(simhash.near_dedup(docs(spark)).collect()) < len(rows()) and simhash.near_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bound", [0, 3, 1000])
def test_vantage_trees_of_leaves(bound):
    """The near stage's search in leaves: all pairs within the radius, hot leaves named, and distances that the triangle bound spares."""
    r = np.random.default_rng(4)
    points, leaf = r.integers(0, 1 << 63, (500, simhash.WIDE_WORDS)).astype(np.uint64), np.sort(r.integers(0, 5, 500)) ** 2
    for k in range(0, 450, 3):  # clusters of near copies, some at the radius
        points[k + 1] = points[k] ^ np.uint64(1 << k % 60)
        flips = np.zeros(64 * simhash.WIDE_WORDS, np.uint8)
        flips[r.permutation(len(flips))[: 8 if k < 300 else 54 + k % 9]] = 1
        points[k + 2] = points[k] ^ np.packbits(flips, bitorder="little").view(np.uint64)
    far = np.bitwise_count(points[:, None] ^ points[None, :]).sum(axis=2)
    want = {(a, b) for a, b in np.argwhere(far <= simhash.WIDE_RADIUS).tolist() if a < b and leaf[a] == leaf[b]}
    size = {x: int((leaf == x).sum()) for x in leaf.tolist()}
    hot = {x for x in size if size[x] > simhash.LEAF and sum(leaf[a] == x for a, _ in want) > bound * size[x]}
    a, b, found, taken = simhash.vantage_pairs(points, leaf, bound)
    assert sorted((min(p), max(p)) for p in zip(a.tolist(), b.tolist())) == sorted(p for p in want if leaf[p[0]] not in hot)
    assert sorted(found) == sorted((size[x], x) for x in hot) and len(want) > 300 and (bound or hot)
    assert taken < sum(n * (n - 1) // 2 for n in size.values())
    assert [len(x) for x in simhash.vantage_pairs(points[:0], leaf[:0], bound)[:3]] == [0, 0, 0]


def test_shared_counts():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 30))) for _ in range(40)]
    got = simhash.shared_counts(sets, slice(0, 15), slice(10, 40), width=16)
    assert got.astype(int).tolist() == [[len(np.intersect1d(a, b)) for b in sets[10:40]] for a in sets[:15]]


@pytest.mark.parametrize("slice_rows", [16_384, 40])
def test_hot_leaves_in_slices(spark, monkeypatch, slice_rows):
    """A crowd of edited copies, in one task and dealt by pairs of slices."""
    monkeypatch.setattr(simhash, "SLICE", slice_rows)
    r = random.Random(29)
    centre = [f"c{r.randrange(900)}" for _ in range(120)]
    data = [(k, " ".join(f"y{k}" if at in (k % 120, (k * 7) % 120) else w for at, w in enumerate(centre))) for k in range(200)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in data]
    root = list(range(200))
    for _ in range(8):
        for b in range(200):
            for a in range(b):
                if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                    root[a] = root[b] = min(root[a], root[b])
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(data, "doc_id long, text string"), 0).collect()}
    assert [got[k] for k in range(200)] == root and len(set(root)) < 200


@pytest.mark.parametrize("bound", [simhash.PAIRS, 0])
def test_similar_texts_are_told_by_their_shingles(spark, bound):
    """Pairs on both sides of 0.8, and a group in which copies are alike to its centre more than to each other."""
    r = random.Random(19)
    data, sets = [], []

    def add(w):
        data.append((len(data), " ".join(w)))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})

    for k in range(300):
        w = [f"w{r.randrange(900)}" for _ in range(200)]
        other = list(w)
        for at in range(3, 200, r.choice([45, 50, 38, 33, 30, 26])):
            other[at] = "x"
        add(w)
        add(other)
    centre = [f"c{r.randrange(900)}" for _ in range(200)]
    for k in range(150):
        add([f"y{k}" if at in (k, (k + 50) % 200, (k + 100) % 200) else w for at, w in enumerate(centre)])
    pairs = {(a, b) for b in range(len(sets)) for a in range(b) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    root = list(range(len(sets)))
    for _ in range(20):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(data, "doc_id long, text string"), bound).collect()}
    assert 100 < len(pairs) and 50 < sum(k + 1 < 600 and (k, k + 1) not in pairs for k in range(0, 600, 2))
    assert all(root[got[k]] == root[k] for k in got)  # no link is wrong
    assert sum(got[k] == root[k] for k in got) >= 0.98 * len(got)


def test_near_groups_of_a_whole_table_against_brute_force(spark):
    """All pairs of sf0.01 that share a five-word shingle, told by their Jaccard similarity: precision and recall of the links."""
    sets = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect():
        w = tokens(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    holders, shared = {}, {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [p for p, n in shared.items() if 5 * n >= 4 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    missed = [p for p in links if got[p[0]] != got[p[1]]]
    assert len(links) > 100 and len(missed) <= 0.01 * len(links)
    assert all(find(d) == find(c) for d, c in got.items())  # no link is wrong
