"""Patches, containment both ways, trees and mergeable distributions against plain versions."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import closure, matching, patches, sketches
from quillspark.plans import catalogue
from quillspark.sources.sinks import shared_path
from quillspark.sources.tables import load
from tests.test_indexes import compare


@pytest.mark.parametrize("name", ["log_tail_lines", "patched_documents", "contained_either_way", "containment_dedupe", "forest_roots", "forest_descendants", "latency_buckets"])
def test_oracles(spark, name):
    compare(spark, name)


# patches


def has_id(x):
    return isinstance(x, dict) and isinstance(x.get("id"), str) and x["id"] != ""


def merged(base, patch, by_id, top=True):
    if not isinstance(patch, dict):
        return patch
    out = dict(base) if isinstance(base, dict) else {}
    for k, v in patch.items():
        if k in patches.BLOCKED:
            continue
        if v is None:
            out.pop(k, None)
        elif by_id and isinstance(out.get(k), list) and isinstance(v, list) and all(map(has_id, out[k])) and listed(v) and listed(out[k]):
            items = [dict(x) for x in out[k]]
            for x in v:
                at = next((i for i, y in enumerate(items) if has_id(x) and y.get("id") == x["id"]), None)
                if at is None:
                    items.append(merged({}, x, by_id) if has_id(x) else x)
                else:
                    items[at] = merged(items[at], x, by_id)
            out[k] = items
        elif isinstance(v, dict):
            out[k] = merged(out.get(k), v, by_id)
        else:
            out[k] = [merged({}, x, by_id) if has_id(x) else x for x in v] if by_id and isinstance(v, list) and listed(v) else v
    return out


def listed(v):
    """An array whose elements are told apart by id: some have one (or it is empty), none repeats."""
    ids = [x["id"] for x in v if has_id(x)]
    return len(set(ids)) == len(ids) and (bool(ids) or not v)


def made(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.35:
        return r.choice([1, 2.5, "s", "", True, None, "é\"\\\n", -7])
    if kind < 0.5:
        return [made(r, 9) for _ in range(r.randrange(3))]
    if kind < 0.65:
        return [{"id": i, **made_object(r, depth + 1)} for i in r.sample("pqr", r.randrange(1, 3))] + ([{"no": 1}] if r.random() < 0.2 else [])
    return made_object(r, depth + 1)


def made_object(r, depth):
    return {k: made(r, depth) for k in r.sample(["a", "b", "c", "__proto__", "k.x"], r.randrange(0, 4))}


def plain_null_free(v):
    """What is new in a patch loses its nulls, as merging into nothing drops them; arrays are taken as they are."""
    return v


@pytest.mark.parametrize("by_id", [False, True])
def test_folded_patches(spark, by_id):
    r = random.Random(11)
    data, want = [], {}
    for doc in range(120):
        state = None
        for seq in range(r.randrange(1, 6)):
            value = made_object(r, 0) if r.random() < 0.93 else made(r)
            if seq == 0 and value is None:
                value = {}
            data.append((doc, seq, json.dumps(value, ensure_ascii=False)))
            state = value if seq == 0 else merged(state, value, by_id)
        want[str(doc)] = state
    data += [(500, 0, "{"), (501, 0, '{"a":1}'), (501, 3, "nope"), (501, 4, None), (502, 5, '{"a":{"b":null}}'), (None, 0, '{"z":1}'), (None, 2, '{"z":null}'), (501, 0, '{"a":1}')]
    want |= {"501": {"a": 1}, "502": {"a": {}}, None: {}}
    got = patches.folded(spark.createDataFrame(data, "doc long, seq long, json string").repartition(4), "doc", "seq", "json", shared_path(spark, "p"), by_id).collect()
    found = {r.doc: json.loads(r.json) for r in got}
    assert len(got) == len(found) and set(found) == set(want)
    assert {k: (v, want[k]) for k, v in found.items() if v != want[k]} == {}


def test_patches_empty_and_deep(spark):
    df = spark.createDataFrame([(1, 0, '{"a":' * 9 + "1" + "}" * 9), (1, 1, '{"a":' * 8 + "null" + "}" * 8)], "doc long, seq long, json string")
    assert patches.folded(df.limit(0), "doc", "seq", "json", shared_path(spark, "p")).count() == 0
    assert patches.folded(df, "doc", "seq", "json", shared_path(spark, "p")).first().json == '{"a":' * 7 + "{}" + "}" * 7


# containment


@pytest.mark.parametrize("block, chunk", [(4 << 20, 1 << 20), (300, 40)])
def test_contained_either_way(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(matching, "BLOCK_BYTES", block)
    monkeypatch.setattr(matching, "CHUNK_CHARS", chunk)
    r = random.Random(3)
    word = lambda n: "".join(r.choice("ab ") for _ in range(n))
    left = [(k, word(r.randrange(5, 60))) for k in range(80)] + [(90, "x" * 700 + "tail"), (91, None), (92, ""), (93, "same text here"), (93, "same text here"), (None, "same text here too"), (94, "in the middle of word")]
    right = [(k, word(r.randrange(5, 14))) for k in range(40)] + [(50, "x" * 690), (51, "x" * 700 + "other"), (52, "Same  TEXT here"), (53, None), (54, "iddle of wor"), (55, "y" * 5000)]
    docs, items = spark.createDataFrame(left, "d long, text string").repartition(3), spark.createDataFrame(right, "i long, text string")
    shape = lambda t: " ".join((t or "").lower().split())
    want = {(d, i, shape(b) in shape(a), shape(a) in shape(b)) for d, a in left for i, b in right if len(shape(a)) >= 10 <= len(shape(b)) and (shape(b) in shape(a) or shape(a) in shape(b))}
    assert sorted(map(repr, (tuple(r) for r in matching.contained_either(docs, "d", items, "i", "text").collect()))) == sorted(map(repr, want)) and len(want) >= 4
    assert matching.contained_either(docs.limit(0), "d", items, "i", "text").count() == 0 == matching.contained_either(docs, "d", items.limit(0), "i", "text").count()


# trees


def plain_roots(parents):
    out = {}
    for k in parents:
        at, depth, seen = k, 0, set()
        while at not in seen and parents[at] in parents:
            seen.add(at)
            at, depth = parents[at], depth + 1
        out[k] = (None, None, True) if at in seen else (at, depth, False)
    return out


def test_trees(spark):
    r = random.Random(5)
    parents = {k: r.choice([r.randrange(k), k - 1, 0]) if k else None for k in range(300)}
    parents |= {1000 + k: 1000 + (k + 1) % 5 for k in range(5)} | {1100: 1002, 1101: 1100, 2000: 9999, 2001: 2000, 3000: 3000, 3001: 3000}
    parents |= {5000 + k: 5000 + k - 1 if k else None for k in range(200)}
    rows = list(parents.items()) + [(None, 3), (5, parents[5])]
    df = spark.createDataFrame(rows, "k long, p long").repartition(3)
    got = closure.pointers(df, "k", "p", shared_path(spark, "t")).collect()
    assert {r.key: (r.root, r.depth, r.cyclic) for r in got} == plain_roots(parents) and len(got) == len(parents)
    chosen = [0, 7, 40, 5003, 5100, 1001, 3000, 424242, 1100, 299]
    want = set()
    for k in parents:
        at, depth, seen = k, 0, {k}
        while parents[at] in parents and parents[at] not in seen:
            at, depth = parents[at], depth + 1
            seen.add(at)
            if at in chosen:
                want.add((at, k, depth))
    got = closure.descendants(df, "k", "p", spark.createDataFrame([(c,) for c in chosen], "c long"), shared_path(spark, "t")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert closure.pointers(df.limit(0), "k", "p", shared_path(spark, "t")).count() == 0


# distributions


def test_sketched_quantiles(spark):
    """Rank error under one percent for sketches merged over days, against all values."""
    events = load(spark, "/root/testdata/sf0.1", "events")
    got = {r.event_type: r for r in catalogue.queries()["latency_sketched"](spark, "/root/testdata/sf0.1").collect()}
    for kind, r in got.items():
        values = sorted(x.value for x in events.where(F.col("event_type") == kind).select("value").collect())
        assert r.n == len(values) and r.least == values[0] and r.most == values[-1] and abs(r.avg - sum(values) / len(values)) < 1e-6
        for q in (0.5, 0.95, 0.99):
            v = r[f"p{round(q * 100)}"]
            low, high = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
            assert low - 0.01 <= q <= high + 0.01


def test_buckets(spark):
    values = [0.0, -1.5, 1.0, 2.0, 2.0000000001, 1024.0, 1e-300, 1e300, 3.7, 0.1, None, float("nan"), 2**0.25, 5.0] * 3
    df = spark.createDataFrame([(k % 2, v) for k, v in enumerate(values)], "g int, v double")
    for scale in (0, 2, 5):
        got = sketches.histogram(df, ["g"], "v", scale).collect()
        assert sum(r.n for r in got) == 36
        base = 2 ** (2.0**-scale)
        for r in got:
            inside = [v for k, v in enumerate(values) if k % 2 == r.g and v is not None and not math.isnan(v) and (v > 0) == (r.sign > 0) and (r.bucket is None or 2.0 ** (r.bucket / 2**scale) < v <= 2.0 ** ((r.bucket + 1) / 2**scale))]
            assert base > 1 and (r.bucket is None or len(inside) == r.n)
    fine, coarse = sketches.histogram(df, ["g"], "v", 3), sketches.histogram(df, ["g"], "v", 1)
    assert sorted(map(str, sketches.coarser(fine, ["g"], 2).collect())) == sorted(map(str, coarse.collect()))
    twice = sketches.merged_histograms(fine.unionAll(fine), ["g"])
    assert sorted((str(r.g), str(r.bucket), r.n) for r in twice.collect()) == sorted((str(r.g), str(r.bucket), 2 * r.n) for r in fine.collect())
    assert sketches.merged(sketches.daily(df.where("v is null").withColumn("d", F.lit(1)), F.col("d"), ["g"], "v"), ["g"], {"p": 0.5}).count() == 0
