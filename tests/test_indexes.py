"""The vector index and the keyword index against plain scans."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from quillspark.operators import keywords, vectors
from quillspark.plans import catalogue
from quillspark.sources.sinks import shared_path
from quillspark.sources.tables import load

SF = "/root/testdata/sf0.001"


def nearest(data, asked, top):
    out = {}
    for q, v in asked:
        scores = [(-(round(float(np.dot(v, x) / (np.linalg.norm(v) * np.linalg.norm(x))), 6) + 0.0), k) for k, x in data if k != q]
        out[q] = [(k, -s) for s, k in sorted(scores)[:top]]
    return out


def test_vector_recall_and_pruning(spark):
    e = load(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    index = vectors.build(e, "vec_id", "embedding", shared_path(spark, "v"), 64)
    data = [(r.vec_id, np.array(r.embedding, float)) for r in e.collect()]
    asked = e.where("vec_id % 20 = 0")
    want = nearest(data, [(k, v) for k, v in data if k % 20 == 0], 6)
    cells = index.cells(spark).count()
    assert cells >= 20 and index.rows(spark).count() == len(data)
    found = {}
    for r in vectors.search(index, asked, "vec_id", "embedding", 6).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    recall = sum(len(found.get(q, set()) & {k for k, _ in hits}) for q, hits in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.9, recall
    exact = vectors.search(index, asked, "vec_id", "embedding", 6, 8, exact=True).collect()
    assert {(r.query_id, r.place): r.id for r in exact} == {(q, p + 1): k for q, hits in want.items() for p, (k, _) in enumerate(hits)}
    plan = vectors._best(index, spark, [(0, data[0][1].tolist())], {1: [0]}, 6, True)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_vector_few_probes_where_rows_cluster(spark):
    """Ten tight clusters: a few of the cells hold all answers."""
    r = random.Random(6)
    heads = [[r.gauss(0, 1) for _ in range(16)] for _ in range(10)]
    rows = spark.createDataFrame([(k, [x + r.gauss(0, 0.05) for x in heads[k % 10]]) for k in range(1500)], "vec_id long, v array<double>")
    index = vectors.build(rows, "vec_id", "v", shared_path(spark, "v"), 16)
    probes = vectors.probes_for(index, rows.where("vec_id % 20 = 0"), "vec_id", "v", 6)
    assert 1 <= probes < index.cells(spark).count() / 3


def test_vector_edges(spark):
    """Nulls, wrong lengths, zeros, ties, repeated rows and ids; fewer rows than cells; the exact search with any number of probes."""
    r = random.Random(1)
    data = [(k, [r.gauss(0, 1) + 5 * (k % 3 == j) for j in range(3)]) for k in range(60)]
    odd = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, float("nan"), 0.0]), (103, [1.0, 2.0]), (104, [float("inf"), 1.0, 1.0]), (None, [1.0, 0.0, 0.0]), (105, [1.0, None, 2.0])]
    ties = [(200 + k, [1.0, 1.0, 1.0]) for k in range(9)] + [(200, [2.0, 2.0, 2.0])]
    rows = spark.createDataFrame(data + odd + ties, "vec_id long, v array<double>")
    asked = spark.createDataFrame([(0, data[0][1]), (200, [3.0, 3.0, 3.0]), (900, [0.0] * 3), (901, None), (0, data[0][1])], "q long, v array<double>")
    known = [(k, np.array(v)) for k, v in data + ties]
    want = nearest(known, [(0, np.array(data[0][1])), (200, np.array([3.0] * 3))], 5)
    for cells in (1, 7, 500):
        index = vectors.build(rows, "vec_id", "v", shared_path(spark, "v"), 3, cells)
        assert index.rows(spark).where("cell = -1").count() == 6
        for probes in (None, 1, 600):
            got = vectors.search(index, asked, "q", "v", 5, probes, exact=True).orderBy("query_id", "place").collect()
            assert [(r.query_id, r.place, r.id, r.score) for r in got] == [(q, p + 1, k, s) for q in (0, 200) for p, (k, s) in enumerate(want[q])]
    empty = vectors.build(rows.limit(0), "vec_id", "v", shared_path(spark, "v"), 3)
    assert vectors.search(empty, asked, "q", "v", 5, exact=True).count() == 0 == vectors.search(index, asked.limit(0), "q", "v", 5).count()


def test_vector_crowded_cell(spark):
    """A third of the rows in one cell are written and read by several tasks."""
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.sin("id"), F.cos("id"))).alias("v"))
    index = vectors.build(rows, "vec_id", "v", shared_path(spark, "v"), 2, 20)
    assert index.cells(spark).agg(F.sum("n"), F.max("n")).first()[0] == 3000
    got = vectors.search(index, spark.createDataFrame([(-1, [2.0, 0.0])], "q long, v array<double>"), "q", "v", 4, exact=True).orderBy("place")
    assert [r.id for r in got.collect()] == [0, 3, 6, 9]


def plain_bm25(docs, queries, top):
    find = lambda t: re.findall(r"\w+", t.lower())
    held = [(k, Counter(find(t)), len(find(t))) for k, t in docs if t is not None]
    n, mean = len(held), sum(x[2] for x in held) / max(1, len(held))
    out = []
    for q, text in queries:
        asked = sorted(set(find(text or "")))
        df = {w: sum(w in c for _, c, _ in held) for w in asked}
        hits = [(round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w in asked), 6), k) for k, c, size in held if asked and all(w in c for w in asked)]
        out += [(q, p + 1, k, s) for p, (s, k) in enumerate(sorted(hits, key=lambda h: (-h[0], h[1] is None, h[1] or 0))[:top])]
    return sorted(out)


@pytest.mark.parametrize("shards, block", [(16, 128), (3, 4)])
def test_keyword_index(spark, monkeypatch, shards, block):
    """Ties, nulls, repeated rows, words of every document, unknown words; blocks of any size give the scan's result."""
    monkeypatch.setattr(keywords, "SHARDS", shards)
    monkeypatch.setattr(keywords, "BLOCK", block)
    r = random.Random(2)
    docs = [(k, " ".join(r.choice(["the", "the", "a", "Rare", "ñandú", "x_1"] + [f"w{j}" for j in range(30)]) for _ in range(r.randrange(1, 60)))) for k in range(300)]
    docs += [(500, None), (501, ""), (502, "!!"), (None, "the a"), docs[0], docs[0], (7, "the rare w1")]
    queries = [(1, "the"), (2, "The rare!"), (3, "w1 w2 the a"), (4, ""), (5, None), (6, "nowhere the"), (7, "ÑANDÚ x_1 the the")]
    index = keywords.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), "doc_id", "text", shared_path(spark, "k"))
    asked = spark.createDataFrame(queries, "q long, text string")
    for top in (1, 5, 1000):
        got = keywords.search(index, asked, "q", "text", top, shared_path(spark, "s")).collect()
        assert sorted((r.query_id, r.place, r.id, r.score) for r in got if r.id is not None) == [w for w in plain_bm25(docs, queries, top) if w[2] is not None]
    assert keywords.search(index, asked.limit(0), "q", "text", 5, shared_path(spark, "s")).count() == 0
    empty = keywords.build(asked.limit(0), "q", "text", shared_path(spark, "k"))
    assert keywords.search(empty, asked, "q", "text", 5, shared_path(spark, "s")).count() == 0


def test_keyword_blocks_skipped(spark):
    """Blocks that can't reach a query's floor go unread, and the scan is pruned to the query's partitions."""
    docs = spark.range(40_000).select("id", F.concat(F.lit("common "), F.repeat(F.lit("common "), F.when(F.col("id") % 1000 == 0, 30).otherwise(0)), F.repeat(F.lit("pad "), (F.col("id") % 50).cast("int"))).alias("text"))
    index = keywords.build(docs, "id", "text", shared_path(spark, "k"))
    asked = spark.createDataFrame([(1, "common")], "q long, text string")
    able, _ = keywords.readable(index, asked, "q", "text", 2, shared_path(spark, "s"))
    every = index.heads(spark).where("term = 'common' and shard > 0").count()
    assert 0 < able.count() < every / 5
    plan = keywords._of(index.postings(spark), *keywords.weighed(index, asked, "q", "text"))._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_keyword_build_shuffles_nothing(spark, monkeypatch):
    """Postings are packed where the texts are read; segments of a few words give the scan's result."""
    monkeypatch.setattr(keywords, "BLOCK", 3)
    data = [(k, f"w{k % 3} w{k % 7} the the w{k}") for k in range(200)]
    plans, real = [], DataFrameWriter.parquet

    def noted(self, path, *args, **named):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        real(self, path, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    index = keywords.build(spark.createDataFrame(data, "id long, text string"), "id", "text", shared_path(spark, "k"))
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)
    asked = spark.createDataFrame([(1, "the w1"), (2, "w2 w5")], "q long, text string")
    got = keywords.search(index, asked, "q", "text", 9, shared_path(spark, "s")).collect()
    assert sorted((r.query_id, r.place, r.id, r.score) for r in got) == plain_bm25(data, [(1, "the w1"), (2, "w2 w5")], 9)


def test_keyword_segments(monkeypatch):
    """A segment's blocks: whole documents, no block of two terms, numbers of blocks that never repeat."""
    monkeypatch.setattr(keywords, "WAIT", 5)
    batches = [pa.RecordBatch.from_arrays([pa.array([(3 << 33) + k]), pa.array([k]), pa.array([["a"] * 2 + ["b"] * k])], names=["row", "id", "t"]) for k in range(6)]
    got = pa.Table.from_batches(keywords._segments(4, 2)(batches)).to_pylist()
    rows = [r for r in got if r["term"]]
    assert sum(r["seen"] or 0 for r in got) == 6 and sum(r["words"] or 0 for r in got) == 27
    assert len({(r["term"], r["shard"], r["block"]) for r in rows}) == len(rows) and max(len(r["docs"]) for r in rows) == 2
    assert sorted((r["term"], d["id"], d["tf"], d["n"]) for r in rows for d in r["docs"]) == sorted([("a", k, 2, k + 2) for k in range(6)] + [("b", k, k, k + 2) for k in range(1, 6)])


@pytest.mark.parametrize("name", ["cosine_indexed_exact", "keyword_indexed_topk"])
def test_index_queries(spark, name):
    compare(spark, name)


def compare(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    con.execute("set timezone='UTC'")
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(catalogue.oracles()[name])
    assert sorted(want.columns) == columns
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, want.select(*(f'"{c}"' for c in columns)).fetchall()))


def test_index_recall_query(spark):
    got = catalogue.queries()["cosine_indexed_topk"](spark, SF)
    exact = {(r.query_id, r.vec_id) for r in catalogue.queries()["cosine_indexed_exact"](spark, SF).collect()}
    assert len({(r.query_id, r.vec_id) for r in got.collect()} & exact) >= 0.9 * len(exact) > 0
