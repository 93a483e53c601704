"""Cases of the review's fourth round."""

import json
import random

import pytest
from pyspark.sql import DataFrameWriter

from quillspark.operators import patches
from quillspark.plans import catalogue
from quillspark.sources.sinks import shared_path
from tests.test_structures import made_object, merged


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") + plan.count("Exchange rangepartitioning")


def test_patches_take_no_more_disk_than_their_texts(spark, monkeypatch):
    """Nothing is written, and texts are shuffled once; of the query's tables, each once at most."""
    written = []
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, f=DataFrameWriter.parquet, **k: (written.append(path), f(self, path, *a, **k))[1])
    df = spark.createDataFrame([(k, s, '{"a":{"b":%d}}' % s) for k in range(9) for s in range(3)], "doc long, seq long, json string")
    done = patches.folded(df, "doc", "seq", "json", shared_path(spark, "p"), by_id=True)
    assert exchanges(done) == 1 and done.count() == 9
    assert exchanges(catalogue.queries()["patched_documents"](spark, "/root/testdata/sf0.001")) <= 3
    assert written == []


def test_patches_of_odd_kinds(spark):
    """Elements without an id stay as they are, a root that is no object takes the document's place, many patches are one walk."""
    docs = {
        1: [{"a": [{"id": "x"}]}, {"a": [{"id": "x", "v": None, "w": 1}, {"id": "y", "v": None}, {"n": None, "constructor": 1}, None]}, {"a": [{"id": "z"}]}],
        2: [{"a": [{"id": "x"}]}, {"a": [None, {"n": None}]}],
        3: [{"a": 1}, None], 4: [{"a": 1}, None, {"b": {"c": None}}], 5: [[{"id": "x"}], [{"id": "y", "n": None}]], 6: [None], 7: [{"a": [{"id": 1.5}]}, {"a": [{"id": ""}]}],
        8: [{"n": None, "constructor": 1, "t": "\x01\x1f\x7f\u2028é\"\\/\n"}, {"n": {"constructor": 1}}], 9: [{"l": []}, *({"l": [{"id": str(k % 700), "n": k}]} for k in range(3000))],
    }
    r = random.Random(5)
    docs |= {k: [made_object(r, 0) for _ in range(r.randrange(1, 7))] for k in range(20, 300)}
    data = [(k, n, json.dumps(v)) for k, vs in docs.items() for n, v in enumerate(vs)]
    want = {}
    for k, (state, *later) in docs.items():
        for v in later:
            state = merged(state, v, True)
        want[str(k)] = state
    got = patches.folded(spark.createDataFrame(data, "doc long, seq long, json string").repartition(5), "doc", "seq", "json", shared_path(spark, "p"), by_id=True).collect()
    assert len(got) == len(want) and {x.doc: json.loads(x.json) for x in got} == want


def test_patched_texts_have_sparks_form(spark):
    data = [(1, 0, ' {"z" : 1.50, "a":1e3, "m":[1.0, -0, 12345678901234567890123, {"y":1e-7,"b":"\\u0001\\u001F\\u00e9\\/"}], "k\\n\\u0002":true}')]
    df = spark.createDataFrame(data, "doc long, seq long, json string")
    assert patches.folded(df, "doc", "seq", "json").first().json == df.selectExpr("to_json(parse_json(json)) as j").first().j


@pytest.mark.parametrize("size", [1, 1 << 24])
def test_patches_across_batches(spark, monkeypatch, size):
    """Documents that span Arrow batches, and results that don't fit one."""
    monkeypatch.setattr(patches, "BATCH_CHARS", size)
    said = [("spark.sql.execution.arrow.maxRecordsPerBatch", "3")]
    before = {k: spark.conf.get(k) for k, _ in said}
    try:
        for k, v in said:
            spark.conf.set(k, v)
        rows = [(k, s, json.dumps({f"k{s}": k})) for k in range(11) for s in range(7)] + [(3, 2, "!"), (4, 2, "~"), (None, None, '{"a":null,"b":1}'), (12, 0, None), (12, 1, "["), (13, 1, "[]")]
        got = patches.folded(spark.createDataFrame(rows, "doc long, seq long, json string"), "doc", "seq", "json").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {str(k): {f"k{s}": k for s in range(7) if (k, s) != (4, 2)} for k in range(11)} | {None: {"b": 1}, "13": []}
    assert len(got) == len(want) and {x.doc: json.loads(x.json) for x in got} == want
