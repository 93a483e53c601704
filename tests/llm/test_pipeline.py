from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import mixing
from quillspark.llm.common import written

SF = "/root/testdata/sf0.01"


def test_stages_in_turn(spark):
    """Each stage keeps a part of what it gets, with the columns of documents; the run equals its stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= left and ids
        assert out.columns[: len(columns)] == columns and (name == "mix" or out.columns == columns)
        docs, left = out, set(ids)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == left


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_rows_of_one_id_are_judged_apart(spark):
    """Repeats, nulls and clashing columns, stage by stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good, bad = (max((d for d, q in labels.items() if q == want), key=lambda d: len(texts[d])) for want in (1, 0))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    extra = docs.withColumns({"score": F.lit(1), "raw": F.lit("x"), "_id": F.lit(2), "size": F.lit(3), "leaf": F.lit(4)})
    other = [(7, texts[good]), (7, texts[bad]), (7, texts[good]), (7, None), (None, texts[good] + " and more"), (7, "a clean sentence then " + item)]
    rows = extra.limit(0).union(spark.createDataFrame([(d, t, "en", "s", 1, 1, "x", 2, 3, 4) for d, t in other], extra.schema))
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality"](spark, rows, SF)
    assert kept.columns == rows.columns
    assert stage["exact"](spark, rows, SF).count() == 5 and stage["exact"](spark, rows, SF).columns == rows.columns
    near = stage["near"](spark, rows, SF).collect()
    assert len(near) == 4 and [r.doc_id for r in near if (r.text or "").startswith(texts[good][:50])] == [7]
    clean = stage["leaks"](spark, rows, SF)
    assert clean.count() == 5 and clean.columns == rows.columns
    mixed = stage["mix"](spark, rows, SF)
    assert {"given_size", "size", "taken", "first_slot", "_id", "raw"} <= set(mixed.columns)


def test_mix_tells_rows_of_one_id_apart(spark):
    """The stage takes of each row what the operator takes of it; equal rows share it."""
    word = lambda n, w: " ".join([w] * n)
    data = [(7, word(1000, "a"), "s"), (7, word(10, "b"), "s"), (None, word(20, "c"), "s"), (None, word(20, "d"), "s"), (8, word(33, "e"), None), (8, word(33, "e"), None), (8, word(33, "e"), None), (9, "", "s"), (9, None, "t")]
    d = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("taken", F.lit("given"))
    want, got = mixing.mix_words(d).where("taken > 0").collect(), mixing.mixed(d).collect()
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in got if r.doc_id != 8) == sorted((r.doc_id or 0, r.size, r.taken) for r in want if r.doc_id != 8)
    assert sum(r.taken for r in got) == sum(r.taken for r in want)
    assert all(r.size == len((r.text or "").split()) and r.taken <= 2 * r.size and r.given_taken == "given" for r in got)
    eights = [r.taken for r in got if r.doc_id == 8]
    assert len(eights) == 3 and max(eights) - min(eights) <= 1


def test_tables_of_earlier_stages_go(spark):
    before = len(written)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "taken", "first_slot").collect()
    assert len(written) - before < 6 and len({r.first_slot for r in got}) > len(got) / 3
