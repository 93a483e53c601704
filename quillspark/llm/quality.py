"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. All of a text is
compressed with each, in blocks of ``BLOCK`` bytes so that a long text can't serve as its own dictionary; the difference of
the two sizes over the text's length says which kind it resembles, and a logistic curve of it and the text's shortness, fitted
on labelled rows that built no dictionary, turns it into a probability. Scoring reads whole texts and nothing but the text.

Fitting uses at most ``SAMPLE`` labelled rows (those with the smallest hash of doc_id) and at most ``PIECES`` pieces of
``PIECE`` characters of each, drawn by hash from its whole length: that bound makes the driver's work (some 100 MB at most) and the
broadcast model (two dictionaries of ``DICTIONARY`` bytes) constant. All
counts else are over all rows. Three quarters of the sample build the dictionaries, one quarter fits the curve; if a part
lacks a class, all of the sample serves for both, and without any of one class the score is the other's share.

Nulls: a null text is scored as an empty one; a null doc_id isn't held out and never trains; labels that are null are
ignored. An empty text has the score of difference 0. Repeated rows get equal results; of several texts of a labelled doc_id the
smallest trains.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, keep_where, rows_of, table

SAMPLE, PIECES, DICTIONARY, PIECE, BLOCK, SHORT, LEVEL, THRESHOLD = 6000, 16, 112 << 10, 1024, 1024, 64, 3, 0.7
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]

    def score(self, text: bytes, compressors) -> float:
        z = sum(w * x for w, x in zip(self.weights, features(text, compressors) if compressors else (0.0, 0.0, 1.0)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

    def compressors(self):
        if not self.good or not self.bad:
            return None
        return [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_dict_id=False)
            for x in (self.good, self.bad)
        ]


def features(text: bytes, compressors) -> tuple[float, float, float]:
    """The normalised difference (above 0 if the good dictionary fits better), the shortness of the text, and 1."""
    sizes = [0, 0]
    for k in range(0, len(text), BLOCK):
        for i, c in enumerate(compressors):
            sizes[i] += len(c.compress(text[k : k + BLOCK]))
    return (sizes[1] - sizes[0]) / max(1, len(text)), SHORT / (SHORT + len(text)), 1.0


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)]
    pieces.sort(key=zlib.crc32)
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"\n".join(pieces)[:DICTIONARY].ljust(8, b" ")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of the columns of ``x``, the last of them constant, by Newton's method with a slight pull towards 0."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[-1] = 1.0
    a = x / scale
    pull = np.array([0.1, 2.0, 1e-6])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + pull * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        w = w - (step := np.linalg.solve(hess, grad))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w / scale))


def fit_rows(rows: list[tuple[int, str, int]]) -> Model:
    """From (doc_id, text, label) rows."""
    rows = sorted(rows)
    labels = [x[2] for x in rows]
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return Model(b"", b"", (0.0, 0.0, math.log(share / (1 - share))))
    curve = [zlib.crc32(b"curve %d" % x[0]) % 4 == 0 for x in rows]
    if any(len({x[2] for x, c in zip(rows, curve) if c == part}) < 2 for part in (True, False)):
        build = check = rows
    else:
        build, check = [x for x, c in zip(rows, curve) if not c], [x for x, c in zip(rows, curve) if c]
    model = Model(*(_dictionary([x[1].encode() for x in build if x[2] == label]) for label in (1, 0)), (1.0, 0.0, 0.0))
    tools = model.compressors()
    x = np.array([features(r[1].encode(), tools) for r in check])
    return Model(model.good, model.bad, _logistic(x, np.array([r[2] for r in check], float)))


def drawn(doc_id: Column, text: Column, pieces: int = PIECES) -> Column:
    """The text, or if it is longer ``pieces`` pieces of it in their order, those with the smallest hashes."""
    last = F.floor((F.length(text) - 1) / PIECE).cast("int")
    every = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.xxhash64(doc_id, k), k.alias("k")))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(every), 1, pieces), lambda x: x["k"]))
    parts = F.transform(chosen, lambda k: F.substring(text, k * PIECE + 1, F.lit(PIECE)))
    return F.when(last < pieces, text).otherwise(F.array_join(parts, ""))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pieces: int = PIECES) -> Model:
    chosen = (
        labels.where(f"quality is not null and doc_id is not null and not {HELD_OUT}")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = documents(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", drawn(F.col("doc_id"), text, pieces).alias("text"), "quality")
    return fit_rows([(r[0], r[1], int(r[2] == 1)) for r in texts.groupBy("doc_id").agg(F.min("text"), F.min("quality")).collect()])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        tools = m.compressors()
        for batch in batches:
            ids, out = [], []
            for doc_id, text in rows_of(batch):
                ids.append(doc_id)
                out.append(m.score(text or b"", tools))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose own text the classifier doesn't reject, with all their columns; a map without a shuffle of texts."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def judge():
        model = sent.value
        tools = model.compressors()
        return lambda text: model.score(text or b"", tools) >= THRESHOLD

    return keep_where(docs, judge)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES, ORACLES = {"op7_quality": op7_quality}, {}
