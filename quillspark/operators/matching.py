"""Joins and merges on text identity: containment by automata, and the merge of sightings of one entity."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions.places import compared

BLOCK_BYTES, PREFIX, CHUNK_CHARS = 4 << 20, 256, 1 << 20


class Finder:
    """Which of some texts stand in a text, in one pass over it. A long text's first ``PREFIX`` characters find it, the rest is compared."""

    def __init__(self, texts: list[str]):
        starts: dict[str, list[int]] = {}
        for k, t in enumerate(texts):
            starts.setdefault(t[:PREFIX], []).append(k)
        self.texts, self.machine = texts, ahocorasick.Automaton()
        for start, mine in starts.items():
            self.machine.add_word(start, (len(start), mine))
        self.machine.make_automaton() if starts else None
        self.any = bool(starts)

    def within(self, text: str) -> set[int]:
        found: set[int] = set()
        for end, (size, mine) in self.machine.iter(text) if self.any else ():
            at = end - size + 1
            found.update(k for k in mine if k not in found and text.startswith(self.texts[k], at))
        return found


def _pairs(docs: DataFrame, doc_id: str, items: DataFrame, item_id: str, both: bool, least: int) -> DataFrame:
    """doc_id, item_id, way ("holds": the document holds the item; "held": the item holds the document) over column _text.
    Documents of fewer than ``least`` characters, and null ones, match nothing.

    Items are sent in blocks of some ``BLOCK_BYTES`` by a hash of the item, each one more map over the documents; no row is shuffled. For
    the second way a task gathers those of its documents that aren't longer than the longest item, builds their automaton,
    some ``CHUNK_CHARS`` at a time, and reads the items."""
    spark = docs.sparkSession
    items = items.select(item_id, "_text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    blocks = 1 + size // BLOCK_BYTES
    kinds = [to_arrow_type(docs.schema[doc_id].dataType), to_arrow_type(items.schema[item_id].dataType), pa.string()]
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, way string"
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64(item_id, "_text"), F.lit(blocks)) == k).collect()
        if not block:
            continue
        sent = spark.sparkContext.broadcast(([r[0] for r in block], [r[1] for r in block]))

        def run(batches, sent=sent):
            ids, texts = sent.value
            finder, longest = Finder(texts), max(map(len, texts))

            def rows(pairs, way):
                pairs = list(pairs)
                arrays = [pa.array([p[0] for p in pairs], kinds[0]), pa.array([p[1] for p in pairs], kinds[1]), pa.array([way] * len(pairs), kinds[2])]
                return pa.RecordBatch.from_arrays(arrays, names=[doc_id, item_id, "way"])

            def held(short):
                mine = Finder([t for _, t in short])
                return rows(((short[d][0], ids[i]) for i, text in enumerate(texts) for d in mine.within(text)), "held")

            short, chars = [], 0
            for batch in batches:
                # the length is asked here: a filter on _text would make Spark shape each text twice
                known = [(n, body) for n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if body is not None and len(body) >= least]
                names, bodies = [n for n, _ in known], [body for _, body in known]
                yield rows(((n, ids[i]) for n, body in zip(names, bodies) for i in finder.within(body)), "holds")
                for n, body in zip(names, bodies) if both else ():
                    if len(body) <= longest:
                        short.append((n, body))
                        chars += len(body)
                        if chars >= CHUNK_CHARS:
                            yield held(short)
                            short, chars = [], 0
            if short:
                yield held(short)

        out = out.unionByName(docs.select(doc_id, "_text").mapInArrow(run, schema))
    return out


def _long(df: DataFrame, id_: str, text, least: int) -> DataFrame:
    return df.select(id_, text.alias("_text")).where(F.length("_text") >= least)


def contained(docs: DataFrame, doc_id: str, items: DataFrame, item_id: str, text: str, least: int) -> DataFrame:
    """Pairs (doc_id, item_id) where the item's text, of ``least`` characters and more, stands in the document's. Null texts match nothing."""
    return _pairs(docs.select(doc_id, F.col(text).alias("_text")), doc_id, _long(items, item_id, F.col(text), least), item_id, False, least).select(doc_id, item_id)


def contained_either(docs: DataFrame, doc_id: str, items: DataFrame, item_id: str, text: str, least: int = 10, folded: bool = True) -> DataFrame:
    """Pairs where either text stands in the other: doc_id, item_id, holds, held (both for equal texts).

    Texts are compared trimmed, lower-cased, without pictographs and with single spaces, unless not ``folded``, and have ``least``
    characters then. Null texts match nothing; rows that repeat id and text give a pair once."""
    shape = compared(F.col(text)) if folded else F.col(text)
    found = _pairs(docs.select(doc_id, shape.alias("_text")), doc_id, _long(items, item_id, shape, least), item_id, True, least)
    return found.groupBy(doc_id, item_id).agg(F.bool_or(F.col("way") == "holds").alias("holds"), F.bool_or(F.col("way") == "held").alias("held"))


def merge_sightings(df: DataFrame, key: str, seq: str, detail: str, plain: list[str], longest: list[str]) -> DataFrame:
    """One row for each key from its sightings in the order of ``seq``: key, the fields, ``detail``, sightings.

    A field takes its first value that isn't empty, and a field of ``longest`` its longest (the first of equals). The first
    sighting with ``detail`` overrides what came before it where it has a value; after it a longest field can only grow.
    Rows without a key stay as they are. The fold has this closed form, so it is two partial aggregations, whatever the size of a key.
    """
    filled = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(c))
    known = df.where(F.col(key).isNotNull())
    first = lambda c, when: F.min(F.when(when & filled(c).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(c).alias("v"))))["v"]
    most = lambda c, when: F.max(F.when(when & filled(c).isNotNull(), F.struct(F.length(F.col(c)).alias("n"), (-F.col(seq)).alias("s"), F.col(c).alias("v"))))["v"]
    opened = known.where(F.col(detail)).groupBy(key).agg(F.min(seq).alias("_open"))
    rows, any_row = known.join(opened, key, "left"), F.lit(True)
    at, after = F.col(seq) == F.col("_open"), F.col(seq) >= F.col("_open")
    fields = [F.coalesce(first(c, at), first(c, any_row)).alias(c) for c in plain]
    fields += [F.when(first(c, at).isNotNull(), most(c, after)).otherwise(most(c, any_row)).alias(c) for c in longest]
    merged = rows.groupBy(key).agg(*fields, F.bool_or(F.coalesce(detail, F.lit(False))).alias(detail), F.count("*").alias("sightings"))
    lone = df.where(F.col(key).isNull()).select(key, *plain, *longest, F.coalesce(detail, F.lit(False)).alias(detail), F.lit(1).cast("long").alias("sightings"))
    return merged.union(lone)
