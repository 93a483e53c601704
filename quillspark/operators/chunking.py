"""Splitting texts (chunks with overlap, byte limits, breaks) and fuzzy ranking.

Each is sequential within one text only: texts go through ``mapInArrow``, without a shuffle; a batch's texts become Python strings
one at a time, and its pieces are given out a thousand at a time. A null text gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

OUT = 1000


def _pieces(df: DataFrame, id_: str, text: str, schema: str, split: Callable[[str], Iterator[tuple]]) -> DataFrame:
    fields = [df.schema[id_], *StructType.fromDDL(schema).fields]
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for batch in batches:
            rows, keys, values = [], batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                key = keys[k].as_py()
                for piece in split(values[k].as_py()):
                    rows.append((key, *piece))
                    if len(rows) == OUT:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

    return df.where(F.col(text).isNotNull()).select(id_, text).mapInArrow(run, StructType(fields))


def ranges(sizes: list[int], most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Runs of pieces of at most ``most`` together; a run opens with the last pieces of the one before that make up ``overlap``."""
    first = used = 0
    for at, size in enumerate(sizes):
        if at > first and used + size > most:
            yield first, at
            floor, first, used = first, at, 0
            while first > floor and used < overlap:
                first -= 1
                used += sizes[first]
        used += size
    if sizes:
        yield first, len(sizes)


def markdown(df: DataFrame, id_: str, text: str, tokens: int = 400, overlap: int = 80) -> DataFrame:
    """Chunks of whole lines, four characters to a token: start_line and end_line (from 1), text, hash. Longer lines are cut."""
    most, shared = max(32, tokens * 4), max(0, overlap * 4)

    def split(value):
        parts = [(n, line[k : k + most]) for n, line in enumerate(value.split("\n"), 1) for k in range(0, max(1, len(line)), most)]
        for a, b in ranges([len(p) + 1 for _, p in parts], most, shared):
            chunk = "\n".join(p for _, p in parts[a:b])
            yield parts[a][0], parts[b - 1][0], chunk, hashlib.sha256(chunk.encode()).hexdigest()

    return _pieces(df, id_, text, "start_line int, end_line int, text string, hash string", split)


def byte_limited(df: DataFrame, id_: str, text: str, most: int) -> DataFrame:
    """Parts of at most ``most`` UTF-8 bytes, never inside a character: part (from 0), text. A character above the limit stands alone."""

    def split(value):
        data, at, part = value.encode(), 0, 0
        while at < len(data) or part == 0:
            end = min(len(data), at + most)
            while end < len(data) and end > at and data[end] & 0xC0 == 0x80:
                end -= 1
            if end == at and at < len(data):
                end = at + 1
                while end < len(data) and data[end] & 0xC0 == 0x80:
                    end += 1
            yield part, data[at:end].decode()
            at, part = end, part + 1

    return _pieces(df, id_, text, "part int, text string", split)


def at_breaks(df: DataFrame, id_: str, text: str, most: int) -> DataFrame:
    """Parts of at most ``most`` characters that end at white space where there is some: part (from 0), text, trimmed."""

    def split(value):
        at, part = 0, 0
        while at < len(value):
            end = min(len(value), at + most)
            if end < len(value):
                found = re.search(r"\s\S*\Z", value[at:end])
                end = at + found.start() if found and found.start() else end
            piece = value[at:end].rstrip() if end < len(value) else value[at:end]
            if piece:
                yield part, piece
                part += 1
            at = end
            while 0 < at < len(value) and value[at].isspace():
                at += 1

    return _pieces(df, id_, text, "part int, text string", split)


def fuzzy_score(query: str):
    """A pandas UDF that scores labels: every word of the query must be a subsequence; the lower the better, null without a match.

    Fixed values: a character costs a tenth of its place and twice the gap before it; runs earn 5, 10, 15 and so on, starts of words 10."""
    wanted = query.lower().split()

    def one(word: str, label: str) -> float | None:
        score, last, run = 0.0, -1, 0
        for ch in word:
            at = label.find(ch, last + 1)
            if at < 0:
                return None
            run = run + 1 if at == last + 1 else 0
            gap = 2 * (at - last - 1) if last >= 0 else 0
            start = at == 0 or re.match(r"[\s\-_./:#@]", label[at - 1])
            score += gap - 5 * run + 0.1 * at - (10 if start else 0)
            last = at
        return score

    @F.pandas_udf("double")
    def score(labels: pd.Series) -> pd.Series:
        found = ([one(w, label.lower()) for w in wanted] if label is not None else [None] for label in labels)
        return pd.Series([None if None in f else float(sum(f)) for f in found], dtype="float64", index=labels.index)

    return score
