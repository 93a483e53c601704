"""Merge patches of nested JSON documents: a base and any number of patches fold into one document.

A patch replaces what it names, descends where both sides are objects, and deletes with null; one that is no object takes the whole
document's place. Texts are dealt by document and sorted by place, once; a task walks them in Arrow batches with one state, the document at hand, so memory is
bounded by a batch and a document, however many patches it has. Nothing is written but that shuffle, whose rows are the given texts: nodes as
rows would repeat their document and path at each step. A document's patches are walked by one task.

With ``by_id``, an array below the root whose objects with an id all have one of their own merges into one of such elements: same ids merge, new
ones and elements without an id, as they are, follow in their order. An array that got an element
without an id, or that repeats one, is replaced by the next array as any other.

A text that isn't JSON changes nothing; a null in the base stays; keys of ``BLOCKED`` are ignored in patches. Keys come in
alphabetical order, numbers in Spark's form. A document without a base starts from nothing. Rows that repeat document and place: the greatest
text counts. A null document is one of its own.
"""

from __future__ import annotations

import json as js
import sys
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a patch can't set.
BLOCKED = ["__proto__", "prototype", "constructor"]
#: Characters of documents that a batch of results holds at most, besides the last.
BATCH_CHARS = 1 << 24
ABSENT = ...  # the same object in every worker
_ESCAPED = {n: f"\\u{n:04X}" for n in range(32)} | str.maketrans({'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"})


class _Number:
    """A number with a fraction or an exponent, in the text's form."""

    def __init__(self, text: str):
        self.text = text


class _Keyed(list):
    """An array with the places of its elements by id; None if one has no id."""

    at: dict[str, int] | None


_READ = js.JSONDecoder(parse_float=_Number, parse_constant=_Number).decode
_WRITE = js.JSONEncoder(ensure_ascii=False, check_circular=False, sort_keys=True, separators=(",", ":")).encode


def _id(x: object) -> str | None:
    name = x.get("id") if type(x) is dict else None
    return name if type(name) is str and name else None


def _told_apart(v: list) -> bool:
    """Some elements have an id (or there are none), and no id repeats."""
    ids = [name for x in v if (name := _id(x))]
    return len(set(ids)) == len(ids) and (bool(ids) or not v)


def _joined(base: object, patch: list) -> list:
    """Array ``patch`` merged by id into ``base``, or in its place if that has other elements."""
    if not isinstance(base, _Keyed):
        ids = [_id(x) for x in base] if isinstance(base, list) else [None]
        fits = None not in ids and len(set(ids)) == len(ids)
        base = _Keyed(base if fits else [])
        base.at = {name: n for n, name in enumerate(ids)} if fits else {}
    elif base.at is None:
        base = _Keyed()
        base.at = {}
    at = base.at
    for x in patch:
        name = _id(x)
        if name is None:
            base.at = None  # for the next array
            base.append(x)
        elif name in at:
            base[at[name]] = merged(base[at[name]], x, True)
        else:
            at[name] = len(base)
            base.append(merged(ABSENT, x, True))
    return base


def merged(base: object, patch: object, by_id: bool) -> object:
    """``base``, which may be changed in place, after ``patch``."""
    if type(patch) is not dict:
        return patch
    out = base if type(base) is dict else {}
    for k, v in patch.items():
        if k in BLOCKED:
            continue
        if v is None:
            out.pop(k, None)
        elif by_id and type(v) is list and _told_apart(v):
            out[k] = _joined(out.get(k), v)
        else:
            out[k] = merged(out.get(k), v, by_id)
    return out


def _spelled(v: object) -> str:
    if isinstance(v, _Number):
        return v.text
    if isinstance(v, str):
        return f'"{v.translate(_ESCAPED)}"'
    if isinstance(v, dict):
        return "{" + ",".join([f"{_spelled(k)}:{_spelled(v[k])}" for k in sorted(v)]) + "}"
    if isinstance(v, list):
        return "[" + ",".join([_spelled(x) for x in v]) + "]"
    return "null" if v is None else str(v).lower()


def _text(v: object) -> str:
    """JSON as Spark writes it, with keys in alphabetical order. The quick writer knows no ``_Number`` and writes escapes by other digits."""
    try:
        text = _WRITE(v)
    except TypeError:
        return _spelled(v)
    return _spelled(v) if "\\u00" in text else text


def _after(state: object, seq: int | None, text: str, by_id: bool) -> object:
    value = _READ(text)
    return value if state is ABSENT and seq == 0 else merged(state, value, by_id)


def _walk(by_id: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))  # Spark reads JSON to a depth of 1000
        rows = chain.from_iterable(zip(*(b.column(k).to_pylist() for k in range(3))) for b in batches)
        docs, texts, size, state, held = [], [], 0, ABSENT, next(rows, None)
        while held is not None:
            doc, seq, text = held
            held = next(rows, None)
            if held is not None and held[:2] == (doc, seq):
                continue  # the greatest text of a place comes last
            if text is not None:
                state = _after(state, seq, text, by_id)
            if held is not None and held[0] == doc:
                continue
            if state is not ABSENT:
                docs.append(doc)
                texts.append(_text(state))
                size, state = size + len(texts[-1]), ABSENT
            if size > BATCH_CHARS or held is None or len(docs) == 10_000:
                yield pa.RecordBatch.from_pydict({"doc": pa.array(docs, pa.string()), "json": pa.array(texts, pa.string())})
                docs, texts, size = [], [], 0

    return run


def folded(patches: DataFrame, doc: str, seq: str, json: str, path: str | None = None, by_id: bool = False) -> DataFrame:
    """doc (as text), json: each document after all its patches. ``seq`` orders them; 0 is the base. ``path``: of no use, nothing is written."""
    rows = patches.select(F.col(doc).cast("string").alias("doc"), F.col(seq).cast("long").alias("seq"), F.col(json).alias("json"))
    rows = rows.repartition("doc").sortWithinPartitions("doc", "seq", "json").select("doc", "seq", F.to_json(F.try_parse_json("json")).alias("json"))
    return rows.mapInArrow(_walk(by_id), "doc string, json string")
