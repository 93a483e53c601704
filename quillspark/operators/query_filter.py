"""The ``key:value`` filter language over session rows, compiled to a Column.

Terms are split at white space (double quotes hold one together) and joined by AND; the first colon splits key and value.
Unknown keys and bad numbers match everything and give a warning.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = {"agent": "agent", "channel": "channel", "chat": "channel", "provider": "provider", "model": "model", "tool": "tool", "label": "label", "key": "key", "session": "session_id", "id": "session_id"}
NUMBERS = {"tokens": "total_tokens", "cost": "total_cost", "messages": "messages"}
FLAGS = {"errors": "errors", "tools": "tool_calls"}


def terms(query: str) -> list[tuple[str | None, str]]:
    out = []
    for raw in re.findall(r'"[^"]*"|(?:[^\s"]|"[^"]*")+', query):
        key, colon, value = raw.partition(":")
        out.append((key.lower(), value.strip('"').strip()) if colon and not raw.startswith('"') else (None, raw.strip('"').strip()))
    return [t for t in out if t[0] or t[1]]


def number(text: str) -> float | None:
    m = re.fullmatch(r"\$?(\d+(?:\.\d+)?)([km]?)", text.strip().lower())
    return float(m[1]) * {"": 1, "k": 1e3, "m": 1e6}[m[2]] if m else None


def matches(value: str, column: Column) -> Column:
    """Contains, or with ``*`` and ``?`` an anchored glob; both without regard to case; null never matches."""
    if "*" in value or "?" in value:
        pattern = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in value)
        return F.coalesce(column.rlike(f"(?is)^{pattern}$"), F.lit(False))
    return F.coalesce(F.contains(F.lower(column), F.lit(value.lower())), F.lit(False))


def compile_query(query: str, columns: list[str]) -> tuple[Column, list[str]]:
    """The predicate, and warnings."""
    parts, warnings = [F.lit(True)], []
    for key, value in terms(query):
        if key is None:
            parts.append(reduce(lambda a, b: a | b, [matches(value, F.col(c)) for c in ("label", "key", "session_id") if c in columns]))
        elif not value:
            warnings.append(f"missing value: {key}")
        elif key in TEXT and TEXT[key] in columns:
            parts.append(matches(value, F.col(TEXT[key])))
        elif key == "has":
            if value.lower() in FLAGS:
                parts.append(F.coalesce(F.col(FLAGS[value.lower()]) > 0, F.lit(False)))
            else:
                warnings.append(f"unknown has: {value}")
        elif (m := re.fullmatch(r"(min|max)(\w+)", key)) and m[2] in NUMBERS:
            if (limit := number(value)) is None:
                warnings.append(f"bad number: {value}")
            else:
                c = F.coalesce(F.col(NUMBERS[m[2]]), F.lit(0))
                parts.append(c >= limit if m[1] == "min" else c <= limit)
        else:
            warnings.append(f"unknown key: {key}")
    return reduce(lambda a, b: a & b, parts), warnings


def apply(df: DataFrame, query: str) -> DataFrame:
    return df.where(compile_query(query, df.columns)[0])
