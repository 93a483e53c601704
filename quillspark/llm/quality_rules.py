"""Quality rules: how much of a text repeats.

Words are interned to numbers text by text; rolling hashes of their runs, for each length of ``LIMITS``, find the runs that
stand in the text twice or more (equal hashes are compared word by word, so a collision changes nothing). What counts is
the characters of the words inside such runs, overlaps once, and the characters of lines equal to an earlier line, each over the
characters of all words. First occurrences don't count there, as is usual with these limits, so that a clean text with
one line said twice stays. The base rules (too few words, too many words in runs of five found twice, first occurrences included)
come first; ``kept`` adds the method's limits.

One map over whole texts without a shuffle. Memory is a few dozen bytes for each word of the longest text; a text is split
in pieces, so that its words never stand in one list.

Nulls: a null text has no words, fails the base rules and has zeros; a null doc_id is passed through. Repeated rows each
have a row of the result. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import documents, keep_where, mixed, prefix_hash, rows_of, table, word_lists

#: Most characters, in hundredths of all word characters, inside repeated runs of so many words, and in repeated lines (published limits for web text).
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
LINE_LIMIT = 20
FEWEST_WORDS, REPEAT_LIMIT, BASE = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
_INSIDE = np.ones(256, bool)  # bytes that begin a character of a word
_INSIDE[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = False


def _chars(text: bytes) -> int:
    return int(np.count_nonzero(_INSIDE[np.frombuffer(text, np.uint8)]))


def interned(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word, equal for equal words, and the characters of each number's word."""
    ids: dict[bytes, int] = {}
    parts = [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)) for words in word_lists(text)]
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.fromiter((len(w.decode("utf-8", "replace")) for w in ids), np.int64, len(ids))


def repeated_starts(ids: np.ndarray, hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``starts`` (ascending) whose run of ``n`` words also begins at another of them, and those at an earlier one.

    ``hashes`` are of the runs."""
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    if not len(same):
        return starts[:0], starts[:0]
    a, b = starts[order[same]], starts[order[same + 1]]
    if not all(np.array_equal(ids[a + k], ids[b + k]) for k in range(n)):  # unequal runs share a hash
        runs = np.stack([ids[starts + k] for k in range(n)], axis=1)
        which = np.unique(runs, axis=0, return_inverse=True)[1].reshape(-1)
        return tuple(starts[x] for x in repeated_starts(which, which, np.arange(len(which)), 1))
    return np.sort(starts[order[np.union1d(same, same + 1)]]), np.sort(starts[order[same + 1]])


def _words_at(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    edges = np.zeros(size + 1, np.int32)
    edges[starts] += 1
    edges[starts + n] -= 1
    return np.cumsum(edges[:-1]) > 0


def covered(ids: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Which words stand in a run of ``BASE`` words found twice or more; for each length of ``LIMITS``, which stand in a run found before."""
    base, out = np.zeros(len(ids), bool), {n: np.zeros(len(ids), bool) for n in LIMITS}
    if len(ids) <= BASE:
        return base, out
    sums, inverse = prefix_hash(mixed(ids.astype(np.uint64) + np.uint64(1)))
    starts = np.arange(len(ids) - BASE + 1)
    for n in sorted(LIMITS):
        starts = starts[starts <= len(ids) - n]
        starts, later = repeated_starts(ids, (sums[starts + n] - sums[starts]) * inverse[starts], starts, n)
        if n == BASE:
            base = _words_at(starts, n, len(ids))
        out[n] = _words_at(later, n, len(ids))
        starts = starts[:-1][np.diff(starts) == 1]  # both shorter runs of a longer repeated run are repeated
        if not len(starts):
            break
    return base, out


def measured(text: bytes | None) -> dict:
    """The result's columns but doc_id."""
    text = text or b""
    ids, lengths = interned(text)
    chars, (base, later) = lengths[ids], covered(ids)
    out = {"n_words": len(ids), "word_chars": int(chars.sum()), "n_symbols": sum(text.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS)))}
    seen: set[bytes] = set()
    out |= {"n_dup_lines": 0, "n_repeat_words": int(base.sum()), "dup_line_chars": 0}
    for line in io.BytesIO(text):
        line = line.removesuffix(b"\n")
        if line in seen:
            out["n_dup_lines"] += 1
            out["dup_line_chars"] += _chars(line)
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    out |= {f"dup_chars_{n}": int(chars[m].sum()) for n, m in later.items()}
    out["base_failed"] = out["n_words"] < FEWEST_WORDS or 100 * out["n_repeat_words"] > REPEAT_LIMIT * out["n_words"]
    fits = all(100 * out[f"dup_chars_{n}"] <= most * out["word_chars"] for n, most in LIMITS.items())
    out["kept"] = not out["base_failed"] and fits and 100 * out["dup_line_chars"] <= LINE_LIMIT * out["word_chars"]
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in LIMITS))
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame) -> DataFrame:
    """The measures of each document and whether the rules keep it."""

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), [measured(text) for _, text in rows_of(batch)]
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in COUNTS] + [pa.array([r[c] for r in rows], pa.bool_()) for c in ("base_failed", "kept")]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *COUNTS, "base_failed", "kept"])

    return documents(docs).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns; a map."""
    return keep_where(docs, lambda: lambda text: measured(text)["kept"])


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def _sql() -> str:
    longest = max(LIMITS)
    leads = ", ".join(f"lead(word, {k}) over p as w{k}" for k in range(1, longest))
    gram = {n: " || ' ' || ".join(["word", *(f"w{k}" for k in range(1, n))]) for n in LIMITS}
    twice = f"case when w{BASE - 1} is not null and count(*) over (partition by nth, {gram[BASE]}) > 1 then 1 else 0 end as d0, "
    twice += ", ".join(f"case when w{n - 1} is not null and row_number() over (partition by nth, {gram[n]} order by pos) > 1 then 1 else 0 end as d{n}" for n in LIMITS)
    inside = ", ".join(f"max(d{n}) over (partition by nth order by pos rows between {(n or BASE) - 1} preceding and current row) as c{n}" for n in (0, *LIMITS))
    sums = ", ".join(f"sum(chars * c{n}) as dup_chars_{n}" for n in LIMITS)
    zero = lambda c: f"coalesce({c}, 0)::bigint as {c}"
    limits = " and ".join(f"100 * dup_chars_{n} <= {most} * word_chars" for n, most in LIMITS.items())
    return f"""
with d as (select row_number() over () as nth, doc_id, coalesce(text, '') as text from documents),
w as (select nth, unnest(words) as word, unnest(range(len(words))) as pos from (select nth, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from d)),
l as (select nth, pos, word, length(word) as chars, {leads} from w window p as (partition by nth order by pos)),
t as (select nth, pos, chars, {twice} from l),
c as (select nth, chars, {inside} from t),
s as (select nth, count(*) as n_words, sum(chars) as word_chars, sum(c0) as n_repeat_words, {sums} from c group by nth),
lines as (select nth, unnest(parts) as line, unnest(range(len(parts))) as spot from (select nth, string_split(text, chr(10)) as parts from d)),
again as (select nth, count(*) as n_dup_lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g'))) as dup_line_chars
  from (select nth, line, row_number() over (partition by nth, line order by spot) as k from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]')) where k > 1 group by nth),
m as (select doc_id, {", ".join(zero(c) for c in COUNTS if c != "n_symbols")}, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols
  from d left join s using (nth) left join again using (nth)),
b as (select *, n_words < {FEWEST_WORDS} or 100 * n_repeat_words > {REPEAT_LIMIT} * n_words as base_failed from m)
select *, not base_failed and {limits} and 100 * dup_line_chars <= {LINE_LIMIT} * word_chars as kept from b"""


SQL = _sql()
QUERIES, ORACLES = {"op12_quality_rules": op12_quality_rules}, {"op12_quality_rules": SQL}
