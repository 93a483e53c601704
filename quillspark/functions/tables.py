"""Markdown tables in texts: read as blocks, written again as bullets or as an aligned code block.

A table is a line with a pipe, a line of dashes (a colon at an end aligns its column) with as many cells, and the lines after it up to an
empty line or another block (fence, heading, quote). ``\\|`` is a pipe inside a cell. Short rows are filled, long ones cut. Lines in
fenced or indented code are no tables. Bullets: a row is its first cell in bold, and a line ``• header: cell`` for each other cell
that isn't empty; a table of one column is a line for each cell. A null text stays null; a text without a table stays as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 128
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_DASHES = re.compile(r":?-+:?")
_BLOCK = re.compile(r" {0,3}(#{1,6}(\s|$)|>|`{3}|~{3})|( {4}|\t)")
_STYLES = re.compile(r"(\*\*|__|~~|`)(?=\S)(.+?)(?<=\S)\1|(?<!\w)([*_])(?=\S)([^*_]+?)(?<=\S)\3(?!\w)")
_LINK = re.compile(r"\[([^\]\n]+)\]\(([^()\s]*)\)")


def cells(line: str) -> list[str]:
    """The cells of a row, trimmed, their escaped pipes plain; a lone pipe has none."""
    line = line.strip()
    if line == "|":
        return []
    parts = re.split(r"(?<!\\)\|", line[1:] if line.startswith("|") else line)
    if len(parts) > 1 and not parts[-1].strip():
        parts.pop()
    return [p.strip().replace("\\|", "|") for p in parts]


def _aligned(line: str, width: int) -> list[str] | None:
    """How each column of a line of dashes is aligned, if it is one of that many cells."""
    if "-" not in line or _BLOCK.match(line):
        return None
    marks = cells(line)
    if len(marks) != width or not all(map(_DASHES.fullmatch, marks)):
        return None
    return ["center" if m[0] == m[-1] == ":" else "right" if m[-1] == ":" else "left" for m in marks]


def blocks(text: str) -> Iterator[list[str] | tuple[list[str], list[list[str]]]]:
    """The text in order: lists of plain lines, and tables (alignments, rows; the first is the header)."""
    lines, plain, fence, at = text.split("\n"), [], "", 0
    while at < len(lines):
        line = lines[at]
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = ""
        elif mark:
            fence = mark[1]
        elif "|" in line and at + 1 < len(lines) and not _BLOCK.match(line):
            header = cells(line)
            if aligned := _aligned(lines[at + 1], len(header)):
                rows, at = [header], at + 2
                while at < len(lines) and lines[at].strip() and not _BLOCK.match(lines[at]):
                    row = cells(lines[at])[: len(header)]
                    rows.append(row + [""] * (len(header) - len(row)))
                    at += 1
                if plain:
                    yield plain
                yield aligned, rows
                plain = []
                continue
        plain.append(line)
        at += 1
    if plain:
        yield plain


def as_bullets(rows: list[list[str]]) -> list[str]:
    header, *body = rows
    if len(header) == 1:
        return [f"• {r[0]}" for r in body if r[0]]
    out: list[str] = []
    for row in body:
        own = [row[0] if row[0].startswith("**") else f"**{row[0]}**"] if row[0] else []
        own += [f"• {h}: {c}" if h else f"• {c}" for h, c in zip(header[1:], row[1:]) if c]
        if own:
            out += [""] * bool(out) + own
    return out


def as_code(aligned: list[str], rows: list[list[str]]) -> list[str]:
    """Columns are padded to their widest cell; styles are stripped, and a link is its label."""
    bare = [[_STYLES.sub(lambda m: m[2] or m[4], _LINK.sub(r"\1", c)) for c in row] for row in rows]
    width = [max(3, *(len(row[k]) for row in bare)) for k in range(len(aligned))]
    pad = {"left": str.ljust, "right": str.rjust, "center": str.center}
    lines = ["| " + " | ".join(pad[a](c, w) for a, c, w in zip(aligned, row, width)) + " |" for row in bare]
    return ["```", lines[0], "| " + " | ".join("-" * w for w in width) + " |", *lines[1:], "```"]


def convert(text: str | None, mode: str) -> str | None:
    if not text or mode == "off" or "|" not in text:
        return text
    out = [line for b in blocks(text) for line in (b if isinstance(b, list) else as_bullets(b[1]) if mode == "bullets" else as_code(*b))]
    return "\n".join(out)


def tables_converted(text: Column, mode: str) -> Column:
    """The text with its tables as ``bullets`` or ``code``, or as it is (``off``)."""
    if mode not in ("off", "bullets", "code"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "off":
        return text

    @F.arrow_udf("string")
    def converted(texts: pa.Array) -> pa.Array:
        # a slice at a time: no batch is Python strings as a whole
        done = [pa.array([convert(t.as_py(), mode) for t in texts[at : at + SLICE]], pa.string()) for at in range(0, len(texts), SLICE)]
        return pa.concat_arrays([pa.array([], pa.string()), *done])

    return converted(text)
