"""Next runs of cron expressions and visible parts of HTML and Markdown, as pandas UDFs over small per-row helpers."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from html.parser import HTMLParser
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import functions as F

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAYS = "sun mon tue wed thu fri sat".split()
#: The longest wait for a date that exists, such as February 29.
YEARS = 8


def _values(field: str, low: int, high: int, names: list[str], shift: int) -> frozenset[int]:
    out = set()
    for part in field.lower().split(","):
        span, _, step = part.partition("/")
        a, dash, b = span.partition("-")
        number = lambda x: names.index(x[:3]) + shift if x[:3] in names else int(x)
        start, end = (low, high) if span in ("*", "?") else (number(a), number(b) if dash else high if step else number(a))
        if not (low <= start <= end <= high) or (step and int(step) < 1):
            raise ValueError(field)
        out.update(range(start, end + 1, int(step or 1)))
    return frozenset(out)


@lru_cache(maxsize=4096)
def parsed(expr: str):
    """Minutes, hours, days, months, weekdays (0 is Sunday) and whether a day must fit either or both; None for a bad expression."""
    fields = expr.split()
    if len(fields) != 5:
        return None
    try:
        m, h, d, mo, w = (_values(f, *x) for f, x in zip(fields, ((0, 59, [], 0), (0, 23, [], 0), (1, 31, [], 0), (1, 12, MONTHS, 1), (0, 7, DAYS, 0))))
    except ValueError:
        return None
    return sorted(m), sorted(h), d, mo, frozenset(x % 7 for x in w), fields[2][0] not in "*?" and fields[4][0] not in "*?"


def next_run(expr: str, now_ms: int, zone: str = "UTC") -> int | None:
    """The first minute after ``now_ms`` that fits, in epoch milliseconds; local times that a clock change skips don't run."""
    if (p := parsed(expr)) is None:
        return None
    minutes, hours, days, months, weekdays, either = p
    tz = ZoneInfo(zone)
    day = datetime.fromtimestamp(now_ms / 1000, tz).date()
    for _ in range(366 * YEARS):
        fits_day, fits_week = day.day in days, day.isoweekday() % 7 in weekdays
        if day.month in months and ((fits_day or fits_week) if either else (fits_day and fits_week)):
            for h in hours:
                for m in minutes:
                    at = datetime(day.year, day.month, day.day, h, m, tzinfo=tz)
                    ms = int(at.timestamp() * 1000)
                    if ms > now_ms and at.astimezone(timezone.utc).astimezone(tz).hour == h:
                        return ms
        day += timedelta(days=1)
    return None


def next_cron_ms(zone: str = "UTC"):
    """A pandas UDF: (expression, now in ms) to the next run; null for a bad expression or none within eight years."""

    @F.pandas_udf("long")
    def run(expr: pd.Series, now: pd.Series) -> pd.Series:
        found = [None if e is None or pd.isna(n) else next_run(e, int(n), zone) for e, n in zip(expr, now)]
        return pd.Series(found, dtype="Int64", index=expr.index)

    return run


VOID = "area base br col embed hr img input link meta source track wbr".split()
#: Elements that are dropped with their content.
DROPPED = "meta template svg canvas iframe object embed script style noscript".split()
#: Classes and property values that hide an element.
HIDDEN_CLASSES = {"sr-only", "visually-hidden", "d-none", "hidden", "invisible", "screen-reader-only", "offscreen"}
HIDDEN_VALUES = {
    "display": "none", "visibility": "hidden", "opacity": "0", "font-size": "0(px|em|rem|pt|%)?", "text-indent": r"-\d{4,}px", "left": r"-\d{4,}px", "top": r"-\d{4,}px",
    "color": r"transparent|(rgba|hsla)\s*\([^)]*,\s*0(\.0+)?\s*\)", "clip-path": r".*inset\s*\(\s*(0*\.\d+|[1-9]\d*(\.\d+)?)%.*", "transform": r".*(scale\s*\(\s*0\s*\)|translate[xy]\s*\(\s*-\d{4,}px\s*\)).*",
}


def hides(style: str) -> bool:
    said: dict[str, str] = {}
    for part in style.lower().split(";"):
        name, colon, value = part.partition(":")
        if colon:
            said.setdefault(name.strip(), value.strip())
    nothing = all(said.get(k) in ("0", "0px") for k in ("width", "height")) and said.get("overflow") == "hidden"
    return nothing or any(re.fullmatch(p, said[k], re.S) for k, p in HIDDEN_VALUES.items() if k in said)


class _Visible(HTMLParser):
    """Collects text outside hidden elements. ``closed`` holds the hidden elements that are open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.closed = [], []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        hidden = (tag in DROPPED or "hidden" in a or a.get("aria-hidden") == "true" or (tag == "input" and a.get("type", "").lower() == "hidden")
                  or HIDDEN_CLASSES & set(a.get("class", "").lower().split()) or hides(a.get("style", "")))
        if tag not in VOID and (hidden or (self.closed and tag == self.closed[-1])):
            self.closed.append(tag)

    def handle_endtag(self, tag):
        if self.closed and tag == self.closed[-1]:
            self.closed.pop()

    def handle_data(self, data):
        if not self.closed:
            self.text.append(data)


def visible_text_of(html: str) -> str:
    parser = _Visible()
    parser.feed(html)
    parser.close()
    return " ".join(" ".join(parser.text).split())


#: Elements that begin a line of their own.
BLOCKS = "p div section article header footer table tr ul ol".split()


class _Markdown(HTMLParser):
    """Writes links, headings and list items as Markdown and blocks as lines. ``marks`` holds where each open link or heading began."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.marks, self.silent, self.title = [], [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.silent += 1
        elif tag in ("a", "title", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.marks.append((tag, len(self.out), dict(attrs).get("href") or ""))
        elif tag in ("br", "hr"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.silent = max(0, self.silent - 1)
        elif any(m[0] == tag for m in self.marks):
            while self.marks[-1][0] != tag:
                self.marks.pop()
            _, at, href = self.marks.pop()
            label = " ".join("".join(self.out[at:]).split())
            del self.out[at:]
            if tag == "title":
                self.title = self.title or label
            self.out.append(self._as(tag, label, href))
        elif tag in BLOCKS:
            self.out.append("\n")

    @staticmethod
    def _as(tag, label, href):
        if tag == "a":
            return f"[{label}]({href})" if label and href else label or href
        if tag == "li":
            return f"\n- {label}" if label else ""
        return f"\n{'#' * int(tag[1])} {label}\n" if tag[0] == "h" else label

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def markdown_of(html: str) -> tuple[str | None, str]:
    """The title and the Markdown of a page."""
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    text = re.sub(r"[ \t]{2,}", " ", re.sub(r"[ \t]+\n", "\n", "".join(parser.out).replace("\r", "")))
    return parser.title, re.sub(r"\n{3,}", "\n\n", text).strip()


def html_markdown():
    """A pandas UDF: title and text of HTML as Markdown; null for null."""

    @F.pandas_udf("title string, text string")
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if h is None else markdown_of(h) for h in html], columns=["title", "text"])

    return run


def visible_text():
    """A pandas UDF: the text of HTML that a reader sees, without hidden elements (tag, attribute, class or style), comments and scripts."""

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None else visible_text_of(h))

    return run


def code_spans(text: str) -> list[tuple[int, int]]:
    """Where fenced blocks (an open one runs to the end) and inline code stand: (start, end), in order."""
    spans, open_at, mark, at = [], None, "", 0
    for line in text.splitlines(keepends=True):
        fence = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if open_at is None and fence:
            open_at, mark = at, fence[1]
        elif open_at is not None and fence and fence[1][0] == mark[0] and len(fence[1]) >= len(mark) and not line[fence.end() :].strip():
            spans.append((open_at, at + len(line)))
            open_at = None
        at += len(line)
    if open_at is not None:
        spans.append((open_at, len(text)))
    inside = lambda k: any(a <= k < b for a, b in spans)
    spans += [m.span() for m in re.finditer(r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)", text) if not inside(m.start())]
    return sorted(spans)


def code_regions():
    """A pandas UDF: the code spans of Markdown; none for null."""

    @F.pandas_udf("array<struct<start: int, stop: int>>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [] if t is None else [{"start": a, "stop": b} for a, b in code_spans(t)])

    return run
