"""Text expressions: tokens, injection and secret flags, redaction, markup, keys. All are built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format characters that don't show.
INVISIBLE = "[\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]"
SECRET = r"(?i)\b(api[_-]?key|token|secret|password)\b\s*[=:]\s*[\"']?([A-Za-z0-9_\-]{16,})"
#: What tries to take over a reader, by the name this library gives it.
INJECTIONS = {
    "ignore previous": r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?)",
    "disregard previous": r"disregard\s+(all\s+)?(previous|prior|above)",
    "forget rules": r"forget\s+(everything|all|your)\s+(instructions?|rules?|guidelines?)",
    "new role": r"you\s+are\s+now\s+(a|an)\s+",
    "new instructions": r"new\s+instructions?:",
    "system prompt": r"system\s*:?\s*(prompt|override|command)",
    "exec command": r"\bexec\b.*command\s*=",
    "elevated": r"elevated\s*=\s*true",
    "remove all": r"rm\s+-rf",
    "delete all": r"delete\s+all\s+(emails?|files?|data)",
    "system tag": r"</?system>",
    "role line": r"\]\s*\n\s*\[?(system|assistant|user)\]?:",
}


def injection_rules(c: Column) -> Column:
    """The names of the rules that a text breaks, in their order."""
    hit = F.array(*[F.when(c.rlike("(?i)" + p), F.lit(n)) for n, p in INJECTIONS.items()])
    return F.array_compact(hit)


def tokens(c: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


def visible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def has_injection(c: Column) -> Column:
    return F.size(injection_rules(c)) > 0


def has_secret(c: Column) -> Column:
    return F.coalesce(c.rlike(SECRET), F.lit(False))


def redact(c: Column) -> Column:
    """Assigned secrets keep their first six and last four characters."""
    return F.regexp_replace(c, r"(?i)(\b(?:api[_-]?key|token|secret|password)\b\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{6})[A-Za-z0-9_\-]{6,}([A-Za-z0-9_\-]{4})", "$1...$2")


def html_text(c: Column) -> Column:
    """Text of HTML without scripts, styles, comments and tags."""
    bare = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def session_key(agent: Column, channel: Column, kind: Column, peer: Column) -> Column:
    return F.concat_ws(":", F.lit("agent"), F.lower(F.trim(agent)), F.lower(F.trim(channel)), kind, peer)


#: The formats of secrets; the group that isn't quotes is what is masked.
SECRETS = [
    r"""\b[A-Z0-9_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD)\b\s*[=:]\s*(["']?)([^\s"'\\]+)\1""",
    r'"(?:apiKey|token|secret|password|passwd|accessToken|refreshToken)"\s*:\s*"([^"]+)"',
    r"""--(?:api[-_]?key|token|secret|password|passwd)\s+(["']?)([^\s"']+)\1""",
    r"Authorization\s*[:=]\s*Bearer\s+([A-Za-z0-9._\-+=]+)",
    r"\bBearer\s+([A-Za-z0-9._\-+=]{18,})\b",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----",
    r"\b(sk-[A-Za-z0-9_-]{8,})\b",
    r"\b(ghp_[A-Za-z0-9]{20,})\b",
    r"\b(github_pat_[A-Za-z0-9_]{20,})\b",
    r"\b(xox[baprs]-[A-Za-z0-9-]{10,})\b",
    r"\b(xapp-[A-Za-z0-9-]{10,})\b",
    r"\b(gsk_[A-Za-z0-9_-]{10,})\b",
    r"\b(AIza[0-9A-Za-z\-_]{20,})\b",
    r"\b(pplx-[A-Za-z0-9_-]{10,})\b",
    r"\b(npm_[A-Za-z0-9]{10,})\b",
    r"\bbot(\d{6,}:[A-Za-z0-9_-]{20,})\b",
    r"\b(\d{6,}:[A-Za-z0-9_-]{20,})\b",
]
#: A format's masked group: what it opens with, the class of its other characters and the fewest of them.
_MASKED = re.compile(r"""\((?!\?|\["')(.*)(\[(?:\\.|[^\]\\])+\])(?:\+|\{(\d+),\})\)""")


def _mask_steps(pattern: str) -> list[tuple[str, str]]:
    """Replacements that mask one format: under 18 characters as ``***``, others by their first six and last four.

    Short ones go first, so that a mask isn't masked again by its own rule; of private keys the outer lines stay."""
    m = _MASKED.search(pattern)
    if not m:
        begin, end = pattern.split(r"[\s\S]+?")
        return [(rf"{begin}[^\r\n]+?{end}", "***"), (rf"({begin}[^\r\n]*)[\s\S]*?([^\r\n]*{end})", "$1\n…redacted…\n$2")]
    before, after, head, kind, least = pattern[: m.start()], pattern[m.end() :], m[1], m[2], int(m[3] or 1)
    if not head:
        lead, end = "(?<lead>" + before.replace("([\"']?)", "(?<q>[\"']?)") + ")", after.replace(r"\1", r"\k<q>")
        return [
            (rf"{lead}(?!{kind}{{18}}){kind}{{{least},}}(?<end>{end})", "${lead}***${end}"),
            (rf"{lead}(?<a>{kind}{{6}}){kind}{{8,}}(?<z>{kind}{{4}})(?<end>{end})", "${lead}${a}…${z}${end}"),
        ]
    if head.startswith(r"\d{6,}"):  # six digits and more, always long enough
        return [(rf"({before}\d{{6}})\d*:{kind}{{{least - 4},}}({kind}{{4}}){after}", "$1…$2")]
    n, steps = len(re.sub(r"\[[^\]]+\]", "x", head)), []
    if n + least < 18:
        steps.append((rf"{before}(?!{head}{kind}{{{18 - n},}}{after}){head}{kind}{{{least},}}{after}", "***"))
    first, rest = (head, "") if n <= 6 else (head[:6], head[6:])
    more = max(0, 6 - n)
    steps.append((rf"{before}({first}{f'{kind}{{{more}}}' if more else ''}){rest}{kind}{{{max(18 - max(n, 6) - 4, least - more - 4)},}}({kind}{{4}}){after}", "$1…$2"))
    return steps


#: What every match of ``SECRETS`` holds one of, in lower case (beside six digits and a colon).
HINTS = ("key", "token", "secret", "passw", "bearer", "sk-", "ghp_", "github_pat_", "xox", "xapp-", "gsk_", "aiza", "pplx-", "npm_")


def redact_all(c: Column) -> Column:
    """Secrets of all formats masked, in the formats' order. A text without any of ``HINTS`` has none and is left at once."""
    lower = F.lower(c)
    hint = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(h)) for h in HINTS]) | c.rlike("[0-9]{6}:")
    out = c
    for pattern in SECRETS:
        for found, by in _mask_steps(pattern):
            out = F.regexp_replace(out, "(?i)" + found, by)
    return F.when(hint, out).otherwise(c)


def safe_pattern(pattern: str) -> bool:
    """Whether a user's pattern parses and repeats nothing that itself repeats without a bound, such as ``(a+)+``."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return False

    def nested(part, inside: bool) -> bool:
        if isinstance(part, tuple) and part and str(part[0]) in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            _, most, body = part[1]
            open_ended = most == re._constants.MAXREPEAT
            return (inside and open_ended) or nested(body, inside or most > 1)
        return any(nested(x, inside) for x in part) if isinstance(part, (tuple, list, re._parser.SubPattern)) else False

    return not nested(tree, False)


def safe_patterns(c: Column) -> Column:
    """``safe_pattern`` of a column of patterns; null for null."""

    @F.pandas_udf("boolean")
    def safe(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: None if p is None else safe_pattern(p)).astype("object")

    return safe(c)


def redact_with(c: Column, patterns: list[str]) -> Column:
    """What matches one of the user's patterns becomes ``***``; unsafe patterns are refused."""
    for pattern in patterns:
        if not safe_pattern(pattern):
            raise ValueError(f"unsafe pattern: {pattern}")
        c = F.regexp_replace(c, pattern, "***")
    return c
