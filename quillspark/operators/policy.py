"""Decisions about single rows: rules, allow lists, gates, hours, freshness. Each gives a Column, so it runs inside the scan.

Rules, lists and patterns are configuration, a few entries that the driver holds; rows are never moved.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A rule: its action, values that columns must equal, and prefixes that they must start with (both in lower case).
Rule = tuple[str, dict[str, str], dict[str, str]]


def _text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def fits(rule: Rule) -> Column:
    """Whether all that a rule asks for holds; a rule that asks for nothing fits every row."""
    _, equal, prefix = rule
    parts = [_text(F.col(c)) == v.strip().lower() for c, v in equal.items() if v.strip()]
    parts += [_text(F.col(c)).startswith(v.strip().lower()) for c, v in prefix.items() if v.strip()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def first_rule(rules: list[Rule] | None, default: str = "allow") -> Column:
    """The action of the first rule that fits; without a list of rules everything is allowed."""
    if rules is None:
        return F.lit("allow")
    out = F.lit(default)
    for rule in reversed(rules):
        out = F.when(fits(rule), rule[0]).otherwise(out)
    return out


def any_deny(rules: list[Rule] | None, default: str = "allow", override: Column | None = None) -> Column:
    """A row's own override, else deny if any fitting rule denies, else allow if any fits, else the default."""
    if rules is None:
        decided = F.lit("allow")
    else:
        some = lambda action: reduce(lambda a, b: a | b, [fits(r) for r in rules if (r[0] == "deny") == (action == "deny")], F.lit(False))
        decided = F.when(some("deny"), "deny").when(some("allow"), "allow").otherwise(default)
    if override is None:
        return decided
    given = _text(override)
    return F.when(given.isin("allow", "deny"), given).otherwise(decided)


def glob_any(c: Column, patterns: list[str]) -> Column:
    """Whether a value matches one of the globs: ``*`` alone is everything, without a ``*`` the value itself, else anchored."""
    value, out = _text(c), F.lit(False)
    for p in [p.strip().lower() for p in patterns]:
        if p == "*":
            return F.lit(True)
        if "*" in p:
            out = out | value.rlike("(?s)^" + ".*".join(re.escape(x) for x in p.split("*")) + "$")
        elif p:
            out = out | (value == p)
    return out


def glob_allowed(c: Column, allow: list[str], deny: list[str]) -> Column:
    """Denied globs win; an empty allow list allows the rest."""
    return ~glob_any(c, deny) & (glob_any(c, allow) if [p for p in allow if p.strip()] else F.lit(True))


def allow_match(sender: Column, name: Column, allow: list[str], by_name: bool = False) -> Column:
    """Struct (allowed, match_key, match_source): a wildcard, then the id, then (if wanted) the name, without regard to case."""
    entries = [x for x in (str(a).strip().lower() for a in allow) if x]
    found = lambda key, source: F.struct(F.lit(True).alias("allowed"), key.alias("match_key"), F.lit(source).alias("match_source"))
    none = F.struct(F.lit(False).alias("allowed"), F.lit(None).cast("string").alias("match_key"), F.lit(None).cast("string").alias("match_source"))
    if "*" in entries:
        return found(F.lit("*"), "wildcard")
    id_, label = F.lower(sender.cast("string")), F.lower(name.cast("string"))
    out = F.when(label.isin(entries), found(label, "name")).otherwise(none) if by_name and entries else none
    return F.when(id_.isin(entries), found(id_, "id")).otherwise(out) if entries else out


def sender_allowed(sender: Column, entries: list[str], allow_when_empty: bool) -> Column:
    """An empty list decides by ``allow_when_empty``; a wildcard allows all; else the sender must be listed (null isn't)."""
    if not entries:
        return F.lit(allow_when_empty)
    return F.lit(True) if "*" in entries else F.coalesce(sender.cast("string").isin(entries), F.lit(False))


def nested_allowed(outer_configured: Column, outer_matched: Column, inner_configured: Column, inner_matched: Column) -> Column:
    """Without an outer list all pass; with one it must match, and so must an inner list if there is one."""
    return ~outer_configured | (outer_matched & (~inner_configured | inner_matched))


def mention_gate(required: Column, detectable: Column, mentioned: Column, implicit: Column, bypass: Column) -> Column:
    """Struct (mentioned, skip): skipped only if a mention is required, can be detected, and there is none of any kind."""
    any_kind = mentioned | F.coalesce(implicit, F.lit(False)) | F.coalesce(bypass, F.lit(False))
    return F.struct(any_kind.alias("mentioned"), (required & detectable & ~any_kind).alias("skip"))


def category_kept(fields: list[str], text: str | None) -> Column:
    """Whether one of the comma-separated terms stands in the fields; no terms keep all, and a row without any text goes."""
    terms = [t for t in (re.sub(r"\s+", " ", x).strip().lower() for x in (text or "").split(",")) if t]
    if not terms:
        return F.lit(True)
    filled = [F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.trim(F.col(c).cast("string"))) for c in fields]
    haystack = F.lower(F.concat_ws(" · ", *filled))
    return reduce(lambda a, b: a | b, [F.contains(haystack, F.lit(t)) for t in terms])


def log_kept(level: Column, levels: set[str], fields: list[Column], text: str) -> Column:
    """Whether a line's level is wanted (one without a level always is) and one of its fields holds the text."""
    needle = text.strip().lower()
    wanted = level.isNull() | F.lower(level).isin(sorted(levels))
    return wanted & (F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(needle)) if needle else F.lit(True))


def minutes_of(clock: str, allow_24: bool = False) -> int | None:
    m = re.fullmatch(r"(\d{1,2}):(\d{2})", clock.strip())
    if not m or int(m[2]) > 59 or int(m[1]) > (24 if allow_24 else 23) or (int(m[1]) == 24 and int(m[2])):
        return None
    return int(m[1]) * 60 + int(m[2])


def within_hours(ts: Column, start: str, end: str, zone: str = "UTC") -> Column:
    """Whether a UTC time is in the hours of a zone: past midnight if they end before they start, never if both are equal,
    always if one can't be read."""
    a, b = minutes_of(start), minutes_of(end, True)
    if a is None or b is None:
        return F.lit(True)
    if a == b:
        return F.lit(False)
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    now = F.hour(local) * 60 + F.minute(local)
    return (now >= a) & (now < b) if b > a else (now >= a) | (now < b)


def fresh(updated: Column, now: Column, mode: str = "daily", at_hour: int = 4, idle_minutes: int | None = None) -> Column:
    """Not fresh if last updated before the last daily reset (in mode daily), nor if idle for longer than ``idle_minutes``."""
    at_hour = min(23, max(0, int(at_hour)))
    if mode == "idle" and idle_minutes is None:
        idle_minutes = 60
    out = F.lit(True)
    if mode == "daily":
        today = F.date_trunc("day", now) + F.expr(f"interval '{at_hour}' hour")
        out = updated >= F.when(now < today, today - F.expr("interval '1' day")).otherwise(today)
    if idle_minutes is not None:
        out = out & (now <= updated + F.expr(f"interval '{max(1, int(idle_minutes))}' minute"))
    return out


def eligible(has: dict[str, Column], needs: dict[str, list[str]], os: Column | None = None, wanted_os: list[str] = (), always: bool = False) -> Column:
    """Whether a machine meets a skill's needs: every one of ``bins``, ``env`` and ``config``, and any of ``any_bins``; ``has``
    gives the machine's arrays. A wrong ``os`` rules it out even if ``always`` is set."""
    lists = lambda k: F.array(*map(F.lit, needs[k])).cast("array<string>")
    parts = [F.size(F.array_except(lists(k), has[k])) == 0 for k in ("bins", "env", "config") if needs.get(k)]
    if needs.get("any_bins"):
        parts.append(F.coalesce(F.arrays_overlap(lists("any_bins"), has["bins"]), F.lit(False)))
    out = F.lit(True) if always else reduce(lambda a, b: a & b, parts, F.lit(True))
    return out & os.isin(list(wanted_os)) if os is not None and wanted_os else out


def is_reminder(text: Column, ack: str = "heartbeat_ok", noise: tuple[str, ...] = ("heartbeat poll", "heartbeat wake"), done: str = "exec finished") -> Column:
    """Whether an event's text is real content: not blank, no acknowledgement (alone or before a character that isn't a
    word's), no noise, no end of a command."""
    t = _text(text)
    acked = t.rlike(f"^{re.escape(ack)}(?![a-z0-9_])")
    return (t != "") & ~acked & ~reduce(lambda a, b: a | b, [F.contains(t, F.lit(n)) for n in (*noise, done)])


def schedule_verdict(at: Column, now: Column, grace_seconds: int = 60, years: int = 10) -> Column:
    """``past`` if over a minute ago, ``far`` if over ten years (of 365.25 days) ahead, else ``ok``; null for null."""
    gap = F.unix_micros(at.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    return F.when(gap < -grace_seconds * 1_000_000, "past").when(gap > F.lit(int(years * 365.25 * 86_400) * 1_000_000), "far").when(gap.isNotNull(), "ok")


def drop_roles(role: Column, roles: tuple[str, ...] = ("tool", "toolResult")) -> Column:
    """False for rows of these roles; a row without a role stays."""
    return F.coalesce(~role.isin(list(roles)), F.lit(True))


def capturable(text: Column, triggers: list[str], rejects: list[str], least: int = 10, most: int = 500) -> Column:
    """A text of the right length that a trigger matches and no reject does, and that isn't markup."""
    hit = lambda ps: reduce(lambda a, b: a | b, [text.rlike("(?i)" + p) for p in ps], F.lit(False))
    return F.coalesce(F.length(text).between(least, most) & hit(triggers) & ~hit(rejects) & ~text.rlike(r"(?s)^\s*<.*>"), F.lit(False))


def visible_to(key: Column, agent: Column, own_key: str, own_agent: str, mode: str, cross_agent: bool = False, spawned: Column | None = None) -> Column:
    """Whether a session may be seen: ``self``, ``tree`` (its own and those it spawned), ``agent`` or ``all``. Other agents'
    sessions are seen only in mode ``all`` and with the cross-agent policy on."""
    own = {"self": key == own_key, "tree": (key == own_key) | (F.coalesce(spawned, F.lit(False)) if spawned is not None else F.lit(False))}
    same = agent == own_agent
    if mode in own:
        return same & own[mode]
    return same if mode == "agent" or not cross_agent else F.lit(True)
