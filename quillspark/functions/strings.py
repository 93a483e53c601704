"""String expressions: slugs, session keys, masks, identities, links. All are built-in expressions over Columns.

Null inputs count as empty where a default is named; elsewhere they give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\s+"
DEFAULT_AGENT = "main"


def _text(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by)
    return c


# plain text

def one_line(c: Column) -> Column:
    """White space runs as one space."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def redact_identifier(c: Column) -> Column:
    """``sha256:`` and twelve digits of it; blank as ``-``."""
    return F.when(_text(c) == "", F.lit("-")).otherwise(F.concat(F.lit("sha256:"), F.substring(F.sha2(_text(c), 256), 1, 12)))


def mask_token(c: Column) -> Column:
    return F.when(F.length(c) < 18, F.lit("***")).otherwise(F.concat(F.left(c, F.lit(6)), F.lit("…"), F.right(c, F.lit(4))))


def mask_api_key(c: Column) -> Column:
    """Keys over 16 characters show their first and last eight; blank is ``missing``."""
    t = _text(c)
    return F.when(t == "", F.lit("missing")).when(F.length(t) <= 16, t).otherwise(F.concat(F.left(t, F.lit(8)), F.lit("..."), F.right(t, F.lit(8))))


def truncate_line(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(most))), F.lit("...")))


def unicode_query(c: Column) -> Column:
    """Words of letters, digits and underscores, each quoted, joined by AND; null if none."""
    words = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " AND "))


def csv_escape(c: Column) -> Column:
    """Quoted only where a comma, quote or line break asks for it."""
    t = F.coalesce(c, F.lit(""))
    return F.when(t.rlike("[\",\\n]"), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def markdown_text(c: Column) -> Column:
    """Markdown without images, fences, inline code marks, headings, list marks and link targets; links keep their label."""
    return _text(_chain(
        c, (r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), ("```[^\\n]*\\n?", ""), ("`([^`]+)`", "$1"),
        (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"),
    ))


# slugs

def hyphen_slug(c: Column) -> Column:
    return _chain(F.lower(_text(c)), (SPACE, "-"), (r"[^a-z0-9#@._+-]+", "-"), (r"-{2,}", "-"), (r"^[-.]+|[-.]+$", ""))


def at_hash_slug(c: Column) -> Column:
    return _chain(F.lower(_text(c)), (r"^[@#]+", ""), (r"[\s_]+", "-"), (r"[^a-z0-9-]+", "-"), (r"-{2,}", "-"), (r"^-+|-+$", ""))


def channel_slug(c: Column) -> Column:
    return _chain(F.lower(_text(c)), (r"^#", ""), (r"[^a-z0-9]+", "-"), (r"^-+|-+$", ""))


def node_key(c: Column) -> Column:
    return _chain(F.lower(c), (r"[^a-z0-9]+", "-"), (r"^-+|-+$", ""))


def agent_id(c: Column) -> Column:
    """A path-safe lower-case name of at most 64 characters; ``main`` if nothing is left."""
    t = F.lower(_text(c))
    cleaned = F.left(_chain(t, (r"[^a-z0-9_-]+", "-"), (r"^-+", ""), (r"-+$", "")), F.lit(64))
    return F.when(t.rlike(r"^[a-z0-9][a-z0-9_-]{0,63}$"), t).when(cleaned == "", F.lit(DEFAULT_AGENT)).otherwise(cleaned)


# session keys: agent:<id>:<rest>

def key_parts(key: Column) -> Column:
    return F.filter(F.split(_text(key), ":"), lambda p: p != "")


def key_rest(key: Column) -> Column:
    """The part after the agent; null where the key is no agent key."""
    p = key_parts(key)
    ok = (F.size(p) >= 3) & (F.get(p, F.lit(0)) == "agent") & (F.trim(F.get(p, F.lit(1))) != "")
    return F.when(ok, F.array_join(F.slice(p, F.lit(3), F.greatest(F.size(p) - 2, F.lit(0))), ":"))


def key_agent(key: Column) -> Column:
    return F.when(key_rest(key).isNotNull(), F.trim(F.get(key_parts(key), F.lit(1))))


def key_shape(key: Column) -> Column:
    t = _text(key)
    return F.when(t == "", "missing").when(key_rest(key).isNotNull(), "agent").when(F.lower(t).startswith("agent:"), "malformed_agent").otherwise("legacy_or_alias")


def chat_type(key: Column) -> Column:
    raw = F.lower(_text(key))
    scoped = F.coalesce(key_rest(raw), raw)
    words = F.split(scoped, ":")
    has = lambda w: F.array_contains(words, w)
    return (
        F.when(has("group"), "group").when(has("channel"), "channel").when(has("direct") | has("dm"), "direct")
        .when(scoped.rlike(r"^discord:(?:[^:]+:)?guild-[^:]+:channel-[^:]+$"), "channel").otherwise("unknown")
    )


def _kind(key: Column, prefix: str, bare: bool) -> Column:
    inside = F.coalesce(F.lower(key_rest(key)).startswith(prefix), F.lit(False))
    return inside | F.lower(_text(key)).startswith(prefix) if bare else inside


def is_cron(key: Column) -> Column:
    return _kind(key, "cron:", False)


def is_cron_run(key: Column) -> Column:
    return F.coalesce(key_rest(key).rlike(r"^cron:[^:]+:run:[^:]+$"), F.lit(False))


def is_subagent(key: Column) -> Column:
    return _kind(key, "subagent:", True)


def is_acp(key: Column) -> Column:
    return _kind(key, "acp:", True)


def subagent_depth(key: Column) -> Column:
    return F.regexp_count(F.regexp_replace(F.lower(_text(key)), ":", "::"), F.lit("::subagent::")).cast("int")


def thread_parent(key: Column) -> Column:
    """What stands before the last thread or topic mark; null without one."""
    found = F.trim(F.regexp_extract(_text(key), r"(?is)^(.+):(?:thread|topic):", 1))
    return F.when(found != "", found)


def peer_key(agent: Column, channel: Column, peer: Column, kind: Column, scope: Column, account: Column) -> Column:
    """The session key of a peer: groups by channel; direct messages by scope (main, per-peer, per-channel-peer,
    per-account-channel-peer), a blank peer as main."""
    head = F.concat(F.lit("agent:"), agent_id(agent))
    to, name = F.lower(_text(channel)), F.lower(_text(peer))
    to = F.when(to == "", F.lit("unknown")).otherwise(to)
    direct = (
        F.when((name == "") | (scope == "main"), F.concat_ws(":", head, F.lit("main")))
        .when(scope == "per-account-channel-peer", F.concat_ws(":", head, to, agent_id(F.coalesce(account, F.lit("default"))), F.lit("direct"), name))
        .when(scope == "per-channel-peer", F.concat_ws(":", head, to, F.lit("direct"), name))
        .otherwise(F.concat_ws(":", head, F.lit("direct"), name))
    )
    return F.when(F.coalesce(kind, F.lit("direct")) == "direct", direct).otherwise(
        F.concat_ws(":", head, to, kind, F.when(name == "", F.lit("unknown")).otherwise(name)))


def session_kind(key: Column, gateway_kind: Column, alias: str = "main") -> Column:
    return (
        F.when(key == alias, "main").when(key.startswith("cron:"), "cron").when(key.startswith("hook:"), "hook").when(key.rlike("^node[-:]"), "node")
        .when((gateway_kind == "group") | key.rlike(":(group|channel):"), "group").otherwise("other")
    )


def session_channel(key: Column, kind: Column, channel: Column, last: Column) -> Column:
    p, blank = key_parts(key), lambda c: F.when(_text(c) != "", F.trim(c))
    named = F.when((F.size(p) >= 3) & F.get(p, F.lit(1)).isin("group", "channel"), F.get(p, F.lit(0)))
    return F.when(kind.isin("cron", "hook", "node"), F.lit("internal")).otherwise(F.coalesce(blank(channel), blank(last), named, F.lit("unknown")))


# chat envelopes

#: Labels that open an envelope.
CHANNELS = "WebChat|WhatsApp|Telegram|Signal|Slack|Discord|Google Chat|iMessage|Teams|Matrix|Zalo|Zalo Personal|BlueBubbles"


def strip_envelope(c: Column) -> Column:
    """Text without a leading ``[...]`` that holds a time or opens with a channel."""
    header = F.regexp_extract(c, r"^\[([^\]]+)\]", 1)
    told = header.rlike(r"\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}Z| \d{2}:\d{2})\b") | header.rlike(f"^({CHANNELS}) ")
    return F.when(told, F.regexp_replace(c, r"^\[([^\]]+)\]\s*", "")).otherwise(c)


def strip_message_ids(c: Column) -> Column:
    lines = F.filter(F.split(c, r"\r?\n"), lambda x: ~x.rlike(r"(?i)^\s*\[message_id:\s*[^\]]+\]\s*$"))
    return F.when(F.contains(c, F.lit("[message_id:")), F.array_join(lines, "\n")).otherwise(c)


def citation(path: Column, first: Column, last: Column) -> Column:
    """``path#L3`` or ``path#L3-L9``."""
    return F.concat(path, F.lit("#L"), first.cast("string"), F.when(first == last, F.lit("")).otherwise(F.concat(F.lit("-L"), last.cast("string"))))


# identities

def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def phone_key(c: Column) -> Column:
    """Digits; the last ten of longer numbers."""
    return F.right(F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", ""), F.lit(10))


def record_key(maps_url: Column, phone: Column, post_id: Column, profile_url: Column, name: Column, place: Column) -> Column:
    """The best identity of a record: feature id, customer id, phone, post, profile, name at place, name; else empty."""
    found = lambda c, p: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), p, 1), F.lit(""))
    who, where = F.nullif(compact(name), F.lit("")), F.nullif(compact(place), F.lit(""))
    tel = phone_key(phone)
    return F.coalesce(
        F.concat(F.lit("fid:"), F.lower(found(maps_url, r"(?i)(0x[0-9a-f]+:0x[0-9a-f]+)"))),
        F.concat(F.lit("cid:"), found(maps_url, r"[?&]cid=(\d+)")),
        F.when(F.length(tel) >= 10, F.concat(F.lit("tel:"), tel)),
        F.concat(F.lit("post:"), found(post_id, r"^(\d{18,20})$")),
        F.concat(F.lit("li:"), F.lower(F.try_url_decode(found(profile_url, r"(?i)linkedin\.com/in/([^/?#]+)")))),
        F.concat(F.lit("name:"), who, F.lit("@"), where), F.concat(F.lit("name:"), who), F.lit(""),
    )


def looks_like_phone(c: Column) -> Column:
    t = one_line(c)
    digits = F.length(F.regexp_replace(t, r"\D", ""))
    return t.rlike(r"\+?\d[\d\s().-]{7,}\d") & ~t.rlike(r"(?i)review|hour|open|clos|₹|\$|€|£") & (digits >= 8)


def rating(c: Column) -> Column:
    """rating and reviews out of a label such as ``4.5 stars 128 Reviews``."""
    return F.struct(
        F.replace(F.regexp_extract(c, r"(?i)([\d.,]+)\s*star", 1), F.lit(","), F.lit(".")).alias("rating"),
        F.regexp_replace(F.regexp_extract(c, r"(?i)([\d.,]+)\s*review", 1), "[.,]", "").alias("reviews"),
    )


def category_city(line: Column) -> Column:
    """A batch line as category and city, split at the first comma, else at `` in ``; comments and blank lines are null."""
    t = F.trim(line)
    comma = F.contains(t, F.lit(","))
    head, tail = F.trim(F.regexp_extract(t, "^([^,]*),", 1)), F.trim(F.regexp_extract(t, "^[^,]*,(.*)$", 1))
    pattern = r"(?i)^(.*?)\s+in\s+(.+)$"
    within = t.rlike(pattern)
    category = F.when(comma, head).when(within, F.trim(F.regexp_extract(t, pattern, 1))).otherwise(t)
    city = F.when(comma, tail).when(within, F.trim(F.regexp_extract(t, pattern, 2))).otherwise(F.lit(""))
    return F.when((t != "") & ~t.startswith("#") & (category != ""), F.struct(category.alias("category"), city.alias("city")))


# links

def clean_url(c: Column) -> Column:
    """The url with a scheme, https if it names none; empty where it isn't an http address."""
    t = F.trim(c)
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    return F.when((_text(c) != "") & full.rlike(r"(?i)^https?://[^\s/?#:]+(:\d+)?([/?#]\S*)?$"), full).otherwise(F.lit(""))


def social_links(c: Column) -> Column:
    """Profile links by network (a map), the first of each that is no share button or bare domain, without query and fragment."""
    def first(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda u: F.regexp_replace(u, r"[)\]},.;'\"]+$", ""))
        noise = r"(?i)/(sharer|share|intent|dialog|plugins|tr\?|login|signup|home|privacy|policies|about/?$)"
        kept = F.filter(found, lambda u: ~u.rlike(noise) & u.rlike(r"^https?://[^/]+/[^/?#]"))
        return F.get(F.transform(kept, lambda u: F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), "/$", "")), F.lit(0))

    rest = r"[^\s\"'<>]"
    links = {
        "facebook": rf"(?i)https?://(?:[\w-]+\.)?facebook\.com/{rest}+", "instagram": rf"(?i)https?://(?:www\.)?instagram\.com/{rest}+",
        "linkedin": rf"(?i)https?://(?:[\w-]+\.)?linkedin\.com/(?:company|in|school)/{rest}+", "twitter": rf"(?i)https?://(?:www\.)?(?:twitter|x)\.com/{rest}+",
        "youtube": rf"(?i)https?://(?:www\.)?youtube\.com/(?:c|channel|user|@){rest}*",
    }
    pairs = [x for k, p in links.items() for x in (F.lit(k), first(p))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def query_identity(url: Column, noise: tuple[str, ...] = ("sid", "trk", "position")) -> Column:
    """A search's parameters but for noise, lower-cased and sorted: one text for each question."""
    pairs = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    kept = F.filter(pairs, lambda p: p.rlike("^[^=]+=.") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*noise))
    said = F.array_join(F.array_sort(F.transform(kept, lambda p: F.concat(F.split_part(p, F.lit("="), F.lit(1)), F.lit("="), F.lower(F.trim(F.regexp_replace(p, "^[^=]+=", "")))))), "&")
    return F.when(said != "", F.concat(F.lit("search:"), said)).otherwise(F.lit(""))
