"""Expressions over records and documents: log lines, front matter, batch results, markers, directives, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")
#: Words that carry no topic.
STOP = "a an the is are was were be i you we they it that this what which who when where how why do does did for of in on at to from with about and or not my your our me".split()


def _field(c: Column, name: str) -> Column:
    return F.get_json_object(c, f"$.{name}")


def log_record(c: Column) -> Column:
    """time, level, subsystem and message of a JSON log line; a line that isn't JSON is its own message."""
    name, bracket = _field(c, "_meta.name"), lambda k: F.get_json_object(c, f"$['{k}']")
    context = F.coalesce(bracket("0"), name)
    is_map = F.coalesce(F.trim(context).rlike(r"(?s)^\{.*\}$"), F.lit(False))
    level = F.lower(F.coalesce(_field(c, "_meta.logLevelName"), _field(c, "_meta.level")))
    inside = F.when(is_map, F.coalesce(F.get_json_object(context, "$.subsystem"), F.get_json_object(context, "$.module")))
    return F.struct(
        F.coalesce(_field(c, "time"), _field(c, "_meta.date")).alias("time"), F.when(level.isin(*LEVELS), level).alias("level"),
        F.coalesce(inside, F.when(F.length(context) < 120, context)).alias("subsystem"),
        F.coalesce(bracket("1"), F.when(~is_map, bracket("0")), _field(c, "message"), c).alias("message"),
    )


def front_matter(c: Column) -> Column:
    """Keys and one-line values of a leading ``---`` block, without quotes around them; an empty map without one."""
    t = F.regexp_replace(c, r"\r\n?", "\n")
    block = F.regexp_extract(t, r"(?s)\A---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[\w-]+:\s*\S"))
    key = lambda x: F.regexp_extract(x, r"^([\w-]+):", 1)
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[\w-]+:", "")), "^([\"'])(.*)\\1$", "$2")
    keys = F.transform(lines, key)
    last = F.filter(lines, lambda x, i: ~F.array_contains(F.slice(keys, i + F.lit(2), F.size(keys)), key(x)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(key(x), value(x))))


def batch_result(c: Column) -> Column:
    """custom_id, vector and error of a line of an embedding batch's output; a line with an error has no vector."""
    status = F.coalesce(_field(c, "response.status_code").try_cast("int"), F.lit(0))
    failed = F.coalesce(_field(c, "error.message"), F.when(status >= 400, F.coalesce(_field(c, "response.body.error.message"), F.lit("unknown error"))))
    vector = F.from_json(_field(c, "response.body.data[0].embedding"), "array<double>")
    empty = F.coalesce(F.size(vector), F.lit(0)) <= 0
    told = F.coalesce(failed, F.when(empty, F.lit("empty embedding")))
    return F.struct(_field(c, "custom_id").alias("custom_id"), F.when(told.isNull(), vector).alias("vector"), told.alias("error"))


def vector_of(c: Column) -> Column:
    """A JSON array of numbers; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<double>"), F.array().cast("array<double>"))


def json_array_in(c: Column) -> Column:
    """The first JSON array of records in noisy output; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\[\s*(?:\{.*?\}\s*(?:,\s*\{.*?\}\s*)*)?\])", 1), F.lit(""))


def untrusted(c: Column, source: str, marker: str) -> Column:
    """Text between boundary markers of the given id; markers that it holds itself (wide letters and angle brackets
    folded) are made harmless."""
    wide = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26)) + "＜＞〈〉＿"
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz<><>_"
    folded = F.translate(c, wide, plain)
    told = folded.rlike("(?i)<<<(END_)?EXTERNAL_UNTRUSTED_CONTENT")
    safe = F.regexp_replace(F.regexp_replace(folded, r'(?i)<<<EXTERNAL_UNTRUSTED_CONTENT(?:\s+id="[^"]{1,128}")?\s*>>>', "[[MARKER_SANITIZED]]"),
                            r'(?i)<<<END_EXTERNAL_UNTRUSTED_CONTENT(?:\s+id="[^"]{1,128}")?\s*>>>', "[[END_MARKER_SANITIZED]]")
    return F.concat(F.lit(f'<<<EXTERNAL_UNTRUSTED_CONTENT id="{marker}">>>\nSource: {source}\n---\n'), F.when(told, safe).otherwise(c), F.lit(f'\n<<<END_EXTERNAL_UNTRUSTED_CONTENT id="{marker}">>>'))


def directives(c: Column) -> Column:
    """reply_to, audio and the text without ``[[...]]`` directive tags."""
    reply = F.regexp_extract(c, r"(?i)\[\[\s*reply_to\s*:\s*([^\]\n]+?)\s*\]\]", 1)
    current = c.rlike(r"(?i)\[\[\s*reply_to_current\s*\]\]")
    bare = F.regexp_replace(F.regexp_replace(c, r"(?i)\[\[\s*(?:audio_as_voice|reply_to_current|reply_to\s*:\s*[^\]\n]+)\s*\]\]", " "), r"[ \t]+", " ")
    return F.struct(F.when(reply != "", reply).when(current, F.lit("current")).alias("reply_to"), c.rlike(r"(?i)\[\[\s*audio_as_voice\s*\]\]").alias("audio"), F.trim(bare).alias("text"))


def memory_category(c: Column) -> Column:
    t = F.lower(c)
    return (
        F.when(t.rlike(r"prefer|like|love|hate|want|need"), "preference").when(t.rlike(r"decided|will use|going with|chose"), "decision")
        .when(t.rlike(r"\+\d{10,}|[\w.-]+@[\w.-]+\.\w+|is called|named"), "entity").when(t.rlike(r"\b(is|are|has|have)\b"), "fact").otherwise("other")
    )


def keywords(c: Column) -> Column:
    """Words of three letters and more that aren't stop words, each once, in order."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP) & ~w.rlike(r"^\d+$")))


def parameter_billions(c: Column) -> Column:
    """The largest parameter count in a model's name, such as 70 in ``llama-70b``; null without one."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"(?<![a-z0-9])[a-z]?(\d+(?:\.\d+)?)b(?![a-z0-9])"), F.lit(1))
    best = F.array_max(F.transform(found, lambda x: x.cast("double")))
    return F.when(best > 0, best)


def truthy(json: Column, path: str) -> Column:
    """Whether the JSON value at a dotted path counts as true."""
    v = F.get_json_object(json, "$." + path)
    return F.coalesce(~F.lower(v).isin("", "false", "0", "null"), F.lit(False))


def sorted_json(m: Column) -> Column:
    """A map as JSON with its keys in order: equal maps give equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


#: What follows a sharer's name, and the last word of a title that is a person's own.
SHARED = r"(?i)\s+(?:posted|reposted|commented)(?: on the topic| on this)?$"
OWNED = ["post", "activity", "update"]


def post_title(c: Column) -> Column:
    """author and text out of the title of a shared post: ``A on LinkedIn: text``, ``A's Post`` or ``text | A``; else all is text."""
    pair = lambda a, b: F.struct(F.trim(a).alias("author"), F.trim(b).alias("text"))
    upto = lambda x, cut: F.substring(x, F.lit(1), F.length(x) - cut)
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    site = F.element_at(F.split(t, "[-|·–—]"), -1)
    t = F.when((F.lower(F.trim(site)) == "linkedin") & (F.length(site) < F.length(t)), F.rtrim(upto(t, F.length(site) + 1))).otherwise(t)
    at = F.locate(" on linkedin:", F.lower(t))
    word = F.element_at(F.split(t, " "), -1)
    owner = upto(t, F.length(word) + 1)
    last = F.element_at(F.split(t, r" \| "), -1)
    who = F.trim(F.regexp_replace(F.trim(last), SHARED, ""))
    signed = (F.length(last) + 3 < F.length(t)) & (who != "") & (F.length(who) <= 80) & (F.size(F.split(who, " ")) <= 8)
    return (
        F.when(at.between(3, 81), pair(upto(t, F.length(t) - at + 1), F.substring(t, at + 13, F.length(t))))
        .when(F.lower(word).isin(OWNED) & F.substring(owner, -2, 2).isin("'s", "’s") & F.length(owner).between(4, 82), pair(upto(owner, F.lit(2)), F.lit("")))
        .when(signed, pair(who, upto(t, F.length(last) + 3))).otherwise(pair(F.lit(""), t))
    )


def source_line(n: Column, line_map: Column) -> Column:
    """The line of the source file for line ``n`` (from 1) of a flattened text; ``n`` where the map ends."""
    return F.coalesce(F.get(line_map, n - 1), n)


def merged_allow_list(own: Column, stored: Column, policy: Column) -> Column:
    """Trimmed entries of both lists, each once, without blanks; a stored list doesn't count under the policy ``allowlist``."""
    extra = F.when(policy == "allowlist", F.array().cast("array<string>")).otherwise(F.coalesce(stored, F.array().cast("array<string>")))
    both = F.concat(F.coalesce(own, F.array().cast("array<string>")), extra)
    return F.array_distinct(F.filter(F.transform(both, lambda x: F.trim(x)), lambda x: x != ""))


#: Rules on single lines (name, severity, pattern, what the whole text must hold as well).
LINE_RULES = [
    ("dangerous-exec", "critical", r"\b(exec|execSync|spawn|spawnSync|execFile|execFileSync)\s*\(", "child_process"),
    ("dynamic-code-execution", "critical", r"\beval\s*\(|new\s+Function\s*\(", None),
    ("crypto-mining", "critical", r"(?i)stratum\+tcp|stratum\+ssl|coinhive|cryptonight|xmrig", None),
    ("suspicious-network", "warn", r"new\s+WebSocket\s*\(\s*[\"']wss?://[^\"']*:(?!(?:80|443|8080|8443|3000)(?!\d))\d+", None),
]
#: Rules on whole texts.
SOURCE_RULES = [
    ("potential-exfiltration", "warn", "readFileSync|readFile", r"(?i)\bfetch\b|\bpost\b|http\.request"),
    ("obfuscated-code", "warn", r"(\\x[0-9a-fA-F]{2}){6,}", None),
    ("obfuscated-code", "warn", r"(?:atob|Buffer\.from)\s*\(\s*[\"'][A-Za-z0-9+/=]{200,}[\"']", None),
    ("env-harvesting", "critical", r"process\.env", r"(?i)\bfetch\b|\bpost\b|http\.request"),
]


def source_findings(df: DataFrame, id_: str, text: str, evidence: int = 120) -> DataFrame:
    """id, rule, severity, line, evidence: for each rule the first line of a source that breaks it. A rule on a whole text that no
    single line breaks names line 1 and the text's start."""
    source, lines = F.col(text), F.split(text, "\n")

    def finding(name, severity, pattern, context, whole):
        at = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.trim(x).alias("evidence"), x.rlike(pattern).alias("hit"))), lambda x: x["hit"])
        there = (source.rlike(context) if context else F.lit(True)) & (source.rlike(pattern) if whole else F.size(at) > 0)
        first = F.when(F.size(at) > 0, at[0]).otherwise(F.struct(F.lit(1).alias("line"), F.substring(source, 1, evidence).alias("evidence"), F.lit(True).alias("hit")))
        return F.when(there, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), first["line"].alias("line"), first["evidence"].alias("evidence")))

    rules = [(*r, False) for r in LINE_RULES] + [(*r, True) for r in SOURCE_RULES]
    # most texts break none: one pattern tells them before any is split
    some = source.rlike("(?i)" + "|".join(f"(?:{r[2].replace('(?i)', '')})" for r in rules))
    found = F.when(some, F.array_compact(F.array(*[finding(*r) for r in rules])))
    cut = F.when(F.length("f.evidence") > evidence, F.concat(F.substring("f.evidence", 1, evidence), F.lit("…"))).otherwise(F.col("f.evidence"))
    return df.select(id_, F.explode(found).alias("f")).select(id_, "f.rule", "f.severity", "f.line", cut.alias("evidence"))


#: Desks, senders that want no answer, and endings of files.
DESKS = "info contact hello enquiry enquiries inquiry sales admin office support mail reception booking".split()
SILENT = "no-reply noreply donot-reply donotreply postmaster abuse webmaster privacy dpo".split()
ASSETS = "png jpg jpeg gif svg webp css js json xml woff woff2 ttf eot ico mp4 pdf".split()
ROLES = "info contact hello sales support admin office enquiry enquiries inquiry inquiries help team mail reception booking bookings appointments care service billing accounts".split()


def emails(text: Column, site: Column, junk: list[str] = ()) -> Column:
    """The e-mail addresses of a page, best first: those of the site's own domain, then desks; senders that want no answer last.

    Addresses of mailto links and of the text, in lower case; without those of ``junk`` domains, names of files, hashes and what
    is over 100 characters. Every part is bounded, so a page without one takes linear time."""
    mailto = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)mailto:([^\"'>?\s]{1,200})"), F.lit(1)), lambda x: F.try_url_decode(x))
    plain = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}"), F.lit(0))
    clean = F.array_distinct(F.transform(F.concat(mailto, plain), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"^[._-]+|[._-]+$", "")))
    host = lambda x: F.substring_index(x, "@", -1)
    within = lambda h, d: (h == d) | F.endswith(h, F.concat(F.lit("."), d))
    good = F.filter(clean, lambda x: x.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]{2,24}$") & ~F.substring_index(x, ".", -1).isin(ASSETS) & ~x.rlike("^[0-9a-f]{16,}@") & (F.length(x) <= 100)
                    & ~F.exists(F.array(*map(F.lit, junk)).cast("array<string>"), lambda d: within(host(x), d)))
    own = F.regexp_replace(F.coalesce(site, F.lit("")), r"^www\.", "")

    def rank(x, i):
        local = F.substring_index(x, "@", 1)
        score = F.when((own != "") & within(host(x), own), 100).otherwise(0) + F.when(local.isin(DESKS), 20).otherwise(0) - F.when(local.isin(SILENT), 50).otherwise(0)
        return F.struct((-score).alias("less"), i.alias("at"), x.alias("email"))

    return F.transform(F.array_sort(F.transform(good, rank)), lambda x: x["email"])


def email_class(email: Column, mail_servers: Column, disposable: list[str]) -> Column:
    """invalid, disposable, unknown (the number of mail servers isn't known), no-mx, role or valid: the first that holds."""
    x = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    local, domain = F.substring_index(x, "@", 1), F.substring_index(x, "@", -1)
    shaped = x.rlike(r"^[^\s@]+@[^\s@.]+(\.[^\s@.]+)+$") & (F.length(x) <= 254)
    thrown = F.exists(F.array(*map(F.lit, disposable)).cast("array<string>"), lambda d: (domain == d) | F.endswith(domain, F.concat(F.lit("."), d)))
    return F.when(~shaped, "invalid").when(thrown, "disposable").when(mail_servers.isNull(), "unknown").when(mail_servers == 0, "no-mx").when(local.isin(ROLES), "role").otherwise("valid")


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def chat_text(text: Column, content: Column) -> Column:
    """The text of a message: its own, or its text blocks joined by a space; white space squeezed, null if nothing is left."""
    blocks = F.transform(F.filter(content, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: _squeezed(b["text"]))
    joined = F.array_join(F.filter(blocks, lambda b: b != ""), " ")
    return F.nullif(F.coalesce(_squeezed(text), joined), F.lit(""))


def tool_names(content: Column) -> Column:
    """The distinct names of the tools that a message calls, in their order."""
    calls = F.filter(content, lambda b: F.lower(F.trim(b["type"])).isin("tool_use", "toolcall", "tool_call") & (F.trim(F.coalesce(b["name"], F.lit(""))) != ""))
    return F.coalesce(F.array_distinct(F.transform(calls, lambda b: F.trim(b["name"]))), F.array().cast("array<string>"))


def tool_results(content: Column) -> Column:
    """Struct (total, errors) of a message's tool results."""
    results = F.coalesce(F.filter(content, lambda b: F.lower(F.trim(b["type"])).isin("tool_result", "tool_result_error")), F.array().cast("array<struct<type: string, text: string, name: string, is_error: boolean>>"))
    return F.struct(F.size(results).alias("total"), F.size(F.filter(results, lambda b: F.coalesce(b["is_error"], F.lit(False)))).alias("errors"))
