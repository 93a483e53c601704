"""Addresses, search urls, comparison of sent texts, shaped history."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import redact_all

#: Segments of an address that are no area, and the form of a postcode.
COUNTRIES = "india|united states|usa|uk|united kingdom|canada|australia|singapore|uae|deutschland"
POSTCODE = r"\d{4,}|\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"
SPACES = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
#: The pictographs and emoji of Unicode by code point, in order, with the plain symbols (tiles, cards, stars) that tables
#: up to Unicode 16 count among them and newer ones don't.
EMOJI = (
    r"[\x{A9}\x{AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}"
    r"\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}"
    r"\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}\x{2795}-\x{2797}\x{27A1}"
    r"\x{27B0}\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}"
    r"\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1FF}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}"
    r"\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F53D}\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}"
    r"\x{1F85A}-\x{1F85F}\x{1F888}-\x{1F88F}\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}\x{1FC00}-\x{1FFFD}]"
)

#: Few ranges that hold those of EMOJI and SPACES: most characters fail at them, and not at each of the many.
MAYBE_EMOJI, MAYBE_SPACE = r"(?=[\x{A9}\x{AE}\x{203C}-\x{1FFFD}])", r"(?=[\x{0}-\x{20}\x{A0}\x{1680}-\x{FEFF}])"


def _line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def _key(c: Column) -> Column:
    return F.regexp_replace(F.lower(_line(c)), "[^a-z0-9]+", "")


def area(address: Column, city: Column) -> Column:
    """The segment before the city's, or the city's own if it is first; without a city the last segment that has no postcode,
    else the last. Countries and bare postcodes are no segments; '' if none is left."""
    parts = F.filter(F.transform(F.split(_line(address), ","), _line), lambda s: (s != "") & ~s.rlike(rf"(?i)^({COUNTRIES}|\d{{4,6}}(-\d{{4}})?)$"))
    own = _key(city)
    meets = lambda s: (_key(s) != "") & (F.startswith(_key(s), own) | F.startswith(own, _key(s)))
    at = F.when(own == "", 0).otherwise(F.array_position(F.transform(parts, meets), True)).cast("int")
    usable = F.filter(parts, lambda s: ~s.rlike(POSTCODE))
    return F.when(F.size(parts) == 0, "").when(at > 0, F.get(parts, F.greatest(at - 2, F.lit(0)))).otherwise(F.coalesce(F.try_element_at(usable, F.lit(-1)), F.try_element_at(parts, F.lit(-1))))


def engine_days(days: Column, default: int = 10) -> Column:
    """The search engine's window: two days over what is asked for; nothing (null, 0) asks for the default."""
    return F.coalesce(F.nullif(days, F.lit(0)), F.lit(default)) + 2


def _said(c: Column) -> Column:
    """Percent-encoded; spaces as %20, and the marks that a browser leaves stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def url_with(url: Column, name: str, value: Column) -> Column:
    """The url with a parameter set, in its place or at the end; null takes it away. Of a repeated parameter the last value
    stays in the first place; the fragment goes."""
    bare = F.regexp_replace(url, "#.*", "")
    given = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)", 1), "&"), lambda p: p != "")
    pairs = F.transform(given, lambda p: F.struct(F.url_decode(F.substring_index(p, "=", 1)).alias("k"), F.url_decode(F.regexp_extract(p, "=(.*)", 1)).alias("v")))
    pairs = F.concat(pairs, F.array(F.struct(F.lit(name).alias("k"), value.cast("string").alias("v"))))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = lambda n: F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"]
    parts = F.filter(F.transform(names, lambda n: F.concat(_said(n), F.lit("="), _said(last(n)))), lambda p: p.isNotNull())
    return F.when(F.size(parts) == 0, F.substring_index(bare, "?", 1)).otherwise(F.concat(F.substring_index(bare, "?", 1), F.lit("?"), F.array_join(parts, "&")))


def page_url(url: Column, n: Column) -> Column:
    """The same search at page ``n``; the first page carries no number."""
    return url_with(url, "page", F.when(n > 1, n.cast("string")))


def facet_urls(url: Column, facet: str, values: Column) -> Column:
    """The same search once for each value of a facet."""
    return F.transform(values, lambda v: url_with(url, facet, F.to_json(F.array(v))))


def without_words(keywords: Column, words: list[str]) -> Column:
    """Keywords without these whole words, commas and runs of spaces as one space; words are literal, without regard to case."""
    out = keywords
    for w in filter(None, words):
        out = F.regexp_replace(out, r"(?i)\b\Q" + w.replace(r"\E", "") + r"\E\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s*,\s*", " "), r"\s+", " "))


def compared(c: Column) -> Column:
    """A text as sent texts are compared: lower case, no emoji, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), MAYBE_EMOJI + EMOJI, ""), MAYBE_SPACE + SPACES, " "))


def shaped_text(c: Column, most: int = 4000) -> Column:
    """Struct (text, cut, redacted): secrets are masked, then the text is cut to ``most`` characters and says so."""
    clean = redact_all(c)
    cut = F.length(clean) > most
    text = F.when(cut, F.concat(F.substring(clean, 1, most), F.lit("\n…(truncated)…"))).otherwise(clean)
    return F.struct(text.alias("text"), F.coalesce(cut, F.lit(False)).alias("cut"), F.coalesce(clean != c, F.lit(False)).alias("redacted"))


def shaped_blocks(content: Column, most: int = 4000) -> Column:
    """Struct (blocks, cut, redacted) of an array of structs (type, text, signature, data): texts are shaped, the signatures of
    thoughts and the data of images go, and an image keeps its size in ``bytes``. Null gives null blocks."""

    def block(b):
        s, image, signed = shaped_text(b["text"], most), b["type"] == "image", (b["type"] == "thinking") & b["signature"].isNotNull()
        gone = F.coalesce((image & b["data"].isNotNull()) | signed, F.lit(False))
        return F.struct(
            b["type"].alias("type"), s["text"].alias("text"), F.when(~F.coalesce(b["type"] == "thinking", F.lit(False)), b["signature"]).alias("signature"),
            F.when(~F.coalesce(image, F.lit(False)), b["data"]).alias("data"), F.when(image, F.length(b["data"])).alias("bytes"), F.coalesce(image, F.lit(False)).alias("omitted"),
            (s["cut"] | gone).alias("cut"), s["redacted"].alias("redacted"))

    blocks = F.transform(content, block)
    any_of = lambda f: F.coalesce(F.exists(blocks, lambda b: b[f]), F.lit(False))
    return F.struct(F.transform(blocks, lambda b: b.dropFields("cut", "redacted")).alias("blocks"), any_of("cut").alias("cut"), any_of("redacted").alias("redacted"))


#: Words that run into an address when a space is lost, and the endings they run into.
GLUED = r"\.(com|org|net|in|co|edu)(?:to|or|and|for|at|call|us|on|by|with|please)$"


def emails_in(text: Column) -> Column:
    """E-mail addresses of a text in lower case, each once; a word glued to the ending is cut off (``x@y.comto``)."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+@(?:[a-z0-9-]{1,63}+\.){1,10}+[a-z]{2,24}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda e: F.regexp_replace(e, GLUED, ".$1")))


def phones_in(text: Column) -> Column:
    """Telephone numbers as written, each once: ten digits from 6 to 9 on, or ten to thirteen behind a plus. Longer runs (ids), dates
    and amounts behind a currency sign aren't numbers."""
    lead = r"(?<![\w₹$€£@./,+-])(?<![₹$€£] )"
    found = F.regexp_extract_all(text, F.lit(lead + r"(?:\+[1-9][0-9]{0,2}(?:[ -]?[0-9]{2,5}){2,4}|[6-9][0-9]{4}[ -]?[0-9]{5})(?![0-9])"), F.lit(0))
    digits = lambda p: F.length(F.regexp_replace(p, "[^0-9]", ""))
    return F.array_distinct(F.filter(found, lambda p: digits(p).between(10, 13)))
