"""Numbers and times as expressions: formats, durations, costs, backoff, vectors, map geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
DAY_MS = 86_400_000
#: Metres at the equator for one pixel at zoom 0, earth radius in metres, last latitude of a map; waits of a delivery in ms.
EQUATOR_MPP, EARTH_M, MAX_LAT = 156543.03392804097, 6378137.0, 85.05112878
WAITS_MS = (5_000, 25_000, 120_000, 600_000)


def nearest_ms(ts: Column) -> Column:
    """Epoch milliseconds of a time, halves away from the epoch."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.call_function("div", micros + F.when(micros < 0, -500).otherwise(500), F.lit(1000))


# formats

def token_count(c: Column) -> Column:
    """``1.2m``, ``12k``, ``1.2k``, whole numbers below; null as 0."""
    v = F.greatest(F.lit(0.0), F.coalesce(c.cast("double"), F.lit(0.0)))
    return (
        F.when(v >= 1e6, F.format_string("%.1fm", v / 1e6)).when(v >= 1e4, F.format_string("%.0fk", v / 1e3))
        .when(v >= 1e3, F.format_string("%.1fk", v / 1e3)).otherwise(F.floor(v + 0.5).cast("string"))
    )


def usd(c: Column) -> Column:
    """Cents, below a cent four decimals; halves of the printed number go up."""
    v = c.cast("double")
    return F.when(v >= 0.01, F.format_string("$%.2f", v)).when(v.isNotNull(), F.format_string("$%.4f", v))


def token_short(c: Column) -> Column:
    """As ``token_count`` for small marks: a trailing ``.0`` stays, null and nothing for zero or less."""
    n = F.floor(c.cast("double"))
    return (
        F.when(c.isNull() | (c <= 0), F.lit(None).cast("string")).when(n < 1000, n.cast("string")).when(n < 10_000, F.format_string("%.1fk", n / 1e3))
        .when(n < 1_000_000, F.concat(F.floor(n / 1e3 + 0.5).cast("string"), F.lit("k"))).otherwise(F.format_string("%.1fm", n / 1e6))
    )


def duration_compact(ms: Column) -> Column:
    """``5m``, ``2h5m``, ``3d4h``; at least a minute; ``n/a`` for nothing."""
    minutes = F.greatest(F.lit(1), F.floor(ms / 60_000 + 0.5)).cast("long")
    hours = F.floor(minutes / 60).cast("long")
    days = F.floor(hours / 24).cast("long")
    tail = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    return (
        F.when(ms.isNull() | (ms <= 0), F.lit("n/a")).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h"), tail(minutes % 60, "m"))).otherwise(F.concat(days.cast("string"), F.lit("d"), tail(hours % 24, "h")))
    )


# times

def duration_ms(c: Column, unit: str = "ms") -> Column:
    """Milliseconds of ``90``, ``1.5h`` or ``1h30m``; null where the text is no duration."""
    t = F.lower(F.trim(c))
    token = r"(\d+(?:\.\d+)?)(ms|s|m|h|d)"
    scale = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    parts = F.zip_with(F.regexp_extract_all(t, F.lit(token), F.lit(1)), F.regexp_extract_all(t, F.lit(token), F.lit(2)), lambda v, u: v.cast("double") * scale[u])
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return (
        F.when(t.rlike(r"^\d+(\.\d+)?$"), F.floor(t.try_cast("double") * UNITS[unit] + 0.5))
        .when(t.rlike(rf"^({token})+$"), F.floor(total + 0.5))
    )


def absolute_ms(c: Column) -> Column:
    """Epoch milliseconds of digits or of an ISO time; times without a zone are UTC; null where it is neither."""
    t = F.trim(c)
    zoned = F.when(t.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$") & ~t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z"))).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(r"^\d+$") & (t.try_cast("long") > 0), t.try_cast("long")).when(t.rlike(r"^\d{4}-\d{2}-\d{2}(T|$)"), F.unix_millis(zoned.try_cast("timestamp")))


def next_run_ms(anchor: Column, every: Column, now: Column) -> Column:
    """The first anchor + k * every (k from 1) at or after ``now``; the anchor itself while it lies ahead."""
    step = F.greatest(F.lit(1), every)
    return F.when(now < anchor, anchor).otherwise(anchor + step * F.greatest(F.lit(1), F.ceil((now - anchor) / step)))


def stagger_ms(expr: Column) -> Column:
    """Five minutes for expressions that recur at the top of an hour; else null."""
    return F.when(F.trim(expr).rlike(r"^(0\s+)?0\s+\S*\*\S*\s+\S+\s+\S+\s+\S+$"), F.lit(300_000))


def id_time(id_: Column) -> Column:
    """Milliseconds that stand in the upper bits of a post's id."""
    return F.shiftright(id_.cast("long"), 22)


def path_date(path: Column) -> Column:
    """The date of ``memory/YYYY-MM-DD.md``; null for others and for days that aren't."""
    return F.try_to_date(F.nullif(F.regexp_extract(path, r"(?:^|/)memory/(\d{4}-\d{2}-\d{2})\.md$", 1), F.lit("")), "yyyy-MM-dd")


def offset_minutes(c: Column) -> Column:
    """Minutes of ``UTC+5:30``; null beyond 14 hours or for 60 minutes and more."""
    pattern = r"^UTC([+-])(\d{1,2})(?::(\d{2}))?$"
    sign = F.when(F.regexp_extract(c, pattern, 1) == "-", -1).otherwise(1)
    hours, minutes = F.regexp_extract(c, pattern, 2).try_cast("int"), F.coalesce(F.regexp_extract(c, pattern, 3).try_cast("int"), F.lit(0))
    total = hours * 60 + minutes
    return F.when(c.rlike(pattern) & (minutes < 60) & (total <= 14 * 60), sign * total)


def offset_text(minutes: Column) -> Column:
    rest = F.abs(minutes) % 60
    return F.concat(F.lit("UTC"), F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("string"), F.when(rest > 0, F.concat(F.lit(":"), F.lpad(rest.cast("string"), 2, "0"))).otherwise(F.lit("")))


def daily_reset(ts: Column, hour: int = 4) -> Column:
    """The last reset at or before ``ts``."""
    return F.date_trunc("day", ts - F.expr(f"interval {hour} hours")) + F.expr(f"interval {hour} hours")


def delivery_wait_ms(retries: Column) -> Column:
    waits = F.array(*[F.lit(w) for w in WAITS_MS])
    return F.when(retries <= 0, F.lit(0)).otherwise(F.element_at(waits, F.least(retries, F.lit(len(WAITS_MS))).cast("int")))


def backoff_ms(attempt: Column, initial: float, factor: float, most: float) -> Column:
    """Exponential waits without jitter."""
    return F.least(F.lit(float(most)), F.floor(F.lit(float(initial)) * F.pow(F.lit(float(factor)), F.greatest(attempt - 1, F.lit(0))) + 0.5))


# usage

#: The names a usage record may give a count.
ALIASES = {
    "input": ("input", "inputTokens", "input_tokens", "promptTokens", "prompt_tokens"),
    "output": ("output", "outputTokens", "output_tokens", "completionTokens", "completion_tokens"),
    "cache_read": ("cacheRead", "cache_read", "cache_read_input_tokens", "cached_tokens", "prompt_tokens_details.cached_tokens"),
    "cache_write": ("cacheWrite", "cache_write", "cache_creation_input_tokens"),
    "total": ("total", "totalTokens", "total_tokens"),
}


def usage(json: Column) -> Column:
    """input, output, cache_read, cache_write and total of a JSON usage record, under whichever alias it has first."""
    return F.struct(*[F.coalesce(*[F.get_json_object(json, f"$.{a}").try_cast("double") for a in names]).alias(k) for k, names in ALIASES.items()])


def prompt_tokens(u: Column) -> Column:
    total = sum((F.coalesce(u[k], F.lit(0.0)) for k in ("input", "cache_read", "cache_write")), F.lit(0.0))
    return F.when(total > 0, total)


def session_tokens(u: Column, override: Column | None = None) -> Column:
    """Prompt tokens (an override first), else the total, else the input; never clamped to a context."""
    first = F.lit(None).cast("double") if override is None else F.when(override > 0, override.cast("double"))
    total = F.coalesce(first, prompt_tokens(u), u["total"], u["input"])
    return F.when(total > 0, total)


def cost(u: Column, rates: Column) -> Column:
    """Tokens by rates for a million; null without rates."""
    return sum((F.coalesce(u[k], F.lit(0.0)) * rates[k] for k in ("input", "output", "cache_read", "cache_write")), F.lit(0.0)) / 1e6


def percent_used(used: Column, context: Column) -> Column:
    return F.when(context > 0, F.least(F.lit(999), F.floor(used / context * 100 + 0.5)))


def clamp_percent(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))))


# vectors

def unit_vector(v: Column) -> Column:
    """Length 1; what isn't finite counts as 0; vectors shorter than 1e-10 stay."""
    v = F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm < 1e-10, v).otherwise(F.transform(v, lambda x: x / norm))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


# map geometry

def _clamp_lat(lat: Column) -> Column:
    return F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))


def metres_per_pixel(lat: Column, zoom: Column) -> Column:
    return F.lit(EQUATOR_MPP) * F.cos(F.radians(_clamp_lat(lat))) / F.pow(F.lit(2.0), zoom)


def zoom_for_span(lat: Column, span: Column, pixels: int) -> Column:
    z = F.log2(F.lit(EQUATOR_MPP) * F.cos(F.radians(_clamp_lat(lat))) / (span / pixels))
    return F.floor(F.greatest(F.lit(3.0), F.least(F.lit(17.0), z)) * 10 + 0.5) / 10


def shifted(lat: Column, lng: Column, north: Column, east: Column) -> Column:
    """A point moved by metres."""
    return F.struct(
        _clamp_lat(lat + north / EARTH_M * (180 / math.pi)).alias("lat"),
        (lng + east / (F.lit(EARTH_M) * F.cos(F.radians(_clamp_lat(lat)))) * (180 / math.pi)).alias("lng"),
    )


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def grid(centres, steps: int, span: float):
    """Each centre's ``steps`` by ``steps`` cell centres: row, col, lat, lng."""
    cell = F.lit(span / steps)
    cells = centres.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    at = lambda c: (F.col(c) - (steps - 1) / 2) * cell
    p = shifted(F.col("lat"), F.col("lng"), at("row"), at("col"))
    return cells.withColumn("p", p).drop("lat", "lng").select("*", "p.lat", "p.lng").drop("p")
