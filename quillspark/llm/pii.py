"""PII pseudonyms that keep the format: a keyed Feistel permutation of validated values. DataFrame functions only.

Found and validated: telephone numbers (7 to 15 digits), payment card numbers (Luhn), IPv4 addresses (octets to 255), social
security numbers (valid areas, groups and serials), ISO and US dates of 1800 to 2199, and e-mail addresses. What fails its
validation stays as it is. A value becomes two numbers a < A and b < B; in ``ROUNDS`` rounds a keyed hash of the one is added
to the other, modulo A or B in turn, which is a bijection of all A * B values. So a card stays a valid card, a date a date, and
equal values get equal pseudonyms in all documents, whatever their separators:

- digits: the halves of the digits (telephone: those after the country code; card: all but the Luhn digit, which is renewed)
- IPv4: the upper and the lower 16 bits; SSN: the area, and group with serial; dates: the day of a 400-year cycle, 189 * 773
- e-mail (a local part of at most 64 characters, at most 127 labels of at most 63; what is longer is none, and labels beyond
  the 127th stay): every letter and digit before the domain's last label moves within its class by a keyed hash of the whole address
  (a pseudonym, not a bijection)

The key is a parameter; the default is for tests only. A null text stays null and counts 0; nothing is read but doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import documents, table

KEY, ROUNDS = "key for tests", 8
# Every part is bounded and possessive, and starts only where a run of its characters does, so that no text takes more than
# linear time or a deep stack: a local part has 1 to 64 characters, a domain 2 to 127 labels of 1 to 63.
EMAIL = r"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+"
ISO = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
US = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
PHONE = r"\+\d{1,3}[ -]?\(\d{1,4}\)[ -]?\d{2,4}(?:[ -]\d{2,4}){1,2}(?![\d.])|\+\d{1,3}(?:[ -]\d{2,4}){2,4}(?![\d.])|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
CARD = r"(?<![\d.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\d-])"
KINDS = {"email": EMAIL, "iso": ISO, "us": US, "ssn": SSN, "ip": IP, "phone": PHONE, "card": CARD}
ANY = "|".join(KINDS.values())


def _feistel(a: Column, b: Column, sizes: tuple[Column, Column], tag: str, key: str) -> Column:
    """Struct (a, b) of longs after the rounds."""

    def noise(i: Column, value: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), value.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")

    def turn(x: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 1, (x["a"] + noise(i, x["b"])) % sizes[0]).otherwise(x["a"]).alias("a"),
            F.when(i % 2 == 0, (x["b"] + noise(i, x["a"])) % sizes[1]).otherwise(x["b"]).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _digits(d: Column, tag: str, key: str) -> Column:
    """A string of 2 to 36 digits permuted among those of its length."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), 1 + k, "0").cast("long")
    x = _feistel(F.substring(d, F.lit(1), u), F.substring(d, u + 1, n - u), (size(u), size(n - u)), tag + ":", key)
    return F.concat(F.lpad(x["a"].cast("string"), u, "0"), F.lpad(x["b"].cast("string"), n - u, "0"))


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _refill(m: Column, d: Column) -> Column:
    """The characters of ``m`` with its digits replaced by those of ``d``, in order."""
    step = F.aggregate(
        F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("used")),
        lambda x, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(x["out"], F.substring(d, x["used"] + 1, F.lit(1))).alias("out"), (x["used"] + 1).alias("used")))
        .otherwise(F.struct(F.concat(x["out"], c).alias("out"), x["used"].alias("used"))),
    )
    return step["out"]


def _luhn(d: Column, odd: int) -> Column:
    """Luhn sum of digits; every second one doubled, counted from the right, from the first (odd = 0) or second (odd = 1)."""
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return total + F.when(i % 2 == odd, x).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(m: Column, key: str) -> tuple[Column, Column]:
    d = _only_digits(m)
    body = _digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", key)
    renewed = F.transform(F.array(body), lambda x: F.concat(x, F.pmod(F.lit(10) - _luhn(x, 0) % 10, F.lit(10)).cast("string")))[0]
    return _luhn(d, 1) % 10 == 0, F.transform(F.array(renewed), lambda x: _refill(m, x))[0]


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    code = F.regexp_extract(m, r"^\+\d{1,3}(?!\d)", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    d = _only_digits(rest)
    return F.length(_only_digits(m)).between(7, 15), F.concat(code, F.transform(F.array(_digits(d, "phone", key)), lambda x: _refill(rest, x))[0])


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    octet = lambda k: F.split(m, r"\.")[k].cast("int")
    x = _feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), (F.lit(65536), F.lit(65536)), "ip", key)
    made = F.transform(F.array(x), lambda y: F.concat_ws(".", *[F.floor(y[p] / 256 % 256).cast("string") if hi else (y[p] % 256).cast("string") for p in "ab" for hi in (1, 0)]))[0]
    return (octet(0) < 256) & (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256), made


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.split(m, "-")[k].cast("int") for k in range(3))
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    x = _feistel(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, (F.lit(898), F.lit(99 * 9999)), "ssn", key)
    part = lambda v, n: F.lpad(v.cast("string"), n, "0")
    made = F.transform(F.array(x), lambda y: F.concat_ws("-", part(y["a"] + 1 + F.when(y["a"] >= 665, 1).otherwise(0), 3), part(F.floor(y["b"] / 9999) + 1, 2), part(y["b"] % 9999 + 1, 4)))[0]
    return ok, made


def _date(m: Column, form: str, key: str) -> tuple[Column, Column]:
    day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit("1800-01-01").cast("date"))
    ok = day.between(0, 146096) & (F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), day), form) == m)
    x = _feistel(F.floor(day / 773), day % 773, (F.lit(189), F.lit(773)), "date", key)
    return ok, F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), (x["a"] * 773 + x["b"]).cast("int")), form)


def _email(m: Column, key: str) -> tuple[Column, Column]:
    head = F.regexp_extract(m, r"^(.*)\.[^.]*$", 1)
    tail = F.substring(m, F.length(head) + 1, F.length(m))
    stream = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lit(str(k)), F.lower(m)), 256) for k in range(2)])

    def move(c: Column, i: Column) -> Column:
        shift = F.conv(F.substring(stream, (i % 63) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        cls = lambda base, n: F.char(F.lit(base) + (F.ascii(c) - base + shift) % n)
        return F.when(c.rlike("^[a-z]$"), cls(97, 26)).when(c.rlike("^[A-Z]$"), cls(65, 26)).when(c.rlike("^[0-9]$"), cls(48, 10)).otherwise(c)

    return F.lit(True), F.concat(F.array_join(F.transform(F.split(head, ""), move), ""), tail)


def _replace(m: Column, key: str) -> Column:
    """Struct (kind, made): what a match is, null if not valid, and what stands in its place."""
    makers = {"email": _email(m, key), "iso": _date(m, "yyyy-MM-dd", key), "us": _date(m, "MM/dd/yyyy", key), "ssn": _ssn(m, key), "ip": _ip(m, key), "phone": _phone(m, key), "card": _card(m, key)}
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("made"))
    for kind, (ok, made) in reversed(makers.items()):
        found = m.rlike(f"^(?:{KINDS[kind]})$")
        out = F.when(found & F.coalesce(ok, F.lit(False)), F.struct(F.lit(kind).alias("kind"), made.alias("made"))).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with pseudonyms, n_pii and the counts of each kind."""
    d = documents(docs)
    # most texts hold neither digit nor @, and most others no match: they are passed on as they are
    matches = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    d = d.withColumn("found", F.transform(matches, lambda m: _replace(m, key)))
    some = F.size("found") > 0
    gaps = F.split("text", ANY, -1)
    made = F.array_join(F.zip_with(gaps, F.concat(F.col("found.made"), F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
    count = lambda kinds: F.coalesce(F.size(F.filter("found", lambda x: x["kind"].isin(kinds))), F.lit(0))
    n = lambda kinds: F.when(some, count(kinds)).otherwise(0)
    return d.select(
        "doc_id", F.when(some, made).otherwise(F.col("text")).alias("text"), n(list(KINDS)).alias("n_pii"), n(["email"]).alias("n_email"), n(["phone"]).alias("n_phone"),
        n(["card"]).alias("n_card"), n(["ip"]).alias("n_ip"), n(["ssn"]).alias("n_ssn"), n(["iso", "us"]).alias("n_date"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op3_pii": op3_pii}, {}
