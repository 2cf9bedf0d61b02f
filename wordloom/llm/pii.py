"""Format-preserving pseudonyms by Feistel networks, in DataFrame expressions only.

A validated value (payment card, US social security number, phone number, IPv4 address, date, e-mail
address, IBAN) is permuted under a key within the set of valid values of its format: it is read as
a pair (l, r) of the ranges A x B, and each round adds a keyed hash of one half to the other,
modulo the half's range. That is a bijection, so equal values get equal pseudonyms in all documents and
different values stay different. Separators, check digits' validity and lengths are kept.

Defined results: null text stays null with no findings, the empty text stays empty; rows that repeat
an id are treated each; values that fail validation (Luhn, ranges, calendar, mod 97) are left as they
are; an empty table gives an empty result; all of the input's other columns are left out, so their
names cannot clash.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The setting that holds the key; without the key, runs are not linked to one another.
KEY_SETTING = "spark.wordloom.pii.key"
#: Formats, in the order in which they are tried at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IPV4 = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![\p{L}\p{N}]|\.[0-9])"
SSN = r"(?<![\p{L}\p{N}-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\p{L}\p{N}]|-[0-9])"
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATES = (
    r"(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![\p{L}\p{N}]|[./-][0-9])",
    r"[0-3][0-9]\.[01][0-9]\.(?:19|20)[0-9]{2}(?![\p{L}\p{N}]|[./-][0-9])",
    r"[0-3]?[0-9]/[0-3]?[0-9]/(?:19|20)[0-9]{2}(?![\p{L}\p{N}]|[./-][0-9])",
    rf"{MONTH}\.? [0-3]?[0-9],? (?:19|20)[0-9]{{2}}(?![\p{{L}}\p{{N}}]|[./-][0-9])",
    rf"[0-3]?[0-9]\.? {MONTH}\.?,? (?:19|20)[0-9]{{2}}(?![\p{{L}}\p{{N}}]|[./-][0-9])",
)
DATE = r"(?<![\p{L}\p{N}./-])(?:" + "|".join(DATES) + ")"
PHONE = r"(?<![\p{L}\p{N}])\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4})?(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}.-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}]|[.-][0-9])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, SSN, DATE, PHONE, IBAN, CARD))
KINDS = ("email", "ipv4", "ssn", "date", "phone", "iban", "card")
#: Days that dates are permuted among: 73,000 from 1900-01-01.
FIRST_DAY, YEARS, DAYS = "1900-01-01", 200, 365


def _prf(key: str, kind: Column, n: Column, half: Column) -> Column:
    """48 keyed bits of a half in round n."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, n.cast("string"), half.cast("string")), 256), 1, 12), 16, 10).cast("long")


def feistel(key: str, kind: Column, l: Column, r: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """The pair (l, r) of 0..a-1 and 0..b-1 after all rounds, as a struct."""
    start = F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    step = lambda s, n: F.when(
        n % 2 == 0, F.struct(F.pmod(s["l"] + _prf(key, kind, n, s["r"]), a).alias("l"), s["r"].alias("r"))
    ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + _prf(key, kind, n, s["l"]), b).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _ten(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(19)]), n + 1)


def permuted_digits(key: str, kind: Column, digits: Column) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    left = (n / 2).cast("int")
    tag = F.concat(kind, F.lit(":"), n.cast("string"))
    out = feistel(key, tag, F.substring(digits, F.lit(1), left), F.substring(digits, left + 1, n - left), _ten(left), _ten(n - left))
    # The pair is taken apart inside one lambda, so that the rounds run once.
    return F.element_at(F.transform(F.array(out), lambda s: F.concat(F.lpad(s["l"].cast("string"), left, "0"), F.lpad(s["r"].cast("string"), n - left, "0"))), 1)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of all digits, the last of weight 1."""
    places = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(F.filter(places, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") / 5).cast("int"))), F.lit(0), lambda s, x: s + x)


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those given."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("t"), F.lit(1).alias("k"))
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["t"], F.substring(digits, s["k"], F.lit(1))).alias("t"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["k"].alias("k")))
    return F.aggregate(chars, start, step, lambda s: s["t"])


def _once(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _card(key: str, m: Column) -> Column:
    digits = digits_of(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    fresh = _once(permuted_digits(key, F.lit("card"), body), lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    return F.when(luhn_sum(digits) % 10 == 0, refilled(m, fresh)).otherwise(m)


def _ssn(key: str, m: Column) -> Column:
    area, rest = F.substring(m, 1, 3).cast("long"), (F.substring(m, 5, 2).cast("long") - 1) * 9999 + F.substring(m, 8, 4).cast("long") - 1
    index = F.when(area > 666, area - 2).otherwise(area - 1)  # 1..899 without 666
    out = feistel(key, F.lit("ssn"), index, rest, F.lit(898), F.lit(99 * 9999))
    return _once(out, lambda s: F.format_string("%03d-%02d-%04d", F.when(s["l"] >= 665, s["l"] + 2).otherwise(s["l"] + 1), F.floor(s["r"] / 9999) + 1, s["r"] % 9999 + 1))


def _ipv4(key: str, m: Column) -> Column:
    part = F.split(m, r"\.")
    number = lambda i: part[i].cast("long") * 256 + part[i + 1].cast("long")
    out = feistel(key, F.lit("ipv4"), number(0), number(2), F.lit(65536), F.lit(65536))
    return _once(out, lambda s: F.format_string("%d.%d.%d.%d", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))


def _date(key: str, m: Column) -> Column:
    """The day is permuted and shown in the layout it came in; a slashed date is day-first unless only month-first is a date."""
    iso, written = m.rlike("^[0-9]{4}-"), m.rlike("[A-Za-z]")
    part = F.regexp_extract_all(m, F.lit("[0-9]+"), 0)
    first, second = part[0].cast("int"), part[1].cast("int")
    us = (~iso) & (~written) & (second > 12)
    name = F.regexp_extract(m, "[A-Za-z]+", 0)
    named = ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(name, 1, 3))) + 2) / 3).cast("int")
    ymd = lambda y, mo, d: F.format_string("%04d-%02d-%02d", y.cast("int"), mo.cast("int"), d.cast("int"))
    parsed = F.try_to_date(F.when(iso, m).when(written, ymd(part[1], named, first)).when(us, ymd(part[2], first, second)).otherwise(ymd(part[2], second, first)), "yyyy-MM-dd")
    day = F.datediff(parsed, F.lit(FIRST_DAY).cast("date"))
    out = feistel(key, F.lit("date"), F.floor(day / DAYS), day % DAYS, F.lit(YEARS), F.lit(DAYS))
    fresh = _once(out, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * DAYS + s["r"]).cast("int")))

    def shown(d: Column) -> Column:
        show = lambda pattern: F.date_format(d, pattern)
        gap = F.split(m, "[A-Za-z]+|[0-9]+", -1)
        padded = (F.length(part[0]) == 2) & (F.length(part[1]) == 2)
        numbers = lambda x, y: F.when(padded, F.concat(show(x * 2), gap[1], show(y * 2), gap[2], show("yyyy"))).otherwise(F.concat(show(x), gap[1], show(y), gap[2], show("yyyy")))
        month = F.when(F.length(name) > 4, show("MMMM")).otherwise(show("MMM"))
        words = F.when(m.rlike("^[A-Za-z]"), F.concat(month, gap[1], show("d"), gap[2], show("yyyy"))).otherwise(F.concat(show("d"), gap[1], month, gap[2], show("yyyy")))
        return F.when(iso, show("yyyy-MM-dd")).when(written, words).when(us, numbers("M", "d")).otherwise(numbers("d", "M"))

    return F.when(parsed.isNotNull() & (day >= 0) & (day < YEARS * DAYS), _once(fresh, shown)).otherwise(m)


def _phone(key: str, m: Column) -> Column:
    """All digits but a country code's are permuted."""
    plus = F.regexp_extract(m, r"^\+[1-9][0-9]{0,2}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(plus) + 1, F.length(m))
    return F.concat(plus, refilled(rest, permuted_digits(key, F.lit("phone"), digits_of(rest))))


def _mod97(text: Column) -> Column:
    """The text's remainder with letters read as 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + value(c)) % 97).otherwise((s * 100 + value(c)) % 97))


def _iban(key: str, m: Column) -> Column:
    plain = F.regexp_replace(m, " ", "")
    body = F.substring(plain, F.lit(5), F.length(plain) - 4)
    land = F.substring(plain, 1, 2)
    valid = (F.length(plain).between(15, 34)) & (_mod97(F.concat(body, land, F.substring(plain, 3, 2))) == 1)
    inner = F.concat(F.lit("iban:"), land, F.lit(":"), F.translate(body, "0123456789", "0000000000"))
    fresh = _once(refilled(body, permuted_digits(key, inner, digits_of(body))), lambda b: F.concat(F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), digits_of(b)))
    return F.when(valid & (F.length(digits_of(body)) >= 2), refilled(m, fresh)).otherwise(m)


def _email(key: str, m: Column) -> Column:
    """The local part's letters and digits are shifted within their kinds, half by the other half; the domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    n = F.length(local)
    left = F.greatest((n / 2).cast("int"), F.lit(1))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(local, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")

    def shift(c: Column, by: Column) -> Column:
        move = lambda base, size: F.char(F.pmod(F.ascii(c) - base + by, F.lit(size)) + base)
        return F.when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).when(c.rlike("^[0-9]$"), move(48, 10)).otherwise(c)

    def moved(half: Column, other: Column, rnd: Column) -> Column:
        chars = F.filter(F.split(half, ""), lambda c: c != "")
        kind = F.concat(F.lit("email:"), shape)
        return F.array_join(F.transform(chars, lambda c, i: shift(c, _prf(key, kind, rnd * 1000 + i, other) % 7907)), "")

    start = F.struct(F.substring(local, F.lit(1), left).alias("l"), F.substring(local, left + 1, n).alias("r"))
    step = lambda s, k: F.when(k % 2 == 0, F.struct(moved(s["l"], s["r"], k).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), moved(s["r"], s["l"], k).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, step, lambda s: F.concat(s["l"], s["r"], F.lit("@"), domain))


def kind_of(m: Column) -> Column:
    whole = lambda p: m.rlike(f"^(?:{p})$")
    out = F.when(m.contains("@"), "email")
    for name, pattern in (("ipv4", IPV4), ("ssn", SSN), ("date", DATE), ("phone", PHONE), ("iban", IBAN)):
        out = out.when(whole(pattern), name)
    return out.otherwise("card")


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of a value in one of the formats."""
    makers = {"email": _email, "ipv4": _ipv4, "ssn": _ssn, "date": _date, "phone": _phone, "iban": _iban}
    kind = kind_of(m)
    out = F.when(kind == "email", _email(key, m))
    for name in ("ipv4", "ssn", "date", "phone", "iban"):
        out = out.when(kind == name, makers[name](key, m))
    return out.otherwise(_card(key, m))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms), found (kind, pseudonym of each replaced value, in order)."""
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    may = F.col("text").rlike(r"[0-9@]")
    base = base.withColumn("values", F.when(may, F.regexp_extract_all("text", F.lit(ANY), 0)).otherwise(F.array().cast("array<string>")))
    base = base.withColumn("fresh", F.transform("values", lambda m: pseudonym(key, m)))
    gaps = F.split("text", ANY, -1)
    whole = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size("fresh")), "fresh", lambda g, f: F.concat(g, f)), ""), F.element_at(gaps, -1))
    changed = F.filter(F.arrays_zip("values", "fresh"), lambda z: z["values"] != z["fresh"])
    found = F.transform(changed, lambda z: F.struct(kind_of(z["values"]).alias("kind"), z["fresh"].alias("pseudonym")))
    return base.select("doc_id", F.when(F.size("values") > 0, whole).otherwise(F.col("text")).alias("text"), F.when(F.col("text").isNull(), F.array().cast("array<struct<kind:string,pseudonym:string>>")).otherwise(found).alias("found"))


def session_key(spark: SparkSession) -> str:
    """The secret that the session names, or a new random one: without it no pseudonym can be traced back."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def pii_digest(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, the pseudonymised text, and how many values of each kind were replaced; key: the session's where not given."""
    out = pseudonymise(docs, key or session_key(docs.sparkSession))
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return out.select("doc_id", "text", F.size("found").cast("long").alias("n_found"), *counts)
