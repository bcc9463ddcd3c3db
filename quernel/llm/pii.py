"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Validated numbers and dates are permuted by a keyed Feistel network over exactly the set of values of their format:

- payment cards: 13 to 19 digits, 4-4-4-4 or 4-6-5, with a right check digit, which the result has again
- IBANs with right check digits, which the result has again; country and letters stay
- social security numbers 3-2-4 in the ranges that are given out
- IPv4 addresses, and IPv6 addresses of eight groups
- telephone numbers with a plus and 7 to 15 digits (the country code stays), or in groups of 3-3-4
- calendar dates of the years 1600 to 2399: year first (with - or /, also before a time), day first with dots, and with
  slashes month first or, where no such month exists, day first; padded with zeros or not

Both halves of a value live in Z_a x Z_b, each round adds a keyed digest of one half to the other, so the map is a
bijection and equal values stay linked across documents, however they are separated. Text around a value, separators
and lengths of numbers stay as they were. E-mail addresses and secrets (32 to 64 hex digits) have no finite format to
permute: they get keyed digests.

Numbers that fail validation (a wrong check digit, an impossible date or address) aren't personal data and stay.

Defined cases: a null text stays null, a text without matches stays itself; every match in a text of any length is
replaced; other columns and repeated rows are passed through; without a key, given or set, there is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ROUNDS = 8
KEY_SETTING = "spark.quernel.pii.key"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
ADDRESS = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
ADDRESS6 = r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])"
DATE = r"(?<![\w\-./])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!(?!T\d)[\w\-/]|\.\d)"
PHONE = r"(?<![\w+])(?:\+\d(?:[ .\-]?[( ]?\d\)?){6,14}|\(\d{3}\) ?\d{3}[\-.]\d{4}|\d{3}([\-.])\d{3}\1\d{4})(?![\w\-]|\.\d)"
SOCIAL = r"(?<![\w\-.])\d{3}-\d{2}-\d{4}(?![\w\-])"
CARD = r"(?<![\w\-.])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\w\-])"
IBAN = r"(?<![\w\-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w\-])"
#: Country calling codes of one and two digits; all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Looks at the first characters before anything dearer. The group that PHONE refers back to is its first.
NUMBER = rf"(?=[0-9+(])(?:{PHONE}|{SECRET}|{ADDRESS}|{DATE}|{SOCIAL}|{CARD})|(?=[A-Z]{{2}}\d\d){IBAN}|(?=[a-fA-F][0-9a-fA-F]{{31}}){SECRET}|(?=[0-9a-fA-F]{{1,4}}:){ADDRESS6}"


def _digest(key: str, *parts: Column) -> Column:
    """60 bits of a keyed digest, as a long that isn't negative."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def let(value: Column, then) -> Column:
    """then(value), with value worked out once however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def feistel(left: Column, right: Column, a: Column, b: Column, kind: str, key: str) -> Column:
    """The struct (l, r) that the network maps (left, right) of Z_a x Z_b to."""

    def step(state: Column, k: Column) -> Column:
        even = k % 2 == 0
        f = _digest(key, F.lit(kind), a, b, k, F.when(even, state["r"]).otherwise(state["l"]))
        return F.struct(F.when(even, (state["l"] + f % a) % a).otherwise(state["l"]).alias("l"), F.when(even, state["r"]).otherwise((state["r"] + f % b) % b).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), start, step)


def _pow10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, kind: str, key: str) -> Column:
    """A string of 2 to 30 digits mapped to one of the same length."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    out = feistel(F.substr(digits, F.lit(1), h), F.substr(digits, h + 1, n - h), _pow10(h), _pow10(n - h), kind, key)
    return let(out, lambda o: F.concat(F.lpad(o["l"].cast("string"), h, F.lit("0")), F.lpad(o["r"].cast("string"), n - h, F.lit("0"))))


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """The check sum of a digit string; double_last: the last digit counts double (its check digit is still missing)."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == (0 if double_last else 1), twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _refill(mask: Column, digits: Column) -> Column:
    """mask with its digits replaced, in order, by digits."""

    def put(state: Column, c: Column) -> Column:
        own = c.rlike("^[0-9]$")
        return F.struct(F.concat(state["s"], F.when(own, F.substr(digits, state["k"], F.lit(1))).otherwise(c)).alias("s"), (state["k"] + F.when(own, 1).otherwise(0)).alias("k"))

    return F.aggregate(F.split(mask, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), put)["s"]


def _card(m: Column, key: str) -> Column:
    def moved(digits: Column) -> Column:
        body = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key)
        new = let(body, lambda x: F.concat(x, F.pmod(-_luhn_sum(x, True), F.lit(10)).cast("string")))
        return F.when(_luhn_sum(digits, False) % 10 == 0, let(new, lambda x: _refill(m, x))).otherwise(m)

    return let(F.regexp_replace(m, r"\D", ""), moved)


def _phone(m: Column, key: str) -> Column:
    def moved(digits: Column) -> Column:
        n = F.length(digits)
        kept = F.when(m.startswith("+"), F.length(F.regexp_extract(digits, COUNTRY, 0))).otherwise(0)
        new = F.concat(F.substr(digits, F.lit(1), kept), permute_digits(F.substr(digits, kept + 1, n - kept), "phone", key))
        return let(new, lambda x: _refill(m, x))

    return let(F.regexp_replace(m, r"\D", ""), moved)


def _social(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.element_at(F.split(m, "-"), k).cast("long") for k in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    out = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), "social", key)

    def told(o: Column) -> Column:
        parts = (o["l"] + F.when(o["l"] >= 665, 2).otherwise(1), F.floor(o["r"] / 9999) + 1, o["r"] % 9999 + 1)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, F.lit("0")) for x, n in zip(parts, (3, 2, 4), strict=True)])

    return F.when(valid, let(out, told)).otherwise(m)


def _mod97(text: Column) -> Column:
    """The number that a string of digits and capital letters (A counts 10) stands for, modulo 97."""

    def add(total: Column, i: Column) -> Column:
        c = F.ascii(F.substr(text, i, F.lit(1)))
        return F.when(c < 58, (total * 10 + c - 48) % 97).otherwise((total * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    def moved(plain: Column) -> Column:
        country, body = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
        digits = F.regexp_replace(body, r"\D", "")
        new = let(F.when(F.length(digits) > 1, permute_digits(digits, "iban", key)).otherwise(digits), lambda x: _refill(body, x))

        def checked(b: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, F.lit("0"))
            return F.concat(check, F.regexp_replace(b, r"\D", ""))

        return F.when(_mod97(F.concat(body, country, F.substr(plain, F.lit(3), F.lit(2)))) == 1, let(let(new, checked), lambda x: _refill(m, x))).otherwise(m)

    return let(F.regexp_replace(m, " ", ""), moved)


def _address6(m: Column, key: str) -> Column:
    groups = F.transform(F.split(m, ":"), lambda g: F.conv(g, 16, 10).cast("long"))
    size = F.lit(1 << 32).cast("long")

    def half(x: Column, first: int) -> Column:
        at = [F.element_at(x, first + k) for k in range(4)]
        out = feistel(at[0] * 65536 + at[1], at[2] * 65536 + at[3], size, size, f"address6-{first}", key)
        return let(out, lambda o: F.concat_ws(":", *[F.lower(F.hex(v)) for v in (F.floor(o["l"] / 65536), o["l"] % 65536, F.floor(o["r"] / 65536), o["r"] % 65536)]))

    return let(groups, lambda x: F.concat(half(x, 1), F.lit(":"), half(x, 5)))


def _address(m: Column, key: str) -> Column:
    p = F.split(m, r"\.")
    at = [F.element_at(p, k).cast("long") for k in (1, 2, 3, 4)]
    size = F.lit(65536).cast("long")
    out = feistel(at[0] * 256 + at[1], at[2] * 256 + at[3], size, size, "address", key)
    return let(out, lambda o: F.concat_ws(".", *[x.cast("string") for x in (F.floor(o["l"] / 256), o["l"] % 256, F.floor(o["r"] / 256), o["r"] % 256)]))


def _date(m: Column, key: str) -> Column:
    """Days since 1600-01-01 modulo 146,097 (a whole cycle of the calendar, 189 x 773 days), era kept."""

    def moved(pattern: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(pattern)).cast("date")
        days = F.datediff(day, F.lit("1600-01-01").cast("date")).cast("long")
        era, x = F.floor(days / 146097), F.pmod(days, F.lit(146097))
        out = feistel(F.floor(x / 773), x % 773, F.lit(189).cast("long"), F.lit(773).cast("long"), "date", key)
        new = let(out, lambda o: F.date_add(F.lit("1600-01-01").cast("date"), (era * 146097 + o["l"] * 773 + o["r"]).cast("int")))
        return F.when((F.year(day) >= 1600) & (F.year(day) < 2400), F.date_format(new, pattern))

    bare = m.rlike(r"(?:^|[/.])\d[/.]")  # a day or month without a leading zero
    dots = F.when(bare, moved("d.M.yyyy")).otherwise(moved("dd.MM.yyyy"))
    slashes = F.when(bare, F.coalesce(moved("M/d/yyyy"), moved("d/M/yyyy"))).otherwise(F.coalesce(moved("MM/dd/yyyy"), moved("dd/MM/yyyy")))
    own = F.when(m.contains("-"), moved("yyyy-MM-dd")).when(m.contains("."), dots).when(m.rlike("^\\d{4}/"), moved("yyyy/MM/dd")).otherwise(slashes)
    return F.coalesce(own, m)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


def _secret(m: Column, key: str) -> Column:
    return F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), m), 256), F.lit(1), F.length(m))


def pseudonym(m: Column, key: str) -> Column:
    """What a match of NUMBER is replaced by; itself if it isn't valid."""
    return (
        F.when(m.rlike(rf"^{PHONE}$"), _phone(m, key))
        .when(m.rlike(r"^[0-9a-fA-F]{32,64}$"), _secret(m, key))
        .when(m.rlike(rf"^{ADDRESS}$"), _address(m, key))
        .when(m.rlike(rf"^{DATE}$"), _date(m, key))
        .when(m.rlike(rf"^{SOCIAL}$"), _social(m, key))
        .when(m.contains(":"), _address6(m, key))
        .when(m.rlike("^[A-Z]"), _iban(m, key))
        .otherwise(_card(m, key))
    )


def key_of(spark: SparkSession) -> str:
    """The secret key of the session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pass a key or set {KEY_SETTING}")
    return key


def shown_key(spark: SparkSession) -> str:
    """The key of the registered queries: the session's, or a public one, as their tables hold invented data only."""
    return spark.conf.get(KEY_SETTING, None) or "public-test-key"


def _with_key(replaced, key: str):
    return lambda m: replaced(m, key)


def pseudonymise(docs: DataFrame, key: str | None = None, text_column: str = "text") -> DataFrame:
    """docs with the personal data of every whole text replaced."""
    key = key_of(docs.sparkSession) if key is None else key
    out, name = docs, C.free_name("__found", docs)
    for pattern, sign, replaced in ((EMAIL, "@", _email), (NUMBER, "[0-9]", pseudonym)):
        text = F.col(f"`{text_column}`")
        # a column of its own, so that each text is searched once; a text without the sign isn't searched
        out = out.withColumn(name, F.when(text.rlike(sign), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
        found, gaps = F.col(name), F.split(text, pattern, -1)
        new = F.transform(found, _with_key(replaced, key))
        joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(found)), new, lambda gap, x: F.concat(gap, x)), ""), F.element_at(gaps, -1))
        out = out.withColumn(text_column, F.when(F.size(found) > 0, joined).otherwise(text)).drop(name)
    return out


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(C.table(spark, sf_dir, "documents").select("doc_id", "text"), shown_key(spark))
