"""Personal data: format-preserving pseudonyms by a keyed Feistel network.

Validated numbers and dates are permuted within their format: the digits of a phone number become other digits in the
same places, a card number stays valid, a date becomes another date. The permutation depends on the key alone, so equal
values stay equal in all documents, and different ones different. Everything is column expressions; a text is a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from EPOCH on that are permuted among themselves: 200 x 365.
EPOCH, YEARS, DAYS = "1900-01-01", 200, 365

# Lengths of account numbers by country, without which the end of one in printed groups cannot be told from the next word.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _grouped(n: int, lands: str) -> str:
    rest = f" [A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}"


GROUPED = "|".join(_grouped(n, lands) for n, lands in _LENGTHS.items())
#: Country codes of telephone numbers; those of three digits are the rest.
COUNTRY = r"^\+(1|7|2[07]|3[0123469]|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_LOCAL = r"(?<![A-Za-z0-9+])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![A-Za-z0-9+-])(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
_ABROAD = r"(?<![A-Za-z0-9+])\+[1-9](?:[ ./-]?(?:\([0-9]{1,4}\)|[0-9])){4,14}(?![0-9])"

# Patterns by kind, tried in this order. Quantifiers are possessive or bounded, so that no text makes them backtrack far.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}+|{GROUPED})(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "phone": f"{_LOCAL}|{_ABROAD}",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _random(key: str, *parts: Column) -> Column:
    """60 bits from the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def permute(left: Column, right: Column, of_left: Column, of_right: Column, tweak: Column, key: str) -> Column:
    """Permutation of the pairs (left < of_left, right < of_right): a struct of l and r.

    ROUNDS (an even number) of a Feistel network with halves of different sizes; of_left and of_right stay below 2^61.
    """

    def step(acc: Column, i: Column) -> Column:
        turn = F.when(i % 2 == 0, of_left).otherwise(of_right)
        noise = F.pmod(_random(key, tweak, i, acc["r"]), turn)
        return F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + noise, turn).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def permute_digits(digits: Column, kind: str, key: str) -> Column:
    """Other digits of the same number, for 2 to 36 digits."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    made = permute(F.substring(digits, F.lit(1), u).cast("long"), F.substring(digits, u + 1, v).cast("long"), _power(u), _power(v), F.concat(F.lit(kind), n), key)
    return F.concat(F.lpad(made["l"].cast("string"), u, F.lit("0")), F.lpad(made["r"].cast("string"), v, F.lit("0")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _placed(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by ``digits``; everything else stays."""
    nth = lambda i: F.length(_digits(F.substring(value, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, nth(i), F.lit(1))).otherwise(c)), "")


def _ssns(digits: Column, key: str) -> Column:
    """Another valid number: areas 001 to 899 but 666, groups 01 to 99 and serials 0001 to 9999 are permuted as one set."""
    area, group, serial = (F.substring(digits, at, n).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
    made = permute(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)
    parts = (made["l"] + 1 + F.when(made["l"] + 1 >= 666, 1).otherwise(0), 3), (F.floor(made["r"] / 9999) + 1, 2), (made["r"] % 9999 + 1, 4)
    return F.concat(*[F.lpad(n.cast("long").cast("string"), size, "0") for n, size in parts])


def luhn_sum(digits: Column) -> Column:
    """Weighted digit sum of a card number without or with its check digit; the last digit counts once."""
    doubled = lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda a, x: a + x)


def _shift(half: Column, other: Column, i: Column, tweak: str, key: str) -> Column:
    """Each letter or digit of ``half`` moved within its class by a number drawn from the other half."""

    def moved(c: Column, p: Column) -> Column:
        k = _random(key, F.lit(tweak), i, p, other)
        turn = lambda first, n: F.char(F.lit(first) + F.pmod(F.ascii(c) - first + k, F.lit(n)))
        return F.when(c.between("0", "9"), turn(48, 10)).when(c.between("a", "z"), turn(97, 26)).when(c.between("A", "Z"), turn(65, 26)).otherwise(c)

    return F.array_join(F.transform(F.split(half, ""), moved), "")


def permute_text(value: Column, kind: str, key: str) -> Column:
    """A Feistel network on the two halves of a text: letters stay letters of their case, digits digits, signs as they are."""
    u = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), u).alias("l"), F.substring(value, u + 1, F.length(value)).alias("r"))
    step = lambda acc, i: F.struct(acc["r"].alias("l"), _shift(acc["l"], acc["r"], i, kind, key).alias("r"))
    made = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.concat(made["l"], made["r"])


def _mod97(text: Column) -> Column:
    """Remainder of a number written with digits and letters (A = 10) by 97."""
    code = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.between("0", "9"), 10).otherwise(100) + code(c), F.lit(97)))


def _month_first(value: Column, key: str) -> Column:
    """Another date written month first, for a day above 12; null for other values.

    Days stay above 12, so that the result reads as one notation only, as the value does. Days 13 to 28, later ones, and
    29 February are permuted among themselves, each within the years from EPOCH on (the last within its 49 leap years).
    """
    month, day, year = (F.substring(value, at, n).try_cast("int") for at, n in ((1, 2), (4, 2), (7, 4)))
    since = year - 1900
    # Later days: 30 of the eleven months but February, then 31 of seven; 29 of eleven comes first.
    long = F.array(*[F.lit(m) for m in (1, 3, 5, 7, 8, 10, 12)])
    other = F.array(*[F.lit(m) for m in (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)])
    place = F.when(day == 31, F.array_position(long, month) + 21).otherwise((day - 29) * 11 + F.array_position(other, month) - 1)
    common = permute(since, (month - 1) * 16 + day - 13, F.lit(YEARS), F.lit(192), F.lit("month-first"), key)
    late = permute(since, place, F.lit(YEARS), F.lit(29), F.lit("month-first-late"), key)
    leap = permute(F.floor((since / 4 - 1) / 7), F.pmod(since / 4 - 1, F.lit(7)), F.lit(7), F.lit(7), F.lit("month-first-leap"), key)
    text = lambda m, d, y: F.concat(F.lpad(m.cast("int").cast("string"), 2, "0"), F.lit("/"), F.lpad(d.cast("int").cast("string"), 2, "0"), F.lit("/"), (y + 1900).cast("int").cast("string"))
    at = late["r"].cast("int")
    late_text = text(F.when(at >= 22, F.get(long, at - 22)).otherwise(F.get(other, at % 11)), F.when(at >= 22, 31).otherwise(F.floor(at / 11) + 29), late["l"])
    real = value.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$") & (day > 12) & (since >= 0) & (since < YEARS) & F.try_to_timestamp(value, F.lit("MM/dd/yyyy")).isNotNull()
    made = F.when(day <= 28, text(F.floor(common["r"] / 16) + 1, common["r"] % 16 + 13, common["l"])).when(month == 2, text(F.lit(2), F.lit(29), (leap["l"] * 7 + leap["r"] + 1) * 4)).otherwise(late_text)
    return F.when(real, made)


def _dates(value: Column, key: str) -> Column:
    """Another date in the same notation, or null if it is no date within the days that are permuted.

    A date with slashes is read day first, and month first only if its second number is above 12.
    """
    out = _month_first(value, key)
    for pattern, notation in ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}/", "dd/MM/yyyy"), (r"^[0-9]{2}\.", "dd.MM.yyyy")):
        days = F.datediff(F.try_to_timestamp(value, F.lit(notation)).cast("date"), F.lit(EPOCH).cast("date"))
        made = permute(F.floor(days / DAYS), F.pmod(days, F.lit(DAYS)), F.lit(YEARS), F.lit(DAYS), F.lit("date"), key)
        fits = value.rlike(pattern) & (days >= 0) & (days < YEARS * DAYS)
        out = F.when(fits, F.date_format(F.date_add(F.lit(EPOCH).cast("date"), (made["l"] * DAYS + made["r"]).cast("int")), notation)).otherwise(out)
    return out


def kind_of(value: Column) -> Column:
    """Kind of a matched value after validation, or null."""
    digits = _digits(value)
    parts = F.split(value, r"\.")
    joined = F.replace(value, F.lit(" "), F.lit(""))
    out = F.lit(None).cast("string")
    checks = {
        "card": F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0),
        "ssn": ~value.rlike("^(000|666|9)|-00-|-0000$"),
        "phone": F.length(digits).between(F.when(value.startswith("+"), 8).otherwise(10), 15),
        "ip": F.forall(parts, lambda p: p.cast("int") <= 255),
        "date": F.lit(True),
        "iban": _mod97(F.concat(F.substring(joined, F.lit(5), F.length(joined)), F.left(joined, F.lit(4)))) == 1,
        "email": F.lit(True),
    }
    for kind, check in checks.items():
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$") & check, F.lit(kind)).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """Pseudonym of a validated value; null for null kinds."""
    digits = _digits(value)
    body = permute_digits(F.left(digits, F.length(digits) - 1), "card", key)
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    # The last ten digits, or all after the country code.
    coded = ~value.rlike(f"^(?:{_LOCAL})$")
    before = F.when(coded, F.length(F.regexp_extract(F.concat(F.lit("+"), digits), COUNTRY, 1))).otherwise(F.length(digits) - 10)
    national = F.substring(digits, before + 1, F.length(digits))
    code = F.left(digits, before)
    octets = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    at = permute(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), F.lit("ip"), key)
    ip = F.concat_ws(".", *[F.floor(x).cast("long").cast("string") for x in (at["l"] / 256, at["l"] % 256, at["r"] / 256, at["r"] % 256)])
    joined = F.replace(value, F.lit(" "), F.lit(""))
    account = permute_text(F.substring(joined, F.lit(5), F.length(joined)), "iban", key)
    land = F.left(value, F.lit(2))
    iban = F.concat(land, F.lpad((98 - _mod97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0"), account)
    iban = F.when(value.contains(" "), F.regexp_replace(iban, "(.{4})(?=.)", "$1 ")).otherwise(iban)
    name = F.substring_index(value, "@", 1)
    email = F.concat(permute_text(name, "email", key), F.substring(value, F.length(name) + 1, F.length(value)))
    return (
        F.when(kind == "card", _placed(value, F.concat(body, check)))
        .when(kind == "phone", _placed(value, F.concat(code, permute_digits(national, "phone", key))))
        .when(kind == "ssn", _placed(value, _ssns(digits, key)))
        .when(kind == "ip", ip)
        .when(kind == "date", _dates(value, key))
        .when(kind == "iban", iban)
        .when(kind == "email", email)
    )


def pseudonymise(documents: DataFrame, key: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns ``keep``, the text with every validated value replaced, n_values and kinds (sorted, distinct).

    Values that fail their validation (a card number's check digit, a date that does not exist, ...) stay. A null text
    stays null with no values. Kept columns named like a result are replaced. One map over the rows; nothing is shuffled.
    """
    if not key:
        raise ValueError("a key is needed")
    keep = [c for c in dict.fromkeys(keep) if c not in (text, "n_values", "kinds")]
    rows = documents.select(*keep, F.col(text).alias("_text"), F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), 0)).alias("_found"))
    typed = F.transform("_found", lambda v: F.struct(v.alias("v"), kind_of(v).alias("k")))
    named = F.transform("_typed", lambda s: F.struct(pseudonym(s["v"], s["k"], key).alias("p"), s["v"].alias("v"), s["k"].alias("k")))
    some = F.coalesce(F.size("_found") > 0, F.lit(False))
    rows = rows.withColumn("_typed", F.when(some, typed)).withColumn("_named", F.when(some, named))
    made = F.filter("_named", lambda s: s["p"].isNotNull())
    pieces = F.zip_with(F.split("_text", ANY, -1), "_named", lambda b, s: F.concat(F.coalesce(b, F.lit("")), F.coalesce(s["p"], s["v"], F.lit(""))))
    return rows.select(
        *keep,
        F.when(some, F.array_join(pieces, "")).otherwise(F.col("_text")).alias(text),
        F.coalesce(F.size(F.when(some, made)), F.lit(0)).cast("long").alias("n_values"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform(F.when(some, made), lambda s: s["k"]))), F.array().cast("array<string>")).alias("kinds"),
    )
