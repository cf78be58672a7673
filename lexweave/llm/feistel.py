"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

A pattern finds candidates, each is validated (check digits, calendar, number
ranges), and a valid one is written as two numbers left < a and right < b that
span exactly the valid values of its format.  Eight Feistel rounds
``left += F(right) mod a``, ``right += F(left) mod b`` with a keyed F (SHA-256)
permute that set, so the pseudonym is a valid value of the same format, differs
for different values, and is the same wherever the value occurs.  The holder of
the key can undo it (``restore``).  No shuffle, no join: one pass over the rows.

| kind | permuted | kept |
|-|-|-|
| email | letters and digits of the local part | domain, punctuation, case |
| phone | area, exchange and line of North American numbers (impossible ones keep the first digits of area and exchange); else the digits after the country code | country code, punctuation |
| card | all digits but the first and the last | first digit; the check digit is computed anew |
| iban | digits of the account part | country, letters; check digits are computed anew |
| ssn | area (not 000, 666, 9xx), group, serial | punctuation |
| ip | the four octets | |
| date | days of 1900-2099; 29 February among leap years | layout, separators |

The date of a timestamp ('2024-03-05T12:34:56Z') counts, its time stays.  Ten
digits in a row count as a phone number if area and exchange are North American
ones and they are no part of a longer number.  A phone number is its country code
(none: North America) and its national digits, however it is set apart, so its
forms share a pseudonym.  Not found are lower-case IBANs, social security numbers
without dashes, dates with names of months and IPv6 addresses.  Candidates that fail validation
stay as they are.  Null text stays null, other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9._%+-]{1,64}@)[._%+-]*[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
DATE = r"\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4}"
IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]\d{2,12}){1,5}|\+\d{9,15}|(?<!\d[.,:/-])[2-9]\d{2}[2-9]\d{6}(?![.,:/-]\d)"
CARD = r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
NUMBERS = "|".join([IP, DATE, SSN, PHONE, CARD, IBAN])
#: the date of a timestamp: a time follows after T
STAMPED = "|".join(rf"\d{{4}}{sep}\d{{1,2}}{sep}\d{{1,2}}|\d{{1,2}}{sep}\d{{1,2}}{sep}\d{{4}}" for sep in ("-", "/", "[.]"))
CANDIDATE = rf"(?<![0-9A-Za-z])(?:(?:{STAMPED})(?=[Tt]\d)|(?:{NUMBERS})(?![0-9A-Za-z]|[.]\d))|{EMAIL}"
#: fixed values: country calling codes of one and of two digits; all others have three
CODES_1 = "1 7"
CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
#: ISO alphabets
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once."""
    return F.transform(F.array(value), lambda v: fn(v))[0]


def _whole(v: Column, pattern: str) -> Column:
    return v.rlike(rf"\A(?:{pattern})\z")


def _long(s: Column) -> Column:
    return F.coalesce(F.expr("cast(null as bigint)"), s.cast("long"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _int(s: Column, at: int | Column, n: int | Column) -> Column:
    """The number written from character ``at`` on; 0 where n is 0."""
    at, n = (F.lit(x) if isinstance(x, int) else x for x in (at, n))
    return F.coalesce(F.nullif(s.substr(at, n), F.lit("")).cast("long"), F.lit(0).cast("long"))


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled (cross sums)."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(F.floor(2 * d / 10).cast("int") + (2 * d) % 10)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(iban: Column) -> Column:
    """The account number (no blanks), first four characters moved to the end, modulo 97."""
    chars = F.split(F.concat(iban.substr(5, 60), iban.substr(1, 4)), "")

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars, F.lit(0), add)


def _base26(s: Column) -> Column:
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 97)


def _power(base: int, n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), n + 1), F.lit(1).cast("long"), lambda a, i: F.when(i <= n, a * base).otherwise(a))


def _letters26(x: Column, n: Column) -> Column:
    return F.when(n == 0, "").otherwise(F.aggregate(
        F.sequence(F.lit(1), n), F.struct(x.alias("x"), F.lit("").alias("s")),
        lambda a, i: F.struct(F.floor(a["x"] / 26).cast("long").alias("x"), F.concat(F.lit(LETTERS).substr((a["x"] % 26 + 1).cast("int"), F.lit(1)), a["s"]).alias("s")), lambda a: a["s"]))


def _padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n, "0") if isinstance(n, int) else F.when(n == 0, "").otherwise(F.lpad(x.cast("string"), n, F.lit("0")))


def _pour(shape: Column, chars: Column, pattern: str) -> Column:
    """``shape`` with its characters of a class replaced, in order, by ``chars`` (upper case stays)."""

    def put(a: Column, c: Column) -> Column:
        new = chars.substr(a["k"], F.lit(1))
        hit = c.rlike(pattern) & (a["k"] <= F.length(chars))
        return F.struct(F.when(hit, a["k"] + 1).otherwise(a["k"]).alias("k"), F.concat(a["s"], F.when(hit, F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)).otherwise(c)).alias("s"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit(1).alias("k"), F.lit("").alias("s")), put, lambda a: a["s"])


def _date_parts(v: Column) -> Column:
    """year, month, day, layout (y: year first, m: month first, d: day first), sep."""
    sep = F.regexp_extract(v, r"\d([-/.])\d", 1)
    p = F.split(v, "[-/.]")
    n = [F.get(p, i).cast("int") for i in range(3)]
    year_first = F.length(F.get(p, 0)) == 4
    month_first = ~year_first & (sep == "/") & (n[0] <= 12)
    pick = lambda y, m, d: F.when(year_first, n[y]).when(month_first, n[m]).otherwise(n[d])
    return F.struct(
        pick(0, 2, 2).alias("y"), pick(1, 0, 1).alias("m"), pick(2, 1, 0).alias("d"), F.when(year_first, "y").when(month_first, "m").otherwise("d").alias("layout"), sep.alias("sep"),
        (F.least(F.length(F.when(year_first, F.get(p, 1)).otherwise(F.get(p, 0))), F.length(F.when(year_first, F.get(p, 2)).otherwise(F.get(p, 1)))) < 2).alias("bare"))


def _valid_date(d: Column) -> Column:
    ok = d["y"].between(1900, 2099) & d["m"].between(1, 12) & d["d"].between(1, 31)
    return ok & (d["d"] <= F.dayofmonth(F.last_day(F.make_date(F.when(ok, d["y"]).otherwise(2000), F.when(ok, d["m"]).otherwise(1), F.lit(1)))))


def kind_of(v: Column) -> Column:
    """The validated kind of a candidate, or null."""
    d = _digits(v)
    bare = F.regexp_replace(v, " ", "")
    octets = F.transform(F.split(v, "[.]"), lambda o: o.cast("int") <= 255)
    return (
        F.when(_whole(v, EMAIL), "email")
        .when(_whole(v, IP), F.when(F.forall(octets, lambda o: o), "ip"))
        .when(_whole(v, DATE), F.when(_let(_date_parts(v), _valid_date), "date"))
        .when(_whole(v, SSN), F.when(_int(d, 1, 3).between(1, 899) & (_int(d, 1, 3) != 666) & (_int(d, 4, 2) > 0) & (_int(d, 6, 4) > 0), "ssn"))
        .when(_whole(v, PHONE), F.when(F.length(d).between(9, 15), "phone"))
        .when(_whole(v, CARD), F.when(F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0), "card"))
        .when(_whole(v, IBAN), F.when(F.length(bare).between(15, 34) & (mod97(bare) == 1), "iban"))
    )


def _country(v: Column) -> Column:
    """Digits of the country code; none where no + leads."""
    starts = lambda codes: v.rlike(rf"\A\+(?:{codes.replace(' ', '|')})")
    return F.when(~v.startswith("+"), 0).when(starts(CODES_1), 1).when(starts(CODES_2), 2).otherwise(3)


def _north_american(v: Column, digits: Column) -> Column:
    """Ten national digits without a country code or after +1."""
    return (F.length(digits) == 10) & ~v.startswith("+") | (F.length(digits) == 11) & v.startswith("+1")


def _lr(l: Column, r: Column, a: Column, b: Column, more: Column | None = None) -> Column:  # noqa: E741
    named = zip("lrab", (l, r, a, b))
    return F.struct(*[x.cast("long").alias(k) for k, x in named], (F.lit("") if more is None else more).alias("tweak"))


def _split10(digits: Column, tweak: Column) -> Column:
    """Any run of digits as two halves of at most 15 digits."""
    n = F.length(digits)
    h = F.ceil(n / 2).cast("int")
    return _lr(_int(digits, F.lit(1), h), _int(digits, h + 1, n - h), _power(10, h), _power(10, n - h), F.concat_ws("|", tweak, n.cast("string")))


def _email_parts(v: Column) -> Column:
    local = F.substring_index(v, "@", 1)
    letters, digits = F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), F.regexp_replace(local, "[^0-9]", "")
    n1, n2, m = F.ceil(F.least(F.length(letters), F.lit(16)) / 2).cast("int"), F.floor(F.least(F.length(letters), F.lit(16)) / 2).cast("int"), F.least(F.length(digits), F.lit(6))
    return F.struct(letters.alias("letters"), digits.alias("digits"), n1.alias("n1"), n2.alias("n2"), m.alias("m"))


def _account(v: Column) -> Column:
    """Digits of an account number after the check digits, at most 30."""
    return _digits(F.regexp_replace(v, " ", "").substr(5, 60))


def _numbers(kind: Column, v: Column) -> Column:
    """The two numbers of a valid value, their ranges, and what else the rounds depend on."""
    d = _digits(v)
    ten = F.right(d, F.lit(10))
    area, exchange, line = _int(ten, 1, 3), _int(ten, 4, 3), _int(ten, 7, 4)
    american, valid_american = _north_american(v, d), (area >= 200) & (exchange >= 200)
    kept = F.concat(F.lit("na"), F.floor(area / 100).cast("string"), F.floor(exchange / 100).cast("string"))
    code = F.left(d, _country(v))
    long_lit = lambda x: F.lit(x).cast("long")

    def email(e: Column) -> Column:
        ten_m = _power(10, e["m"])
        return _lr(_base26(F.substring(e["letters"], F.lit(1), e["n1"])), _base26(F.substring(e["letters"], e["n1"] + 1, e["n2"])) * ten_m + _int(e["digits"], F.lit(1), e["m"]),
                   _power(26, e["n1"]), _power(26, e["n2"]) * ten_m, F.concat_ws("|", e["n1"].cast("string"), e["n2"].cast("string"), e["m"].cast("string")))

    def date(p: Column) -> Column:
        leap_day = (p["m"] == 2) & (p["d"] == 29)
        years = F.floor((p["y"] - 1904) / 4)  # 1904 .. 2096: 49 leap years
        plain = F.dayofyear(F.make_date(F.lit(2001), F.when(leap_day, 1).otherwise(p["m"]), F.when(leap_day, 1).otherwise(p["d"]))) - 1
        return F.when(leap_day, _lr(F.floor(years / 7), years % 7, long_lit(7), long_lit(7), F.lit("leap"))).otherwise(_lr(p["y"] - 1900, plain, long_lit(200), long_lit(365)))

    octet = lambda i: F.get(F.split(v, "[.]"), i).cast("long")
    real_area = area - F.when(area > 666, 2).otherwise(1)
    return (
        F.when(kind == "email", _let(_email_parts(v), email))
        .when(kind == "ip", _lr(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), long_lit(65536), long_lit(65536)))
        .when(kind == "date", _let(_date_parts(v), date))
        .when(kind == "ssn", _lr((_int(d, 1, 3) - F.when(_int(d, 1, 3) > 666, 2).otherwise(1)) * 99 + _int(d, 4, 2) - 1, _int(d, 6, 4) - 1, long_lit(898 * 99), long_lit(9999)))
        .when((kind == "phone") & american & valid_american, _lr((area - 200) * 100 + exchange % 100, (F.floor(exchange / 100) - 2) * 10000 + line, long_lit(80000), long_lit(80000), F.lit("na")))
        .when((kind == "phone") & american, _lr(area % 100 * 100 + exchange % 100, line, long_lit(10000), long_lit(10000), kept))
        .when(kind == "phone", _split10(F.substring(d, F.length(code) + 1, F.lit(20)), code))
        .when(kind == "card", _split10(F.substring(d, F.lit(2), F.length(d) - 2), F.left(d, F.lit(1))))
        .when(kind == "iban", _split10(_account(v), F.left(v, F.lit(2))))
    )


def _rounds(kind: Column, x: Column, key: str, undo: bool) -> Column:
    def mix(i: Column, value: Column, size: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), kind, x["tweak"], i.cast("string"), value.cast("string"))
        return F.pmod(F.conv(F.left(F.sha2(text.cast("binary"), 256), F.lit(15)), 16, 10).cast("long"), size)

    sign = -1 if undo else 1

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + sign * mix(i, s["r"], x["a"]), x["a"])
        right = F.pmod(s["r"] + sign * mix(i, s["l"], x["b"]), x["b"])
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(x["l"].alias("l"), x["r"].alias("r")), step)


def _written(kind: Column, v: Column, x: Column, y: Column, key: str, undo: bool) -> Column:
    """The permuted numbers in the layout of the old value."""
    d = _digits(v)
    n = F.length(d)
    origin = y if undo else x
    american = F.concat(_padded(F.floor(y["l"] / 100) + 200, 3), _padded((F.floor(y["r"] / 10000) + 2) * 100 + y["l"] % 100, 3), _padded(y["r"] % 10000, 4))
    joined = lambda size: F.concat(_padded(y["l"], F.ceil(size / 2).cast("int")), _padded(y["r"], F.floor(size / 2).cast("int")))
    digit = lambda at: F.substring(x["tweak"], at, 1)
    impossible = F.concat(digit(3), _padded(F.floor(y["l"] / 100), 2), digit(4), _padded(y["l"] % 100, 2), _padded(y["r"], 4))
    code = _country(v)
    payload = F.concat(F.left(d, F.lit(1)), joined(n - 2))
    card = F.concat(payload, F.pmod(-luhn_sum(F.concat(payload, F.lit("0"))), F.lit(10)).cast("string"))
    area = F.floor(y["l"] / 99)
    ssn = F.concat_ws("-", _padded(area + F.when(area >= 665, 2).otherwise(1), 3), _padded(y["l"] % 99 + 1, 2), _padded(y["r"] + 1, 4))
    account = _pour(F.substring(v, F.lit(5), F.lit(60)), joined(F.length(_account(v))), "[0-9]")

    def iban(tail: Column) -> Column:
        check = 98 - mod97(F.concat(F.left(v, F.lit(2)), F.lit("00"), F.regexp_replace(tail, " ", "")))
        return F.concat(F.left(v, F.lit(2)), _padded(check, 2), tail)

    def date(p: Column) -> Column:
        leap = x["tweak"] == "leap"
        year = F.when(leap, (y["l"] * 7 + y["r"]) * 4 + 1904).otherwise(y["l"] + 1900)
        day = F.date_add(F.lit("2001-01-01").cast("date"), F.when(leap, 0).otherwise(y["r"]).cast("int"))
        width = F.when(p["bare"], 1).otherwise(2)
        two = lambda c: F.when((width == 1) | (c >= 10), c.cast("string")).otherwise(F.concat(F.lit("0"), c.cast("string")))
        m, dd, yy = two(F.when(leap, 2).otherwise(F.month(day))), two(F.when(leap, 29).otherwise(F.dayofmonth(day))), year.cast("int").cast("string")
        return F.when(p["layout"] == "y", F.concat_ws("\x00", yy, m, dd)).when(p["layout"] == "m", F.concat_ws("\x00", m, dd, yy)).otherwise(F.concat_ws("\x00", dd, m, yy))

    def email(e: Column) -> Column:
        ten_m = _power(10, e["m"])
        old = F.concat_ws("|", F.lit(key), origin["l"].cast("string"), origin["r"].cast("string"))
        sign = -1 if undo else 1
        shift = lambda i, size: sign * F.pmod(F.conv(F.left(F.sha2(F.concat_ws("|", old, i.cast("string")).cast("binary"), 256), F.lit(15)), 16, 10).cast("long"), F.lit(size))
        first = F.concat(_letters26(y["l"], e["n1"]), _letters26(F.floor(y["r"] / ten_m).cast("long"), e["n2"]))
        rest = F.transform(F.filter(F.split(F.substring(e["letters"], F.lit(17), F.lit(64)), ""), lambda c: c != ""), lambda c, i: F.char(F.pmod(F.ascii(c) - 97 + shift(i, 26), F.lit(26)) + 97))
        digits = _padded(y["r"] % ten_m, e["m"])
        more = F.transform(F.filter(F.split(F.substring(e["digits"], F.lit(7), F.lit(64)), ""), lambda c: c != ""), lambda c, i: F.pmod(c.cast("long") + shift(i + 100, 10), F.lit(10)).cast("string"))
        local = _pour(F.substring_index(v, "@", 1), F.concat(first, F.array_join(rest, "")), "[A-Za-z]")
        return F.concat(_pour(local, F.concat(digits, F.array_join(more, "")), "[0-9]"), F.lit("@"), F.substring_index(v, "@", -1))

    return (
        F.when(kind == "email", _let(_email_parts(v), email))
        .when(kind == "ip", F.concat_ws(".", *[part.cast("string") for part in (F.floor(y["l"] / 256), y["l"] % 256, F.floor(y["r"] / 256), y["r"] % 256)]))
        .when(kind == "date", _let(_date_parts(v), lambda p: F.replace(date(p), F.lit("\x00"), p["sep"])))
        .when(kind == "ssn", ssn)
        .when((kind == "phone") & (x["tweak"] == "na"), _pour(v, F.concat(F.substring(d, F.lit(1), n - 10), american), "[0-9]"))
        .when((kind == "phone") & x["tweak"].startswith("na"), _pour(v, F.concat(F.substring(d, F.lit(1), n - 10), impossible), "[0-9]"))
        .when(kind == "phone", _pour(v, F.concat(F.substring(d, F.lit(1), code), joined(n - code)), "[0-9]"))
        .when(kind == "card", _pour(v, card, "[0-9]"))
        .when(kind == "iban", _let(account, iban))
    )


def pseudonym(v: Column, key: str, undo: bool = False) -> Column:
    """(kind, text): the pseudonym of one candidate; kind is null and text the
    candidate itself where validation fails."""

    def of(kind: Column) -> Column:
        made = _let(_numbers(kind, v), lambda x: _let(_rounds(kind, x, key, undo), lambda y: _written(kind, v, x, y, key, undo)))
        return F.struct(kind.alias("kind"), F.when(kind.isNull(), v).otherwise(made).alias("text"))

    return _let(kind_of(v), of)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with the text's personal data replaced, and ``kinds``: the kinds
    of what was replaced, in order of place (empty for null text; replaces a column
    of this name)."""
    text = F.col(text_col)
    found = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), 0), lambda v: pseudonym(v, key, undo))

    def put(done: Column) -> Column:
        gaps = F.split(text, CANDIDATE, -1)
        new = F.concat(F.transform(done, lambda p: p["text"]), F.array(F.lit("")))
        return F.struct(
            F.when(F.size(done) == 0, text).otherwise(F.array_join(F.zip_with(gaps, new, lambda g, p: F.concat(g, p)), "")).alias("text"),
            F.filter(F.transform(done, lambda p: p["kind"]), lambda k: k.isNotNull()).alias("kinds"))

    doc = F.col("_doc")
    out = docs.select(F.struct("*").alias("_doc"), F.when(text.rlike("[0-9@]"), _let(found, put)).alias("_new"))
    return out.select(
        *[F.coalesce("_new.text", doc[c]).alias(c) if c == text_col else doc[c].alias(c) for c in docs.columns if c != "kinds"],
        F.coalesce("_new.kinds", F.expr("cast(array() as array<string>)")).alias("kinds"))


def restore(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The inverse of ``pseudonymise`` under the same key."""
    return pseudonymise(docs, key, text_col, undo=True)
