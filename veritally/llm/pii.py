"""Personal data: format-preserving Feistel pseudonyms.  DataFrame functions only.

Candidates are found by one pattern and validated by kind (check digits, ranges, the calendar).  A valid value is split
into symbols, each with its own radix, and permuted by an alternating Feistel network: ten rounds in which one half
is shifted, symbol by symbol modulo its radix, by a keyed hash of the other half.  Check digits are computed anew; where
some results are invalid (dates, social security numbers) the network is applied again until one is valid, which
keeps the map a permutation of the valid values.  So equal values have equal pseudonyms in all documents,
different values different ones, and every pseudonym is a valid value of the same format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import read

ROUNDS, WALKS = 10, 48
#: The key of the registered query; give your own in production.
KEY = "veritally registered query"

_EDGE, _STOP = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: Candidates by kind, in order of precedence where two begin at one place.
PATTERNS = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "secret": _EDGE + r"AKIA[A-Z0-9]{16}" + _STOP + r"|\b(?:password|passwd|secret|token|api_key) ?[=:] ?\"?[A-Za-z0-9_\-/+]{8,}+",
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)" + _STOP,
    "phone": r"(?:\+1[ .-]?)?(?<![\d)])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?:\+1[ .-])?(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\.?\d|[/-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![ -]?\d)",
}
PATTERN = "|".join(PATTERNS.values())
DATES = {r"^\d{4}-": "yyyy-MM-dd", r"^\d{2}/": "MM/dd/yyyy", r"^\d{2}\.": "dd.MM.yyyy"}
FIRST_DAY, DAYS, DATE_RADIX = "1900-01-01", 73049, (271, 270)


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _shift(part: Column, radix: Column, other: Column, tweak: Column, number: Column) -> Column:
    stream = F.sha2(F.concat_ws("|", tweak, number.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ",")).cast("binary"), 512)
    return bind(stream, lambda s: F.transform(part, lambda x, j: F.pmod(x + F.conv(F.substring(s, F.pmod(j, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("long"), F.get(radix, j))))


def feistel(symbols: Column, radix: Column, tweak: Column) -> Column:
    """Permutation of arrays of symbols (long, 0 <= symbol < radix) under a key and tweak."""
    half = F.floor(F.size(symbols) / 2).cast("int")
    low, high = F.slice(radix, F.lit(1), half), F.slice(radix, half + 1, F.size(radix) - half)
    start = F.struct(F.slice(symbols, F.lit(1), half).alias("l"), F.slice(symbols, half + 1, F.size(symbols) - half).alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.struct(_shift(s["l"], low, s["r"], tweak, i).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), _shift(s["r"], high, s["l"], tweak, i).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def walked(symbols: Column, radix: Column, tweak: Column, valid: Callable[[Column], Column]) -> Column:
    """The first valid array of symbols that repeated application of the network reaches from a valid one."""
    again = lambda v, _: F.when(valid(v), v).otherwise(feistel(v, radix, tweak))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), feistel(symbols, radix, tweak), again)


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _longs(chars: Column) -> Column:
    return F.transform(chars, lambda c: c.cast("long"))


def _refill(value: Column, pattern: str, new: Column) -> Column:
    """`value` with its characters that match `pattern` replaced by the strings of `new` in turn."""
    def filled(chars: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(chars)), lambda i: F.element_at(chars, i).rlike(pattern))
        return bind(places, lambda p: bind(new, lambda n: F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(pattern), F.element_at(n, F.array_position(p, i + 1).cast("int"))).otherwise(c)), "")))

    return bind(_chars(value), filled)


def _strings(symbols: Column) -> Column:
    return F.transform(symbols, lambda x: x.cast("string"))


def luhn(digits: Column) -> Column:
    """Luhn sum of an array of digits."""
    n = F.size(digits)
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, double(d)).otherwise(d)), F.lit(0).cast("long"), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """Remainder by 97 of a string of digits and capitals (A = 10 ... Z = 35)."""
    add = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(text), F.lit(0).cast("long"), add)


def _same(radix: int, symbols: Column) -> Column:
    return F.transform(symbols, lambda _: F.lit(radix).cast("long"))


def _card(m: Column, tweak: Column) -> Column:
    """The first digit (the network) stays, the last is the check digit."""
    def new(d: Column) -> Column:
        body = F.slice(d, F.lit(2), F.size(d) - 2)
        return bind(F.concat(F.slice(d, 1, 1), feistel(body, _same(10, body), tweak)), lambda b: F.concat(b, F.array(F.pmod(-luhn(F.concat(b, F.array(F.lit(0).cast("long")))), F.lit(10)))))

    digits = _longs(_chars(F.regexp_replace(m, "[^0-9]", "")))
    return bind(digits, lambda d: F.when(luhn(d) % 10 == 0, _refill(m, "[0-9]", _strings(new(d)))))


def _code(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), F.ascii(c) - 48).when(c.rlike("[A-Z]"), F.ascii(c) - 65).otherwise(F.ascii(c) - 97).cast("long")


def _radix(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 10).otherwise(26).cast("long")


def _permuted(chars: Column, tweak: Column) -> Column:
    """Letters and digits, each permuted within its class, as strings."""
    def back(out: Column) -> Column:
        return F.transform(out, lambda x, i: bind(F.get(chars, i), lambda c: F.char((x + F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97)).cast("long"))))

    return bind(feistel(F.transform(chars, _code), F.transform(chars, _radix), tweak), back)


def _text(m: Column, kept: Column, tweak: Column) -> Column:
    """Letters and digits of m after its first `kept` characters are permuted within their class."""
    rest = F.substring(m, kept + 1, F.length(m) - kept)
    alnum = _chars(F.regexp_replace(rest, "[^A-Za-z0-9]", ""))
    return F.concat(F.substring(m, F.lit(1), kept), bind(alnum, lambda c: _refill(rest, "[A-Za-z0-9]", _permuted(c, tweak))))


def _email(m: Column, tweak: Column) -> Column:
    """The top-level domain stays."""
    top = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    return F.concat(_text(F.substring(m, F.lit(1), F.length(m) - F.length(top)), F.lit(0), tweak), top)


def _secret(m: Column, tweak: Column) -> Column:
    return _text(m, F.length(F.regexp_extract(m, r'^(?:AKIA|\w+ ?[=:] ?"?)', 0)), tweak)


def _iban(m: Column, tweak: Column) -> Column:
    def valid(s: Column) -> Column:
        bban = F.substring(s, F.lit(5), F.length(s))
        return F.when(mod97(F.concat(bban, F.substring(s, 1, 4))) == 1, bind(F.array_join(_permuted(_chars(bban), tweak), ""), lambda b: _refill(m, "[A-Z0-9]", _chars(F.concat(F.substring(s, 1, 2), F.lpad((98 - mod97(F.concat(b, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b)))))

    return bind(F.regexp_replace(m, " ", ""), valid)


def _phone(m: Column, tweak: Column) -> Column:
    """Ten digits; area code and exchange begin with 2-9."""
    radix = F.array(*[F.lit(8 if i in (0, 3) else 10).cast("long") for i in range(10)])
    base = F.array(*[F.lit(2 if i in (0, 3) else 0).cast("long") for i in range(10)])

    def new(d: Column) -> Column:
        tail = F.slice(d, F.size(d) - 9, F.lit(10))
        moved = F.zip_with(feistel(F.zip_with(tail, base, lambda x, y: x - y), radix, tweak), base, lambda x, y: x + y)
        return F.when((F.element_at(d, -10) >= 2) & (F.element_at(d, -7) >= 2), _refill(m, "[0-9]", _strings(F.concat(F.slice(d, F.lit(1), F.size(d) - 10), moved))))

    return bind(_longs(_chars(F.regexp_replace(m, "[^0-9]", ""))), new)


def _ssn_valid(v: Column) -> Column:
    at = lambda i: F.element_at(v, i)
    area = at(1) * 100 + at(2) * 10 + at(3)
    return (area > 0) & (area != 666) & (area < 900) & (at(4) + at(5) > 0) & (at(6) + at(7) + at(8) + at(9) > 0)


def _ssn(m: Column, tweak: Column) -> Column:
    digits = _longs(_chars(F.regexp_replace(m, "-", "")))
    return bind(digits, lambda d: F.when(_ssn_valid(d), _refill(m, "[0-9]", _strings(walked(d, _same(10, d), tweak, _ssn_valid)))))


def _date(m: Column, tweak: Column) -> Column:
    radix = F.array(*[F.lit(r).cast("long") for r in DATE_RADIX])
    number = lambda v: F.element_at(v, 1) * DATE_RADIX[1] + F.element_at(v, 2)
    first = F.lit(FIRST_DAY).cast("date")

    def as_form(form: str) -> Column:
        def new(day: Column) -> Column:
            symbols = F.array(F.floor(day / DATE_RADIX[1]).cast("long"), day % DATE_RADIX[1])
            moved = walked(symbols, radix, tweak, lambda v: number(v) < DAYS)
            return F.when((day >= 0) & (day < DAYS), F.date_format(F.date_add(first, number(moved).cast("int")), form))

        return bind(F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), first).cast("long"), new)

    out = F.lit(None).cast("string")
    for start, form in DATES.items():
        out = F.when(m.rlike(start), as_form(form)).otherwise(out)
    return out


def _ip(m: Column, tweak: Column) -> Column:
    return bind(_longs(F.split(m, r"\.")), lambda o: F.when(F.array_max(o) < 256, F.array_join(_strings(feistel(o, _same(256, o), tweak)), ".")))


KINDS = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "ssn": _ssn, "date": _date, "ip": _ip, "card": _card}


def pseudonym(match: Column, key: str = KEY) -> Column:
    """struct(kind, value, new) of a candidate; kind and new are null if it is invalid in all kinds."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), match.alias("value"), F.lit(None).cast("string").alias("new"))
    for kind in reversed(KINDS):
        new = KINDS[kind](match, F.lit(f"{key}|{kind}"))
        found = F.struct(F.lit(kind).alias("kind"), match.alias("value"), new.alias("new"))
        out = F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), found).otherwise(out)
    return out


def pseudonymise(documents: DataFrame, key: str = KEY) -> DataFrame:
    """All columns of documents with `text` pseudonymised, and found: array of (kind, value, new), n_values.

    Null and empty texts stay, with nothing found.  Every row is handled on its own, so repeated rows and ids
    do no harm.  Columns of the input named found or n_values are replaced.
    """
    keep = documents.drop("found", "n_values")
    hot = F.coalesce(F.col("text").rlike(r"[0-9@]|password|passwd|secret|token|api_key"), F.lit(False))
    matches = F.when(hot, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    done = keep.withColumn("__all", F.transform(matches, lambda m: pseudonym(m, key)))
    gaps = F.split("text", PATTERN)
    pieces = F.zip_with(gaps, F.col("__all"), lambda g, m: F.concat(g, F.coalesce(m["new"], m["value"], F.lit(""))))
    text = F.when(F.size("__all") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    found = F.filter("__all", lambda m: m["new"].isNotNull())
    return done.withColumn("text", text).withColumn("found", found).withColumn("n_values", F.size("found")).select(*keep.columns, "found", "n_values")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents")).select("doc_id", "n_values", F.transform("found", lambda f: f["kind"]).alias("kinds"), "text")
