"""Numbers in text: parsing, and finding those that belong to a label.  All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_FULL_OPEN, _FULL_CLOSE = "（", "）"
_NUMBER = r"[-+]?\d+(?:\.\d+)?"
#: Amounts as printed: thousands separators, decimals, a sign or brackets, and a percent sign to recognise rates.
TOKEN = r"[(（-]?\d[\d,]*(?:\.\d+)?[)）]?%?"
_SPACE = " \t\n\x0b\f\r"
_EMPTY = ("", "-", "--", "—", "–", "n/a", "na", "nil", "none", "/")


def _signed(text: Column) -> tuple[Column, Column]:
    """(digits as text, whether in brackets)."""
    bare = F.translate(F.trim(text), _SPACE + ",'　，", "")
    bracket = bare.rlike(rf"^[(（].*[)）]%?$")
    return F.translate(bare, "()（）", ""), bracket


def parse_number(text: Column) -> Column:
    """Double at the start of the text; brackets (ASCII or full width) are negative; dashes and N/A are null."""
    digits, negative = _signed(text)
    value = F.regexp_extract(digits, rf"^({_NUMBER})", 1).try_cast("double")
    return F.when(F.lower(F.trim(text)).isin(*_EMPTY), None).when(negative, -value).otherwise(value)


def parse_number_anywhere(text: Column) -> Column:
    """As parse_number but the first number anywhere; null beyond 15 digits or 1e15."""
    digits, negative = _signed(text)
    found = F.regexp_extract(digits, rf"({_NUMBER})", 1)
    value = found.try_cast("double")
    fits = (F.length(F.regexp_replace(found, r"\D", "")) <= 15) & (F.abs(value) <= 1e15)
    return F.when(~F.lower(F.trim(text)).isin(*_EMPTY) & fits, F.when(negative, -value).otherwise(value))


def parse_chart_number(text: Column) -> Column:
    """First number anywhere, percent signs dropped, without guards."""
    return F.regexp_extract(F.translate(text, _SPACE + ",%", ""), rf"({_NUMBER})", 1).try_cast("double")


def tokens(text: Column) -> Column:
    """All printed numbers of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def _read(text: Column) -> Column:
    """All printed numbers of a text as array<struct<raw, value, size: its amount>>, each parsed once however many tests read it."""
    parsed = F.transform(tokens(text), lambda t: F.struct(t.alias("raw"), parse_number(t).alias("value")))
    return F.transform(parsed, lambda t: F.struct(t["raw"].alias("raw"), t["value"].alias("value"), F.abs(t["value"]).alias("size")))


def _is_year(t: Column) -> Column:
    """A printed number of 1990 to 2035 without decimals: 2,012.00 is an amount."""
    return (t["size"] >= 1990) & (t["size"] <= 2035) & (t["size"] == F.floor(t["size"])) & ~t["raw"].contains(".")


def first_financial_number(text: Column, least: float = 1000.0) -> Column:
    """First number with a separator or |x| >= least that is no rate, year or small count; else the first number of all."""
    all_ = _read(text)
    good = F.filter(all_, lambda t: ~t["raw"].endswith("%") & ~_is_year(t) & ~((t["size"] <= 50) & ~t["raw"].contains(".")) & (t["raw"].contains(",") | (t["size"] >= least)))
    return F.coalesce(F.get(good, F.lit(0)), F.get(all_, F.lit(0)))["value"]


def first_number_of_row(cells: Column) -> Column:
    """First cell that reads as a number with a separator or |x| >= 1000."""
    good = F.filter(cells, lambda t: t.contains(",") & parse_number(t).isNotNull() | (F.abs(parse_number(t)) >= 1000))
    return parse_number(F.get(good, F.lit(0)))


def number_near_label(text: Column, label: Column, width: int = 40) -> Column:
    """Number in the `width` characters after a label, else before it; years, note numbers and rates are passed over."""
    at = F.instr(text, label)
    after = F.substring(text, at + F.length(label), F.lit(width))
    before = F.when(at > 1, F.substring(text, F.greatest(at - width, F.lit(1)), F.least(at - 1, F.lit(width))))
    pick = lambda s: F.filter(_read(s), lambda t: ~t["raw"].endswith("%") & ~_is_year(t) & ~((t["size"] < 50) & ~t["raw"].contains(",") & ~t["raw"].contains(".")))
    return F.when(at > 0, F.coalesce(F.get(pick(after), F.lit(0))["value"], F.get(F.reverse(pick(before)), F.lit(0))["value"]))


def closest_number_near_label(text: Column, label: Column, target: Column, width: int = 30) -> Column:
    """The number around a label nearest to a target if its ratio to it is in [.95, 1.05] or [95, 105]."""
    at = F.instr(text, label)
    around = F.substring(text, F.greatest(at - width, F.lit(1)), F.length(label) + 2 * width)
    values = F.filter(F.transform(tokens(around), parse_number), lambda v: (v / target).between(0.95, 1.05) | (v / target).between(95, 105))
    return F.when(at > 0, F.get(F.transform(F.array_sort(F.transform(values, lambda v: F.struct(F.abs(v - target).alias("d"), v.alias("v")))), lambda s: s["v"]), F.lit(0)))


def overlay_value(text: Column) -> Column:
    """Value of a printed word on a page: brackets and sign, separators dropped; null if other characters remain."""
    digits, negative = _signed(text)
    value = F.when(digits.rlike(r"^[-+]?\d+(\.\d+)?%?$"), F.regexp_replace(digits, "%", "")).try_cast("double")
    return F.when(negative, -value).otherwise(value)


def percentages(text: Column) -> Column:
    """All rates of a text, as array of double."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?) ?%"), F.lit(1)), lambda x: x.try_cast("double"))
