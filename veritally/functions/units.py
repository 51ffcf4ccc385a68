"""Units and currencies: one table for all operators, longest name first."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Multiplier of a unit by a name that it contains, in order of precedence.
UNITS = (
    ("billion", 1e9), ("million", 1e6), ("thousand", 1e3),
    ("十亿元", 1e9), ("十億元", 1e9), ("百万元", 1e6), ("百萬元", 1e6),
    ("千元", 1e3), ("亿", 1e8), ("億", 1e8), ("万", 1e4), ("萬", 1e4),
)
#: Abbreviations, taken only if they are the whole unit.
SHORT = {"bn": 1e9, "m": 1e6, "mn": 1e6, "mm": 1e6, "k": 1e3, "000": 1e3}
#: Currencies by a name that the text contains, and units of each in Hong Kong dollars.
CURRENCIES = (
    ("hk$", "HKD"), ("hkd", "HKD"), ("港元", "HKD"), ("港币", "HKD"), ("us$", "USD"), ("usd", "USD"), ("美元", "USD"),
    ("rmb", "CNY"), ("cny", "CNY"), ("人民币", "CNY"), ("人民幣", "CNY"), ("yuan", "CNY"), ("元", "CNY"),
)
TO_HKD = {"HKD": 1.0, "CNY": 1.08, "USD": 7.80}
#: Share units of events.
SHARES = (("亿股", 1e8), ("万股", 1e4), ("million shares", 1e6), ("shares", 1.0), ("股", 1.0))
FIX = (1.0, 1e3, 1e4, 1e6, 1e8)


def _ordered(text: Column, table, default: Column) -> Column:
    out = default
    for name, value in reversed(table):
        out = F.when(text.contains(name), F.lit(value)).otherwise(out)
    return out


def multiplier(unit: Column) -> Column:
    """Multiplier to the base unit; null or unknown units count 1."""
    low = F.lower(F.trim(unit))
    out = _ordered(low, UNITS, F.lit(1.0))
    for name, value in SHORT.items():
        out = F.when(low == name, F.lit(value)).otherwise(out)
    return F.when(unit.isNull(), F.lit(1.0)).otherwise(out)


def event_multiplier(unit: Column) -> Column:
    """As multiplier, share units included."""
    low = F.lower(F.trim(unit))
    return _ordered(low, SHARES, multiplier(unit))


def normalised(value: Column, unit: Column) -> Column:
    return value * multiplier(unit)


def currency(text: Column) -> Column:
    return _ordered(F.lower(text), CURRENCIES, F.lit(None).cast("string"))


def in_hkd(value: Column, code: Column) -> Column:
    rate = F.lit(None).cast("double")
    for k, v in TO_HKD.items():
        rate = F.when(code == k, F.lit(v)).otherwise(rate)
    return value * rate


def unit_fix_ratio(a: Column, h: Column) -> Column:
    """Least relative difference of a and h over all pairs of FIX multipliers (only their quotient matters)."""
    quotients = sorted({x / y for x in FIX for y in FIX})
    return F.least(*[relative_delta(a * q, h) for q in quotients])


def relative_delta(a: Column, h: Column) -> Column:
    return F.abs(a - h) / F.greatest(F.abs(a), F.abs(h), F.lit(1e-9))
