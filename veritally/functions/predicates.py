"""Filters and gates as Column predicates, and the buckets that they compare."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text, units
from .grading import PER_SHARE

#: Keys that every report must have.
CORE_KEYS = ("total_assets", "total_liabilities", "equity", "total_equity", "revenue", "net_profit", "total_profit", "operating_profit", "cash_equivalents", "operating_cash_flow", *PER_SHARE)
#: Context of a metric by a word of its section or snippet, in order.
CONTEXTS = (("quarter", "quarterly"), ("parent company", "parent"), ("segment", "segment"), ("subsidiar", "subsidiary"), ("highlights", "highlights"), ("balance sheet", "main"), ("income statement", "main"), ("cash flow", "main"), ("note", "notes"))
#: Role of a value by a word around it, in order; without any it is the main value.
VALUE_ROLES = (("note", "note_ref"), ("prior", "prior_period"), ("previous", "prior_period"), ("last year", "prior_period"), ("increase", "change"), ("decrease", "change"), ("growth", "change"), ("ratio", "ratio"), ("per cent", "ratio"), ("matur", "maturity"))


def _first(low: Column, table, default: str) -> Column:
    out = F.lit(default)
    for word, code in reversed(table):
        out = F.when(low.contains(word), code).otherwise(out)
    return out


def context_bucket(section: Column, snippet: Column) -> Column:
    return _first(F.lower(F.concat_ws(" ", section, snippet)), CONTEXTS, "unknown")


def value_role(snippet: Column) -> Column:
    return _first(F.lower(F.coalesce(snippet, F.lit(""))), VALUE_ROLES, "main")


def candidate(value: Column, confidence: Column, key: Column, context: Column) -> Column:
    """A value, confidence of .65 and a readable key in a context that can be compared."""
    return value.isNotNull() & (confidence >= 0.65) & ~text.garbled_key(key) & ~context.isin("segment", "subsidiary", "parent")


def comparison_item(known: Column, confidence: Column, source: Column) -> Column:
    """Known keys, others only from tables with confidence .9."""
    return known | ((confidence >= 0.9) & (source == "table"))


def key_metric(key: Column, value: Column, confidence: Column, keys: tuple[str, ...] = CORE_KEYS) -> Column:
    return key.isin(*keys) & value.isNotNull() & (confidence >= 0.6)


def contexts_compatible(a: Column, h: Column) -> Column:
    """One bucket but not unknown, or main and highlights; quarterly never with annual."""
    main = ("main", "highlights")
    return ((a == h) & (a != "unknown")) | (a.isin(*main) & h.isin(*main))


def same_scope_exact(a_scope: Column, h_scope: Column, a_period: Column, h_period: Column, a_role: Column, h_role: Column) -> Column:
    return (a_scope == h_scope) & (a_period.isNull() | h_period.isNull() | (a_period == h_period)) & (a_role == "main") & (h_role == "main")


def internally_comparable(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Equal period, currency, unit and scope, both main values."""
    out = (a["role"] == "main") & (b["role"] == "main")
    for c in ("period", "currency", "unit", "scope"):
        out = out & a[c].eqNullSafe(b[c])
    return out


def event_signal(fragment: Column, signals: tuple[str, ...], least: int = 1) -> Column:
    """Enough signal words, and not mostly digits."""
    hits = sum((F.lower(fragment).contains(s).cast("int") for s in signals), F.lit(0))
    return (hits >= least) & (text.share_of(fragment, r"\d") <= 0.4)


def real_mismatch(confidence: Column, anchored: Column, role_equal: Column, magnitude_ok: Column) -> Column:
    return (confidence >= 0.65) & anchored & role_equal & magnitude_ok


def anchored(a_signature: Column, h_signature: Column, topic: Column) -> Column:
    """The signatures share a term; bonds need one that is more than a year."""
    common = F.array_intersect(a_signature, h_signature)
    strong = F.size(F.filter(common, lambda t: ~t.rlike(r"^(19|20)\d{2}$"))) > 0
    return F.when(topic == "bond", strong).otherwise(F.size(common) > 0)


def magnitude_mismatch(a: Column, h: Column, kind: Column) -> Column:
    """Shares: ratio under .1 and over 1e6 apart; amounts: under .05 and over 1e9."""
    ratio, delta = F.try_divide(F.least(F.abs(a), F.abs(h)), F.greatest(F.abs(a), F.abs(h))), F.abs(a - h)
    return F.when(kind == "shares", (ratio < 0.1) & (delta > 1e6)).otherwise((ratio < 0.05) & (delta > 1e9))


def branch_evidence(snippet: Column, name: Column, count: Column, asset: Column) -> Column:
    bare = F.regexp_replace(snippet, ",", "")
    return snippet.contains(name) & bare.contains(count.cast("string")) & bare.contains(asset.cast("long").cast("string"))


def material(paragraph: Column, least: int = 100) -> Column:
    """Long enough, with a number or a letter run, and no page mark."""
    return (F.length(F.trim(paragraph)) >= least) & paragraph.rlike(r"[A-Za-z一-鿿]{2}") & ~text.junk_label(F.substring(paragraph, 1, 40))


def shared_entity(a: Column, b: Column) -> Column:
    """Arrays of numberings, amount prefixes, dates and glossary keys have one in common."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def values_match(a: Column, h: Column, a_currency: Column, h_currency: Column) -> Column:
    """Within 1e-4, or across currencies within 1 % in Hong Kong dollars."""
    across = units.relative_delta(units.in_hkd(a, a_currency), units.in_hkd(h, h_currency)) <= 0.01
    return (units.relative_delta(a, h) <= 1e-4) | F.coalesce((a_currency != h_currency) & across, F.lit(False))


def sets_overlap(a: Column, h: Column, kind: Column) -> Column:
    """Some pair of values within 1 %; shares must be equal."""
    near = F.exists(a, lambda x: F.exists(h, lambda y: units.relative_delta(x, y) <= 0.01))
    return F.when(kind == "shares", F.arrays_overlap(a, h)).otherwise(near)
