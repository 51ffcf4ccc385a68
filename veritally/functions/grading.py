"""Severity, triage and the two comparison ladders, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .units import multiplier, relative_delta, unit_fix_ratio

RANKS = ("info", "low", "medium", "high", "critical")
PER_SHARE = ("eps_basic", "eps_diluted", "basic_eps", "diluted_eps")
#: What the mean confidence and the likeness of the values can add to the score of a pair.
CONFIDENCE, VALUE = 0.20, 0.08


def grade(ratio: Column, bands: tuple[float, float, float] = (0.01, 0.05, 0.20), names: tuple[str, ...] = RANKS[1:]) -> Column:
    """Severity by relative difference: below 1, 5, 20 per cent, and beyond."""
    return F.when(ratio < bands[0], names[0]).when(ratio < bands[1], names[1]).when(ratio < bands[2], names[2]).otherwise(names[3])


def internal_grade(ratio: Column) -> Column:
    """One step lower: contradictions within one report."""
    return grade(ratio, names=RANKS[:4])


def branch_grade(percent: Column) -> Column:
    return F.when(percent > 50, "high").when(percent > 20, "medium").when(percent > 5, "low").otherwise("info")


def exact_grade(ratio: Column) -> Column:
    return F.when(ratio <= 0.005, "medium").otherwise("high")


def rank(severity: Column) -> Column:
    """critical 4 to info 0; unknown -1."""
    out = F.lit(-1)
    for i, name in enumerate(RANKS):
        out = F.when(severity == name, i).otherwise(out)
    return out


def demoted(severity: Column, steps: int = 1) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in RANKS]), F.greatest(rank(severity) - steps, F.lit(0)) + 1)


def triage(expected: Column, unresolved: Column) -> Column:
    return F.when(expected, "expected").when(unresolved, "unresolved").otherwise("real")


def triaged(severity: Column, state: Column) -> Column:
    """Expected differences are info; unresolved ones are medium at most."""
    return F.when(state == "expected", "info").when((state == "unresolved") & severity.isin("high", "critical"), "medium").otherwise(severity)


def within_tolerance(a: Column, h: Column, key: Column) -> Column:
    """Per-share values: the larger of .01 and half a per cent; others: the larger of 1 and one per cent."""
    base, delta = F.greatest(F.abs(a), F.abs(h), F.lit(1.0)), F.abs(a - h)
    per_share = key.startswith("eps") | key.isin(*PER_SHARE)
    return F.when(per_share, delta <= F.greatest(F.lit(0.01), base * 0.005)).otherwise(delta <= F.greatest(F.lit(1.0), base * 0.01))


def non_monetary(value: Column) -> Column:
    """Years 1990 to 2035 and small counts; per-share keys are exempted by the caller."""
    return value.between(1990, 2035) | ((F.abs(value) > 0) & (F.abs(value) < 50))


def pair_check(a: Column, h: Column, a_unit: Column, h_unit: Column, tolerance: Column) -> Column:
    """struct(kind, severity, triage): match, unit_fix, unit_conversion, rounding or mismatch."""
    am, hm = multiplier(a_unit), multiplier(h_unit)
    ratio, delta = relative_delta(a * am, h * hm), F.abs(a * am - h * hm)
    kind = (
        F.when(a.isNull() | h.isNull(), None)
        .when(delta <= tolerance, "match")
        .when((ratio > 0.5) & (unit_fix_ratio(a, h) <= 0.02), "unit_fix")
        .when((am != hm) & (ratio <= 0.02), "unit_conversion")
        .when((am == hm) & (ratio <= 0.01), "rounding")
        .otherwise("mismatch")
    )
    severity = F.when(kind == "mismatch", grade(ratio)).when(kind != "match", "info")
    state = F.when(kind == "mismatch", "real").when(kind != "match", "expected")
    return F.struct(kind.alias("kind"), severity.alias("severity"), state.alias("triage"))


def match_kind(a: Column, h: Column, a_unit: Column, h_unit: Column, tolerance: Column, factor: Column) -> Column:
    """How two values agree: direct, unit_conversion, unit_fix, rounding, currency_conversion, or null."""
    return agreement(a, h, multiplier(a_unit), multiplier(h_unit), tolerance, factor)


def agreement(a: Column, h: Column, am: Column, hm: Column, tolerance: Column, factor: Column) -> Column:
    """match_kind by the multipliers of the units."""
    ratio = relative_delta(a * am, h * hm)
    return (
        F.when(F.abs(a * am - h * hm) <= tolerance * am, "direct")
        .when(ratio <= 0.005, "direct")
        .when((am != hm) & (ratio <= 0.02), "unit_conversion")
        .when(unit_fix_ratio(a, h) <= 0.02, "unit_fix")
        .when(ratio <= 0.01, "rounding")
        .when(relative_delta(a * am, h * hm * factor) <= 0.05, "currency_conversion")
    )


def pair_score(context: Column, label: Column, confidence: Column, period: Column, source: Column, ratio: Column) -> Column:
    value = F.greatest(F.lit(0.0), 1 - F.least(ratio, F.lit(1.0)))
    return 0.28 * context + 0.24 * label + CONFIDENCE * confidence + 0.12 * period + 0.08 * source + VALUE * value


def same_scope(context: Column, confidence: Column, label: Column, period: Column, source: Column, score: Column) -> Column:
    """The six thresholds of a pair that is sure enough to be called a real difference."""
    return context & (confidence >= 0.88) & (label >= 0.62) & (period >= 0.5) & (source >= 0.5) & (score >= 0.72)


def explanation(label: Column, a: Column, h: Column) -> Column:
    """Presentation struct of a difference."""
    money = lambda v: F.format_number(v, 2)
    return F.struct(F.concat(label, F.lit(": "), money(a), F.lit(" vs "), money(h)).alias("headline"), F.abs(a - h).alias("delta"), F.round(relative_delta(a, h) * 100, 2).alias("percent"))


def alignment_confidence(score: Column, same_section: Column, same_signature: Column, has_facts: Column, glossary_jaccard: Column) -> Column:
    """A tenth of the score, .95 at most; .75 for a section, .85 for a signature; .15 less if signatures differ; .7 by glossary."""
    base = F.least(score / 10, F.lit(0.95))
    return F.when(same_signature, F.greatest(base, F.lit(0.85))).when(~has_facts & (glossary_jaccard >= 0.6), F.greatest(base, F.lit(0.7))).when(same_section, F.greatest(base, F.lit(0.75))).otherwise(base - 0.15)


def mismatch_labels(tests: dict[str, Column]) -> Column:
    """Names of the fact families whose test is true, as array."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def unmatched_paragraph(text: Column) -> Column:
    """Severity of a paragraph without a partner: info if material, else null."""
    from .predicates import material

    return F.when(material(text), "info")
