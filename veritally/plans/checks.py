"""The end-to-end checks, over tables of many pairs of reports at once (every table carries pair_id).

metric_items: pair_id, side, seq, canonical_key, value, unit, currency, period, page, context, confidence, source.
All checks return diffs: pair_id, diff_id, diff_type, severity, triage, canonical_key, a_value, h_value, evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import grading, predicates, text, units
from ..operators import aggregates, events as event_rules, joins, matching, nearest, retrieval, spatial, terms
from ..sources.shared import cut, wide

DIFF = ("pair_id", "diff_id", "diff_type", "severity", "triage", "canonical_key", "a_value", "h_value", "evidence")


def _diff(df: DataFrame, kind: str, key: Column, a: Column, h: Column, severity: Column, triage: Column, *evidence: Column, apart: tuple[Column, ...] = ()) -> DataFrame:
    """apart: what else tells two differences apart (a period, a scope) besides pair, key, values and evidence."""
    ev = F.array_compact(F.array(*evidence)) if evidence else F.array().cast("array<string>")
    return df.select("pair_id", text.stable_id(f"{kind}-", F.col("pair_id"), key, a, h, *evidence, *apart).alias("diff_id"), F.lit(kind).alias("diff_type"), severity.alias("severity"), triage.alias("triage"), key.alias("canonical_key"), a.cast("double").alias("a_value"), h.cast("double").alias("h_value"), ev.alias("evidence"))


def _kinds(items: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Items as far as scores can tell them apart, once each with their least seq: pair_id, canonical_key, side, kind, confidence, norm, value, unit, seq, page.

    kind(context, name, hit, period, table): name falls back to the key; hit: name or text hold a term of the key (the
    glossary's forms, and the key itself).
    """
    for c in ("name", "text"):
        if c not in items.columns:
            items = items.withColumn(c, F.lit(None).cast("string"))
    key = F.array(F.lower("canonical_key"))
    if glossary is not None:
        forms = glossary.groupBy("canonical_key").agg(F.collect_set(F.lower("form")).alias("__forms"))
        items = items.join(forms, "canonical_key", "left")
        key = F.concat(key, F.coalesce("__forms", F.array().cast("array<string>")))
    held = F.exists(F.filter(key, lambda t: F.length(t) >= 2), lambda t: F.coalesce(F.lower(F.concat_ws(" ", "name", "text")).contains(t), F.lit(False)))
    name = F.lower(F.trim(F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.col("canonical_key"))))
    kind = F.struct("context", name.alias("name"), held.alias("hit"), "period", F.coalesce(F.col("source") == "table", F.lit(False)).alias("table"))
    named = items.where(F.col("side").isin("A", "H")).select("pair_id", "canonical_key", "side", kind.alias("kind"), "confidence", units.normalised(F.col("value"), F.col("unit")).alias("norm"), "value", "unit", "seq", "page")
    return named.groupBy("pair_id", "canonical_key", "side", "kind", "confidence", "norm", "value", "unit").agg(F.min(F.struct("seq", "page")).alias("first")).select("*", "first.seq", "first.page").drop("first")


def labelled(kinds: DataFrame) -> DataFrame:
    """Adds label to pairs of kinds: likeness of the names, .92 at least if both hold a term of the key, .72 if one does, .62 else.

    Names repeat, so the ratio is worked out once for each two of them.
    """
    named = kinds.withColumn("__x", F.col("a_kind.name")).withColumn("__y", F.col("h_kind.name"))
    ratios = named.select("__x", "__y").distinct().withColumn("__seq", matching.sequence_ratio("__x", "__y"))
    hits = F.col("a_kind.hit").cast("int") + F.col("h_kind.hit").cast("int")
    least = F.when(hits == 2, 0.92).when(hits == 1, 0.72).otherwise(0.62)
    return named.join(ratios, ["__x", "__y"]).withColumn("label", F.greatest("__seq", least)).drop("__x", "__y", "__seq")


def _scope(a: str, h: str) -> tuple[Column, Column, Column]:
    """Context, period and source of two kinds."""
    of = lambda c: (F.col(f"{a}.{c}"), F.col(f"{h}.{c}"))
    (ac, hc), (ap, hp), (at, ht) = of("context"), of("period"), of("table")
    period = F.when(ap.isNull() | hp.isNull(), 0.8).when(ap == hp, 1.0).otherwise(0.0)
    return (ac == hc) & (ac != "unknown"), period, F.when(at, 0.5).otherwise(0.25) + F.when(ht, 0.5).otherwise(0.25)


def _scored(a_confidence: Column, h_confidence: Column, ratio: Column) -> Column:
    context, period, source = _scope("a_kind", "h_kind")
    return grading.pair_score(context.cast("int"), F.col("label"), (a_confidence + h_confidence) / 2, period, source, ratio)


#: How far below the best confidence those items go that are tried for a first bound.
LEVELS = (0.0, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0)


def _place(value: Column, scale: float) -> Column:
    """Where a value lies: places are as far apart as the logarithms, or (below 1 / scale) as the values."""
    return F.signum(value) * F.asinh(F.abs(value) * scale)


def _best(one: DataFrame) -> DataFrame:
    """The pair of the highest score for each key, then of the least a_seq, h_seq: no pairs are made that cannot be it.

    A score is a sum over two kinds, two confidences and the ratio of two values.  The kinds of a key give bounds from
    above.  From below: their first items, and neighbours by value among the surest items of the best two kinds.  What can
    reach that, by spans of values and then each, meets by value, as close as it must be; if values add nothing, the first of the surest items are best.
    """
    key = ["pair_id", "canonical_key"]
    item = ("confidence", "norm", "seq", "page")
    side = lambda df, s, *cols: df.where(F.col("side") == s).select(*key, *[F.col(c).alias(f"{s.lower()}_{c}") for c in cols])
    down = F.coalesce(-F.col("confidence"), F.lit(float("inf")))
    kinds = one.groupBy(*key, "side", "kind").agg(F.min(F.struct(down.alias("down"), "seq", *[c for c in item if c != "seq"])).alias("r"), F.count("*").alias("n")).select(*key, "side", "kind", "n", *[F.col(f"r.{c}").alias(c) for c in item])
    met = labelled(side(kinds, "A", "kind", "n", *item).join(side(kinds, "H", "kind", "n", *item), key))
    ac, hc = F.col("a_confidence"), F.col("h_confidence")
    ratio = units.relative_delta(F.col("a_norm"), F.col("h_norm"))
    pairs = cut(met.withColumn("bound", _scored(ac, hc, F.lit(0.0))).withColumn("score", _scored(ac, hc, ratio)), "kinds")
    lead = pairs.where("bound IS NOT NULL").groupBy(*key).agg(F.max(F.struct("bound", F.least("a_n", "h_n").alias("n"), "a_kind", "h_kind", "label", ac.alias("a_top"), hc.alias("h_top"))).alias("l"), F.max("score").alias("floor")).select(*key, "l.a_kind", "l.h_kind", "l.label", "l.a_top", "l.h_top", "floor")
    mine = F.col("side") == "A"
    deep = F.when(mine, F.col("a_top")).otherwise(F.col("h_top")) - F.col("confidence")
    tried = one.join(lead, key).where(F.when(mine, F.col("kind") == F.col("a_kind")).otherwise(F.col("kind") == F.col("h_kind"))).withColumn("level", F.explode(F.filter(F.array(*[F.lit(x) for x in LEVELS]), lambda x: deep <= x)))
    before = lambda c: F.lag(c).over(Window.partitionBy(*key, "level").orderBy("norm", "side"))
    beside = tried.withColumn("__side", before("side")).withColumn("__c", before("confidence")).withColumn("__v", before("norm")).where(F.col("__side") != F.col("side"))
    reached = beside.groupBy(*key).agg(F.max(_scored(F.col("confidence"), F.col("__c"), units.relative_delta(F.col("norm"), F.col("__v")))).alias("reached"))
    floors = lead.join(reached, key, "left").select(*key, (F.greatest("floor", "reached") - 1e-13).alias("floor"))
    hopeful = cut(pairs.join(floors, key).where("bound >= floor").select(*key, "a_kind", "h_kind", "label", ac.alias("a_top"), hc.alias("h_top"), "bound", "floor"), "hopeful")
    most = F.least((F.col("bound") - F.col("floor")) / grading.VALUE, F.lit(1.0))
    wide = F.when(most > 0.999, 12).otherwise(F.ceil(F.log2(F.greatest(-F.log(1 - F.least(most, F.lit(0.999))) * (1 + 1e-6), F.lit(1e-12))))).cast("int")
    cell = F.floor(_place(F.col("norm"), 1e9) / F.pow(F.lit(2.0), F.col("wide"))).cast("long")
    kinds_of = [*key, "a_kind", "h_kind"]

    def able(s: str) -> DataFrame:
        p = s.lower()
        rows = one.where(F.col("side") == s).where("abs(norm) < double('Infinity')").withColumnRenamed("kind", f"{p}_kind").join(hopeful, [*key, f"{p}_kind"])
        rows = rows.where(F.col("bound") - grading.CONFIDENCE / 2 * (F.col(f"{p}_top") - F.col("confidence")) >= F.col("floor"))
        return rows.withColumn(f"{p}_span", F.floor(_place(F.col("norm"), 1e9) * 2).cast("long"))

    spans = lambda s: able(s.upper()).groupBy(*kinds_of, f"{s}_span").agg(F.max("confidence").alias(f"{s}_most"), F.min("norm").alias(f"{s}_lo"), F.max("norm").alias(f"{s}_hi"))
    lo, hi = F.least("a_hi", "h_hi"), F.greatest("a_lo", "h_lo")  # the nearest two, unless the spans overlap
    apart = F.when(lo < hi, units.relative_delta(lo, hi)).otherwise(0.0)
    surest = F.col("bound") - grading.CONFIDENCE / 2 * (F.col("a_top") - F.col("a_most") + F.col("h_top") - F.col("h_most"))
    spanned = hopeful.join(spans("a"), kinds_of).join(spans("h"), kinds_of).withColumn("apart", grading.VALUE * apart).withColumn("bound", surest).where("bound - apart >= floor")
    spanned = cut(spanned.select(*kinds_of, "a_span", "h_span", "label", "a_most", "h_most", "bound", "apart", "floor", wide.alias("wide")), "spans")

    def sure(s: str) -> DataFrame:
        p = s.lower()
        rows = able(s).select(*kinds_of, f"{p}_span", *item).join(spanned, [*kinds_of, f"{p}_span"])
        rows = rows.where(F.col("bound") - F.col("apart") - grading.CONFIDENCE / 2 * (F.col(f"{p}_most") - F.col("confidence")) >= F.col("floor"))
        near = F.explode(F.array(cell - 1, cell, cell + 1)) if s == "A" else cell
        return rows.withColumn("cell", near).select(*kinds_of, "a_span", "h_span", "cell", *[F.col(c).alias(f"{p}_{c}") for c in item], *(["label", "floor"] if s == "A" else []))

    close = sure("A").join(sure("H"), [*kinds_of, "a_span", "h_span", "cell"]).where(_scored(ac, hc, ratio) >= F.col("floor"))
    firsts = one.groupBy(*key, "side").agg(F.min(F.struct("seq", "kind", *[c for c in item if c != "seq"])).alias("r")).select(*key, "side", "r.*")
    any_ = side(firsts, "A", "kind", *item).join(side(firsts, "H", "kind", *item), key)  # for keys without any score
    kept = [*key, "a_kind", "h_kind", "label", *[f"{p}_{c}" for p in "ah" for c in item]]
    first = pairs.join(floors, key).where("score >= floor").select(kept)
    rest = any_.join(pairs.select(*key, "a_kind", "h_kind", "label"), [*key, "a_kind", "h_kind"]).select(kept)
    all_ = close.select(kept).unionByName(first).unionByName(rest)
    context, period, source = _scope("a_kind", "h_kind")
    told = all_.withColumn("score", _scored(ac, hc, ratio)).withColumn("sure", grading.same_scope(context, (ac + hc) / 2, F.col("label"), period, source, F.col("score")))
    return aggregates.pick(told, key, [F.col("score").desc(), F.col("a_seq"), F.col("h_seq")])


def _agreed(one: DataFrame, ruled: DataFrame) -> DataFrame:
    """Keys of ruled(pair_id, canonical_key, tolerance, factor) of which some two values of one context agree somehow: pair_id, canonical_key.

    Values in one cell of half a per cent agree.  Elsewhere the ends of the cells stand for what lies between: each meets,
    as it is, by every unit fix and by the factor, the values next to it among those of a unit on the other side.
    """
    key = ["pair_id", "canonical_key"]
    where = [*key, "context"]
    times = units.multiplier(F.col("unit"))
    told = one.where("kind.context <> 'unknown' AND abs(norm) < double('Infinity')").join(ruled, key).select(*where[:2], F.col("kind.context").alias("context"), "side", times.alias("times"), "value", "norm", "tolerance", "factor")
    fine = F.floor(_place(F.col("norm"), 1e20) / 0.005).cast("long")
    within = F.when(F.col("tolerance") > 0, F.floor(F.col("norm") * 2 / (F.col("tolerance") * F.when(F.col("side") == "A", F.col("times")).otherwise(1.0))))
    ends = cut(told.groupBy(*where, "side", "times", "tolerance", "factor", fine.alias("fine"), within.alias("within")).agg(F.min("value").alias("lo"), F.max("value").alias("hi")), "ends")
    same = ends.groupBy(*where, "fine").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select(*key).distinct()
    left = ends.join(same, key, "left_anti").withColumn("value", F.explode(F.array_distinct(F.array("lo", "hi"))))
    h = left.where("side = 'H'").select(*where, F.col("times").alias("h_times"), (F.col("value") * F.col("times")).alias("at"), F.struct("value", "times").alias("h"))
    classes = h.groupBy(*where).agg(F.collect_set("h_times").alias("classes"))
    norm = F.col("value") * F.col("times")
    fixes = F.array(*[F.lit(q) for q in sorted({x / y for x in units.FIX for y in units.FIX})])
    probes = F.array_compact(F.concat(F.array(norm, norm / F.col("factor")), F.transform(fixes, lambda q: F.col("value") * q * F.col("h_times"))))
    a = left.where("side = 'A'").join(classes, where).withColumn("h_times", F.explode("classes")).withColumn("at", F.explode(probes)).select(*where, "h_times", "at", F.struct("value", "times", "tolerance", "factor").alias("a"))
    both = h.unionByName(a, allowMissingColumns=True).withColumn("__a", F.col("a").isNotNull())
    by = lambda at: F.last("h", ignorenulls=True).over(Window.partitionBy(*where, "h_times").orderBy(at, "__a").rowsBetween(Window.unboundedPreceding, 0))
    beside = both.withColumn("below", by(F.col("at"))).withColumn("above", by(F.col("at").desc())).where("__a")
    met = beside.select(*key, "a", F.explode(F.array_distinct(F.array_compact(F.array("below", "above")))).alias("h")).select(*key, "a.*", F.col("h.value").alias("h_value"), F.col("h.times").alias("h_times"))
    met = met.where(grading.agreement(F.col("value"), F.col("h_value"), F.col("times"), F.col("h_times"), F.col("tolerance"), F.col("factor")).isNotNull())
    return same.unionByName(met.select(*key)).distinct()


def numeric(items: DataFrame, rules: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Many-to-many scores for each key; a key of which any two values agree somehow is silent, else the best pair is graded.

    A pair below the six thresholds of one scope is unresolved.  Per-share keys are never taken for counts.  Items may
    have a name and a text, which the label score compares.  The pairs of a key are not made: see _best and _agreed.
    """
    per_share = F.col("canonical_key").startswith("eps") | F.col("canonical_key").isin(*grading.PER_SHARE)
    usable = items.where(F.col("value").isNotNull() & (per_share | ~grading.non_monetary(F.col("value"))))
    one = cut(_kinds(usable, glossary), "items")
    best = cut(_best(one), "best")
    factor = aggregates.currency_factor(best, ["pair_id"]).select("pair_id", "factor")
    ruled = joins.first_rule(best.select("pair_id", "canonical_key").join(factor, "pair_id", "left"), rules, "canonical_key").select("pair_id", "canonical_key", "tolerance", "factor")
    open_ = best.join(_agreed(one, ruled), ["pair_id", "canonical_key"], "left_anti")
    state = grading.triage(F.lit(False), ~F.col("sure"))
    graded = grading.triaged(grading.grade(units.relative_delta(F.col("a_norm"), F.col("h_norm"))), state)
    return _diff(open_, "numeric", F.col("canonical_key"), F.col("a_norm"), F.col("h_norm"), graded, state, F.concat(F.lit("A:"), F.col("a_page").cast("string")), F.concat(F.lit("H:"), F.col("h_page").cast("string")))


def disclosure(items: DataFrame) -> DataFrame:
    """Contradictions within one side: equal key, period, unit and context, different values."""
    keyed = items.where("value IS NOT NULL").withColumn("group", F.struct("pair_id", "side", "canonical_key", F.coalesce("period", F.lit("")).alias("period"), F.coalesce("unit", F.lit("")).alias("unit"), "context"))
    pairs = joins.internal_pairs(keyed, "group", "seq", "value", "page").select("group.pair_id", "group.side", "group.canonical_key", "group.period", "group.unit", "group.context", "i", "j", "left_value", "right_value", "left_page", "right_page", "severity")
    state = F.when(F.col("side") == "H", "unresolved").otherwise("real")
    return _diff(pairs, "internal", F.col("canonical_key"), F.col("left_value"), F.col("right_value"), grading.triaged(F.col("severity"), state), state, F.concat_ws(":", "side", F.col("left_page").cast("string")), F.concat_ws(":", "side", F.col("right_page").cast("string")), apart=tuple(F.col(c) for c in ("period", "unit", "context", "i", "j")))


def coverage(topics: DataFrame, whitelist: DataFrame) -> DataFrame:
    """topics(pair_id, side, topic, words, page): missing on one side, or 1.8 times as long; expected ones are info."""
    side = lambda s: topics.where(F.col("side") == s).groupBy("pair_id", "topic").agg(F.sum("words").alias("words"), F.min("page").alias("page"))
    j = joins.align(side("A"), side("H"), ["pair_id", "topic"])
    ratio = F.greatest("a_words", "h_words") / F.least("a_words", "h_words")
    short = j.where((F.col("status") != "matched") | (ratio > 1.8))
    less = F.when(F.col("status") == "a_only", "H").when(F.col("status") == "h_only", "A").when(F.col("a_words") < F.col("h_words"), "A").otherwise("H")
    known = joins.whitelisted(short.withColumn("missing_side", less), whitelist, "topic")
    state = grading.triage(F.col("expected"), (F.col("status") == "matched") & (ratio <= 3.0))
    return _diff(known, "coverage", F.col("topic"), F.col("a_words"), F.col("h_words"), grading.triaged(F.lit("low"), state), state, F.col("status"))


def framework(sections: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sections that a map of expected counterparts finds on one side only: sections(pair_id, side, section, page), mapping(a_section, h_section)."""
    side = lambda x, c: sections.where(F.col("side") == x).groupBy("pair_id", F.col("section").alias(c)).agg(F.min("page").alias(c + "_page"))
    pairs = sections.select("pair_id").distinct()
    a = side("A", "a_section").join(mapping, "a_section")
    h = side("H", "h_section").join(mapping, "h_section")
    j = a.join(h, ["pair_id", "a_section", "h_section"], "full_outer").join(pairs, "pair_id", "left_semi")
    short = j.where(F.col("a_section_page").isNull() | F.col("h_section_page").isNull())
    status = F.when(F.col("h_section_page").isNull(), "a_only").otherwise("h_only")
    none = F.lit(None).cast("double")
    return _diff(short, "framework", F.col("a_section"), none, none, F.lit("low"), F.lit("unresolved"), status, F.coalesce("a_section_page", "h_section_page").cast("string"), apart=(F.col("h_section"),))


def depth_rules(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose quoted terms are found on one side only: segments(pair_id, side, text), rules(rule_id, check_logic).

    All terms are looked for at once, in one pass over the texts.
    """
    named = rules.select("rule_id", F.explode(text.quoted_terms(F.col("check_logic"))).alias("form")).where(F.length(F.trim("form")) > 0)
    hits = terms.glossary_hits(segments, named, "text", "raw", whole_words=False).groupBy("pair_id", "rule_id").agg(F.max((F.col("side") == "A").cast("int")).alias("a"), F.max((F.col("side") == "H").cast("int")).alias("h"))
    one = hits.where("a <> h")
    status = F.when(F.col("a") == 1, "a_only").otherwise("h_only")
    none = F.lit(None).cast("double")
    return _diff(one, "depth_rule", F.col("rule_id"), none, none, F.lit("low"), F.lit("unresolved"), status)


def events(segments: DataFrame) -> DataFrame:
    """Events of the sides matched one to one, and those of one side among themselves; real mismatches are differences.

    segments(pair_id, side, page, seq, section, text).
    """
    found = cut(event_rules.extracted(segments, ["pair_id", "side"]), "events")  # read eight times below
    matched = event_rules.between(found).where(F.size("real") > 0)
    own = event_rules.within(found).withColumn("ambiguous", F.lit(False))
    amount = lambda p: F.when(F.array_contains("real", "amount"), F.array_max(p + "amounts")).when(F.array_contains("real", "rate"), F.array_max(p + "rates"))
    out = []
    for df, kind, one, two in ((matched, "event", "A:", "H:"), (own, "internal_event", None, None)):
        state = grading.triage(F.lit(False), F.col("ambiguous"))
        a, h = amount("a_"), amount("h_")
        graded = grading.triaged(F.coalesce(grading.grade(units.relative_delta(a, h)), F.lit("medium")), state)
        mark = lambda p, side: F.concat(F.lit(side) if side else F.concat("side", F.lit(":")), F.col(p + "page").cast("string"))
        out.append(_diff(df, kind, F.col("a_topic"), a, h, graded, state, mark("a_", one), mark("h_", two), apart=(F.col("a_seq"), F.col("h_seq"), F.array_join("real", ","))))
    return out[0].unionByName(out[1])


#: Keys that stand for each other when an image is compared with a text.
FAMILY = (("cash_equivalents", "cash_equivalents_end"),)


def key_metrics(items: DataFrame, visual: DataFrame) -> DataFrame:
    """Values read from page images against those of the text of the page, and near misses across the reports.

    visual(pair_id, side, canonical_key, page, value).  Keys of one family meet; of several values in the text the one
    whose digits are most like those seen counts, then the surer one.
    """
    kin = F.array(F.col("canonical_key"))
    for x, y in FAMILY:
        kin = F.when(F.col("canonical_key") == x, F.array(F.lit(x), F.lit(y))).when(F.col("canonical_key") == y, F.array(F.lit(y), F.lit(x))).otherwise(kin)
    seen = visual.select("pair_id", "side", F.explode(kin).alias("canonical_key"), "page", F.col("value").alias("visual"), F.col("canonical_key").alias("seen_key"))
    j = items.join(seen, ["pair_id", "side", "canonical_key", "page"]).withColumn("ratio", units.relative_delta(F.col("value"), F.col("visual"))).where("ratio > 0")
    digits = lambda c: F.regexp_replace(F.format_number(F.col(c), 2), r"[,]|\.?0*$", "")
    like = j.withColumn("alike", matching.sequence_ratio(digits("value"), digits("visual")))
    near = aggregates.pick(like, ["pair_id", "side", "seen_key", "page", "visual"], [F.col("alike").desc(), F.col("ratio"), F.col("confidence").desc(), F.col("seq")])
    shown = _diff(near, "visual", F.col("canonical_key"), F.col("visual"), F.col("value"), grading.exact_grade(F.col("ratio")), F.lit("unresolved"), F.concat_ws(":", "side", F.col("page").cast("string")))
    key = F.struct("pair_id", "canonical_key", F.coalesce("period", F.lit("")).alias("period"))
    half = lambda s, p: items.where(F.col("side") == s).select(key.alias("k"), F.col("value").alias(p), F.col("page").alias(p + "_page"))
    cross = joins.exact_mismatches(half("A", "a"), half("H", "h"), "k", "a", "h", ["a_page", "h_page"]).select("k.pair_id", "k.canonical_key", "k.period", "a", "h", "severity", "a_page", "h_page")
    return shown.unionByName(_diff(cross, "exact", F.col("canonical_key"), F.col("a"), F.col("h"), F.col("severity"), F.lit("unresolved"), F.col("a_page").cast("string"), F.col("h_page").cast("string"), apart=(F.col("period"),)))


def overlay(words: DataFrame) -> DataFrame:
    """Values printed over others, on each side alone: words as for spatial.overlays, doc_id = pair_id:side."""
    hits = spatial.overlays(words).withColumn("pair_id", F.split("doc_id", ":")[0])
    from ..functions.numbers import overlay_value

    return _diff(hits, "overlay", F.concat(F.lit("page "), F.col("page").cast("string")), overlay_value(F.col("visible")), overlay_value(F.col("hidden")), F.lit("high"), F.lit("real"), F.col("doc_id"), F.col("visible"), F.col("hidden"))


def branches(rows: DataFrame) -> DataFrame:
    """rows(pair_id, side, name, n, asset): branches with equal counts and other assets, gated by pair."""
    clean = rows.withColumn("name", text.branch_name(F.col("name")))
    side = lambda s, p: aggregates.pick(clean.where(F.col("side") == s), ["pair_id", "name"], [F.col("seq")]).select("pair_id", "name", F.col("n").alias(p + "n"), F.col("asset").alias(p + "asset"))
    a, h = side("A", "a_"), side("H", "h_")
    both = a.join(h, ["pair_id", "name"])
    count = lambda df, c: df.groupBy("pair_id").agg(F.count("*").alias(c))
    gate = count(a, "na").join(count(h, "nh"), "pair_id").join(count(both, "nb"), "pair_id").where((F.least("na", "nh") < 5) | (F.col("nb") / F.least("na", "nh") >= 0.6)).select("pair_id")
    open_ = both.join(gate, "pair_id", "left_semi").where("a_n = h_n AND a_asset <> h_asset")
    percent = units.relative_delta(F.col("a_asset"), F.col("h_asset")) * 100
    return _diff(open_, "branch", F.col("name"), F.col("a_asset"), F.col("h_asset"), grading.branch_grade(percent), F.lit("real"))


def standard(diffs: DataFrame, vectors: DataFrame, clauses: DataFrame, k: int = 4) -> DataFrame:
    """The k clauses nearest to each real difference: vectors(query_id = diff_id, vector), clauses(item_id, vector).

    Differences whose two values are the same number (within a millionth) are none, and go unasked.
    """
    if {"a_value", "h_value"} <= set(diffs.columns):
        diffs = diffs.where(F.coalesce(units.relative_delta(F.col("a_value"), F.col("h_value")) > 1e-6, F.lit(True)))
    real = vectors.join(diffs.where("triage = 'real'").select(F.col("diff_id").alias("query_id")), "query_id", "left_semi")
    return retrieval.top_cosine(real, clauses, k)


def charts(shown: DataFrame, tables: DataFrame, texts: DataFrame) -> DataFrame:
    """Chart values against table values within 2 pages and text values within 3: all (pair_id, key, page, value); spread over 1 %."""
    other = lambda df, c, p: df.select("pair_id", "key", F.col("page").alias(p), F.col("value").alias(c))
    one = joins.bucketed_range(shown, other(tables, "vb", "pb"), ["pair_id", "key"], "page", "pb", 2)
    near = aggregates.pick(one, ["pair_id", "key", "page"], [F.abs(F.col("page") - F.col("pb")), F.col("vb")]).select("pair_id", "key", "page", "vb")
    two = joins.bucketed_range(shown, other(texts, "vc", "pc"), ["pair_id", "key"], "page", "pc", 3)
    said = aggregates.pick(two, ["pair_id", "key", "page"], [F.abs(F.col("page") - F.col("pc")), F.col("vc")]).select("pair_id", "key", "page", "vc")
    three = shown.join(near, ["pair_id", "key", "page"], "left").join(said, ["pair_id", "key", "page"], "left")
    high, low = F.greatest("value", "vb", "vc"), F.least("value", "vb", "vc")
    off = three.withColumn("spread", (high - low) / F.greatest(F.abs(high), F.lit(1e-9))).where("spread > 0.01")
    return _diff(off, "chart", F.col("key"), F.col("value"), F.coalesce("vb", "vc"), grading.grade(F.col("spread")), F.lit("unresolved"), F.col("page").cast("string"))


def page_window(zh_page: Column, zh_total: Column, en_total: Column) -> Column:
    """Pages that a paragraph's partner may be away: 8 at least, wider in longer reports and further on, 30 at most."""
    base = F.greatest(F.lit(8), F.floor(5 * en_total / zh_total)) + F.when(zh_page > 50, F.floor((zh_page - 50) / 15)).otherwise(0)
    return F.when(zh_total <= 0, 12).otherwise(F.least(base, F.lit(30)))


_UNIT_ARRAYS = ("signals", "topics", "actions", "glossary")


def paragraph_candidates(units_: DataFrame, top: int = 20) -> DataFrame:
    """Candidates of each zh paragraph with their score; columns zh_* and en_*.

    units_(pair_id, lang, unit, page, section, seq, signals; topics, actions, glossary: arrays of codes, if known).
    They meet by page window, section or signal; the `top` nearest are kept.
    """
    none = F.array().cast("array<string>")
    for c in _UNIT_ARRAYS:
        units_ = units_.withColumn(c, F.coalesce(F.col(c), none) if c in units_.columns else none)
    w = Window.partitionBy("pair_id", "lang", "section")
    placed = units_.withColumn("rank", F.row_number().over(w.orderBy("seq", "unit")) - 1).withColumn("size", F.count("*").over(w)).withColumn("total", F.max("page").over(Window.partitionBy("pair_id", "lang")))
    side = lambda lang, p: placed.where(F.col("lang") == lang).select("pair_id", *[F.col(c).alias(p + c) for c in ("unit", "page", "section", "seq", "rank", "size", "total", *_UNIT_ARRAYS)])
    one = lambda lang, p: side(lang, p).dropDuplicates(["pair_id", p + "unit"])
    zh, en = one("zh", "zh_"), one("en", "en_")
    c = F.col
    # They meet by ids alone; of the paragraphs near by page, only those that can be among the `top` where a band of pages is crowded.
    place_of = lambda df, p, u: df.select("pair_id", c(p + "unit").alias(u), c(p + "page").alias("page"), c(p + "seq").alias("seq"), c(p + "total").alias("total"))
    totals = en.where("en_total IS NOT NULL").select("pair_id", "en_total").distinct()
    here = place_of(zh, "zh_", "i").join(totals, "pair_id").withColumn("reach", page_window(c("page"), c("total"), c("en_total"))).drop("total", "en_total")
    near = nearest.pages(here, place_of(en, "en_", "j").drop("total"), 30, top)
    ids = lambda df, p, u, s: df.select("pair_id", c(p + "unit").alias(u), s.alias("__s"))
    section = ids(zh, "zh_", "i", c("zh_section")).join(ids(en, "en_", "j", c("en_section")), ["pair_id", "__s"]).drop("__s")
    signal = ids(zh, "zh_", "i", F.explode("zh_signals")).join(ids(en, "en_", "j", F.explode("en_signals")), ["pair_id", "__s"]).drop("__s")
    met = near.unionByName(section).unionByName(signal).distinct().select("pair_id", c("i").alias("zh_unit"), c("j").alias("en_unit"))
    met = met.join(wide(en), ["pair_id", "en_unit"]).join(wide(zh), ["pair_id", "zh_unit"])
    same = F.coalesce(c("zh_section") == c("en_section"), F.lit(False))
    apart = F.abs(c("zh_page") - c("en_page"))
    order = Window.partitionBy("pair_id", "zh_unit").orderBy(same.desc(), apart, F.abs(c("zh_seq") - c("en_seq")), "en_seq", "en_unit")
    few = met.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= top).drop("__r")
    shared = lambda x: F.size(F.array_intersect("zh_" + x, "en_" + x))
    place = F.abs(c("zh_rank") / c("zh_size") - c("en_rank") / c("en_size"))
    both_long = same & (c("zh_size") > 1) & (c("en_size") > 1)
    position = F.when(~both_long, 0).when(place <= 0.15, 4).when(place <= 0.30, 2).when(place >= 0.70, -2).otherwise(0)
    base = F.when(same, 2).otherwise(0) + 3 * shared("topics") + 5 * shared("actions") + 2 * shared("glossary") + F.when(apart <= 2, 2).when(apart <= 5, 1).otherwise(0) + position
    known = text.jaccard(c("zh_glossary"), c("en_glossary"))
    score = base + F.when((base < 5) & (known > 0.75), 3).when((base < 5) & (known > 0.60), 1).otherwise(0)
    return few.withColumn("score", score.cast("double")).withColumn("same_section", same)


#: Factors by which a unit may have been misread.
_SCALES = (1e3, 1e4, 1e6, 1e8, 1e9)


def fact_pairs(aligned: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of aligned paragraphs (pair_id, i, j) paired one to one by kind and role, the least cost first.

    Cost: 0 for equal values (currencies converted), little for a factor of a unit, else the ratio.  Adds a, h, cost, equal.
    """
    order = Window.partitionBy("pair_id", "lang", "unit", "kind", "role").orderBy("value", *[x for x in ("currency",) if x in facts.columns])
    if "currency" not in facts.columns:
        facts = facts.withColumn("currency", F.lit(None).cast("string"))
    numbered = facts.withColumn("n", F.row_number().over(order))
    side = lambda lang, u, p: numbered.where(F.col("lang") == lang).select("pair_id", F.col("unit").alias(u), "kind", "role", F.col("value").alias(p), F.col("currency").alias(p + "_currency"), F.col("n").alias(p + "_n"))
    met = aligned.join(side("zh", "i", "a"), ["pair_id", "i"]).join(side("en", "j", "h"), ["pair_id", "j", "kind", "role"])
    a, h = F.col("a"), F.col("h")
    equal = predicates.values_match(a, h, F.coalesce("a_currency", F.lit("CNY")), F.coalesce("h_currency", "a_currency", F.lit("CNY")))
    ratio = F.greatest(F.abs(a), F.abs(h)) / F.least(F.abs(a), F.abs(h))
    scaled = F.lit(None).cast("double")
    for f in reversed(_SCALES):
        scaled = F.when(F.abs(ratio - f) / f <= 0.05, f / 1e6).otherwise(scaled)
    cost = F.when(equal, 0.0).when((a == 0) | (h == 0), F.abs(a - h)).otherwise(F.coalesce(scaled, ratio))
    costed = met.withColumn("cost", cost).withColumn("equal", equal).withColumn("__g", F.concat_ws("\u0001", *[F.col(x).cast("string") for x in ("pair_id", "i", "j", "kind", "role")])).withColumn("__score", -F.col("cost"))
    chosen = matching.greedy(costed, "__g", "a_n", "h_n", "__score", least=-1e300)
    return costed.join(chosen.select("__g", "a_n", "h_n"), ["__g", "a_n", "h_n"]).drop("__g", "__score")


def bilingual(units_: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(alignments, diffs, stats) of the zh and en paragraphs of each pair.

    units_ as for paragraph_candidates; facts(pair_id, lang, unit, kind, role, value, currency if known).
    """
    scored = paragraph_candidates(units_)
    scored = cut(scored.where("score >= 3.0"), "paragraphs")  # read twice below
    near = scored.select("pair_id", F.col("zh_unit").alias("i"), F.col("en_unit").alias("j"), "score", "same_section", F.coalesce(F.arrays_overlap("zh_signals", "en_signals"), F.lit(False)).alias("signed"), text.jaccard(F.col("zh_glossary"), F.col("en_glossary")).alias("known"))
    has = facts.select("pair_id", F.col("unit").alias("i"), F.lit(True).alias("has")).where(F.col("lang") == "zh").distinct()
    chosen = matching.greedy(near, "pair_id", "i", "j", "score", least=3.0)
    aligned = chosen.join(near.drop("score"), ["pair_id", "i", "j"]).join(has, ["pair_id", "i"], "left")
    aligned = aligned.withColumn("confidence", grading.alignment_confidence(F.col("score"), F.col("same_section"), F.col("signed"), F.coalesce("has", F.lit(False)), F.col("known"))).select("pair_id", "i", "j", "score", "confidence")
    wrong = fact_pairs(aligned.drop("score"), facts).where("NOT equal")
    state = grading.triage(F.lit(False), F.col("confidence") < 0.85)
    graded = grading.triaged(grading.grade(units.relative_delta(F.col("a"), F.col("h"))), state)
    diffs = _diff(wrong, "bilingual", F.concat_ws(":", "kind", "role"), F.col("a"), F.col("h"), graded, state, F.col("i").cast("string"), F.col("j").cast("string"), apart=(F.col("a_n"), F.col("h_n")))
    n = lambda df, c: df.groupBy("pair_id").agg(F.count("*").alias(c))
    of = lambda lang: units_.where(F.col("lang") == lang)
    stats = n(of("zh"), "zh_units").join(n(of("en"), "en_units"), "pair_id", "full_outer").join(n(aligned, "aligned"), "pair_id", "left").na.fill(0).withColumn("coverage", F.try_divide("aligned", F.least("zh_units", "en_units")))
    return aligned, diffs, stats


def table_rows(rows: DataFrame, least: float = 4.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paired tables, paired rows, diffs of their numbers) of zh and en tables.

    rows(pair_id, lang, table, row, page, title_keys, keys, unit, values): glossary keys of the title and of the row, numbers.
    Tables meet by a key of their titles or rows, best score first; then rows within paired tables in the same way.
    """
    side = lambda lang, p: rows.where(F.col("lang") == lang).select("pair_id", *[F.col(c).alias(p + c) for c in ("table", "row", "page", "title_keys", "keys", "unit", "values")])
    zh, en = side("zh", "zh_"), side("en", "en_")
    term = lambda df, p: df.withColumn("__k", F.explode(F.array_distinct(F.concat(p + "keys", p + "title_keys"))))
    met = term(zh, "zh_").join(term(en, "en_"), ["pair_id", "__k"]).drop("__k").dropDuplicates(["pair_id", "zh_table", "zh_row", "en_table", "en_row"])
    shared = F.least(F.lit(4), 2 * F.size(F.array_intersect("zh_keys", "en_keys")))
    title = F.when(F.arrays_overlap("zh_title_keys", "en_title_keys"), 2).otherwise(0)
    other = F.when(F.col("zh_unit").isNotNull() & F.col("en_unit").isNotNull() & (units.multiplier(F.col("zh_unit")) != units.multiplier(F.col("en_unit"))), -2).otherwise(0)
    page = F.when(F.abs(F.col("zh_page") - F.col("en_page")) <= 2, 1).otherwise(0)
    scored = met.withColumn("score", (shared + title + page + other).cast("double"))
    tables = scored.groupBy("pair_id", "zh_table", "en_table").agg(F.sum(F.when(F.col("score") >= least, F.col("score")).otherwise(0.0)).alias("score")).where("score > 0")
    paired = matching.greedy(tables, "pair_id", "zh_table", "en_table", "score", least=3.0)
    inside = scored.join(paired.select("pair_id", "zh_table", "en_table"), ["pair_id", "zh_table", "en_table"]).withColumn("__g", F.concat_ws("\u0001", *[F.col(c).cast("string") for c in ("pair_id", "zh_table", "en_table")]))
    chosen = matching.greedy(inside, "__g", "zh_row", "en_row", "score", least=least)
    out = inside.join(chosen.select("__g", "zh_row", "en_row"), ["__g", "zh_row", "en_row"]).drop("__g")
    each = out.select("*", F.posexplode(F.arrays_zip("zh_values", "en_values")).alias("n", "v")).withColumn("a", F.col("v.zh_values") * units.multiplier(F.col("zh_unit"))).withColumn("h", F.col("v.en_values") * units.multiplier(F.col("en_unit")))
    wrong = each.where(units.relative_delta(F.col("a"), F.col("h")) > 1e-4)
    graded = grading.grade(units.relative_delta(F.col("a"), F.col("h")))
    mark = lambda p: F.concat_ws(":", F.col(p + "table").cast("string"), F.col(p + "row").cast("string"))
    return paired, out, _diff(wrong, "bilingual_row", F.array_join(F.array_sort(F.array_intersect("zh_keys", "en_keys")), ","), F.col("a"), F.col("h"), graded, F.lit("real"), mark("zh_"), mark("en_"), apart=(F.col("n"),))


def all_checks(parts: list[DataFrame]) -> DataFrame:
    """The union of the checks' diffs; equal ids once, the most severe first."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return aggregates.pick(every, ["pair_id", "diff_id"], [grading.rank(F.col("severity")).desc(), F.col("diff_type")])
