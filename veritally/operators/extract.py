"""Extraction of facts: metrics of tables and texts, amounts and rates with their roles, events and their signatures."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import dates, numbers, text, units
from . import joins, matching, terms

#: Words that give an amount its role, in order.
ROLES = (("guarantee", "guarantee"), ("dividend", "dividend"), ("loan", "loan"), ("acqui", "consideration"), ("dispos", "consideration"), ("invest", "investment"), ("revenue", "revenue"), ("profit", "profit"))
SIGNALS = ("acqui", "dispos", "guarantee", "litigation", "dividend", "bond", "issue", "merger", "pledge", "repurchase")
_AMOUNT = re.compile(r"(?:(HK\$|US\$|RMB|CNY|USD|HKD)\s?)?(\d[\d,]*(?:\.\d+)?)\s?(billion|million|thousand|亿元|万元|千元|元|yuan|bn|mn)", re.I)
_RATE = re.compile(r"(\d+(?:\.\d+)?)\s?%")
FACTS = "array<struct<kind:string,role:string,value:double,currency:string,start:int,end:int,reliable:boolean>>"


def _role(context: str, default: str) -> str:
    low = context.lower()
    return next((role for word, role in ROLES if word in low), default)


def _facts(s: str) -> list[dict]:
    """Amounts (role by 56 characters around) and rates (80 around); the longer of overlapping spans stays."""
    scale = dict((k, v) for k, v in units.UNITS) | {"亿元": 1e8, "万元": 1e4, "千元": 1e3, "元": 1.0, "yuan": 1.0, "bn": 1e9, "mn": 1e6}
    found = []
    for m in _AMOUNT.finditer(s or ""):
        code = {"hk$": "HKD", "us$": "USD", "rmb": "CNY"}.get((m[1] or "").lower(), (m[1] or "").upper() or None)
        found.append({"kind": "amount", "role": _role(s[max(0, m.start() - 56) : m.end() + 56], "amount"), "value": float(m[2].replace(",", "")) * scale.get(m[3].lower(), 1.0), "currency": code, "start": m.start(), "end": m.end(), "reliable": bool(m[1]) or "," in m[2]})
    for m in _RATE.finditer(s or ""):
        found.append({"kind": "rate", "role": _role(s[max(0, m.start() - 80) : m.end() + 80], "rate"), "value": float(m[1]), "currency": None, "start": m.start(), "end": m.end(), "reliable": True})
    out: list[dict] = []
    for f in sorted(found, key=lambda f: (f["start"] - f["end"], f["start"])):
        if all(f["end"] <= o["start"] or f["start"] >= o["end"] for o in out):
            out.append(f)
    return sorted(out, key=lambda f: f["start"])


def fact_udf():
    """Arrow UDF: text to FACTS, with character offsets, which Spark's regular expressions do not give."""
    @pandas_udf(FACTS)
    def facts(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _facts(x or ""))

    return facts


def table_metrics(cells: DataFrame, glossary: DataFrame, keys: list[str]) -> DataFrame:
    """One item for each number right of a row's label: keys, row, col, canonical_key, value, period, confidence, source.

    cells(keys, row, col, text, is_header).  A known label has confidence .9, others get a key of their own with .5.
    """
    header = cells.where("is_header").select(*keys, "col", F.col("text").alias("period_text"))
    first = cells.where(~F.col("is_header") & (F.length(F.trim("text")) > 0) & numbers.parse_number(F.col("text")).isNull())
    label = first.groupBy(*keys, "row").agg(F.min_by("text", "col").alias("label"), F.min("col").alias("label_col"))
    known = label.join(glossary.select(F.lower("form").alias("form"), "canonical_key"), F.lower(F.trim("label")) == F.col("form"), "left").drop("form")
    value = numbers.parse_number(F.col("text"))
    items = cells.where(~F.col("is_header")).join(known, [*keys, "row"]).where(F.col("col") > F.col("label_col")).withColumn("value", value).where("value IS NOT NULL")
    named = items.withColumn("confidence", F.when(F.col("canonical_key").isNotNull(), 0.9).otherwise(0.5)).withColumn("canonical_key", F.coalesce("canonical_key", text.snake_key(F.col("label"))))
    return named.join(header, [*keys, "col"], "left").select(*keys, "row", "col", "canonical_key", "value", dates.period(F.col("period_text")).alias("period"), "confidence", F.lit("table").alias("source"))


def text_metrics(segments: DataFrame, glossary: DataFrame, keys: list[str]) -> DataFrame:
    """Glossary terms with the number 60 characters after or 40 before: keys, canonical_key, value, unit, confidence .75."""
    hits = terms.glossary_hits(segments, glossary, "text")
    plain = F.lower(text.simplify(F.col("text")))
    value = numbers.number_near_label(plain, F.col("form"), 60)
    unit = F.regexp_extract(plain, r"(billion|million|thousand|亿元|百万元|万元|千元)", 1)
    got = hits.withColumn("value", value).where("value IS NOT NULL").withColumn("unit", F.nullif(unit, F.lit("")))
    return got.select(*keys, "canonical_key", "value", "unit", F.lit(0.75).alias("confidence"), F.lit("text").alias("source")).distinct()


def generic_metrics(segments: DataFrame, keys: list[str]) -> DataFrame:
    """'Name of thing was 1,234 million' in English: keys, canonical_key, value, unit, confidence .5."""
    pattern = r"(?i)([a-z][a-z ]{3,40}?) (?:was|were|amounted to|of) (?:RMB|HK\$|US\$)? ?(\d[\d,]*(?:\.\d+)?) ?(billion|million|thousand)?"
    part = lambda k: F.regexp_extract_all("text", F.lit(pattern), F.lit(k))
    every = segments.select(*keys, F.explode(F.arrays_zip(part(1).alias("n"), part(2).alias("v"), part(3).alias("u"))).alias("m"))
    return every.select(*keys, text.snake_key(F.trim("m.n")).alias("canonical_key"), numbers.parse_number(F.col("m.v")).alias("value"), F.nullif("m.u", F.lit("")).alias("unit"), F.lit(0.5).alias("confidence"), F.lit("generic_pattern").alias("source"))


def candidates(items: DataFrame, glossary: DataFrame, least: float = 0.65) -> DataFrame:
    """Items with a value, enough confidence and a sane, known key."""
    return items.where(F.col("value").isNotNull() & (F.col("confidence") >= least) & ~text.garbled_key(F.col("canonical_key"))).join(glossary.select("canonical_key").distinct(), "canonical_key", "left_semi")


def signature(fragment: Column) -> Column:
    """Sorted identity terms of an event: years, rates, quoted or capitalised names."""
    terms = F.concat(F.regexp_extract_all(fragment, F.lit(r"((?:19|20)\d{2})"), F.lit(1)), F.regexp_extract_all(fragment, F.lit(r"(\d+(?:\.\d+)?%)"), F.lit(1)), F.regexp_extract_all(fragment, F.lit(r"\b([A-Z][a-z]+ (?:[A-Z][a-z]+ ?)+(?:Limited|Ltd|Bank|Company|Group)?)"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(terms, lambda x: F.trim(x)), lambda t: ~t.isin("The Company", "The Group"))))


def events(segments: DataFrame, keys: list[str], topics: list[tuple[str, str]]) -> DataFrame:
    """Fragments that carry an event signal, with topic, dates, facts and signature; first of equal (page, start) stays."""
    cut = segments.withColumn("fragment", F.explode(text.fragments(F.col("text"))))
    low = F.lower("fragment")
    signals = F.array_compact(F.array(*[F.when(low.contains(s), F.lit(s)) for s in SIGNALS]))
    noisy = text.share_of(F.col("fragment"), r"\d") > 0.4
    some = cut.withColumn("signals", signals).where((F.size("signals") > 0) & ~noisy)
    w = Window.partitionBy(*keys, "page", F.substring("fragment", 1, 120)).orderBy("seq")
    first = some.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return first.select(*keys, "page", "seq", "fragment", "signals", text.first_keyword(F.col("fragment"), topics).alias("topic"), dates.dates(F.col("fragment")).alias("dates"), fact_udf()("fragment").alias("facts"), signature(F.col("fragment")).alias("signature"))


def structure(segments: DataFrame, keys: list[str], parents: dict[str, str]) -> DataFrame:
    """Two-level tree of sections: node, parent, level, first and last page."""
    parent = F.lit("other")
    for child, up in parents.items():
        parent = F.when(F.col("section") == child, up).otherwise(parent)
    named = segments.where("section IS NOT NULL").withColumn("parent", parent)
    leaf = named.groupBy(*keys, F.col("section").alias("node"), "parent").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")).withColumn("level", F.lit(2))
    top = leaf.groupBy(*keys, F.col("parent").alias("node")).agg(F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page")).withColumn("level", F.lit(1)).withColumn("parent", F.lit(None).cast("string"))
    return leaf.unionByName(top)


#: Section codes that stand for others, and the domain of a report that each section belongs to.
SECTION_ALIASES = {"governance": "corporate_governance", "segment": "segment_report", "basic_eps": "eps", "diluted_eps": "eps", "cfo": "cf", "cfi": "cf", "cff": "cf"}
SECTION_PARENTS = {
    **dict.fromkeys(("company_profile", "mda", "directors_report", "risk"), "company_overview"),
    **dict.fromkeys(("corporate_governance", "share_changes", "preference_shares", "bonds", "significant_events"), "governance_and_shareholders"),
    **dict.fromkeys(("financial_statements", "bs", "pl", "cf", "equity", "notes", "accounting_policy", "accounting_estimate", "revenue", "segment_report", "related_party", "goodwill", "tax", "eps", "leases", "financial_instruments", "commitments", "employees", "cash_equivalents"), "financial_statements_tree"),
    "esg": "esg_and_social",
}


def section_code(section: Column) -> Column:
    """The code that a section's name stands for."""
    out = F.trim(section)
    for name, code in SECTION_ALIASES.items():
        out = F.when(F.trim(section) == name, code).otherwise(out)
    return out


def raw_table_metrics(segments: DataFrame, glossary: DataFrame, keys: list[str], reach: int = 17) -> DataFrame:
    """Metrics of tables that came as lines, one cell each: keys, canonical_key, value, confidence .82.

    A line that is a glossary form (numbering left out) is a label; numbers in the `reach` lines after it, up to the
    next label, are its values; page marks such as 12 / 300 end the table.  Years, note numbers and single letters are none.
    """
    lines = segments.select(*keys, F.posexplode(F.filter(F.transform(F.split("text", r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")).alias("seq", "cell"), F.size(F.filter(F.split("text", r"[\r\n]+"), lambda x: F.trim(x) != "")).alias("n"))
    w = Window.partitionBy(*keys)
    foot = F.max(F.when(F.col("cell").rlike(r"^\d{1,4}\s*/\s*\d{1,4}$") & (F.col("seq") >= F.greatest(F.lit(4), F.floor(F.col("n") / 2))), F.col("seq"))).over(w)
    body = lines.where("n >= 4").withColumn("foot", foot).where("foot IS NULL OR seq < foot")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("cell", r"\s+", " "), r"^[(（]?\d+[)）、.．]\s*", ""), "^[一二三四五六七八九十]+[、.．]\\s*", "")
    known = glossary.select(F.lower("form").alias("__form"), "canonical_key").dropDuplicates(["__form"])
    named = body.withColumn("__form", F.lower(F.trim(text.simplify(bare)))).join(known, "__form", "left")
    last = F.last(F.when(F.col("canonical_key").isNotNull(), F.struct("canonical_key", "seq")), True).over(w.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    cells = named.withColumn("label", last).where(F.col("canonical_key").isNull() & F.col("label").isNotNull() & (F.col("seq") - F.col("label.seq") <= reach))
    mark = F.col("cell").rlike("^[(（]?(?:[一二三四五六七八九十0-9]+|[A-Za-z]\\d*)[)）]?$")
    token = cells.where(~mark).select(*keys, "label.canonical_key", "seq", F.explode(numbers.tokens(F.col("cell"))).alias("raw")).withColumn("value", numbers.parse_number(F.col("raw")))
    year = F.col("value").between(1990, 2035) & ~F.col("raw").contains(".")
    return token.where(F.col("value").isNotNull() & ~year).select(*keys, "canonical_key", "value", F.lit(0.82).alias("confidence"), F.lit("text").alias("source"))


def tail_numbers(s: Column, most: int = 12) -> Column:
    """Numbers printed after the page mark (12 / 300) at the end of a page's text, as array: values laid over the page come last."""
    tail = F.regexp_extract(s, r"(?:^|\s)\d{1,4}\s*/\s*\d{1,4}\s+((?:[(\-]?\d[\d,]*(?:\.\d+)?\)?\s*){1,12})\s*$", 1)
    raw = F.filter(numbers.tokens(tail), lambda t: numbers.parse_number(t).isNotNull() & ~(numbers.parse_number(t).between(1990, 2035) & ~t.contains(".")))
    return F.slice(raw, 1, most)


def overlaid_items(items: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose printed value another at the end of the page's text nearly repeats: keys, page, canonical_key, value (item), overlaid.

    items(keys, page, canonical_key, value, confidence, section), pages(keys, page, text).  A value within 3 % (10 % outside
    notes) but not equal is a candidate; of all pairs of a page the likest digits come first, each end once.
    """
    tails = pages.select(*keys, "page", F.posexplode(tail_numbers(F.col("text"))).alias("at", "raw")).withColumn("overlaid", numbers.parse_number(F.col("raw")))
    met = items.where("confidence >= 0.7 AND value IS NOT NULL").join(tails, [*keys, "page"])
    ratio = F.abs(F.col("overlaid") - F.col("value")) / F.greatest(F.abs("overlaid"), F.abs("value"), F.lit(1.0))
    near = met.withColumn("ratio", ratio).where((F.abs(F.col("overlaid") - F.col("value")) > 1e-9) & ((F.col("ratio") <= 0.03) | ((F.coalesce("section", F.lit("")) != "notes") & (F.col("ratio") <= 0.10))))
    digits = lambda c: F.regexp_replace(F.format_number(F.col(c), 2), r"[,]|\.?0*$", "")
    group = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in (*keys, "page")])
    scored = near.withColumn("__g", group).withColumn("__s", matching.sequence_ratio(digits("value"), digits("overlaid")) - F.col("ratio") / 1000)
    chosen = matching.greedy(scored, "__g", "canonical_key", "at", "__s", least=-1.0)
    return scored.join(chosen.select("__g", "canonical_key", "at"), ["__g", "canonical_key", "at"]).dropDuplicates(["__g", "canonical_key", "at"]).select(*keys, "page", "canonical_key", "value", "overlaid")


#: Page limits and keys whose later pages are looked at first when images are read.
FRONT_PAGES, STRICT_PAGES, MOST_PAGES = 60, 120, 24
LATE_KEYS = ("central_bank_deposits", "cash_equivalents", "cash_equivalents_end", "commission_net", "credit_impairment_loss", "customer_deposits", "customer_loans", "financial_investments", "interest_net", "inventory", "investing_cash_flow", "operating_cash_flow", "receivables", "taxes_and_surcharges")


def visual_pages(pages: DataFrame, items: DataFrame, keys: list[str], most: int = MOST_PAGES) -> DataFrame:
    """keys, page, score of the pages of each report whose images are worth reading: all if there are `most` at most.

    pages(keys, page, risky), items(keys, page, canonical_key, source, section, text).  The first late page of each late
    key goes before all; the rest by points for place, risk, items, tables and the words around them.
    """
    c, low = F.col, F.lower(F.coalesce(F.col("text"), F.lit("")))
    bare = F.regexp_replace(low, r"\s+", "")
    said = lambda s, *words: sum((s.contains(x).cast("int") for x in words), F.lit(0)) > 0
    late = (c("page") > STRICT_PAGES) & c("canonical_key").isin(*LATE_KEYS)
    points = 20 + F.when(c("source") == "table", 8).otherwise(0) + F.when(late, 74).otherwise(0) + F.when(said(low, "note", "financial statements", "statement of financial position", "income statement", "cash flow statement", "附注", "财务报表", "资产负债表", "利润表", "现金流量表"), 36).otherwise(0) + F.when(said(bare, "total", "carryingamount", "netamount", "endingbalance", "netcashflow", "cashflow", "合计", "小计", "账面价值", "净额", "年末余额", "期末余额", "现金流"), 34).otherwise(0) + F.when(c("page") <= FRONT_PAGES, 18).otherwise(0)
    of_items = items.withColumn("__p", points).groupBy(*keys, "page").agg(F.sum("__p").alias("__p"))
    cash = c("canonical_key").isin("investing_cash_flow", "operating_cash_flow", "cash_equivalents_end")
    anchor = (c("section") == "notes") | (cash & (c("section").isin("cf", "cash_flow", "cash_flow_statement") | said(bare, "cashflow", "现金流"))) | (~c("section").isin("cf", "cash_flow", "cash_flow_statement") & ~said(bare, "cashflow", "现金流") & said(low, "附注", "notes"))
    first = items.where(late & F.coalesce(anchor, F.lit(False))).groupBy(*keys, "canonical_key").agg(F.min("page").alias("page")).select(*keys, "page", F.lit(True).alias("__first")).distinct()
    place = F.when(c("page") <= FRONT_PAGES, 34).when(c("page") <= STRICT_PAGES, 16).otherwise(4)
    scored = pages.join(of_items, [*keys, "page"], "left").join(first, [*keys, "page"], "left").withColumn("score", (place + F.when(c("risky"), 55).otherwise(0) + F.coalesce("__p", F.lit(0))).cast("double"))
    w = Window.partitionBy(*keys).orderBy(F.coalesce(c("__first"), F.lit(False)).desc(), F.when(c("__first"), c("page")), c("score").desc(), "page")
    return scored.withColumn("__r", F.row_number().over(w)).where(c("__r") <= most).select(*keys, "page", "score")


def report_units(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unit, multiplier, currency that a report says its figures are in: the phrase on most pages, then on the earliest.

    pages(keys, page, text); phrases such as "Unit: RMB million", "单位：百万元" or "in thousands of RMB".
    """
    said = F.concat(F.regexp_extract_all("text", F.lit(r"(?i)(?:\bunit|单位|單位)\s*[:：]\s*([^\n]{1,30})"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?i)\b(in (?:millions|thousands) of [A-Z$]{2,4})"), F.lit(1)))
    each = pages.select(*keys, "page", F.explode(F.array_distinct(F.transform(said, lambda x: F.trim(x)))).alias("unit"))
    counted = each.groupBy(*keys, "unit").agg(F.count("*").alias("__n"), F.min("page").alias("__page"))
    w = Window.partitionBy(*keys).orderBy(F.col("__n").desc(), "__page", "unit")
    top = counted.withColumn("__r", F.row_number().over(w)).where("__r = 1")
    return top.select(*keys, "unit", units.multiplier(F.col("unit")).alias("multiplier"), units.currency(F.col("unit")).alias("currency"))
