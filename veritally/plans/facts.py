"""Carrier queries of facts with inherited units: each customer's orders are the blocks of a report in two languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, sections
from ..sources.shared import spread
from .registry import query

_SAID = {"1-URGENT": ("单位：人民币万元", "(RMB million)", 1e4, 1e6), "2-HIGH": ("單位：千元", "Unit: thousand", 1e3, 1e3)}


def _blocks(t, chinese: bool):
    rows = t("orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderstatus")
    o = spread(rows, "o_custkey").groupBy("o_custkey", "o_orderkey").agg(F.min("o_orderpriority").alias("p"), F.min("o_orderdate").alias("d"), F.min("o_totalprice").alias("v"), F.min("o_orderstatus").alias("s"))
    n = F.format_number(1000 + F.col("o_orderkey") * 7, 0)
    if chinese:
        text = F.concat(F.lit("董事會於"), F.date_format("d", "yyyy年M月d日"), F.lit("批准，發行"), n, F.lit("股，占5.5%，營業收入"), F.format_number("v", 2))
    else:
        more = F.when(F.col("s") == "F", F.format_number(3000 + F.col("o_orderkey") * 7, 0)).otherwise(n)
        day = F.when(F.col("s") == "P", F.date_add("d", 40)).otherwise(F.col("d"))
        text = F.concat(F.lit("On "), F.date_format(day, "d MMMM yyyy"), F.lit(" the board approved the issue of "), more, F.lit(" shares (5.5%); revenue "), F.format_number("v", 2))
    for p, (zh, en, _, _) in _SAID.items():
        text = F.when(F.col("p") == p, zh if chinese else en).otherwise(text)
    return facts.with_context(o.select(F.col("o_custkey").alias("report"), F.col("o_orderkey").alias("seq"), text.alias("text")), ["report"], "seq")


_BASE = """WITH o AS (SELECT o_custkey AS report, o_orderkey AS seq, min(o_orderpriority) AS p, min(o_orderdate) AS d, min(o_totalprice) AS v, min(o_orderstatus) AS s FROM orders GROUP BY ALL),
c AS (SELECT *, coalesce(last_value(CASE p WHEN '1-URGENT' THEN 1e4 WHEN '2-HIGH' THEN 1e3 END IGNORE NULLS) OVER w, 1) AS zh, coalesce(last_value(CASE p WHEN '1-URGENT' THEN 1e6 WHEN '2-HIGH' THEN 1e3 END IGNORE NULLS) OVER w, 1) AS en, CAST(printf('%.2f', v) AS DOUBLE) AS r FROM o WINDOW w AS (PARTITION BY report ORDER BY seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT * FROM c WHERE p NOT IN ('1-URGENT', '2-HIGH'))"""


@query(_BASE + """ SELECT report, seq, 'share_count' AS kind, CAST(1000 + seq * 7 AS DOUBLE) AS value FROM b UNION ALL SELECT report, seq, 'amount', round(r * zh, 2) FROM b UNION ALL SELECT report, seq, 'date', CAST(date_diff('day', DATE '1970-01-01', CAST(d AS DATE)) AS DOUBLE) FROM b""")
def inherited_facts(t, spark):
    """Amounts in the unit that the last block with one declares, share counts and dates."""
    return facts.facts(_blocks(t, True)).select("report", "seq", "kind", F.round("value", 2).alias("value"))


@query(_BASE + """ SELECT report, seq, 'share_count' AS kind, CASE WHEN s = 'F' AND 2000.0 / (3000 + seq * 7) > 1e-3 THEN 'differs' ELSE 'same' END AS status FROM b
UNION ALL SELECT report, seq, 'amount', CASE WHEN zh = en THEN 'same' ELSE 'unit_scale' END FROM b UNION ALL SELECT report, seq, 'date', CASE WHEN s = 'P' THEN 'differs' ELSE 'same' END FROM b""")
def bilingual_fact_status(t, spark):
    """Facts of both languages by block: equal, explained by units, or different."""
    side = lambda zh: facts.facts(_blocks(t, zh))
    return facts.compared(side(True), side(False), ["report", "seq"]).select("report", "seq", "kind", "status")


_KEYS = {"th": "bs", "an": "notes", "de": "audit", "er": "contents", "in": "risk", "re": "cf"}
_UNITS = """WITH u AS (SELECT source AS pair_id, CASE WHEN lang IN ('en', 'de') THEN 'zh' ELSE 'en' END AS lang, doc_id AS unit, CAST(doc_id % 97 AS BIGINT) AS page, doc_id AS seq, trim(lower(left(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), 2))) AS k, text, length(text) % 3 = 0 AS material FROM documents WHERE text IS NOT NULL),
s AS (SELECT * REPLACE (CASE k WHEN 'th' THEN 'bs' WHEN 'an' THEN 'notes' WHEN 'de' THEN 'audit' WHEN 'er' THEN 'contents' WHEN 're' THEN 'cf' WHEN 'in' THEN 'risk' ELSE k END AS k), lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS t FROM u),
a AS (SELECT x.pair_id, x.unit FROM s x JOIN s y ON x.pair_id = y.pair_id AND x.unit + 1 = y.unit AND x.lang = 'zh' AND y.lang = 'en')"""


def _units(t):
    text = F.lower(F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 2))
    key = text
    for k, v in _KEYS.items():
        key = F.when(text == k, v).otherwise(key)
    units = t("documents").where("text IS NOT NULL").select(F.col("source").alias("pair_id"), F.when(F.col("lang").isin("en", "de"), "zh").otherwise("en").alias("lang"), F.col("doc_id").alias("unit"), (F.col("doc_id") % 97).alias("page"), F.col("doc_id").alias("seq"), key.alias("section"), "text", (F.length("text") % 3 == 0).alias("material"))
    en = units.where("lang = 'en'").select("pair_id", (F.col("unit") - 1).alias("unit"))
    return units, units.where("lang = 'zh'").join(en, ["pair_id", "unit"], "left_semi").select("pair_id", F.col("unit").alias("i"))


@query(_UNITS + """, z AS (SELECT pair_id, k, min(page) AS page, arg_min(t, (page, seq)) AS first, bool_or(unit IN (SELECT unit FROM a)) AS met, bool_or(material) AS material FROM s WHERE lang = 'zh' AND k <> '' GROUP BY ALL),
e AS (SELECT DISTINCT pair_id, k FROM s WHERE lang = 'en'), r AS (SELECT pair_id, max(page) FILTER (lang = 'en') / max(page) FILTER (lang = 'zh') AS ratio, bool_or(lang = 'en' AND contains(t, 'auditor')) AS audited FROM s GROUP BY 1)
SELECT pair_id, k AS section, page FROM z JOIN r USING (pair_id) WHERE NOT met AND NOT EXISTS (SELECT 1 FROM e WHERE e.pair_id = z.pair_id AND e.k = z.k) AND k <> 'contents' AND NOT contains(first, 'definition') AND NOT contains(first, 'contents') AND NOT contains(first, 'glossary') AND NOT contains(first, 'abbreviations') AND NOT contains(first, 'meansthe') AND NOT contains(first, 'means ')
  AND NOT (k = 'audit' AND audited) AND CASE WHEN material THEN true WHEN k IN ('bs', 'cf') THEN length(first) >= 8 ELSE NOT coalesce(ratio > 1.8 OR ratio < 0.6, false) AND k IN ('audit', 'risk', 'notes') AND length(first) >= 8 END""")
def section_gaps(t, spark):
    """Sections by how a text begins; paragraphs have a partner where the next id is on the other side."""
    units, aligned = _units(t)
    return sections.gaps(units, aligned).select("pair_id", "section", "page")


@query(_UNITS + " SELECT pair_id, unit, page FROM s WHERE lang = 'zh' AND material AND length(t) >= 100 AND unit NOT IN (SELECT unit FROM a)")
def unpaired_paragraphs(t, spark):
    units, aligned = _units(t)
    return sections.unpaired(units, aligned).select("pair_id", "unit", "page")


@query("""WITH l AS (SELECT l_orderkey AS report, l_linenumber AS seq, min(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
v AS (SELECT *, floor(q * 7) / 100 AS z, CASE WHEN f = 'R' THEN (floor(q * 7) + 1) / 100 ELSE floor(q * 7) / 100 END AS e FROM l)
SELECT report, seq, 'per_ten' AS kind, z AS zh_value, e AS en_value, CASE WHEN abs(z - e) / greatest(abs(z), abs(e), 1e-9) <= 1e-3 THEN 'same' ELSE 'differs' END AS status FROM v
UNION ALL SELECT report, seq, 'share_count', CAST(1000 + seq AS DOUBLE), CAST(1000 + seq AS DOUBLE), 'same' FROM v""")
def per_ten_share_facts(t, spark):
    """Dividends for each ten shares of every order line in both languages, beside share counts that are facts of their own."""
    l = spread(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("f"))
    cents = F.floor(F.col("q") * 7)
    said = lambda c: F.format_string("%d.%02d", F.floor(c / 100), (c % 100).cast("long"))
    n = F.format_number(1000 + F.col("l_linenumber"), 0)
    zh = F.concat(F.lit("以總股份"), n, F.lit("股為基數，向全體股東每 10 股派發現金紅利人民幣"), said(cents), F.lit("元（含稅）"))
    en = F.concat(F.lit("on the basis of "), n, F.lit(" shares, a cash dividend of RMB"), said(F.when(F.col("f") == "R", cents + 1).otherwise(cents)), F.lit(" (tax inclusive) per 10 shares"))
    side = lambda text: facts.facts(facts.with_context(l.select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("seq"), text.alias("text")), ["report"], "seq"))
    return facts.compared(side(zh), side(en), ["report", "seq"])
