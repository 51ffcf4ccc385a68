"""Carrier queries of the column rules and the checks: texts and values made from the keys of whole tables, so that SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import dates, grading, numbers, predicates, text, units
from ..operators import aggregates, events, extract, spatial
from ..sources import readers, sinks
from . import checks
from .registry import query


def _by(key: Column, n: int, values: list) -> Column:
    """The value of a list by key mod n (n values)."""
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(key % n == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN -o_totalprice WHEN 2 THEN o_totalprice END AS bounded,
  CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 2 THEN o_totalprice WHEN 3 THEN 1234567890123456.0::DOUBLE END AS chart, CASE o_orderkey % 4 WHEN 0 THEN -o_totalprice WHEN 3 THEN 1234567890123456.0::DOUBLE END AS overlay,
  CAST(printf('%.2f', o_totalprice + 5000) AS DOUBLE) AS financial, CAST(printf('%.2f', o_totalprice + 5000) AS DOUBLE) AS row_first, CAST(printf('%.2f', o_totalprice + 5000) AS DOUBLE) AS near, CASE WHEN o_orderkey % 2 = 0 THEN CAST(printf('%.2f', o_totalprice + 5000) AS DOUBLE) END AS closest FROM orders""")
def number_rules(t, spark):
    k, price = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    raw = _by(k, 4, [F.concat(F.lit("("), price, F.lit(")")), "n/a", F.concat(F.lit("total "), price, F.lit(" yuan")), "1234567890123456"])
    more = F.format_number(F.col("o_totalprice") + 5000, 2)
    said, target = F.concat(F.lit("Total assets (note 5) "), more), (F.col("o_totalprice") + 5000) * F.when(k % 2 == 0, 1.01).otherwise(1.5)
    return t("orders").select(
        k.alias("k"), numbers.parse_number_anywhere(raw).alias("bounded"), numbers.parse_chart_number(raw).alias("chart"), numbers.overlay_value(raw).alias("overlay"),
        numbers.first_financial_number(F.concat(F.lit("Note 12 of 2023: 35.5% and "), more)).alias("financial"), numbers.first_number_of_row(F.array(F.lit("Revenue"), F.lit("7"), more)).alias("row_first"),
        numbers.number_near_label(said, F.lit("Total assets")).alias("near"), numbers.closest_number_near_label(said, F.lit("Total assets"), target).alias("closest"),
    )


@query("""SELECT p_partkey AS k, CAST(CASE p_partkey % 8 WHEN 0 THEN 1e6 WHEN 1 THEN 1e6 WHEN 2 THEN 1e4 WHEN 3 THEN 1e6 WHEN 5 THEN 1e3 WHEN 6 THEN 1e8 ELSE 1 END AS DOUBLE) AS multiplier,
  CAST(CASE p_partkey % 8 WHEN 0 THEN 1e6 WHEN 1 THEN 1e6 WHEN 2 THEN 1e4 WHEN 3 THEN 1e6 WHEN 5 THEN 1e3 WHEN 6 THEN 1e8 ELSE 1 END AS DOUBLE) AS of_event,
  CASE WHEN p_partkey % 8 IN (0, 6) THEN 'CNY' WHEN p_partkey % 8 = 1 THEN 'HKD' WHEN p_partkey % 8 = 4 THEN 'USD' END AS currency,
  round(p_retailprice * CASE WHEN p_partkey % 8 IN (0, 6) THEN 1.08 WHEN p_partkey % 8 = 1 THEN 1.0 WHEN p_partkey % 8 = 4 THEN 7.8 END, 6) AS hkd FROM part""")
def unit_rules(t, spark):
    unit = _by(F.col("p_partkey"), 8, ["百万元", "HK$ million", "万股", "million shares", "US$", "k", "亿元", F.lit(None).cast("string")])
    p = t("part").withColumn("u", unit).withColumn("c", units.currency(F.col("u")))
    return p.select(F.col("p_partkey").alias("k"), units.multiplier(F.col("u")).alias("multiplier"), units.event_multiplier(F.col("u")).alias("of_event"), F.col("c").alias("currency"), F.round(units.in_hkd(F.col("p_retailprice"), F.col("c")), 6).alias("hkd"))


@query("""SELECT c_custkey AS k, '资产总额' || c_name AS simple, '营业 收入 ' || lower(c_mktsegment) AS normal, '北京' || c_name AS branch, c_custkey % 6 <> 4 AS junk,
  CASE c_custkey % 6 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' WHEN 2 THEN 'bilingual' WHEN 3 THEN 'en' WHEN 4 THEN 'bilingual' ELSE 'zh' END AS vote, c_custkey % 6 IN (0, 2, 3) AS quarterly,
  CASE c_custkey % 6 WHEN 0 THEN 'signing' WHEN 1 THEN 'announcement' WHEN 2 THEN 'completion' WHEN 3 THEN 'effective' WHEN 4 THEN 'maturity' ELSE 'other' END AS date_role,
  CASE c_custkey % 3 WHEN 0 THEN 'going concern,risk' WHEN 1 THEN 'pension plan' ELSE '' END AS terms, CASE c_custkey % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END AS demoted, c_custkey % 3 = 1 AS garbled FROM customer""")
def text_rules(t, spark):
    k = F.col("c_custkey")
    label = _by(k, 6, ["Page", "Contents", "12", "net profit net profit", "Revenue, net", "a" * 45])
    votes = _by(k, 6, [F.array(*map(F.lit, v)) for v in (["zh", "zh", "en"], ["en", "en", "zh"], ["zh", "en"])] + [F.array().cast("array<string>")] + [F.array(*map(F.lit, v)) for v in (["bilingual", "zh"], ["zh"])])
    logic = _by(k, 3, ['must state "going concern" and "risk"', "must disclose the pension plan.", "nothing"])
    return t("customer").select(
        k.alias("k"), text.simplify(F.concat(F.lit("資產總額"), "c_name")).alias("simple"), text.normalise(F.concat(F.lit("  營業　收入 "), "c_mktsegment")).alias("normal"),
        text.branch_name(F.concat(F.lit("北 京　"), "c_name")).alias("branch"), text.junk_label(label).alias("junk"), text.language_vote(votes).alias("vote"),
        dates.quarterly(_by(k, 6, ["Q3 results", "annual", "first quarter", "第一季度", "FAQ3x", F.lit(None).cast("string")])).alias("quarterly"),
        dates.date_role(_by(k, 6, ["signed on", "announced", "completed", "effective from", "will expire", "on"])).alias("date_role"),
        F.array_join(text.quoted_terms(logic), ",").alias("terms"), grading.demoted(_by(k, 6, ["critical", "high", "medium", "low", "info", "x"])).alias("demoted"),
        text.garbled_text(_by(k, 3, ["plain text", "� �", "营业收入 12"])).alias("garbled"),
    )


_L = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"""WITH x AS (SELECT {_L}, 1 - l_discount AS conf, l_returnflag AS flag, l_extendedprice AS v, l_quantity AS q,
  CASE l_partkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'highlights' WHEN 2 THEN 'quarterly' ELSE 'unknown' END AS a, CASE l_suppkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'quarterly' WHEN 2 THEN 'highlights' ELSE 'unknown' END AS h FROM lineitem)
SELECT {_L}, l_partkey % 2 = 0 OR (conf >= 0.9 AND flag = 'A') AS comparison, l_partkey % 3 <> 1 AND conf >= 0.6 AS key_metric, (a = h AND a <> 'unknown') OR (a IN ('main', 'highlights') AND h IN ('main', 'highlights')) AS compatible,
  a = h AND (l_partkey % 5 = 0 OR l_suppkey % 2 = 0) AND l_partkey % 3 = 0 AS same_scope, l_partkey % 3 = 0 AND l_suppkey % 2 = 0 AND flag = 'A' AS comparable,
  conf >= 0.65 AND l_partkey % 2 = 0 AND l_suppkey % 2 = 0 AS real, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey % 3 = 0 ELSE l_suppkey % 3 <> 2 END AS anchored,
  CASE WHEN l_partkey % 2 = 0 THEN q * 10 < v * 1e4 * 0.1 * 10 AND v * 1e4 - q > 1e6 ELSE q / (v * 1e5) < 0.05 AND v * 1e5 - q > 1e9 END AS magnitude FROM x""")
def gate_rules(t, spark):
    c, p, s = F.col, F.col("l_partkey"), F.col("l_suppkey")
    conf = 1 - c("l_discount")
    a, h = _by(p, 4, ["main", "highlights", "quarterly", "unknown"]), _by(s, 4, ["main", "quarterly", "highlights", "unknown"])
    role = F.when(p % 3 == 0, "main").otherwise("change")
    period = F.when(p % 5 != 0, "2024")
    one = {"role": role, "period": F.lit("2024"), "currency": F.lit(None).cast("string"), "unit": F.lit("k"), "scope": c("l_returnflag")}
    two = {"role": F.lit("main"), "period": F.when(s % 2 == 0, "2024"), "currency": F.lit(None).cast("string"), "unit": F.lit("k"), "scope": F.lit("A")}
    mine = F.array(F.lit("2024"), F.lit("3.5%"))
    yours = _by(s, 3, [F.array(F.lit("3.5%")), F.array(F.lit("2024")), F.array(F.lit("Acme"))])
    kind = F.when(p % 2 == 0, "shares").otherwise("amount")
    big = c("l_extendedprice") * F.when(p % 2 == 0, 1e4).otherwise(1e5)
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", predicates.comparison_item(p % 2 == 0, conf, F.when(c("l_returnflag") == "A", "table").otherwise("text")).alias("comparison"),
        predicates.key_metric(_by(p, 3, ["revenue", "goodwill", "equity"]), c("l_extendedprice"), conf).alias("key_metric"), predicates.contexts_compatible(a, h).alias("compatible"),
        predicates.same_scope_exact(a, h, period, F.when(s % 2 == 0, "2024").otherwise("2023"), role, F.lit("main")).alias("same_scope"), predicates.internally_comparable(one, two).alias("comparable"),
        predicates.real_mismatch(conf, p % 2 == 0, s % 2 == 0, F.lit(True)).alias("real"), predicates.anchored(mine, yours, F.when(p % 2 == 0, "bond").otherwise("loan")).alias("anchored"),
        predicates.magnitude_mismatch(big, c("l_quantity"), kind).alias("magnitude"),
    )


@query("""SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS branch, length(o_orderpriority) >= 0 AND o_orderkey % 3 <> 0 AS material, o_orderkey % 4 = 0 AS shared, o_orderkey % 5 IN (0, 2) AS same_value, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 = 0 ELSE o_orderkey % 3 <> 2 END AS overlap,
  o_orderkey % 3 <> 2 AS tolerated, CASE o_orderkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.85 WHEN 2 THEN 0.75 ELSE 0.45 END::DOUBLE AS confidence, CASE o_orderkey % 4 WHEN 0 THEN 'amount,date' WHEN 1 THEN 'date' WHEN 2 THEN 'amount' ELSE '' END AS labels,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'info' END AS unmatched, 'Revenue: 1,200.00 vs 1,000.00' AS headline, 200.0::DOUBLE AS delta, 16.67::DOUBLE AS percent FROM orders""")
def grade_rules(t, spark):
    k, lit = F.col("o_orderkey"), F.lit
    long = F.when(k % 3 == 0, "Short paragraph").otherwise("During the year, the Company opened new branches in several provinces; it also widened the range of services that it offers to clients.")
    key = F.when(k % 2 == 0, "revenue").otherwise("eps_basic")
    value = F.when(k % 2 == 0, 1000.0).otherwise(2.0)
    other = value * _by(k, 3, [lit(1.0), lit(1.004), lit(1.05)])
    near = _by(k, 3, [F.array(lit(5.0)), F.array(lit(5.0 * 1.005)), F.array(lit(9.0))])
    told = grading.explanation(lit("Revenue"), lit(1200.0), lit(1000.0))
    yes = lambda *rest: k % 4 == rest[0]
    sure = grading.alignment_confidence(_by(k, 4, [lit(9.0), lit(6.0), lit(6.0), lit(6.0)]), yes(2), yes(1) | yes(0), lit(True), lit(0.0))
    return t("orders").select(
        k.alias("k"), predicates.branch_evidence(F.when(k % 2 == 0, "Beijing 75 810,136").otherwise("Beijing 75 810,137"), lit("Beijing"), lit(75), lit(810136.0)).alias("branch"),
        predicates.material(long).alias("material"), predicates.shared_entity(F.array(lit("a"), lit("b")), F.when(k % 4 == 0, F.array(lit("b"))).otherwise(F.array(lit("c")))).alias("shared"),
        predicates.values_match(lit(100.0), _by(k, 5, [lit(100.0), lit(101.0), lit(108.0), lit(120.0), lit(50.0)]), lit("CNY"), F.when(k % 5 == 2, "HKD").otherwise("CNY")).alias("same_value"),
        predicates.sets_overlap(F.array(lit(5.0), lit(70.0)), near, F.when(k % 2 == 0, "shares").otherwise("amount")).alias("overlap"), grading.within_tolerance(value, other, key).alias("tolerated"),
        F.round(sure, 6).alias("confidence"), F.array_join(grading.mismatch_labels({"amount": k % 2 == 0, "date": k % 4 < 2}), ",").alias("labels"), grading.unmatched_paragraph(long).alias("unmatched"),
        told["headline"].alias("headline"), told["delta"].alias("delta"), told["percent"].alias("percent"),
    )


@query("""SELECT conv_id, CAST(sum(turn + 1) AS BIGINT) AS word_count, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS pages, list_aggregate(list_sort(list_distinct(list(role))), 'string_agg', ',') AS keywords, arg_min(role, turn) AS evidence FROM conversations GROUP BY conv_id""")
def narrative_blocks(t, spark):
    b = t("conversations").select("conv_id", (F.col("turn") + 1).alias("word_count"), F.col("turn").alias("page"), F.array("role").alias("keywords"), F.col("role").alias("evidence"), F.col("turn").alias("seq"))
    return aggregates.narratives(b, ["conv_id"]).select("conv_id", "word_count", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), F.array_join("keywords", ",").alias("keywords"), "evidence")


@query("""SELECT l_orderkey AS k, list_aggregate(list_sort(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(list(l_returnflag), x))), 'string_agg', ',') AS missing, round(count(DISTINCT l_returnflag) / 3, 6) AS coverage FROM lineitem GROUP BY l_orderkey""")
def table_sections(t, spark):
    out = aggregates.table_coverage(t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("section")), ["k"], ["A", "N", "R"])
    return out.select("k", F.nullif(F.array_join("missing", ","), F.lit("")).alias("missing"), F.round("coverage", 6).alias("coverage"))


@query("""SELECT l_orderkey AS k, count(*) AS n, count(DISTINCT l_returnflag) AS n_keys, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_returnflag, l_extendedprice, l_partkey) AS parts FROM lineitem GROUP BY l_orderkey""")
def profile_snapshot(t, spark):
    i = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("canonical_key"), F.col("l_extendedprice").alias("value"), F.col("l_partkey").alias("page"))
    return aggregates.profile_summary(i, ["k"]).select("k", "n", "n_keys", F.array_join(F.transform("items", lambda s: s["page"].cast("string")), ",").alias("parts"))


@query("""WITH f AS (SELECT event_id AS pair_id, event_type AS flag FROM events) SELECT pair_id, flag, CASE flag WHEN 'error' THEN 'scan' WHEN 'click' THEN 'input' ELSE 'other' END AS category, CASE flag WHEN 'error' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS severity, flag = 'error' AS blocking FROM f""")
def warning_classes(t, spark):
    table = spark.createDataFrame([("error", "scan", "high", True), ("click", "input", "medium", False)], "flag string, category string, severity string, blocking boolean")
    return aggregates.warnings(t("events").select(F.col("event_id").alias("pair_id"), F.col("event_type").alias("flag")), table).select("pair_id", "flag", "category", "severity", "blocking")


@query("""WITH m AS (SELECT o_orderkey AS diff_id, o_custkey % 50 AS sig FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT o_orderkey AS diff_id, o_custkey % 70 AS sig FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0)
SELECT diff_id, sig FROM (SELECT *, 0 AS o FROM m UNION ALL SELECT *, 1 FROM r) QUALIFY row_number() OVER (PARTITION BY sig ORDER BY o, diff_id) = 1""")
def model_and_pattern_diffs(t, spark):
    o = t("orders")
    model = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("diff_id"), (F.col("o_custkey") % 50).alias("sig"), F.lit("low").alias("severity"))
    found = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("diff_id"), (F.col("o_custkey") % 70).alias("sig"), _by(F.col("o_orderkey"), 3, ["low", "high", "critical"]).alias("severity"))
    return aggregates.merged_diffs(model, found, ["sig"]).select("diff_id", "sig")


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def costly_rows(t, spark):
    return aggregates.demand_selection(t("orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_orderkey", "o_custkey")


@query("""SELECT DISTINCT o_custkey, o_orderstatus, arg_min(o_orderkey, o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus, floor(o_totalprice / 1000)) AS k FROM orders""")
def flat_occurrences(t, spark):
    o = t("orders").withColumn("v", F.floor(F.col("o_totalprice") / 1000))
    return aggregates.pick(o, ["o_custkey", "o_orderstatus", "v"], [F.col("o_orderkey")]).select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("k"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'pdf' WHEN page_id % 3 = 0 THEN 'html' WHEN page_id % 3 = 1 THEN 'pdf' ELSE 'unknown' END AS parser,
  CASE page_id % 3 WHEN 0 THEN url || ' x' WHEN 1 THEN url ELSE url || chr(10) || 'other' END AS merged, page_id % 4 <> 0 AS fresh FROM pages""")
def page_sources(t, spark):
    p = t("pages")
    k = F.col("page_id")
    a = p.select("page_id", F.col("url").alias("text"))
    b = p.select("page_id", _by(k, 3, [F.concat("url", F.lit(" x")), F.concat(F.lit(" "), F.col("url")), "other"]).alias("text"))
    both = readers.merged_pages(a, b, ["page_id"]).select("page_id", F.trim("text").alias("merged"))
    content = F.concat_ws("\n", F.col("page_id").cast("string"), "url").cast("binary")  # pages may share a URL, but no file
    cache = p.where(k % 4 == 0).select(F.concat(F.sha2(content, 256), F.lit("-v1")).alias("key"))
    new = readers.uncached(p.select("page_id", content.alias("content")), cache, "v1").select("page_id", F.lit(True).alias("fresh"))
    parser = readers.route(F.concat("url", _by(k, 3, [".HTML", ".pdf", ".doc"])), F.when(k % 2 == 0, "A").otherwise("H"))
    return p.select("page_id", parser.alias("parser")).join(both, "page_id").join(new, "page_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


@query("""SELECT o_orderkey AS k, 3::BIGINT AS n_rows, 2::BIGINT AS n_cols, o_orderkey % 2 = 0 AS useful, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS value, CASE WHEN o_orderkey % 2 = 0 THEN 0.9::DOUBLE END AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 2024 END AS year FROM orders""")
def table_grids(t, spark):
    """Tables of three rows: a header, a known and an empty or full row; metrics of the useful ones."""
    k = F.col("o_orderkey")
    price = F.format_number("o_totalprice", 2)
    cell = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    grid = F.when(k % 2 == 0, F.array(cell("Item", "2024"), cell("Total assets", price), cell("Odd row", "(5)"))).otherwise(F.array(cell("Item", "x"), cell("", ""), cell("", "")))
    cells = readers.grid_cells(t("orders").select(k.alias("k"), grid.alias("grid")), ["k"], "grid")
    sizes = cells.groupBy("k").agg((F.max("row") + 1).cast("long").alias("n_rows"), (F.max("col") + 1).cast("long").alias("n_cols"))
    useful = readers.useful_tables(cells, ["k"]).select("k", F.lit(True).alias("useful"))
    glossary = spark.createDataFrame([("total assets", "total_assets")], "form string, canonical_key string")
    found = extract.table_metrics(cells, glossary, ["k"]).where("canonical_key = 'total_assets'").select("k", "value", "confidence", F.col("period.year").alias("year"))
    return sizes.join(useful, "k", "left").join(found, "k", "left").withColumn("useful", F.coalesce("useful", F.lit(False)))


@query("""SELECT o_orderkey AS k, 'net_assets' AS canonical_key, CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS value, 'million' AS unit, 'text' AS source FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'cash_on_hand', CAST(printf('%.2f', o_totalprice) AS DOUBLE), 'thousand', 'generic_pattern' FROM orders WHERE o_orderkey % 2 = 1""")
def text_metric_rules(t, spark):
    k, price = F.col("o_orderkey"), F.format_number("o_totalprice", 2)
    said = F.when(k % 2 == 0, F.concat(F.lit("net assets "), price, F.lit(" million"))).otherwise(F.concat(F.lit("cash on hand was RMB "), price, F.lit(" thousand")))
    lines = readers.lines_of(t("orders").select(k.alias("k"), F.concat(F.lit("\n"), said, F.lit("\n  \n")).alias("page")), ["k"], "page")
    glossary = spark.createDataFrame([("net assets", "net_assets")], "form string, canonical_key string")
    known = extract.text_metrics(lines.where(F.col("k") % 2 == 0), glossary, ["k"])
    other = extract.generic_metrics(lines.where(F.col("k") % 2 == 1), ["k"])
    return known.unionByName(other).select("k", "canonical_key", "value", "unit", "source")


@query("""SELECT item_id AS name, seq, CASE seq WHEN 1 THEN 'Scope' ELSE 'Rules' END AS title, CASE seq WHEN 1 THEN 'for all' ELSE text END AS body, CAST(item_id AS VARCHAR) AS id FROM benchmark, (VALUES (1), (2)) v(seq)""")
def knowledge_chunks(t, spark):
    files = t("benchmark").select(F.col("item_id").alias("name"), F.concat(F.lit("---\nid: "), F.col("item_id").cast("string"), F.lit("\n---\n# Scope\nfor all\n# Rules\n"), F.col("text")).alias("text"))
    return readers.chunks(files, "name", "text").select("name", "seq", "title", F.col("body"), F.col("meta")["id"].alias("id"))


@query("""SELECT CAST(o_orderkey AS INTEGER) AS ord, CAST(o_orderkey % 90 AS INTEGER) AS page, o_orderpriority AS topic, CAST(o_totalprice AS VARCHAR) AS original_value, 'R' || CAST(o_orderkey % 5 AS VARCHAR) AS expected_rule_id FROM orders WHERE o_orderkey % 7 <> 0""")
def answer_keys(t, spark):
    k = F.col("o_orderkey")
    page = F.when(k % 7 != 0, F.concat(F.lit("p. "), (k % 90).cast("string"))).otherwise("none")
    rows = t("orders").select(k.alias("No"), page.alias("page_no"), F.col("o_orderpriority").alias("Item"), F.format_string("%.2f", "o_totalprice").alias("original"), F.concat(F.lit("R"), (k % 5).cast("string")).alias("rule"))
    got = readers.answer_key(rows)
    return got.select("ord", "page", "topic", F.regexp_replace("original_value", r"(\.\d)0$|\.00$", "$1").alias("v"), "expected_rule_id").withColumn("original_value", F.when(F.col("v").contains("."), F.col("v")).otherwise(F.concat("v", F.lit(".0")))).drop("v")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS pair_id, CAST(printf('%.2f', o_totalprice + 1000) AS DOUBLE) + CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 10 = 9 THEN -9 ELSE 1 END AS a_value, CAST(printf('%.2f', o_totalprice + 1000) AS DOUBLE) AS h_value, 'high' AS severity FROM orders WHERE o_orderkey % 3 <> 0""")
def overlay_check(t, spark):
    """Two words on one place: the hidden one, and the visible one with the last digit before the point changed; a third of them apart."""
    k, price = F.col("o_orderkey"), F.format_string("%.2f", F.col("o_totalprice") + 1000)
    digit = F.substring(price, -4, 1).cast("int")
    changed = F.concat(F.substring(price, F.lit(1), F.length(price) - 4), ((digit + 1) % 10).cast("string"), F.substring(price, -3, 3))
    o = t("orders").select(F.concat(k.cast("string"), F.lit(":A")).alias("doc_id"), F.lit(1).alias("page"), price.alias("hidden"), changed.alias("visible"), F.when(k % 3 == 0, 300.0).otherwise(0.0).alias("off"))
    word = lambda n, c, off: o.select("doc_id", "page", F.lit(n).alias("word_seq"), F.col(c).alias("text"), (F.lit(10.0) + off).alias("x0"), F.lit(5.0).alias("y0"), (F.lit(50.0) + off).alias("x1"), F.lit(15.0).alias("y1"), F.lit(n).alias("stream_order"))
    words = word(0, "hidden", F.lit(0.0)).unionByName(word(1, "visible", F.col("off")))
    return checks.overlay(words).select("pair_id", "a_value", "h_value", "severity")


@query("""SELECT o_orderkey AS k, 'Total ' || printf('%.2f', o_totalprice) AS line, 'Total' AS label, 8::BIGINT AS stream_order FROM orders""")
def word_lines(t, spark):
    """Two words on a line and one below; spans of the content stream that cover them."""
    o = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.format_string("%.2f", "o_totalprice").alias("n"))
    word = lambda n, s, x, y: o.select("doc_id", "page", F.lit(n).alias("word_seq"), s.alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 30.0).alias("x1"), F.lit(y + 10.0).alias("y1"))
    words = word(1, F.col("n"), 60.0, 0.0).unionByName(word(0, F.lit("Total"), 0.0, 0.0)).unionByName(word(2, F.lit("below"), 0.0, 60.0))
    span = lambda at, y: o.select("doc_id", "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(y).alias("y1"), F.lit(at).cast("long").alias("span_order"))
    order = spatial.stream_order(words, span(2, 20.0).unionByName(span(8, 20.0)).unionByName(span(9, 1.0))).where("word_seq = 1").select("doc_id", "stream_order")
    lines = spatial.line_context(words).where("word_seq = 1").select("doc_id", "line", "label")
    return lines.join(order, "doc_id").select(F.col("doc_id").alias("k"), "line", "label", "stream_order")


@query("""SELECT o_custkey AS pair_id, 'k' || CAST(o_orderkey AS VARCHAR) AS canonical_key, o_totalprice AS a_value, o_totalprice * CASE o_orderkey % 4 WHEN 1 THEN 1.5 ELSE 1 END AS h_value, CASE o_orderkey % 4 WHEN 1 THEN 'critical' ELSE 'high' END AS severity FROM orders WHERE o_orderkey % 4 IN (1, 2)""")
def chart_check(t, spark):
    """Values of charts, tables one page on, texts three pages on: some tables are half as large again, some texts a tenth less."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    point = lambda page, value: t("orders").select(F.col("o_custkey").alias("pair_id"), F.concat(F.lit("k"), k.cast("string")).alias("key"), (k % 50 + page).alias("page"), value.alias("value"))
    out = checks.charts(point(0, v), point(1, v * F.when(k % 4 == 1, 1.5).otherwise(1.0)), point(3, v * F.when(k % 4 == 2, 0.9).otherwise(1.0)))
    return out.select("pair_id", "canonical_key", "a_value", "h_value", "severity")


@query("""WITH b AS (SELECT c_nationkey AS pair_id, c_name AS name, c_custkey, CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 2 = 0 THEN false ELSE true END AS there FROM customer), g AS (SELECT pair_id, count(*) AS na, count(*) FILTER (there) AS nb FROM b GROUP BY 1)
SELECT pair_id, b.name AS canonical_key, CASE WHEN c_custkey % 3 = 1 THEN 'high' ELSE 'low' END AS severity FROM b JOIN g USING (pair_id) WHERE there AND (least(na, nb) < 5 OR nb / least(na, nb) >= 0.6) AND c_custkey % 3 IN (1, 2)""")
def branch_check(t, spark):
    k = F.col("c_custkey")
    rows = lambda side, where, asset: t("customer").where(where).select(F.col("c_nationkey").alias("pair_id"), F.lit(side).alias("side"), k.alias("seq"), F.col("c_name").alias("name"), F.lit(7).alias("n"), asset.alias("asset"))
    a = rows("A", F.lit(True), F.lit(1000.0))
    h = rows("H", ~((F.col("c_nationkey") % 2 == 0) & (k % 2 == 0)), _by(k, 3, [F.lit(1000.0), F.lit(2500.0), F.lit(1100.0)]))
    return checks.branches(a.unionByName(h)).select("pair_id", "canonical_key", "severity")


@query("""SELECT o_custkey AS pair_id, CASE WHEN o_orderkey % 4 = 3 THEN 'cash_equivalents_end' ELSE 'key' || CAST(o_orderkey AS VARCHAR) END AS canonical_key, CAST(printf('%.2f', o_totalprice) AS DOUBLE) * CASE WHEN o_orderkey % 4 = 1 THEN 1.002 ELSE 1.2 END AS a_value, o_totalprice AS h_value, CASE WHEN o_orderkey % 4 = 1 THEN 'medium' ELSE 'high' END AS severity FROM orders WHERE o_orderkey % 4 <> 0""")
def visual_check(t, spark):
    """Values seen on pages against those of their texts: equal ones are silent, keys of one family meet."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    name = lambda cash: F.when(k % 4 == 3, cash).otherwise(F.concat(F.lit("key"), k.cast("string")))
    items = t("orders").select(F.col("o_custkey").alias("pair_id"), F.lit("A").alias("side"), k.alias("seq"), name("cash_equivalents_end").alias("canonical_key"), v.alias("value"), F.lit("2024").alias("period"), k.alias("page"), F.lit(0.9).alias("confidence"))
    seen = t("orders").select(F.col("o_custkey").alias("pair_id"), F.lit("A").alias("side"), name("cash_equivalents").alias("canonical_key"), k.alias("page"), (v * _by(k, 4, [F.lit(1.0), F.lit(1.002), F.lit(1.2), F.lit(1.2)])).alias("value"))
    return checks.key_metrics(items, seen).select("pair_id", "canonical_key", "a_value", "h_value", "severity")


@query("""SELECT c_nationkey AS pair_id, 's' || CAST(c_custkey % 9 AS VARCHAR) AS canonical_key, CASE WHEN c_custkey % 9 % 3 = 1 THEN 'a_only' ELSE 'h_only' END AS status FROM customer WHERE c_custkey % 9 % 3 <> 0 GROUP BY ALL""")
def framework_map(t, spark):
    """Sections of A map to those of H by name; each third of the names is on both sides, on A or on H only."""
    n = F.col("c_custkey") % 9
    rows = lambda side, mark, where: t("customer").where(where).select(F.col("c_nationkey").alias("pair_id"), F.lit(side).alias("side"), F.concat(F.lit(mark), n.cast("string")).alias("section"), F.lit(3).alias("page"))
    mapping = spark.createDataFrame([(f"s{i}", f"h{i}") for i in range(9)], "a_section string, h_section string")
    out = checks.framework(rows("A", "s", n % 3 != 2).unionByName(rows("H", "h", n % 3 != 1)), mapping)
    return out.select("pair_id", "canonical_key", F.col("evidence")[0].alias("status"))


@query("""WITH x AS (SELECT doc_id % 20 AS pair_id, CASE WHEN lang = 'en' THEN 'A' ELSE 'H' END AS side, text FROM documents), r(rule_id, term) AS (VALUES ('R1', 'license'), ('R2', 'password'), ('R3', 'idiot')),
h AS (SELECT pair_id, rule_id, bool_or(side = 'A') AS a, bool_or(side = 'H') AS h FROM x JOIN r ON contains(text, term) GROUP BY ALL) SELECT pair_id, rule_id AS canonical_key, CASE WHEN a THEN 'a_only' ELSE 'h_only' END AS status FROM h WHERE a <> h""")
def depth_rule_terms(t, spark):
    segments = t("documents").select((F.col("doc_id") % 20).alias("pair_id"), F.when(F.col("lang") == "en", "A").otherwise("H").alias("side"), "text")
    rules = spark.createDataFrame([("R1", 'names a "license"'), ("R2", 'names a "password"'), ("R3", 'says "idiot"')], "rule_id string, check_logic string")
    return checks.depth_rules(segments, rules).select("pair_id", "canonical_key", F.col("evidence")[0].alias("status"))


def _told(t, side: str, amount: Column, page: int):
    k = F.col("o_orderkey")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    claim = F.concat(F.lit("The litigation of 海华贸易有限公司 is pending, the claim amount is RMB "), amount.cast("string"), F.lit(" million, heard on 2024-08-"), day, F.lit("."))
    paid = F.concat(F.lit("The Board approved a cash dividend, total dividends amounting to RMB "), amount.cast("string"), F.lit(" million, payable on 2024-05-"), day, F.lit("."))
    said = F.when(k % 3 == 0, paid).when(k % 3 == 1, claim).otherwise("The weather was fair in all of the regions where we work.")
    return t("orders").select(k.alias("pair_id"), F.lit(side).alias("side"), (k % 90 + page).cast("int").alias("page"), F.lit(1).alias("seq"), F.lit("significant_events").alias("section"), said.alias("text"))


@query("""SELECT o_orderkey AS pair_id, CASE o_orderkey % 3 WHEN 0 THEN 'dividend_distribution' ELSE 'litigation' END AS topic, CASE o_orderkey % 3 WHEN 0 THEN 'dividend' ELSE 'litigation' END AS domains,
  CASE o_orderkey % 3 WHEN 0 THEN 'approved,cash dividend,dividend,dividend_distribution' ELSE 'litigation' END AS actions, CASE o_orderkey % 3 WHEN 0 THEN 'approved' ELSE 'pending' END AS statuses, CASE o_orderkey % 3 WHEN 1 THEN '海华贸易有限公司' ELSE '' END AS names,
  CASE o_orderkey % 3 WHEN 0 THEN '2024-05-' ELSE '2024-08-' END || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') AS dates, (o_orderkey % 500 + 100) * 1e6::DOUBLE AS amount, CASE o_orderkey % 3 WHEN 0 THEN 'dividend_total' ELSE 'claim_amount' END AS roles,
  CASE o_orderkey % 3 WHEN 0 THEN 'date=2024-05-' || lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0') ELSE '' END AS identity, CASE o_orderkey % 3 WHEN 0 THEN 8 ELSE 10 END AS strength FROM orders WHERE o_orderkey % 3 <> 2""")
def event_facts(t, spark):
    """Facts, identity and strength of events told of every order; the rest says nothing."""
    e = events.extracted(_told(t, "A", F.col("o_orderkey") % 500 + 100, 1), ["pair_id"])
    s = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return e.select("pair_id", "topic", s("domains"), s("actions"), s("statuses"), s("names"), s("dates"), F.element_at("amounts", 1).alias("amount"), s("roles"), s("identity"), "strength")


@query("""SELECT o_orderkey AS pair_id, 'event' AS diff_type, CASE o_orderkey % 3 WHEN 0 THEN 'dividend_distribution' ELSE 'litigation' END AS canonical_key, (o_orderkey % 500 + 100) * 1e6::DOUBLE AS a_value, (o_orderkey % 500 + 100) * 2e6::DOUBLE AS h_value, 'critical' AS severity, 'real' AS triage
FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'internal_event', CASE o_orderkey % 3 WHEN 0 THEN 'dividend_distribution' ELSE 'litigation' END, (o_orderkey % 500 + 100) * 1e6::DOUBLE, (o_orderkey % 500 + 100) * 3e6::DOUBLE, 'critical', 'real'
FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0""")
def event_check(t, spark):
    """One event a pair on each side; a quarter of the amounts are twice as large in H, a fifth of the A sides contradict themselves further on."""
    k = F.col("o_orderkey")
    base = k % 500 + 100
    again = _told(t, "A", base * 3, 40).where("pair_id % 5 = 0 AND pair_id % 4 <> 0")
    both = _told(t, "A", base, 1).unionByName(_told(t, "H", base * F.when(k % 4 == 0, 2).otherwise(1), 2)).unionByName(again)
    return checks.events(both).select("pair_id", "diff_type", "canonical_key", "a_value", "h_value", "severity", "triage")


@query("""SELECT o_orderkey AS pair_id, 1 AS i, 7 AS j, CASE WHEN o_orderkey % 3 = 0 THEN 2 + 3 + 5 + 2 + 2 ELSE 3 + 2 END::DOUBLE AS score FROM orders WHERE o_orderkey % 3 <> 2""")
def bilingual_alignment(t, spark):
    """One paragraph a side: a page apart across any border with a shared topic and, for some, a section and an action; pages too far apart for the rest."""
    k = F.col("o_orderkey")
    page = (k % 60 + 1).cast("int")
    none = F.array().cast("array<string>")
    given = lambda c, x: F.when(c, F.array(F.lit(x))).otherwise(none)
    unit = lambda lang, n, at: t("orders").select(k.alias("pair_id"), F.lit(lang).alias("lang"), F.lit(n).alias("unit"), at.alias("page"), F.when(k % 3 == 0, "bs").alias("section"), F.lit(1).alias("seq"), none.alias("signals"), given(k % 3 != 2, "loan").alias("topics"), given(k % 3 == 0, "repay").alias("actions"), given(k % 3 == 0, "debt").alias("glossary"))
    rows = unit("zh", 1, page).unionByName(unit("en", 7, page + F.when(k % 3 == 2, 40).otherwise(1)))
    aligned, _, _ = checks.bilingual(rows, t("orders").select(k.alias("pair_id"), F.lit("zh").alias("lang"), F.lit(1).alias("unit"), F.lit("amount").alias("kind"), F.lit("loan").alias("role"), F.col("o_totalprice").alias("value")))
    return aligned.select("pair_id", "i", "j", "score")


@query("""SELECT o_orderkey AS pair_id, o_totalprice AS a_value, o_totalprice * 1.3 AS h_value, 'critical' AS severity FROM orders WHERE o_orderkey % 2 = 0""")
def bilingual_facts(t, spark):
    """Two amounts of one role in paragraphs that match; for every other pair one differs, and equal ones pair first."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    o = t("orders")
    units_ = o.select(k.alias("pair_id"), F.explode(F.array(F.struct(F.lit("zh").alias("lang"), F.lit(1).alias("unit")), F.struct(F.lit("en").alias("lang"), F.lit(5).alias("unit")))).alias("u"), F.lit(3).alias("page"), F.lit("notes").alias("section"), F.lit(1).alias("seq"), F.array(F.lit("s")).alias("signals")).select("pair_id", "u.lang", "u.unit", "page", "section", "seq", "signals")
    fact = lambda lang, unit, value: o.select(k.alias("pair_id"), F.lit(lang).alias("lang"), F.lit(unit).alias("unit"), F.lit("amount").alias("kind"), F.lit("loan").alias("role"), value.alias("value"))
    facts = fact("zh", 1, v).unionByName(fact("zh", 1, v * 50)).unionByName(fact("en", 5, v * 50)).unionByName(fact("en", 5, v * F.when(k % 2 == 0, 1.3).otherwise(1.0)))
    return checks.bilingual(units_, facts)[1].select("pair_id", "a_value", "h_value", "severity")


@query("""SELECT o_orderkey AS pair_id, 'debt' AS canonical_key, 4e6::DOUBLE AS a_value, 5e6::DOUBLE AS h_value, 'critical' AS severity FROM orders WHERE o_orderkey % 2 = 0""")
def bilingual_rows(t, spark):
    """Rows of paired tables: one row agrees, the other differs for every other pair."""
    k = F.col("o_orderkey")
    o = t("orders")
    row = lambda lang, table, n, key, unit, value: o.select(k.alias("pair_id"), F.lit(lang).alias("lang"), F.lit(table).alias("table"), F.lit(n).alias("row"), F.lit(5).alias("page"), F.array(F.lit("bs")).alias("title_keys"), F.array(F.lit(key)).alias("keys"), F.lit(unit).alias("unit"), F.array(value).alias("values"))
    rows = row("zh", "t1", 1, "assets", "百万元", F.lit(10.0)).unionByName(row("zh", "t1", 2, "debt", "百万元", F.lit(4.0))).unionByName(row("en", "e9", 8, "debt", "million", F.when(k % 2 == 0, 5.0).otherwise(4.0))).unionByName(row("en", "e9", 9, "assets", "million", F.lit(10.0)))
    return checks.table_rows(rows)[2].select("pair_id", "canonical_key", "a_value", "h_value", "severity")


@query("""WITH d AS (SELECT c_nationkey AS pair_id, c_custkey % 40 AS g, CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM customer) SELECT pair_id, g, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'low' END AS severity FROM d GROUP BY 1, 2""")
def union_of_checks(t, spark):
    """Differences of several checks with repeated ids: each once, the most severe."""
    c = t("customer")
    part = lambda where: checks._diff(c.where(where).withColumn("pair_id", F.col("c_nationkey")).withColumn("g", F.col("c_custkey") % 40), "x", F.col("g").cast("string"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.when(F.col("c_custkey") % 2 == 0, "high").otherwise("low"), F.lit("real"))
    return checks.all_checks([part("c_custkey % 3 = 0"), part("c_custkey % 3 = 1"), part("c_custkey % 3 = 2")]).select("pair_id", F.col("canonical_key").cast("long").alias("g"), "severity")


@query("""WITH d AS (SELECT c_custkey, c_nationkey AS pair_id, CASE c_custkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM customer)
SELECT 'cards' AS sheet, count(*) AS n FROM d WHERE severity IN ('critical', 'high') UNION ALL SELECT 'evidence', count(*) * 2 FROM d UNION ALL SELECT 'real', count(*) FROM d UNION ALL SELECT 'by_severity', count(DISTINCT severity) FROM d UNION ALL SELECT 'diffs', count(*) FROM d""")
def report_sheets(t, spark):
    c = t("customer").withColumn("pair_id", F.col("c_nationkey"))
    k = F.col("c_custkey")
    found = checks._diff(c, "x", k.cast("string"), F.col("c_acctbal"), F.lit(0.0), _by(k, 4, ["critical", "high", "medium", "low"]), F.lit("real"), F.lit("A:1"), F.lit("H:2"))
    tables = sinks.sheets(found, found.limit(0), found.limit(0))
    out = None
    for name in ("cards", "evidence", "real", "by_severity", "diffs"):
        one = tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("sheet"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'dividend' ELSE 'claim' END AS topic, 1 AS n_facts, CASE o_orderkey % 3 WHEN 0 THEN '2024|The Board' ELSE '2024' END AS signature FROM orders WHERE o_orderkey % 3 <> 2""")
def event_fragments(t, spark):
    told = _told(t, "A", F.col("o_orderkey") % 500 + 100, 1).withColumnRenamed("pair_id", "doc_id")
    found = extract.events(told, ["doc_id"], [("dividend", "dividend"), ("litigation", "claim")])
    return found.select("doc_id", "topic", F.size("facts").alias("n_facts"), F.array_join("signature", "|").alias("signature"))


@query("""SELECT o_orderkey AS k, 'total_assets' AS canonical_key, CAST(printf('%.2f', o_totalprice + 5000) AS DOUBLE) AS value, 0.82::DOUBLE AS confidence FROM orders UNION ALL SELECT o_orderkey, 'net_profit', -CAST(printf('%.2f', o_totalprice + 5000) AS DOUBLE), 0.82::DOUBLE FROM orders""")
def raw_tables(t, spark):
    """Tables as lines: a numbered label, a note number, a year and a value; another label and a value in brackets; a page mark and more."""
    price = F.format_number(F.col("o_totalprice") + 5000, 2)
    page = F.concat(F.lit("Item\n1. Total assets\n12\n2024\n"), price, F.lit("\nNet profit\nA1\n("), price, F.lit(")\n12 / 300\n9,999.00"))
    glossary = spark.createDataFrame([("total assets", "total_assets"), ("net profit", "net_profit")], "form string, canonical_key string")
    return extract.raw_table_metrics(t("orders").select(F.col("o_orderkey").alias("k"), page.alias("text")), glossary, ["k"]).select("k", "canonical_key", "value", "confidence")


@query("""SELECT o_orderkey AS k, 'revenue' AS canonical_key, CAST(printf('%.2f', o_totalprice + 5000) AS DOUBLE) AS value, CAST(printf('%.2f', (o_totalprice + 5000) * 1.02) AS DOUBLE) AS overlaid FROM orders WHERE o_orderkey % 3 = 0""")
def overlaid_tails(t, spark):
    """A third of the pages end in a value 2 % off an item's, a third in the value itself, a third in one far from it."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice") + 5000
    o = t("orders").select(k.alias("k"), F.lit(12).alias("page"), F.concat(F.lit("words of the page 12 / 300\n2024\n"), F.format_number(v * _by(k, 3, [1.02, 1.0, 1.9]), 2)).alias("text"), F.lit("revenue").alias("canonical_key"), F.format_number(v, 2).alias("said"), F.lit(0.9).alias("confidence"), F.lit("mda").alias("section"))
    items = o.select("k", "page", "canonical_key", numbers.parse_number(F.col("said")).alias("value"), "confidence", "section")
    return extract.overlaid_items(items, o.select("k", "page", "text"), ["k"]).select("k", "canonical_key", "value", "overlaid")


@query("""WITH p AS (SELECT DISTINCT o_custkey % 20 AS doc, o_orderkey % 200 + 1 AS page FROM orders), r AS (SELECT DISTINCT o_custkey % 20 AS doc, o_orderkey % 200 + 1 AS page FROM orders WHERE o_orderkey % 5 = 0),
i AS (SELECT o_custkey % 20 AS doc, o_orderkey % 200 + 1 AS page, o_orderstatus, 20 + CASE WHEN o_orderstatus = 'F' THEN 8 ELSE 0 END + CASE WHEN o_orderkey % 200 + 1 > 120 AND o_orderstatus = 'P' THEN 74 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 36 ELSE 34 END + CASE WHEN o_orderkey % 200 + 1 <= 60 THEN 18 ELSE 0 END AS pts FROM orders),
f AS (SELECT doc, min(page) AS page FROM i WHERE page > 120 AND o_orderstatus = 'P' GROUP BY doc), s AS (SELECT doc, page, sum(pts) AS pts FROM i GROUP BY doc, page),
x AS (SELECT p.doc, p.page, CAST(CASE WHEN p.page <= 60 THEN 34 WHEN p.page <= 120 THEN 16 ELSE 4 END + CASE WHEN r.doc IS NOT NULL THEN 55 ELSE 0 END + coalesce(pts, 0) AS DOUBLE) AS score, f.doc IS NOT NULL AS first FROM p LEFT JOIN r ON r.doc = p.doc AND r.page = p.page LEFT JOIN s ON s.doc = p.doc AND s.page = p.page LEFT JOIN f ON f.doc = p.doc AND f.page = p.page)
SELECT doc, page, score FROM x QUALIFY row_number() OVER (PARTITION BY doc ORDER BY first DESC, score DESC, page) <= 24""")
def visual_page_choice(t, spark):
    """The 24 pages of each report to read as images, by points of its items, after the first late page of a late key."""
    k = F.col("o_orderkey")
    o = t("orders").select((F.col("o_custkey") % 20).alias("doc"), (k % 200 + 1).alias("page"), (k % 5 == 0).alias("risky"), F.when(F.col("o_orderstatus") == "P", "inventory").otherwise("goodwill").alias("canonical_key"), F.when(F.col("o_orderstatus") == "F", "table").otherwise("text").alias("source"), F.lit("notes").alias("section"), F.when(k % 2 == 0, "in the income statement").otherwise("the total of all").alias("text"))
    return extract.visual_pages(o.groupBy("doc", "page").agg(F.max("risky").alias("risky")), o, ["doc"]).select("doc", "page", "score")


@query("""WITH s AS (SELECT CAST(conv_id % 20 AS BIGINT) AS doc, CASE turn % 5 WHEN 0 THEN 'corporate_governance' WHEN 1 THEN 'cf' WHEN 2 THEN 'mda' WHEN 3 THEN 'odd' ELSE 'cf' END AS node, turn AS page FROM conversations),
l AS (SELECT doc, node, CASE node WHEN 'corporate_governance' THEN 'governance_and_shareholders' WHEN 'cf' THEN 'financial_statements_tree' WHEN 'mda' THEN 'company_overview' ELSE 'other' END AS parent, min(page) AS first_page, max(page) AS last_page FROM s GROUP BY ALL)
SELECT doc, node, parent, first_page, last_page, 2 AS level FROM l UNION ALL SELECT doc, parent, NULL, min(first_page), max(last_page), 1 FROM l GROUP BY doc, parent""")
def section_tree(t, spark):
    name = _by(F.col("turn"), 5, ["governance", "cfo", "mda", "odd", "cff"])
    s = t("conversations").select((F.col("conv_id") % 20).alias("doc"), extract.section_code(name).alias("section"), F.col("turn").alias("page"))
    return extract.structure(s, ["doc"], extract.SECTION_PARENTS).select("doc", "node", "parent", "first_page", "last_page", "level")


@query("""SELECT DISTINCT o_custkey % 50 AS doc, CASE o_custkey % 50 % 3 WHEN 0 THEN 'RMB million' WHEN 1 THEN 'HK$ thousand' ELSE 'in thousands of USD' END AS unit, CASE o_custkey % 50 % 3 WHEN 0 THEN 1e6 ELSE 1e3 END::DOUBLE AS multiplier, CASE o_custkey % 50 % 3 WHEN 0 THEN 'CNY' WHEN 1 THEN 'HKD' ELSE 'USD' END AS currency FROM orders""")
def report_unit(t, spark):
    """The unit that most pages of a report state; every seventh page states another, some state none."""
    k, doc = F.col("o_orderkey"), F.col("o_custkey") % 50
    own = _by(doc, 3, ["Unit: RMB million", "单位：HK$ thousand", "figures in thousands of USD"])
    said = F.when(k % 7 == 0, "Unit: k").when(k % 7 == 1, "no such statement").otherwise(own)
    pages = t("orders").select(doc.alias("doc"), k.alias("page"), F.concat(F.lit("Report\n"), said, F.lit("\nrest")).alias("text"))
    return extract.report_units(pages, ["doc"])


@query("SELECT o_custkey AS pair_id, o_orderkey AS ord, o_orderkey + 1000000 AS diff_id, 3.0::DOUBLE AS score FROM orders")
def answers_found(t, spark):
    """Planted values and differences found a page on: each meets its own first, though rules alone would match others."""
    from ..operators import matching

    k = F.col("o_orderkey")
    o = t("orders")
    rule = F.concat(F.lit("R-"), (k % 3).cast("string"))
    expected = o.select(F.col("o_custkey").alias("pair_id"), k.alias("ord"), (k % 90).alias("page"), (F.col("o_totalprice") + k).alias("value"), rule.alias("rule_id"))
    found = o.select(F.col("o_custkey").alias("pair_id"), (k + 1000000).alias("diff_id"), (k % 90 + 1).alias("page"), (F.col("o_totalprice") + k).alias("value"), rule.alias("rule"))
    return matching.answer_matches(expected, found)


@query("""SELECT n AS pair_id, zh_units, en_units, least(zh_units, en_units) AS aligned, 1.0::DOUBLE AS coverage FROM (SELECT c_nationkey AS n, count(*) AS zh_units, count(*) FILTER (c_custkey % 2 = 0) AS en_units FROM customer GROUP BY 1) WHERE en_units > 0""")
def bilingual_stats(t, spark):
    """Every paragraph has a signal of its own; half of them have a partner with the same one."""
    k = F.col("c_custkey")
    c = t("customer")
    part = lambda lang, where, n: c.where(where).select(F.col("c_nationkey").alias("pair_id"), F.lit(lang).alias("lang"), (k + n).alias("unit"), (k % 40 + 1).cast("int").alias("page"), k.cast("string").alias("section"), k.alias("seq"), F.array(k.cast("string")).alias("signals"), F.array(k.cast("string")).alias("actions"))
    stats = checks.bilingual(part("zh", F.lit(True), 0).unionByName(part("en", k % 2 == 0, 100000)), spark.createDataFrame([], "pair_id int, lang string, unit long, kind string, role string, value double"))[2]
    return stats.where("en_units > 0").select("pair_id", "zh_units", "en_units", "aligned", "coverage")
