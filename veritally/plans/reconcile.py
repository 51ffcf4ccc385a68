"""Carrier queries over orders and line items: alignment, grading, rules, candidates, dedupe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading, units
from ..functions.text import stable_id
from ..operators import aggregates, joins
from ..operators.rules import compiled
from .registry import query

_LINE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
_H = "SELECT l_orderkey AS k, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(28,6))) AS DOUBLE), 2) AS h_value FROM lineitem GROUP BY l_orderkey"
_GRADE = "CASE WHEN ratio < 0.01 THEN 'low' WHEN ratio < 0.05 THEN 'medium' WHEN ratio < 0.2 THEN 'high' ELSE 'critical' END"
_RECONCILED = f"""
WITH h AS ({_H}), a AS (SELECT o_orderkey AS k, o_totalprice AS a_value FROM orders),
j AS (SELECT coalesce(a.k, h.k) AS k, a_value, h_value, a.k IS NOT NULL AND h.k IS NOT NULL AS both_sides,
             CASE WHEN h.k IS NULL THEN 'a_only' WHEN a.k IS NULL THEN 'h_only' ELSE 'matched' END AS status FROM a FULL JOIN h ON a.k = h.k),
r AS (SELECT *, CASE WHEN both_sides THEN abs(a_value - h_value) / greatest(abs(a_value), abs(h_value), 1e-9) END AS ratio FROM j),
d AS (SELECT k, a_value, h_value, status, round(ratio, 6) AS ratio, CASE WHEN both_sides THEN 'real' ELSE 'unresolved' END AS triage,
             CASE WHEN both_sides THEN {_GRADE} ELSE 'medium' END AS severity FROM r)
"""


def _sides(t):
    a = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    h = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(F.expr(_LINE).cast("decimal(28,6)")).cast("double"), 2).alias("value"))
    return a, h


def _reconciled(t):
    return joins.compare(joins.align(*_sides(t), ["k"]), "a_value", "h_value").withColumn("ratio", F.round("ratio", 6))


@query(_RECONCILED + "SELECT k, a_value, h_value, status, ratio, triage, severity FROM d")
def reconcile_orders(t, spark):
    return _reconciled(t).select("k", "a_value", "h_value", "status", "ratio", "triage", "severity")


@query(_RECONCILED + """SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info,
  count(*) FILTER (triage = 'real') AS real, count(*) FILTER (triage = 'expected') AS expected, count(*) FILTER (triage = 'unresolved') AS unresolved FROM d""")
def reconcile_summary(t, spark):
    return aggregates.summary(_reconciled(t))


@query(_RECONCILED + """, s(severity) AS (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')), g(triage) AS (VALUES ('real'), ('expected'), ('unresolved'))
SELECT s.severity, g.triage, count(d.k) AS n FROM s CROSS JOIN g LEFT JOIN d ON d.severity = s.severity AND d.triage = g.triage GROUP BY 1, 2""")
def triage_matrix(t, spark):
    return aggregates.dense_counts(_reconciled(t), ("severity", list(reversed(grading.RANKS))), ("triage", ["real", "expected", "unresolved"]))


@query(_RECONCILED + "SELECT severity, count(*) AS n, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS severity_rank FROM d GROUP BY severity")
def severity_distribution(t, spark):
    return _reconciled(t).groupBy("severity").agg(F.count("*").alias("n")).withColumn("severity_rank", grading.rank(F.col("severity")))


@query(_RECONCILED + "SELECT k, severity, ratio FROM d WHERE status = 'matched' ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, ratio DESC, k LIMIT 120")
def priority_top120(t, spark):
    return _reconciled(t).where("status = 'matched'").orderBy(grading.rank(F.col("severity")).desc(), F.col("ratio").desc(), "k").select("k", "severity", "ratio").limit(120)


@query(_RECONCILED + """, e AS (SELECT k, severity, unnest([{'side': 'A', 'v': a_value}, {'side': 'H', 'v': h_value}]) AS e FROM d)
SELECT k, severity, e.side AS side, e.v AS value FROM e WHERE e.v IS NOT NULL""")
def evidence_explode(t, spark):
    sides = F.array(F.struct(F.lit("A").alias("side"), F.col("a_value").alias("value")), F.struct(F.lit("H").alias("side"), F.col("h_value").alias("value")))
    return _reconciled(t).select("k", "severity", F.explode(sides).alias("e")).select("k", "severity", "e.*").where("value IS NOT NULL")


@query(_RECONCILED + "SELECT k, 'cov-' || substr(sha1(CAST(k AS VARCHAR) || '|' || status), 1, 12) AS coverage_id, status FROM d WHERE status <> 'matched'")
def coverage_ids(t, spark):
    return _reconciled(t).where("status <> 'matched'").select("k", stable_id("cov-", F.col("k"), F.col("status")).alias("coverage_id"), "status")


_RULES = [
    {"rule_id": "R1", "targets": ["F", "O"], "tolerance": 50.0},
    {"rule_id": "R2", "targets": ["O", "P"], "tolerance": 5000.0},
    {"rule_id": "R0", "targets": ["P"], "tolerance": 1.0, "enabled": False},
]


@query(f"""WITH h AS ({_H}), r(target, ord, rule_id, tolerance) AS (VALUES ('F', 0, 'R1', 50.0), ('O', 0, 'R1', 50.0), ('O', 1, 'R2', 5000.0), ('P', 1, 'R2', 5000.0)),
f AS (SELECT target, arg_min(rule_id, ord) AS rule_id, arg_min(tolerance, ord) AS tolerance FROM r GROUP BY target)
SELECT o_orderkey AS k, f.rule_id, CAST(coalesce(f.tolerance, 0) AS DOUBLE) AS tolerance, abs(o_totalprice - h_value) <= coalesce(f.tolerance, 0) AS within
FROM orders JOIN h ON h.k = o_orderkey LEFT JOIN f ON f.target = o_orderstatus""")
def tolerance_rules(t, spark):
    from ..sources.readers import rules

    _, h = _sides(t)
    both = t("orders").select(F.col("o_orderkey").alias("k"), "o_totalprice", F.col("o_orderstatus").alias("status")).join(h, "k")
    return joins.first_rule(both, rules(spark, _RULES), "status").select("k", "rule_id", "tolerance", (F.abs(F.col("o_totalprice") - F.col("value")) <= F.col("tolerance")).alias("within"))


@query("""SELECT l_orderkey AS k, sum(l_quantity) = coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) + coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0) AS parts_add_up,
  max(l_discount) <= 0.1 AND 0 <= min(l_discount) AS discount_in_range, NOT (count(*) < 1) AS has_lines FROM lineitem GROUP BY l_orderkey""")
def cross_check_rules(t, spark):
    returned = F.col("l_returnflag") == "R"
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("total"), F.sum(F.when(returned, F.col("l_quantity")).otherwise(0.0)).alias("returned"), F.sum(F.when(~returned, F.col("l_quantity")).otherwise(0.0)).alias("kept"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"), F.count("*").alias("n"))
    names = {c: F.col(c) for c in g.columns}
    return g.select("k", compiled("total == returned + kept", names).alias("parts_add_up"), compiled("0 <= low <= high <= 0.1", names).alias("discount_in_range"), compiled("n >= 1", names).alias("has_lines"))


_UNIT_SQL = "CASE p_partkey % 5 WHEN 0 THEN 'RMB million' WHEN 1 THEN 'thousand yuan' WHEN 2 THEN '万元' WHEN 3 THEN '百万元' ELSE NULL END"
_MULT_SQL = "CASE p_partkey % 5 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 WHEN 2 THEN 1e4 WHEN 3 THEN 1e6 ELSE 1 END"


@query(f"SELECT p_partkey, {_UNIT_SQL} AS unit, CAST({_MULT_SQL} AS DOUBLE) AS multiplier, p_retailprice * {_MULT_SQL} AS normalised FROM part")
def unit_normalise(t, spark):
    p = t("part").withColumn("unit", F.expr(_UNIT_SQL))
    return p.select("p_partkey", "unit", units.multiplier(F.col("unit")).alias("multiplier"), units.normalised(F.col("p_retailprice"), F.col("unit")).alias("normalised"))


@query("""WITH m(x) AS (VALUES (1e0), (1e3), (1e4), (1e6), (1e8)), q AS (SELECT DISTINCT a.x / b.x AS q FROM m a CROSS JOIN m b),
p AS (SELECT p_partkey, p_retailprice AS a, p_retailprice * CASE p_partkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1.01 WHEN 2 THEN 10 ELSE 3 END AS h FROM part)
SELECT p_partkey, min(abs(a * q - h) / greatest(abs(a * q), abs(h), 1e-9)) <= 0.02 AS fixed FROM p CROSS JOIN q GROUP BY p_partkey""")
def unit_fix(t, spark):
    p = t("part").select("p_partkey", F.col("p_retailprice").alias("a"), (F.col("p_retailprice") * F.expr("CAST(CASE p_partkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1.01 WHEN 2 THEN 10 ELSE 3 END AS DOUBLE)")).alias("h"))
    return p.select("p_partkey", (units.unit_fix_ratio(F.col("a"), F.col("h")) <= 0.02).alias("fixed"))


_ITEMS = "SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS seq, l_extendedprice AS value, round(1 - l_discount, 2) AS confidence, CASE l_returnflag WHEN 'A' THEN 'table' ELSE 'text' END AS source, CAST(l_suppkey % 20 AS INTEGER) AS page FROM lineitem"


def _items(t):
    return t("lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("value"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), F.when(F.col("l_returnflag") == "A", "table").otherwise("text").alias("source"), (F.col("l_suppkey") % 20).cast("int").alias("page"))


def _picked(order: str, keys: str = "k") -> str:
    return f"WITH i AS ({_ITEMS}) SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


@query(_picked("confidence DESC, source = 'table' DESC, abs(value) DESC, seq, page, value"))
def best_by_key(t, spark):
    return aggregates.best_by_key(_items(t), ["k"], "seq")


@query(_picked("abs(value) DESC, confidence DESC, seq, page, source, value"))
def primary_occurrence(t, spark):
    return aggregates.primary_occurrence(_items(t), ["k"], "seq")


@query(_picked("confidence DESC, seq, source, value", "k, page, round(value, 6)"))
def occurrence_dedupe(t, spark):
    return aggregates.pick(_items(t).withColumn("v6", F.round("value", 6)), ["k", "page", "v6"], [F.col("confidence").desc(), F.col("seq"), F.col("source"), F.col("value")]).drop("v6")


@query(f"""WITH i AS ({_ITEMS}), m AS (SELECT * FROM i QUALIFY confidence = max(confidence) OVER (PARTITION BY k)), c AS (SELECT k, value, count(*) AS n, min(page) AS page FROM m GROUP BY k, value)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, page, value) = 1""")
def modal_value(t, spark):
    return aggregates.modal_value(_items(t), ["k"])


@query(f"""WITH i AS ({_ITEMS}), p AS (SELECT a.k, a.seq AS i, b.seq AS j, a.value AS left_value, b.value AS right_value, abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1e-9) AS ratio, a.page AS lp, b.page AS rp, a.page = b.page AS same_page
  FROM i a JOIN i b ON a.k = b.k AND a.seq < b.seq),
r AS (SELECT * FROM p WHERE round(left_value, 2) <> round(right_value, 2) AND (same_page OR ratio >= 0.05) QUALIFY row_number() OVER (PARTITION BY k ORDER BY i, j, left_value, right_value, lp, rp) <= 3)
SELECT k, i, j, left_value, right_value, CASE WHEN ratio < 0.01 THEN 'info' WHEN ratio < 0.05 THEN 'low' WHEN ratio < 0.2 THEN 'medium' ELSE 'high' END AS severity FROM r""")
def internal_inconsistency(t, spark):
    return joins.internal_pairs(_items(t), "k", "seq", "value", "page").select("k", "i", "j", "left_value", "right_value", "severity")


@query("""WITH c AS (SELECT p_partkey AS k, l_orderkey, l_linenumber,
  round(0.28 * CAST(p_size % 2 = l_linenumber % 2 AS INTEGER) + 0.24 * 0.62 + 0.20 * (1 - l_discount) + 0.12 * CAST(l_linestatus = 'F' AS INTEGER) + 0.08 * CAST(l_returnflag = 'A' AS INTEGER)
  + 0.08 * greatest(0, 1 - least(abs(p_retailprice - l_extendedprice / l_quantity) / greatest(p_retailprice, l_extendedprice / l_quantity, 1e-9), 1)), 9) AS score
  FROM part JOIN lineitem ON p_partkey = l_partkey)
SELECT k, l_orderkey, l_linenumber, score FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, l_orderkey, l_linenumber) = 1""")
def candidate_score_top1(t, spark):
    a = t("part").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice")
    h = t("lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber", "l_discount", "l_linestatus", "l_returnflag", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    yes = lambda c: c.cast("int")
    score = grading.pair_score(yes(F.col("p_size") % 2 == F.col("l_linenumber") % 2), F.lit(0.62), 1 - F.col("l_discount"), yes(F.col("l_linestatus") == "F"), yes(F.col("l_returnflag") == "A"), units.relative_delta(F.col("p_retailprice"), F.col("unit_price")))
    return joins.best_candidates(a, h, "k", F.round(score, 9), [F.col("l_orderkey"), F.col("l_linenumber")]).select("k", "l_orderkey", "l_linenumber", "score")


@query(f"""WITH h AS ({_H}), p AS (SELECT o_orderkey AS k, o_totalprice AS a, h_value * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.001 WHEN 2 THEN 1.007 ELSE 0.1 END AS h,
  CASE WHEN o_orderkey % 4 = 1 THEN 1000 ELSE 1 END AS hm FROM orders JOIN h ON h.k = o_orderkey),
r AS (SELECT *, abs(a - h * hm) / greatest(abs(a), abs(h * hm), 1e-9) AS ratio FROM p), m(x) AS (VALUES (1e0), (1e3), (1e4), (1e6), (1e8)), q AS (SELECT DISTINCT a.x / b.x AS q FROM m a CROSS JOIN m b),
f AS (SELECT k, min(abs(a * q - h) / greatest(abs(a * q), abs(h), 1e-9)) AS fix FROM p CROSS JOIN q GROUP BY k)
SELECT k, CASE WHEN abs(a - h * hm) <= 1 THEN 'direct' WHEN ratio <= 0.005 THEN 'direct' WHEN hm <> 1 AND ratio <= 0.02 THEN 'unit_conversion' WHEN fix <= 0.02 THEN 'unit_fix' WHEN ratio <= 0.01 THEN 'rounding'
  WHEN abs(a - h * hm * 7.2) / greatest(abs(a), abs(h * hm * 7.2), 1e-9) <= 0.05 THEN 'currency_conversion' END AS kind FROM r JOIN f USING (k)""")
def match_kind_ladder(t, spark):
    a, h = _sides(t)
    p = a.join(h.withColumnRenamed("value", "h"), "k").withColumn("h", F.col("h") * F.expr("CAST(CASE k % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.001 WHEN 2 THEN 1.007 ELSE 0.1 END AS DOUBLE)"))
    unit = F.when(F.col("k") % 4 == 1, "thousand")
    return p.select("k", grading.match_kind(F.col("value"), F.col("h"), F.lit(None).cast("string"), unit, F.lit(1.0), F.lit(7.2)).alias("kind"))


@query(f"""WITH h AS ({_H}), p AS (SELECT o_orderkey AS k, o_totalprice AS a, h_value * CASE o_orderkey % 5 WHEN 0 THEN 0.001 WHEN 1 THEN 1.3 ELSE 1 END AS h FROM orders JOIN h ON h.k = o_orderkey), r AS (SELECT *, abs(a - h) / greatest(abs(a), abs(h), 1e-9) AS ratio FROM p),
m(x) AS (VALUES (1e0), (1e3), (1e4), (1e6), (1e8)), q AS (SELECT DISTINCT a.x / b.x AS q FROM m a CROSS JOIN m b), f AS (SELECT k, min(abs(a * q - h) / greatest(abs(a * q), abs(h), 1e-9)) AS fix FROM p CROSS JOIN q GROUP BY k),
x AS (SELECT k, CASE WHEN abs(a - h) <= 100 THEN 'match' WHEN ratio > 0.5 AND fix <= 0.02 THEN 'unit_fix' WHEN ratio <= 0.01 THEN 'rounding' ELSE 'mismatch' END AS kind, ratio FROM r JOIN f USING (k))
SELECT k, kind, CASE WHEN kind = 'mismatch' THEN {_GRADE} WHEN kind <> 'match' THEN 'info' END AS severity, CASE WHEN kind = 'mismatch' THEN 'real' WHEN kind <> 'match' THEN 'expected' END AS triage FROM x""")
def pair_check(t, spark):
    a, h = _sides(t)
    none = F.lit(None).cast("string")
    other = h.withColumn("h", F.col("value") * F.expr("CAST(CASE k % 5 WHEN 0 THEN 0.001 WHEN 1 THEN 1.3 ELSE 1 END AS DOUBLE)")).drop("value")
    return a.join(other, "k").select("k", grading.pair_check(F.col("value"), F.col("h"), none, none, F.lit(100.0)).alias("c")).select("k", "c.kind", "c.severity", "c.triage")


@query("""WITH p AS (SELECT n_regionkey AS g, n_nationkey, CAST(sum(CAST(o_totalprice AS DECIMAL(28,6))) AS DOUBLE) AS a FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT g, CASE WHEN n_nationkey % 3 = 0 THEN 7.2 WHEN n_nationkey % 3 = 1 THEN 7.4 ELSE 1 / (1 / 7.0) END AS r FROM p WHERE a >= 7200),
l AS (SELECT g, list_sort(list(round(r, 6))) AS rs FROM r GROUP BY g HAVING count(*) >= 2), m AS (SELECT g, rs, rs[CAST(floor(len(rs) / 2.0) AS INTEGER) + 1] AS median FROM l),
n AS (SELECT g, median, list_filter(rs, lambda x: abs(x - median) / median <= 0.10) AS near FROM m)
SELECT g, median, len(near) AS n, round(list_avg(near), 6) AS factor FROM n WHERE len(near) >= 3 OR (len(near) = 2 AND list_max(near) / list_min(near) <= 1.04)""")
def currency_factor(t, spark):
    totals = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("g"), "n_nationkey").agg(F.sum(F.col("o_totalprice").cast("decimal(28,6)")).cast("double").alias("a_norm"))
    rate = F.when(F.col("n_nationkey") % 3 == 0, 7.2).when(F.col("n_nationkey") % 3 == 1, 7.4).otherwise(1 / 7.0)
    out = aggregates.currency_factor(totals.withColumn("h_norm", F.col("a_norm") / rate), ["g"])
    return out.select("g", F.round("median", 6).alias("median"), F.col("n").cast("long").alias("n"), F.round("factor", 6).alias("factor"))


@query(f"""WITH i AS ({_ITEMS}), a AS (SELECT k, seq, value FROM i WHERE source = 'table'), h AS (SELECT k, seq, value FROM i WHERE source = 'text'),
p AS (SELECT a.k, a.seq AS a_seq, h.seq AS h_seq, abs(a.value - h.value) / greatest(abs(a.value), abs(h.value), 1e-9) AS ratio FROM a JOIN h ON a.k = h.k)
SELECT k, a_seq, h_seq, CASE WHEN ratio <= 0.005 THEN 'medium' ELSE 'high' END AS severity FROM p WHERE ratio > 0 AND ratio <= 0.01 QUALIFY row_number() OVER (PARTITION BY k ORDER BY ratio, a_seq, h_seq) <= 8""")
def exact_top8(t, spark):
    i = _items(t)
    side = lambda s, p: i.where(F.col("source") == s).select("k", F.col("seq").alias(p + "_seq"), F.col("value").alias(p))
    return joins.exact_mismatches(side("table", "a"), side("text", "h"), "k", "a", "h", ["a_seq", "h_seq"]).select("k", "a_seq", "h_seq", "severity")


@query("""WITH a AS (SELECT s_nationkey AS name, count(*) % 3 AS n, round(CAST(sum(CAST(s_acctbal AS DECIMAL(28,6))) AS DOUBLE), 2) AS asset FROM supplier GROUP BY 1),
h AS (SELECT c_nationkey AS name, count(*) % 3 AS n, round(CAST(sum(CAST(c_acctbal AS DECIMAL(28,6))) AS DOUBLE), 2) AS asset FROM customer GROUP BY 1),
b AS (SELECT a.name, a.n AS an, h.n AS hn, a.asset AS a_asset, h.asset AS h_asset FROM a JOIN h USING (name)),
g AS (SELECT least((SELECT count(*) FROM a), (SELECT count(*) FROM h)) AS small, (SELECT count(*) FROM b) AS matched),
p AS (SELECT name, a_asset, h_asset, abs(a_asset - h_asset) / greatest(abs(a_asset), abs(h_asset), 1e-9) * 100 AS pct FROM b CROSS JOIN g WHERE (small < 5 OR matched / small >= 0.6) AND an = hn AND a_asset <> h_asset)
SELECT name, a_asset, h_asset, CASE WHEN pct > 50 THEN 'high' WHEN pct > 20 THEN 'medium' WHEN pct > 5 THEN 'low' ELSE 'info' END AS severity FROM p""")
def branch_gate(t, spark):
    side = lambda df, p: df.groupBy(F.col(p + "_nationkey").alias("name")).agg((F.count("*") % 3).alias("n"), F.round(F.sum(F.col(p + "_acctbal").cast("decimal(28,6)")).cast("double"), 2).alias("asset"))
    return joins.gated_branches(side(t("supplier"), "s"), side(t("customer"), "c"), "name", "n", "asset").select("name", "a_asset", "h_asset", "severity")


@query("""WITH d AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, CASE WHEN count(*) % 2 = 0 THEN 'A' ELSE 'H' END AS missing_side FROM customer GROUP BY 1, 2)
SELECT nation, segment, missing_side, segment = 'BUILDING' AND missing_side = 'A' OR segment = 'MACHINERY' AS expected, CASE WHEN segment = 'BUILDING' AND missing_side = 'A' THEN 'local rule' WHEN segment = 'MACHINERY' THEN 'both regimes' END AS rationale FROM d""")
def expected_whitelist(t, spark):
    diffs = t("customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.when(F.count("*") % 2 == 0, "A").otherwise("H").alias("missing_side"))
    known = spark.createDataFrame([("BUILDING", "A", "local rule"), ("MACHINERY", "A", "both regimes"), ("MACHINERY", "H", "both regimes")], "segment string, missing_side string, rationale string")
    return joins.whitelisted(diffs, known, "segment").select("nation", "segment", "missing_side", "expected", "rationale")


@query("""WITH i AS (SELECT l_orderkey AS k, l_extendedprice AS v1, l_quantity AS v2 FROM lineitem), o AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 2 = 0 THEN l_extendedprice * 10 ELSE l_quantity END AS w1, CASE WHEN l_orderkey % 2 = 0 THEN l_quantity * 10 ELSE l_extendedprice * 3 END AS w2 FROM lineitem WHERE l_orderkey % 3 <> 0)
SELECT i.k, v1, v2 FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = i.k AND (
  (abs(log10(v1 / w1) - round(log10(v1 / w1))) < 1e-9 AND abs(log10(v1 / w1) - log10(v2 / w2)) < 1e-9) OR (abs(log10(v1 / w2) - round(log10(v1 / w2))) < 1e-9 AND abs(log10(v1 / w2) - log10(v2 / w1)) < 1e-9)))""")
def shadow_anti(t, spark):
    first = t("lineitem")
    internal = first.select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v1"), F.col("l_quantity").alias("v2"))
    even = F.col("l_orderkey") % 2 == 0
    overlay = first.where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("k"), F.when(even, F.col("l_extendedprice") * 10).otherwise(F.col("l_quantity")).alias("w1"), F.when(even, F.col("l_quantity") * 10).otherwise(F.col("l_extendedprice") * 3).alias("w2"))
    return joins.without_shadows(internal, overlay, ["k"]).select("k", "v1", "v2")


@query("""WITH a AS (SELECT o_custkey AS k, CAST(count(*) AS DOUBLE) AS va FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, CAST(10 + c_nationkey AS DOUBLE) AS vb FROM customer), c AS (SELECT s_suppkey AS k, 11.0 AS vc FROM supplier),
j AS (SELECT k, va, vb, CAST(vc AS DOUBLE) AS vc FROM a FULL JOIN b USING (k) FULL JOIN c USING (k))
SELECT k, va, vb, vc FROM j WHERE (greatest(va, vb, vc) - least(va, vb, vc)) / greatest(abs(greatest(va, vb, vc)), 1e-9) > 0.01""")
def three_way_check(t, spark):
    a = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("double").alias("va"))
    b = t("customer").select(F.col("c_custkey").alias("k"), (10 + F.col("c_nationkey")).cast("double").alias("vb"))
    c = t("supplier").select(F.col("s_suppkey").alias("k"), F.lit(11.0).alias("vc"))
    return joins.three_way(a, b, c, "k").select("k", "va", "vb", "vc")


@query("""SELECT c_nationkey AS k, 'A' AS side FROM (SELECT DISTINCT round(c_acctbal) AS c_nationkey FROM customer) WHERE c_nationkey NOT IN (SELECT round(s_acctbal) FROM supplier)
UNION ALL SELECT s_nationkey, 'H' FROM (SELECT DISTINCT round(s_acctbal) AS s_nationkey FROM supplier) WHERE s_nationkey NOT IN (SELECT round(c_acctbal) FROM customer)""")
def one_sided_keys(t, spark):
    return joins.one_sided(t("customer").select(F.round("c_acctbal").alias("k")), t("supplier").select(F.round("s_acctbal").alias("k")), "k")


def metric_items(t):
    """Items of both sides: each part is a key, each nation of suppliers a pair of reports; H values differ for some."""
    base = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    common = [F.col("s_nationkey").alias("pair_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("key_"), (F.col("l_partkey") % 40).cast("string")).alias("canonical_key")]
    rest = [F.lit(None).cast("string").alias("unit"), F.lit("CNY").alias("currency"), F.date_format("l_shipdate", "yyyy").alias("period"), (F.col("l_suppkey") % 20).cast("int").alias("page"), F.lit("main").alias("context"), (1 - F.col("l_discount")).alias("confidence"), F.when(F.col("l_suppkey") % 2 == 0, "table").otherwise("text").alias("source")]
    key = F.concat(F.lit("key_"), (F.col("l_partkey") % 40).cast("string"))
    named = lambda other: F.when(F.col("l_partkey") % 3 == 0, other).when(F.col("l_partkey") % 3 == 1, key).alias("name")
    a = base.where("l_linenumber % 2 = 1").select(*common, F.lit("A").alias("side"), F.col("l_extendedprice").alias("value"), *rest, named("aaaa"))
    h = base.where("l_linenumber % 2 = 0").select(*common, F.lit("H").alias("side"), F.col("l_extendedprice").alias("value"), *rest, named("bbbb"))
    return a.unionByName(h)


_ITEM_SQL = """b AS (SELECT s_nationkey AS pair_id, l_orderkey * 10 + l_linenumber AS seq, 'key_' || CAST(l_partkey % 40 AS VARCHAR) AS k, CASE l_linenumber % 2 WHEN 1 THEN 'A' ELSE 'H' END AS side,
  l_extendedprice AS value, strftime(l_shipdate, '%Y') AS period, l_suppkey % 20 AS page, 1 - l_discount AS confidence, l_partkey % 3 AS m, CASE WHEN l_suppkey % 2 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS src FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"""WITH {_ITEM_SQL}, u AS (SELECT * FROM b WHERE NOT (value BETWEEN 1990 AND 2035 OR (abs(value) > 0 AND abs(value) < 50))),
j AS (SELECT a.pair_id, a.k, a.seq AS i, h.seq AS j, a.value AS av, h.value AS hv, abs(a.value - h.value) / greatest(abs(a.value), abs(h.value), 1e-9) AS ratio, (a.confidence + h.confidence) / 2 AS conf, CASE WHEN a.period = h.period THEN 1.0 ELSE 0.0 END::DOUBLE AS per, a.src + h.src AS src,
  greatest(CASE WHEN a.m <> 0 AND h.m <> 0 THEN 1 ELSE 0 END, CASE CAST(a.m = 1 AS INTEGER) + CAST(h.m = 1 AS INTEGER) WHEN 2 THEN 0.92 WHEN 1 THEN 0.72 ELSE 0.62 END)::DOUBLE AS label
  FROM u a JOIN u h ON a.pair_id = h.pair_id AND a.k = h.k WHERE a.side = 'A' AND h.side = 'H'),
s AS (SELECT *, 0.28::DOUBLE + 0.24::DOUBLE * label + 0.20::DOUBLE * conf + 0.12::DOUBLE * per + 0.08::DOUBLE * src + 0.08::DOUBLE * greatest(0::DOUBLE, 1 - least(ratio, 1)) AS score FROM j),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pair_id, k ORDER BY score DESC, i, j) = 1),
r AS (SELECT pair_id, CASE WHEN av / hv BETWEEN 4 AND 10 THEN av / hv WHEN av / hv BETWEEN 0.10 AND 0.25 THEN hv / av END AS r FROM best WHERE av >= 1000 AND hv >= 1000),
l AS (SELECT pair_id, list_sort(list(r)) AS rs FROM r WHERE r IS NOT NULL GROUP BY pair_id HAVING count(*) >= 2), m AS (SELECT *, rs[CAST(floor(len(rs) / 2.0) AS INTEGER) + 1] AS median FROM l),
n AS (SELECT pair_id, list_filter(rs, lambda x: abs(x - median) / median <= 0.10) AS near FROM m), f AS (SELECT pair_id, list_avg(near) AS factor FROM n WHERE len(near) >= 3 OR (len(near) = 2 AND list_max(near) / list_min(near) <= 1.04)),
x(x) AS (VALUES (1e0), (1e3), (1e4), (1e6), (1e8)), q AS (SELECT list(DISTINCT a.x / b.x) AS qs FROM x a CROSS JOIN x b),
ok AS (SELECT DISTINCT s.pair_id, s.k FROM s CROSS JOIN q LEFT JOIN f ON f.pair_id = s.pair_id WHERE abs(av - hv) <= CASE WHEN s.k IN ('key_1', 'key_2') THEN 100 ELSE 0 END OR ratio <= 0.01
  OR list_min(list_transform(qs, lambda y: abs(av * y - hv) / greatest(abs(av * y), abs(hv), 1e-9))) <= 0.02 OR coalesce(abs(av - hv * factor) / greatest(abs(av), abs(hv * factor), 1e-9) <= 0.05, false)),
o AS (SELECT *, conf >= 0.88 AND per >= 0.5 AND src >= 0.5 AND label >= 0.62 AND score >= 0.72 AS sure FROM best WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.pair_id = best.pair_id AND ok.k = best.k))
SELECT pair_id, 'numeric' AS diff_type, k AS canonical_key, av AS a_value, hv AS h_value, CASE WHEN sure THEN 'real' ELSE 'unresolved' END AS triage,
  CASE WHEN NOT sure AND ratio >= 0.05 THEN 'medium' ELSE {_GRADE} END AS severity FROM o""")
def numeric_check(t, spark):
    from ..sources.readers import rules
    from .checks import numeric

    return numeric(metric_items(t), rules(spark, [{"rule_id": "R1", "targets": ["key_1", "key_2"], "tolerance": 100.0}])).drop("evidence", "diff_id")


@query(f"""WITH {_ITEM_SQL}, p AS (SELECT a.pair_id, a.side, a.k, a.period, a.seq AS i, c.seq AS j, a.value AS lv, c.value AS rv, a.page AS lp, c.page AS rp, a.page = c.page AS same_page, abs(a.value - c.value) / greatest(abs(a.value), abs(c.value), 1e-9) AS ratio
  FROM b a JOIN b c ON a.pair_id = c.pair_id AND a.side = c.side AND a.k = c.k AND a.period = c.period AND a.seq < c.seq),
r AS (SELECT * FROM p WHERE round(lv, 2) <> round(rv, 2) AND (same_page OR ratio >= 0.05) QUALIFY row_number() OVER (PARTITION BY pair_id, side, k, period ORDER BY i, j, lv, rv, lp, rp) <= 3)
SELECT pair_id, 'internal' AS diff_type, k AS canonical_key, lv AS a_value, rv AS h_value, CASE side WHEN 'H' THEN 'unresolved' ELSE 'real' END AS triage,
  CASE WHEN ratio < 0.01 THEN 'info' WHEN ratio < 0.05 THEN 'low' WHEN ratio < 0.2 OR side = 'H' THEN 'medium' ELSE 'high' END AS severity FROM r""")
def disclosure_check(t, spark):
    from .checks import disclosure

    return disclosure(metric_items(t)).drop("evidence", "diff_id")


@query("""WITH p AS (SELECT s_nationkey AS pair_id, 'key' || CAST(p_size % 9 AS VARCHAR) AS topic, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'H' END AS side, p_size AS words FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
a AS (SELECT pair_id, topic, CAST(sum(words) AS DOUBLE) AS w FROM p WHERE side = 'A' GROUP BY ALL), h AS (SELECT pair_id, topic, CAST(sum(words) AS DOUBLE) AS w FROM p WHERE side = 'H' GROUP BY ALL),
j AS (SELECT coalesce(a.pair_id, h.pair_id) AS pair_id, coalesce(a.topic, h.topic) AS canonical_key, a.w AS a_value, h.w AS h_value, greatest(a.w, h.w) / least(a.w, h.w) AS ratio, a.w IS NOT NULL AND h.w IS NOT NULL AS m FROM a FULL JOIN h ON a.pair_id = h.pair_id AND a.topic = h.topic),
d AS (SELECT *, CASE WHEN a_value IS NULL THEN 'A' WHEN h_value IS NULL THEN 'H' WHEN a_value < h_value THEN 'A' ELSE 'H' END AS less FROM j WHERE NOT m OR ratio > 1.8)
SELECT pair_id, canonical_key, a_value, h_value, CASE WHEN canonical_key = 'key3' AND less = 'A' THEN 'expected' WHEN m AND ratio <= 3 THEN 'unresolved' ELSE 'real' END AS triage, CASE WHEN canonical_key = 'key3' AND less = 'A' THEN 'info' ELSE 'low' END AS severity FROM d""")
def coverage_check(t, spark):
    from .checks import coverage

    rows = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    topics = rows.select(F.col("s_nationkey").alias("pair_id"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("H").alias("side"), F.concat(F.lit("key"), (F.col("p_size") % 9).cast("string")).alias("topic"), F.col("p_size").alias("words"), F.lit(1).alias("page"))
    known = spark.createDataFrame([("key3", "A", "local")], "topic string, missing_side string, rationale string")
    return coverage(topics, known).select("pair_id", "canonical_key", "a_value", "h_value", "triage", "severity")
