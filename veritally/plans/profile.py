"""Carrier queries of value roles, contexts, keywords, headers, the comparison summary and the one-pass profile."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..operators import aggregates, profile, roles, windows
from .registry import query
from .terms import LETTERS, SIMPLE, TRADITIONAL


def _of(column: str | Column, table: dict[str, str], other: str = "") -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when((F.col(column) if isinstance(column, str) else column) == k, v).otherwise(out)
    return out


def _sql(column: str, table: dict[str, str], other: str = "") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


_HEADER = {"1": "2024 年末", "2": "Book value", "3": "附註", "4": "利息收入"}
_SECTION = {"1": "bs", "2": "equity_statement", "3": "parent_company", "4": "notes", "5": "cf", "6": "cash_flow_reconciliation"}
_CONTEXT = {"A": "處置固定資產 收益", "N": "Depreciation of plant", "R": "Opening balance, restricted"}
_STATUS = {"O": "外币折算", "F": ""}


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {_sql('CAST(l_linenumber AS VARCHAR)', _HEADER, 'other')} AS h, {_sql('CAST(month(l_shipdate) AS VARCHAR)', _SECTION, 'pl')} AS sec, {_sql('l_returnflag', _CONTEXT)} || ' ' || {_sql('l_linestatus', _STATUS)} || CASE WHEN l_quantity > 40 THEN ' 31 December 2023' WHEN l_quantity < 5 THEN ' 本年发生额' ELSE '' END AS ctx, l_quantity FROM lineitem),
r AS (SELECT *, CASE WHEN h = '附註' THEN 'note_reference' WHEN l_quantity > 40 THEN 'prior_period_balance' WHEN sec = 'parent_company' THEN 'parent_company_distribution_component' WHEN sec = 'equity_statement' THEN 'equity_statement_component' WHEN sec = 'cash_flow_reconciliation' THEN 'cash_flow_reconciliation_component'
  WHEN contains(ctx, 'Depreciation') THEN 'depreciation_component' WHEN l_quantity < 5 AND l_partkey % 2 = 0 THEN 'current_period_detail' WHEN contains(ctx, '處置') THEN 'disposal_gain_loss' WHEN contains(ctx, 'Opening') THEN 'opening_balance' WHEN h = 'Book value' AND contains(ctx, 'restricted') THEN 'restricted_book_value'
  WHEN contains(ctx, '外币') THEN 'foreign_currency_translation' WHEN h = '利息收入' THEN 'interest_component' ELSE 'main_value' END AS value_role FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, value_role, count(*) AS n FROM r GROUP BY ALL""")
def value_role_rules(t, spark):
    """Headers, sections and contexts in both scripts and both languages, several rules met by most rows."""
    extra = F.when(F.col("l_quantity") > 40, " 31 December 2023").when(F.col("l_quantity") < 5, " 本年发生额").otherwise("")
    items = t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", _of(F.col("l_linenumber").cast("string"), _HEADER, "other").alias("header"), _of(F.month("l_shipdate").cast("string"), _SECTION, "pl").alias("section"),
        F.concat(_of("l_returnflag", _CONTEXT), F.lit(" "), _of("l_linestatus", _STATUS), extra).alias("context"), F.when(F.col("l_partkey") % 2 == 0, "1 2,000 3.5").otherwise("1 and 2").alias("snippet"), F.lit("2024").alias("period"),
    )
    return roles.value_roles(items).groupBy("l_orderkey", "l_linenumber", "l_partkey", "value_role").agg(F.count("*").alias("n"))


_PLACES = {"1-URGENT": "share_changes", "2-HIGH": "bs", "3-MEDIUM": "mda", "4-NOT SPECIFIED": "notes"}


@query(f"""WITH x AS (SELECT o_orderkey, {_sql('o_orderpriority', _PLACES, 'risk')} AS sec, o_custkey % 2 = 0 AS a, o_custkey % 3 = 0 AS b, o_custkey % 5 = 0 AS c, o_custkey % 7 = 0 AS d FROM orders)
SELECT o_orderkey, CASE WHEN sec = 'bs' THEN 'main_statement' WHEN a THEN 'parent_company' WHEN b THEN 'financial_instruments' WHEN sec = 'share_changes' OR c THEN 'share_changes' WHEN d THEN 'main_statement' ELSE 'unknown' END AS context FROM x""")
def context_rules(t, spark):
    """Contexts of which several are told at once."""
    k = F.col("o_custkey")
    text = F.concat_ws("，", F.when(k % 7 == 0, "合併資產負債表"), F.when(k % 5 == 0, "前十名股東"), F.when(k % 3 == 0, "Fair Value"), F.when(k % 2 == 0, "母公司 "))
    return roles.contexts(t("orders").select("o_orderkey", _of("o_orderpriority", _PLACES, "risk").alias("section"), text.alias("text"))).select("o_orderkey", "context")


_HALF = LETTERS[:13]


@query(f"""WITH d AS (SELECT doc_id, translate(lower(text), '{_HALF}', '{SIMPLE[:13]}') AS s, lower(text) AS low FROM documents),
c AS (SELECT doc_id, [{", ".join(f"regexp_extract_all(s, '[一-龥]{{{n}}}')" for n in range(6, 1, -1))}, regexp_extract_all(translate(low, '{_HALF}', '{SIMPLE[:13]}'), '[a-z]{{3,}}')] AS parts FROM d), f AS (SELECT doc_id, flatten(parts) AS ws FROM c),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM f), n AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM w GROUP BY ALL)
SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM n QUALIFY rank <= 20""")
def unsegmented_keywords(t, spark):
    """Half of the letters as Chinese characters: pieces of each length, and the Latin words between them."""
    docs = t("documents").select("doc_id", F.translate(F.lower("text"), _HALF, TRADITIONAL[:13]).alias("text"))
    return profile.keywords(docs, ["doc_id"], "text").select("doc_id", "word", "n", F.col("rank").cast("long").alias("rank"))


@query("""WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS row, CAST(length(text) % 3 AS BIGINT) AS col, CASE WHEN length(text) % 5 = 0 THEN '  ' ELSE text END AS text FROM conversations)
SELECT conv_id, row, col, md5(coalesce(string_agg(CASE WHEN length(trim(text)) > 0 THEN trim(text) END, ' ') OVER (PARTITION BY conv_id, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS header FROM c""")
def column_headers(t, spark):
    c = t("conversations").select("conv_id", F.col("turn").alias("row"), (F.length("text") % 3).cast("long").alias("col"), F.when(F.length("text") % 5 == 0, "  ").otherwise(F.col("text")).alias("s"))
    return windows.column_texts(c, ["conv_id"], "row", "col", "s").select("conv_id", "row", "col", F.md5(F.col("header").cast("binary")).alias("header"))


_TRIAGE = {"O": "real", "F": "expected"}
_RULES = {"1-URGENT": "low_confidence_candidate", "2-HIGH": "event_fact_match", "3-MEDIUM": "context_mismatch", "4-NOT SPECIFIED": "key_metric_exact_mismatch"}
_KINDS = {"1": "event", "2": "event", "3": "topic"}
_STATES = {"A": "a_only", "R": "h_only"}


@query(f"""WITH d AS (SELECT o_custkey AS pair_id, {_sql('o_orderstatus', _TRIAGE, 'unresolved')} AS triage, {_sql('o_orderpriority', _RULES, 'text_overlay_tamper')} AS rule_id, CASE WHEN o_orderkey % 4 = 0 THEN 'internal' ELSE 'numeric' END AS diff_type, CASE o_orderkey % 3 WHEN 0 THEN 'cross_report' WHEN 1 THEN 'a_internal' ELSE 'h_internal' END AS scope FROM orders),
v AS (SELECT l_suppkey AS pair_id, {_sql('CAST(l_linenumber AS VARCHAR)', _KINDS, 'metric')} AS category, {_sql('l_returnflag', _STATES, 'matched')} AS status FROM lineitem), w AS (SELECT c_custkey AS pair_id, CASE WHEN c_nationkey % 2 = 0 THEN 'A' ELSE 'H' END AS side, c_acctbal < 0 AS blocking, CASE WHEN c_nationkey < 5 THEN 'auxiliary_chart' ELSE 'core' END AS category FROM customer),
f AS (SELECT l_suppkey AS pair_id, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'H' END AS side, l_partkey AS k FROM lineitem), b AS (SELECT p_partkey AS pair_id, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'H' END AS side FROM part),
k AS (SELECT pair_id FROM d UNION SELECT pair_id FROM v UNION SELECT pair_id FROM w UNION SELECT pair_id FROM f UNION SELECT pair_id FROM b),
dd AS (SELECT pair_id, count(*) AS total_diff_count, count(*) FILTER (triage = 'real') AS real_diff_count, count(*) FILTER (triage = 'expected') AS expected_diff_count, count(*) FILTER (triage = 'unresolved') AS unresolved_diff_count, {", ".join(f"count(*) FILTER (rule_id = '{r}') AS {n}" for n, r in aggregates.RULE_COUNTS.items())},
  count(*) FILTER (diff_type = 'internal') AS internal_inconsistency_count, {", ".join(f"count(*) FILTER (scope = '{s}') AS {n}" for n, s in aggregates.SCOPES.items())} FROM d GROUP BY 1),
vv AS (SELECT pair_id, count(*) AS coverage_count, count(*) FILTER (category = 'event' AND status = 'matched') AS matched_event_count, count(*) FILTER (status = 'a_only') AS a_only_count, count(*) FILTER (status = 'h_only') AS h_only_count FROM v GROUP BY 1),
ww AS (SELECT pair_id, count(*) AS warning_count, count(*) FILTER (blocking) AS blocking_warning_count, count(*) FILTER (blocking) AS core_warning_count, count(*) FILTER (category = 'auxiliary_chart') AS aux_warning_count, count(*) FILTER (side = 'A') AS a_warning_count, count(*) FILTER (side = 'H') AS h_warning_count FROM w GROUP BY 1),
ff AS (SELECT pair_id, count(*) FILTER (side = 'A') AS a_fact_count, count(*) FILTER (side = 'H') AS h_fact_count, count(DISTINCT k) FILTER (side = 'A') AS a_metric_keys, count(DISTINCT k) FILTER (side = 'H') AS h_metric_keys FROM f GROUP BY 1),
bb AS (SELECT pair_id, count(*) FILTER (side = 'A') AS a_narrative_blocks, count(*) FILTER (side = 'H') AS h_narrative_blocks FROM b GROUP BY 1)
SELECT pair_id, coalesce(COLUMNS(* EXCLUDE (pair_id)), 0) FROM (SELECT * FROM k LEFT JOIN dd USING (pair_id) LEFT JOIN vv USING (pair_id) LEFT JOIN ww USING (pair_id) LEFT JOIN ff USING (pair_id) LEFT JOIN bb USING (pair_id))""")
def comparison_summary(t, spark):
    """All counts of a comparison, by pair."""
    side = lambda even: F.when(even, "A").otherwise("H").alias("side")
    k = F.col("o_orderkey")
    return aggregates.comparison_summary(
        t("orders").select(F.col("o_custkey").alias("pair_id"), _of("o_orderstatus", _TRIAGE, "unresolved").alias("triage"), _of("o_orderpriority", _RULES, "text_overlay_tamper").alias("rule_id"), F.when(k % 4 == 0, "internal").otherwise("numeric").alias("diff_type"), F.when(k % 3 == 0, "cross_report").when(k % 3 == 1, "a_internal").otherwise("h_internal").alias("scope")),
        t("lineitem").select(F.col("l_suppkey").alias("pair_id"), _of(F.col("l_linenumber").cast("string"), _KINDS, "metric").alias("category"), _of("l_returnflag", _STATES, "matched").alias("status")),
        t("customer").select(F.col("c_custkey").alias("pair_id"), side(F.col("c_nationkey") % 2 == 0), (F.col("c_acctbal") < 0).alias("blocking"), F.when(F.col("c_nationkey") < 5, "auxiliary_chart").otherwise("core").alias("category")),
        t("lineitem").select(F.col("l_suppkey").alias("pair_id"), side(F.col("l_linenumber") % 2 == 0), F.col("l_partkey").alias("canonical_key")),
        t("part").select(F.col("p_partkey").alias("pair_id"), side(F.col("p_size") % 2 == 0)),
    )


@query("""WITH s AS (SELECT source AS report, doc_id AS page, doc_id AS seq, CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'de' THEN 'notes' WHEN lang = 'es' THEN 'mda' ELSE 'bs' END AS section, text FROM documents)
SELECT report, 'narrative' AS part, coalesce(section, 'other') AS name, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size, min(page) AS first_page FROM s GROUP BY ALL
UNION ALL SELECT report, 'structure', section, max(page), NULL, min(page) FROM s WHERE section IS NOT NULL GROUP BY report, section""")
def profile_build(t, spark):
    """Narratives and structure of each source's profile, out of one pass that also takes the figures."""
    section = F.when(F.col("lang") == "fr", F.lit(None)).when(F.col("lang") == "de", "notes").when(F.col("lang") == "es", "mda").otherwise("bs")
    segments = t("documents").select(F.col("source").alias("report"), F.col("doc_id").alias("page"), F.col("doc_id").alias("seq"), section.alias("section"), "text")
    parts = profile.build(segments, spark.createDataFrame([("license", "legal"), ("password", "secret")], "form string, canonical_key string"), ["report"])
    n = parts["narratives"].select("report", F.lit("narrative").alias("part"), "name", F.col("segments").alias("n"), F.col("chars").alias("size"), "first_page")
    s = parts["structure"].select("report", F.lit("structure").alias("part"), "name", F.col("last_page").alias("n"), F.lit(None).cast("long").alias("size"), "first_page")
    return n.unionByName(s)
