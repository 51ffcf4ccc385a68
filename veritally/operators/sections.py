"""Sections of a report: found by keywords in the order of their table, then carried over the pages of a statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as texts_
from . import terms

#: Sections that are statements, and what a page without one of its own may be called.
STATEMENTS, GENERIC = ("bs", "pl", "cf", "equity"), ("financial_statements",)
#: Titles of statements, in order.
STATEMENT_TITLES = [
    ("資產負債表", "bs"), ("財務狀況表", "bs"), ("財務狀況", "bs"), ("損益表", "pl"), ("綜合損益表", "pl"), ("綜合收益表", "pl"), ("收益表", "pl"), ("現金流量表", "cf"),
    ("權益變動表", "equity"), ("股東權益變動表", "equity"), ("所有者權益變動表", "equity"), ("资产负债表", "bs"), ("利润表", "pl"), ("现金流量表", "cf"), ("所有者权益变动表", "equity"), ("股东权益变动表", "equity"),
    ("statement of financial position", "bs"), ("balance sheet", "bs"), ("statement of profit or loss", "pl"), ("income statement", "pl"), ("statement of comprehensive income", "pl"),
    ("comprehensive income statement", "pl"), ("statement of cash flows", "cf"), ("cash flow statement", "cf"), ("statement of changes in equity", "equity"), ("changes in equity statement", "equity"),
]
#: A statement's title on a page that discusses it.
DISCUSSION = ("分析", "討論與分析", "management discussion")
#: Keywords of sections in Chinese reports, in order; a keyword that occurs twice has its last code.
KEYWORDS = [
    ("合并资产负债表", "bs"), ("合并利润表", "pl"), ("合并现金流量表", "cf"), ("合并所有者权益变动表", "equity"), ("合并股东权益变动表", "equity"), ("管理层讨论与分析", "mda"), ("董事会报告", "directors_report"),
    ("重要事项", "significant_events"), ("关联交易", "related_party"), ("关联方", "related_party"), ("会计政策", "accounting_policy"), ("重要会计估计", "accounting_estimate"), ("附注", "notes"),
    ("财务报表", "financial_statements"), ("公司概况", "company_profile"), ("公司治理", "corporate_governance"), ("环境与社会责任", "esg"), ("股份变动", "share_changes"), ("优先股", "preference_shares"), ("债券", "bonds"),
    ("商誉", "goodwill"), ("研发支出", "rnd"), ("所得税", "income_tax"), ("每股收益", "eps"), ("分部报告", "segment_report"), ("永续债", "perpetual_bond"), ("政府补助", "government_grant"), ("租赁", "leases"),
    ("金融工具", "financial_instruments"), ("收入", "revenue"), ("存货", "inventories"), ("固定资产", "ppe"), ("在建工程", "construction_in_progress"), ("无形资产", "intangible_assets"), ("投资性房地产", "investment_property"),
    ("长期股权投资", "long_term_investment"), ("应付职工薪酬", "employee_payables"), ("预计负债", "provisions"), ("资本公积", "capital_reserve"), ("盈余公积", "surplus_reserve"), ("未分配利润", "retained_earnings"),
    ("少数股东权益", "minority_interest"), ("营业收入", "revenue"), ("营业成本", "cogs"), ("销售费用", "selling_expenses"), ("管理费用", "admin_expenses"), ("研发费用", "rnd_expenses"), ("财务费用", "finance_expenses"),
    ("净利润", "net_profit"), ("归属于母公司股东的净利润", "net_profit_attributable"), ("基本每股收益", "basic_eps"), ("稀释每股收益", "diluted_eps"), ("经营活动现金流量", "cfo"), ("投资活动现金流量", "cfi"), ("筹资活动现金流量", "cff"),
    ("现金及现金等价物", "cash_equivalents"), ("货币资金", "cash"), ("应收账款", "receivables"), ("预付款项", "prepayments"), ("其他应收款", "other_receivables"), ("流动资产合计", "current_assets"),
    ("非流动资产合计", "non_current_assets"), ("资产总计", "total_assets"), ("短期借款", "short_term_borrowings"), ("应付账款", "payables"), ("预收款项", "advance_receipts"), ("合同负债", "contract_liabilities"), ("应交税费", "tax_payables"),
    ("其他应付款", "other_payables"), ("一年内到期的非流动负债", "current_portion_non_current"), ("流动负债合计", "current_liabilities"), ("非流动负债合计", "non_current_liabilities"), ("负债合计", "total_liabilities"),
    ("实收资本", "share_capital"), ("股本", "share_capital"), ("其他权益工具", "other_equity_instruments"), ("其他综合收益", "oci"), ("所有者权益合计", "total_equity"), ("负债和所有者权益总计", "total_liabilities_equity"),
    ("手续费及佣金收入", "fee_commission_income"), ("手续费及佣金支出", "fee_commission_expense"), ("利息收入", "interest_income"), ("利息支出", "interest_expense"), ("融出资金", "margin_loans"), ("买入返售金融资产", "reverse_repurchase"),
    ("卖出回购金融资产款", "repo_payable"), ("交易性金融资产", "trading_assets"), ("债权投资", "debt_investment"), ("其他债权投资", "other_debt_investment"), ("其他权益工具投资", "other_equity_investment"), ("金融负债", "financial_liabilities"),
    ("代理买卖证券款", "agency_trading_payable"), ("应付短期融资款", "short_term_financing"), ("应付债券", "bonds_payable"), ("衍生金融工具", "derivative_instruments"), ("公允价值变动", "fv_change"), ("投资收益", "investment_income"),
    ("资产减值损失", "impairment_loss"), ("信用减值损失", "credit_impairment"), ("其他资产", "other_assets"), ("其他负债", "other_liabilities"), ("代理承销证券款", "agency_underwriting"), ("证券承销业务", "underwriting"),
    ("资产管理业务", "asset_management"), ("融资融券业务", "margin_trading"), ("股票质押回购", "stock_pledge_repo"), ("期货经纪业务", "futures_brokerage"),
]


def keywords(extra: list[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """A table for reports in either script: `extra` (English keywords, say) first, then KEYWORDS, then KEYWORDS in traditional characters by PAIRS."""
    back = {ord(s): t for t, s in reversed(list(zip(texts_.TRADITIONAL, texts_.SIMPLIFIED)))}
    return [*extra, *KEYWORDS, *((k.translate(back), code) for k, code in KEYWORDS if k.translate(back) != k)]


def detected(texts: DataFrame, text: str, table: list[tuple[str, str]], statements: list[tuple[str, str]] = (), discussion: tuple[str, ...] = (), head: int = 200) -> DataFrame:
    """texts with section: the code of the first keyword in table order within the first `head` characters, in lower case; null without one.

    Titles of `statements` go before the table; one on a page that also holds a term of `discussion` gives mda.
    """
    out = terms.first_in_table(texts, table, text, "section", head)
    if not statements:
        return out
    out = terms.first_in_table(out, list(statements), text, "__title", head)
    out = terms.first_in_table(out, [(d, "mda") for d in discussion] or [("\0", "mda")], text, "__talk", head)
    return out.withColumn("section", F.when(F.col("__title").isNotNull(), F.coalesce("__talk", "__title")).otherwise(F.col("section"))).drop("__title", "__talk")


def carried(segments: DataFrame, keys: list[str], page: str, seq: str, reach: int = 5, statements: tuple[str, ...] = STATEMENTS, generic: tuple[str, ...] = GENERIC) -> DataFrame:
    """segments with section carried from a page with a statement to up to `reach` pages after it, as far as the next page with one.

    Of several statements on a page the last by seq counts.  Only segments without a section, or with a generic one, on
    pages without a statement take it; missing pages don't stop it.  Each such page files itself under the pages that it may
    reach, so pages meet by an equi-join, and no task holds a report.
    """
    own = segments.where(F.col("section").isin(*statements)).groupBy(*keys, F.col(page).alias("__page")).agg(F.max_by("section", seq).alias("__section"))
    reached = own.withColumn("__to", F.explode(F.sequence("__page", F.col("__page") + reach)))
    last = reached.groupBy(*keys, "__to").agg(F.max_by("__section", "__page").alias("__section"), F.max("__page").alias("__page"))
    joined = segments.join(last.withColumnRenamed("__to", page), [*keys, page], "left")
    takes = F.col("__section").isNotNull() & (F.col("__page") < F.col(page)) & (F.col("section").isNull() | F.col("section").isin(*generic))
    return joined.withColumn("section", F.when(takes, F.col("__section")).otherwise(F.col("section"))).select(*segments.columns)


#: Sections that no counterpart is expected for, by key or by a word of key or text; and words of an audit report.
UNSURE_KEYS = ("contents", "definitions", "glossary", "abbreviations", "company", "overview")
UNSURE_KEY_WORDS = ("definition", "contents", "glossary", "abbreviation")
UNSURE_WORDS = ("definitions", "definition", "contents", "glossary", "abbreviations", "meansthe", "means ", "释义", "目录")
AUDITOR_WORDS = ("auditor", "audit opinion", "independent auditor", "key audit matters")
#: Sections whose lack counts without a material paragraph: always, and where both reports are of like length.
CORE_SECTIONS = ("bs", "pl", "cf", "balance_sheet", "income_statement", "cash_flow", "equity_statement")
OTHER_SECTIONS = ("governance", "directors", "audit", "risk", "financial_statements", "notes")
#: A paragraph that only states the unit.
UNIT_ONLY = r"(?i)^(?:除(?:特别注明外|另有说明).*?(?:单位|金额)|以人民币(?:千元|万元|亿元)为单位|all amounts in (?:rmb|hk\$|us\$).*?(?:thousands|millions|billions)|expressed in (?:thousands|millions) of renminbi|stated in (?:rmb\s+)?(?:thousands|millions|billions)|单位[：:]\s*人民币(?:千元|万元|亿元))"


def gaps(units: DataFrame, aligned: DataFrame) -> DataFrame:
    """Chinese sections that the English report lacks: pair_id, section, page, severity (low), triage (unresolved).

    units(pair_id, lang zh or en, unit, page, seq, section, text, material), aligned(pair_id, i: zh unit).  A section that the
    other side has, or of which a paragraph found a partner, is none.  Unsure sections and an audit report whose words
    the English side holds are passed over.  What is left counts if it has a material paragraph (and is not just
    statements of the unit), or is a core section with a text, or one of the others while pages are in a ratio of .6 to 1.8.
    All conditions are aggregates by section, so no task holds a report.
    """
    shaped = F.lower(texts_.simplify(F.regexp_replace(F.trim("text"), r"\s+", " ")))
    marked = units.withColumn("__t", shaped).withColumn("section", F.nullif(F.lower(F.trim("section")), F.lit("")))
    has = lambda c, words: F.coalesce(F.col(c).rlike("|".join(w.replace(".", r"\.") for w in words)), F.lit(False))
    zh = marked.where("lang = 'zh'").join(aligned.select("pair_id", F.col("i").alias("unit"), F.lit(True).alias("__met")).distinct(), ["pair_id", "unit"], "left")
    own = zh.where("section IS NOT NULL").groupBy("pair_id", "section").agg(
        F.min("page").alias("page"), F.min_by("__t", F.struct("page", "seq", "unit")).alias("first"), F.max(F.coalesce("__met", F.lit(False))).alias("met"),
        F.max("material").alias("material"), F.min(F.coalesce(F.col("__t").rlike(UNIT_ONLY), F.lit(False))).alias("unit_only"),
    )
    en = marked.where("lang = 'en'")
    report = marked.groupBy("pair_id").agg(F.max(F.when(F.col("lang") == "zh", F.col("page"))).alias("zh_pages"), F.max(F.when(F.col("lang") == "en", F.col("page"))).alias("en_pages"), F.max((F.col("lang") == "en") & has("__t", AUDITOR_WORDS)).alias("audited"))
    ratio = F.try_divide("en_pages", "zh_pages")
    lacking = own.where("NOT met").join(en.select("pair_id", "section").distinct(), ["pair_id", "section"], "left_anti").join(report, "pair_id")
    unsure = F.col("section").isin(*UNSURE_KEYS) | has("section", UNSURE_KEY_WORDS) | has("first", UNSURE_WORDS) | ((F.col("section") == "audit") & F.coalesce("audited", F.lit(False)))
    told = F.length("first") >= 8
    extreme = F.coalesce((ratio > 1.8) | (ratio < 0.6), F.lit(False))
    counts = F.when(F.coalesce("material", F.lit(False)), ~F.col("unit_only")).when(F.col("section").isin(*CORE_SECTIONS), told).otherwise(~extreme & F.col("section").isin(*OTHER_SECTIONS) & told)
    return lacking.where(~unsure & counts).select("pair_id", "section", "page", F.lit("low").alias("severity"), F.lit("unresolved").alias("triage"))


def unpaired(units: DataFrame, aligned: DataFrame, least_chars: int = 100) -> DataFrame:
    """Material Chinese paragraphs of `least_chars` characters or more without a partner: pair_id, unit, page, severity (info), triage."""
    alone = units.where((F.col("lang") == "zh") & F.col("material") & (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) >= least_chars)).join(aligned.select("pair_id", F.col("i").alias("unit")), ["pair_id", "unit"], "left_anti")
    return alone.select("pair_id", "unit", "page", F.lit("info").alias("severity"), F.lit("unresolved").alias("triage"))
