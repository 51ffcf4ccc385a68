"""Decision lists over marker words: the role of a value and the context of a metric.

A list is a table of rules in order of precedence.  A rule asks for one marker or more out of each of its parts; a part looks at one
field of the row.  All markers of a list are one automaton, so a row is read once, and the first rule whose parts are
all met gives the code.  Fields are simplified and in lower case, and a marker may also meet the field without its spaces.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as texts_
from . import terms


@dataclass(frozen=True)
class Rule:
    """code, and its parts: pairs of a field and markers of which one must be in it."""

    code: str
    parts: tuple[tuple[str, tuple[str, ...]], ...]


def rule(code: str, *parts: tuple[str, str]) -> Rule:
    """Markers are written in one text, parted by bars."""
    return Rule(code, tuple((field, tuple(markers.split("|"))) for field, markers in parts))


#: Role of a value within a report, in order; the first rule that is met counts, without one it is main_value.
VALUE_ROLES = (
    rule("note_reference", ("header", "note|notes|note no|noteno|附注|附注编号|附注号")),
    rule("prior_period_balance", ("flags", "other year"), ("text", "12月31日|december31|31december")),
    rule("prior_period_balance", ("header", "上年年末数|上年年末余额|上年末数|上年末余额|prior year end|previous year end|last year end")),
    rule("parent_company_distribution_component", ("section", "parent_company")),
    rule("parent_company_distribution_component", ("text", "母公司报表|母公司可供分配|parent company statement|parent company financial statements")),
    rule("opening_balance", ("text", "年初未分配利润|opening retained earnings|retained earnings at beginning")),
    rule("equity_statement_component", ("section", "equity_statement")),
    rule("equity_statement_component", ("text", "利润分配|综合收益总额|专项储备|提取盈余公积|减：库存股|其他综合收益")),
    rule("cash_flow_reconciliation_component", ("section", "cash_flow_reconciliation")),
    rule("dividend_component", ("text", "现金分红|现金股利|cash dividend|dividend paid|dividend distribution")),
    rule("impairment_component", ("text", "跌价准备|跌价损失|减值损失|impairment|write-down|writedown")),
    rule("depreciation_component", ("text", "折旧|depreciation")),
    rule("rental_income_component", ("text", "租赁收入|rental income|lease income")),
    rule("tax_utilisation_component", ("text", "使用前期未确认递延所得税资产|previously unrecognised deferred tax assets")),
    rule("movement_component", ("text", "本年新增|本年增加|本年减少|补助金额|additions during the year|decrease during the year")),
    rule("current_period_detail", ("text", "本年发生额|amount incurred during the year|current year amount"), ("flags", "three numbers")),
    rule("cash_receipt_component", ("text", "收到的政府补助|收到政府补助|government grants received|received government grants")),
    rule("profit_or_loss_component", ("text", "计入当期损益|计入当年损益|recognised in profit or loss|credited to profit or loss")),
    rule("investment_income_component", ("text", "权益法核算|成本法核算|长期股权投资收益|处置交易性金融资产取得的投资收益|同业存单取得的投资收益|计划资产投资收益|investment income from|share of profit")),
    rule("disposal_gain_loss", ("text", "处置|disposal|disposed"), ("text", "收益|损失|gain|loss")),
    rule("amortization_component", ("text", "摊销|amortisation|amortization")),
    rule("ratio", ("text", "percentage|percent|asapercentage|% of|%of|ratio|proportion|rate|占比|比例|比率|率|增减幅")),
    rule("materiality_threshold", ("text", "materiality threshold|materialitystandard|重要性标准")),
    rule("change_amount", ("text", "change amount|changeamount|increase/decrease|increase or decrease|movement|variance|增减额|变动额|增加额|减少额|调整金额")),
    rule("transfer_movement", ("text", "transferred in|transfer in|transferred out|transfer out|reclassification|reclassified|转入|转出|重分类")),
    rule("opening_balance", ("text", "opening balance|beginning balance|balance at beginning|initial balance|期初余额|年初余额")),
    rule("profit_effect", ("text", "impact on profit|effect on profit|effect on profit before tax|impact on profit before tax|对利润总额的影响|对当期利润的影响")),
    rule("restricted_book_value", ("header", "book value|carrying amount|账面价值"), ("text", "restricted|pledged|limited ownership|受限|所有权受到限制|受限原因")),
    rule("foreign_currency_translation", ("text", "foreign currency|exchange rate|translated rmb|translated renminbi|外币|折算汇率|折算人民币余额|年末外币余额")),
    rule("maturity_bucket", ("text", "maturity|within3months|within 3 months|3 months or less|past due|indefinite|undated|期限|3个月内|三个月内|已逾期|无期限")),
    rule("average_balance", ("text", "average balance|averagebalance|平均余额")),
    rule("interest_component", ("header", "interest income|interest expense|interestincome|interestexpense|利息收入|利息支出")),
)
#: Sections that are statements, and the context that markers of a metric's text tell, in order.
STATEMENT_SECTIONS = ("bs", "pl", "cf", "income", "cash_flow", "equity", "financial_statements")
CONTEXTS = (
    rule("parent_company", ("text", "母公司|本公司财务状况表|公司财务状况表|母公司资产负债表|company financial position|company statement of financial position")),
    rule("financial_instruments", ("text", "金融工具|公允价值|fair value|以公允价值计量|以摊余成本计量")),
    rule("risk_exposure", ("text", "信用风险敞口|最大信用风险|风险敞口|risk exposure|credit risk exposure")),
    rule("share_changes", ("flags", "share section")),
    rule("share_changes", ("text", "股东|持股|前十名|股份变动|证券投资基金|限售股")),
    rule("segment_report", ("text", "分部|业务分部|经营分部|营运分部|segment|银行业务关键指标|保险业务|分部分析")),
    rule("financial_highlights", ("text", "主要会计数据|主要财务指标|财务摘要|financial highlights|key financial data")),
    rule("main_statement", ("text", "合并资产负债表|合并利润表|合并现金流量表|资产负债表|利润表|现金流量表|consolidated statement of financial position|consolidated income statement|consolidated statement of cash flows")),
)


def first_rule(rows: DataFrame, rules: tuple[Rule, ...], fields: dict[str, Column], out: str, default: str) -> DataFrame:
    """rows with `out`: the code of the first rule that is met.  fields: a text for each field that the rules name; null counts as empty."""
    spark = rows.sparkSession
    names = sorted(fields)
    asked: dict[str, list[tuple[int, int, int]]] = {}  # marker: (field, rule, part) that it meets
    for r, one in enumerate(rules):
        for p, (field, markers) in enumerate(one.parts):
            for m in markers:
                asked.setdefault(m.lower(), []).append((names.index(field), r, p))
    shared, key = spark.sparkContext.broadcast((list(asked), list(asked.values()), [(r.code, len(r.parts)) for r in rules])), uuid.uuid4().hex

    @F.pandas_udf(T.StringType())
    def decide(*columns: pd.Series) -> pd.Series:
        markers, meets, codes = shared.value
        a = terms.automaton(key, markers)

        held = [{v: {i for _, _, i in terms.found(a, v, False)} for v in column.unique()} for column in columns]  # headers, sections and flags recur

        def one(values: tuple[str, ...]) -> str:
            met: dict[int, set[int]] = {}
            for k, value in enumerate(values):
                for number in held[k][value]:
                    for field, r, p in meets[number]:
                        if field == k:
                            met.setdefault(r, set()).add(p)
            return next((codes[r][0] for r in sorted(met) if len(met[r]) == codes[r][1]), default)

        return pd.Series([one(v) for v in zip(*columns)])

    def field(c: Column) -> Column:
        low = F.lower(texts_.simplify(F.coalesce(c, F.lit(""))))
        return F.concat(low, F.lit("\0"), F.regexp_replace(low, r"\s+", ""))

    return rows.withColumn(out, decide(*[field(fields[n]) for n in names]))


def around(text: Column, match: Column, before: int = 80, after: int = 40) -> Column:
    """What a text says about a match: from `before` characters before it to `after` characters behind it; the beginning of the text where it does not occur."""
    at = F.instr(text, match)
    begin = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, begin, at - begin + F.length(match) + after)).otherwise(F.substring(text, 1, before + after))


def value_roles(items: DataFrame, out: str = "value_role") -> DataFrame:
    """items(header, section, context, snippet, period) with the role of their value.

    context is what is known about the item in words (names, period, value, section, snippet).  Flags: a year other than
    the period's in any of the texts; three numbers or more in the snippet.
    """
    text = F.concat_ws(" ", "header", "section", "context")
    years = F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit(r"((?:19|20)\d{2})"), F.lit(1))
    other = F.col("period").isNotNull() & (F.length("period") > 0) & F.exists(years, lambda y: y != F.col("period"))
    flags = F.concat_ws("|", F.when(other, "other year"), F.when(F.regexp_count(F.coalesce("snippet", F.lit("")), F.lit(r"\d[\d,]*(?:\.\d+)?")) >= 3, "three numbers"))
    return first_rule(items, VALUE_ROLES, {"header": F.col("header"), "section": F.col("section"), "text": text, "flags": flags}, out, "main_value")


def contexts(items: DataFrame, out: str = "context") -> DataFrame:
    """items(section, text) with the bucket of their context; a statement's section is main_statement at once, without any marker it is unknown."""
    flags = F.when(F.lower("section") == "share_changes", "share section")
    found = first_rule(items, CONTEXTS, {"text": F.col("text"), "flags": flags}, out, "unknown")
    return found.withColumn(out, F.when(F.lower("section").isin(*STATEMENT_SECTIONS), "main_statement").otherwise(F.col(out)))
