"""Roles, contexts, keywords and the profile on small made cases in both languages and scripts."""

import collections
import random
import re

from pyspark.sql import functions as F

from veritally.operators import profile, roles, windows

ITEM = "header string, section string, context string, snippet string, period string"


def role(spark, *cases):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ITEM)
    return [r["value_role"] for r in roles.value_roles(rows).orderBy("i").collect()]


def test_value_roles_by_order_of_the_rules(spark):
    cases = {
        ("附注", "", "折旧", "", "2024"): "note_reference",
        ("Note No.", None, None, None, None): "note_reference",
        ("", "bs", "2023 年 12 月 31 日 折旧", "", "2024"): "prior_period_balance",
        ("", "bs", "2024 年 12 月 31 日", "", "2024"): "main_value",
        ("上年年末餘額", "", "", "", ""): "prior_period_balance",
        ("", "parent_company_bs", "折旧", "", ""): "parent_company_distribution_component",
        ("", "equity_statement", "", "", ""): "equity_statement_component",
        ("", "", "存貨跌價準備", "", ""): "impairment_component",
        ("", "", "Depreciation and impairment", "", ""): "impairment_component",
        ("", "", "本年发生额", "1 2,000 3.5", ""): "current_period_detail",
        ("", "", "本年发生额", "1 and 2", ""): "main_value",
        ("", "", "Gain on disposal of plant", "", ""): "disposal_gain_loss",
        ("", "", "处置固定资产", "", ""): "main_value",
        ("", "", "毛利率", "", ""): "ratio",
        ("Carrying amount", "", "pledged", "", ""): "restricted_book_value",
        ("Carrying amount", "", "", "", ""): "main_value",
        ("", "", "pledged", "", ""): "main_value",
        ("", "", "折算匯率及外幣", "", ""): "ratio",
        ("", "", "外幣", "", ""): "foreign_currency_translation",
        ("Within 3 months", "", "", "", ""): "maturity_bucket",
        ("利 息 收 入", "", "", "", ""): "interest_component",
        ("", "", "利息收入", "", ""): "main_value",
        (None, None, None, None, None): "main_value",
    }
    assert dict(zip(cases, role(spark, *cases))) == cases


def test_contexts(spark):
    cases = {("bs", "母公司"): "main_statement", ("notes", "母公司 公允價值"): "parent_company", (None, "以攤餘成本計量"): "unknown", ("x", "Fair value of shares"): "financial_instruments", ("share_changes", ""): "share_changes", ("x", "分部資料"): "segment_report", ("x", "合併利潤表"): "main_statement", (None, None): "unknown"}
    got = {(r["section"], r["text"]): r["context"] for r in roles.contexts(spark.createDataFrame(list(cases), "section string, text string")).collect()}
    assert {k: v for k, v in got.items() if k != (None, "以攤餘成本計量")} == {k: v for k, v in cases.items() if k != (None, "以攤餘成本計量")}


def test_windows_around_a_match(spark):
    text = "a" * 100 + "[42]" + "b" * 100
    rows = spark.createDataFrame([(text, "[42]"), (text, "none"), ("[42]", "[42]"), ("", "x")], "t string, m string")
    got = [r["w"] for r in rows.select(roles.around(F.col("t"), F.col("m")).alias("w")).collect()]
    assert got == ["a" * 80 + "[42]" + "b" * 40, text[:120], "[42]", ""]


def test_keywords_equal_a_plain_loop(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("资产净利润报告 ab，cdeThe\n") for _ in range(rng.randrange(0, 90))) for _ in range(60)] + ["公司" * 9, "資產" * 12 + " the Assets assets", ""]
    simple = str.maketrans({"資": "资", "產": "产"})
    got = collections.defaultdict(list)
    for r in profile.keywords(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), ["i"], "t").orderBy("i", "rank").collect():
        got[r["i"]].append((r["word"], r["n"]))
    for i, t in enumerate(texts):
        words = [w for n in range(6, 1, -1) for w in re.findall(rf"[一-龥]{{{n}}}", t.translate(simple))] + re.findall("[a-z]{3,}", t.lower())
        assert got[i] == collections.Counter(w for w in words if w not in profile.STOPWORDS).most_common(20)


def test_headers_hold_data_rows(spark):
    cells = spark.createDataFrame([(1, 0, 1, "2024"), (1, 1, 1, " "), (1, 2, 1, " 5 "), (1, 3, 1, "6"), (1, 2, 0, "label")], "t int, row int, col int, s string")
    assert {(r["row"], r["col"]): r["header"] for r in windows.column_texts(cells, ["t"], "row", "col", "s").collect()} == {(0, 1): "", (1, 1): "2024", (2, 1): "2024", (3, 1): "2024 5", (2, 0): ""}


def test_profile_reads_its_segments_once(spark, tmp_path):
    rows = [("r", 1, 1, "重要事項", "營業收入 1,234.50 萬元"), ("r", 2, 2, None, "Revenue was 7,000 and 营业收入 9,999.0"), ("r", 3, 3, "mda", "nothing"), ("q", 1, 1, None, "")]
    spark.createDataFrame(rows, "report string, page int, seq int, section string, text string").write.parquet(str(tmp_path / "s"))
    segments = spark.read.parquet(str(tmp_path / "s"))
    glossary = spark.createDataFrame([("营业收入", "revenue"), ("revenue", "revenue")], "form string, canonical_key string")
    assert profile.tagged(segments, glossary, ["report"])._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    parts = profile.build(segments, glossary, ["report"])
    assert all(str(tmp_path) not in p._jdf.queryExecution().executedPlan().toString() for p in parts.values())
    assert {tuple(r) for r in parts["metrics"].collect()} == {("r", "revenue", 1234.5, 1, 3)}
    assert {(r["report"], r["name"], r["chars"], r["segments"], r["first_page"]) for r in parts["narratives"].collect()} == {("r", "重要事項", len(rows[0][4]), 1, 1), ("r", "other", len(rows[1][4]), 1, 2), ("r", "mda", 7, 1, 3), ("q", "other", 0, 1, 1)}
    assert parts["structure"].count() == 2
