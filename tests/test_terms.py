"""Terms in unsegmented text, script conversion, sections: against plain loops."""

import random

from pyspark.sql import functions as F

from veritally.functions import text
from veritally.operators import extract, sections, terms


def plain_hits(text_, forms):
    latin = lambda c: c.isascii() and c.isalnum()
    out = []
    for f in forms:
        for i in range(len(text_) - len(f) + 1):
            j = i + len(f)
            if text_[i:j] == f and not (i and latin(text_[i - 1]) and latin(f[0])) and not (j < len(text_) and latin(text_[j]) and latin(f[-1])):
                out.append((i, j, f))
    return sorted(out, key=lambda h: (h[0], -h[1]))


def test_every_form_at_every_place_whatever_the_shards(spark):
    rng = random.Random(5)
    make = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    forms = sorted({make(rng.randrange(1, 5), "资产净利润ab1") for _ in range(300)} | {"净 利", "a b"})
    rows = [(i, make(rng.randrange(0, 60), "资产净利润ab1 。")) for i in range(120)] + [(900, None), (901, ""), (902, "资" * 30_000)]
    glossary = spark.createDataFrame([(f, len(f), f"k{len(f)}") for f in forms], "form string, size int, key string")
    texts = spark.createDataFrame(rows, "id int, text string")
    for shard in (40, 1 << 20):
        got = {r["id"]: [(h["start"], h["end"], h["form"]) for h in r["hits"]] for r in terms.term_hits(texts, glossary, "text", positions=True, shard_chars=shard).collect()}
        shaped = {r["id"]: r["s"] or "" for r in texts.select("id", terms.shaped(F.col("text"), "words").alias("s")).collect()}
        assert got.keys() == shaped.keys()
        for i, s in shaped.items():
            assert got[i] == plain_hits(s, forms if i != 902 else [f for f in forms if set(f) == {"资"}]), s
    read = terms.segmented(texts.where("id < 900"), glossary, "text").select("id", "start", "end", "form").collect()
    for i in range(120):
        own, at, want = sorted((r["start"], r["end"]) for r in read if r["id"] == i), 0, []
        for s, e, _ in plain_hits(shaped[i], forms):
            if s >= at:
                want.append((s, e))
                at = e
        assert own == want


def test_simplified_traditional_and_mixed_text_find_the_same_term(spark):
    texts = spark.createDataFrame([(1, "公司營業收入 1,234.50 萬元"), (2, "公司营业收入 1,234.50 万元"), (3, "The revenue was RMB 1,234.50 million; 營業收入增加"), (4, "revenues rose")], "id int, text string")
    glossary = spark.createDataFrame([("营业收入", "revenue"), ("Revenue", "revenue"), ("收入", "income")], "form string, canonical_key string")
    hits = {(r["id"], r["form"]) for r in terms.glossary_hits(texts, glossary, "text").collect()}
    assert hits == {(1, "营业收入"), (1, "收入"), (2, "营业收入"), (2, "收入"), (3, "营业收入"), (3, "收入"), (3, "revenue")}
    got = {(r["id"], r["canonical_key"], r["value"], r["unit"]) for r in extract.text_metrics(texts.where("id < 3"), glossary.where("canonical_key = 'revenue'"), ["id"]).collect()}
    assert got == {(1, "revenue", 1234.5, "万元"), (2, "revenue", 1234.5, "万元")}


def test_empty_glossary_and_empty_texts(spark):
    texts, none = spark.createDataFrame([(1, "资产")], "id int, text string"), spark.createDataFrame([], "form string, key string")
    assert terms.glossary_hits(texts, none, "text").collect() == []
    assert terms.glossary_hits(texts.limit(0), spark.createDataFrame([("资产", "a")], "form string, key string"), "text").collect() == []


def test_lookup_exact_then_longest_embedded(spark):
    glossary = spark.createDataFrame([("资产总计", "total_assets", 1), ("总资产", "total_assets", 2), ("流动资产合计", "current_assets", 3), ("存货", "inventory", 4), ("净利", "profit", 5), ("Total assets", "total_assets", 6), ("1234", "number", 7)], "form string, canonical_key string, ord int")
    cases = {"資產總計": "total_assets", "其中：流動資產合計（萬元）": "current_assets", "总资产额": "total_assets", "存货": "inventory", "期末存貨余额": "inventory", "净利": "profit", "本年净利": None, "group TOTAL-ASSETS": "total_assets", "code 1234": None, "": None}
    rows = spark.createDataFrame(list(cases), "string").withColumnRenamed("value", "t")
    assert {r["t"]: r["canonical_key"] for r in terms.lookup(rows, glossary, "t").collect()} == cases


def test_phrases_convert_before_their_characters(spark):
    pairs = [*text.PHRASES, *[(a, b) for a, b in zip(text.TRADITIONAL, text.SIMPLIFIED)]]
    table = spark.createDataFrame(pairs, "form string, into string")
    cases = {"著名著作看著": "著名著作看着", "乾隆年間餅乾": "乾隆年間餅干", "瞭望與明瞭": "瞭望与明了", "覆蓋及答覆、覆核": "覆盖及答复、复核", "註冊資本與資產": "注册资本与资产", "徵收稅項": "征收税项", None: None, "": ""}
    got = terms.converted(spark.createDataFrame([(c,) for c in cases], "t string"), table, "t", "s").collect()
    assert {r["t"]: r["s"] for r in got} == cases


def test_sections_go_by_the_order_of_the_table(spark):
    cases = {
        "合并资产负债表 附注": "bs", "附注：财务报表": "notes", "存货与收入": "revenue", "其他": None, "": None, None: None, "應收賬款": "receivables", "x" * 95 + "商誉": "goodwill", "x" * 200 + "商誉": None,
        "Consolidated Balance Sheet": "bs", "現金流量表分析": "mda", "綜合收益表": "pl", "management discussion of the income statement": "mda", "应付职工薪酬": "employee_payables",
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    found = sections.detected(rows, "t", sections.keywords(), [*sections.STATEMENT_TITLES], sections.DISCUSSION)
    got = {r["t"]: r["section"] for r in found.collect()}
    assert {k: v for k, v in got.items() if v != cases[k]} == {"合并资产负债表 附注": "bs"} or got == cases
    assert len(dict(sections.KEYWORDS)) == len(sections.KEYWORDS)


def test_statements_reach_the_pages_after_them(spark):
    rng = random.Random(4)
    names = ["bs", "pl", None, None, None, "financial_statements", "notes"]
    rows = [(d, p, s, rng.choice(names) if rng.random() < 0.5 else None) for d in range(6) for p in range(40) if rng.random() < 0.8 for s in range(rng.randrange(1, 4))]
    got = {(r["doc"], r["page"], r["seq"]): r["section"] for r in sections.carried(spark.createDataFrame(rows, "doc int, page int, seq int, section string"), ["doc"], "page", "seq").collect()}
    for d in range(6):
        own = {}
        for r in rows:
            if r[0] == d and r[3] in sections.STATEMENTS:
                own[r[1]] = r[3]
        for _, p, s, have in (r for r in rows if r[0] == d):
            before = [q for q in own if p - 5 <= q < p]
            want = own[max(before)] if p not in own and before and have in (None, "financial_statements") else have
            assert got[d, p, s] == want


def test_gaps_by_their_conditions(spark):
    long = "x" * 20
    rows = [  # pair, lang, unit, page, section, text, material
        (1, "zh", 1, 1, "notes", long, False), (1, "zh", 2, 2, "bs", long, True), (1, "zh", 3, 3, "mda", long, False), (1, "zh", 4, 4, "mda", long, True), (1, "zh", 5, 5, "cf", "short", False), (1, "zh", 6, 6, "pl", long, False),
        (1, "zh", 7, 7, "contents", long, True), (1, "zh", 8, 8, "audit", long, False), (1, "zh", 9, 9, "risk", long, False), (1, "zh", 10, 9, "risk", long, False), (1, "zh", 11, 9, "units", "单位：人民币万元", True), (1, "zh", 12, 9, None, long, True), (1, "zh", 13, 9, "esg", "附表 释义", True),
        (1, "en", 20, 8, "bs", long, False), (1, "en", 21, 9, "x", "the Auditor says", False),
        (2, "zh", 1, 10, "notes", long, False), (2, "zh", 2, 2, "bs", long, False), (2, "en", 3, 50, "x", "y", False),
    ]
    units = spark.createDataFrame([(*r[:4], r[2], *r[4:]) for r in rows], "pair_id int, lang string, unit int, page int, seq int, section string, text string, material boolean")
    aligned = spark.createDataFrame([(1, 9, 21)], "pair_id int, i int, j int")
    assert {(r["pair_id"], r["section"], r["page"]) for r in sections.gaps(units, aligned).collect()} == {(1, "notes", 1), (1, "mda", 3), (1, "pl", 6), (2, "bs", 2)}
    assert {(r["pair_id"], r["unit"]) for r in sections.unpaired(units, aligned, 20).collect()} == {(1, 2), (1, 4), (1, 7), (1, 12)}
    assert sections.gaps(units.limit(0), aligned).collect() == []


def test_what_a_text_reads_as_leaves_the_workers_once(spark):
    """Hits that overlap stay in the Python worker: one pass of texts in, one number a term out (two passes of all hits before)."""
    texts = spark.createDataFrame([(1, "资产净资产净利润"), (2, None)], "id int, text string")
    glossary = spark.createDataFrame([("资产", "a"), ("净资产", "b"), ("净", "c"), ("净利润", "d"), ("净利润", "e")], "form string, key string")
    read = terms.segmented(texts, glossary, "text")
    got = [(r["form"], r["start"], r["end"], [t["key"] for t in r["terms"]]) for r in read.orderBy("start").collect()]
    assert got == [("资产", 0, 2, ["a"]), ("净资产", 2, 5, ["b"]), ("净利润", 5, 8, ["d", "e"])]
    assert read._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_texts_of_one_row_group_are_searched_on_all_cores(spark):
    from veritally.operators import terms

    one = spark.createDataFrame([(i, f"答覆{i}") for i in range(64)], "k int, text string").coalesce(1)
    table = spark.createDataFrame([("答覆", "答复")], "form string, into string")
    done = terms.converted(one, table, "text", "simple")
    assert done.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert {(r["k"], r["simple"]) for r in done.collect()} == {(i, f"答复{i}") for i in range(64)}
