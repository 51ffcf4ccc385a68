"""Facts with inherited units in both languages, and their comparison."""

from veritally.operators import facts

ROW = "r int, seq int, text string"


def found(spark, *texts):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], ROW)
    out = {}
    for r in facts.facts(facts.with_context(rows, ["r"], "seq")).collect():
        out.setdefault(r["seq"], []).append((r["kind"], r["value"], r["own_unit"]))
    return {k: sorted(v) for k, v in out.items()}


def test_units_reach_the_blocks_after_them(spark):
    got = found(spark, "资产 1,000.5", "单位：人民币百万元", "资产 1,000.5，其中 2,000 万元", "nothing 12 here", "(in thousands)", "assets 7,000 and 1.5 billion", None)
    assert got == {0: [("amount", 1000.5, None)], 2: [("amount", 2000e4, "万元"), ("amount", 1000.5e6, "百万元")], 5: [("amount", 7000e3, "thousand"), ("amount", 1.5e9, "billion")]}


def test_share_counts_dates_and_rates_are_no_amounts(spark):
    got = found(spark, "25,039,944,560股及1000萬股，占5.25%", "issued 10 million shares and 1,234 shares on 5 March 2024, 3.5%", "董事会2024年3月5日批准")
    assert got == {0: [("share_count", 1e7, "万股"), ("share_count", 25039944560.0, None)], 1: [("date", 19787.0, None), ("share_count", 1234.0, None), ("share_count", 1e7, "million")], 2: [("date", 19787.0, None)]}


def test_comparison_pairs_the_closest_and_knows_units(spark):
    side = lambda *t: facts.facts(facts.with_context(spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], ROW), ["r"], "seq"))
    zh = side("利润 1,000.0 和 2,000.0", "发行 500 万股", "2024年3月5日公司成立", "2024年3月5日董事会批准", "利润 3,000.0 万元", "资产 9.5 亿元")
    en = side("profit 2,000.0 and 1,500.0", "issued 5 million shares", "approved by the board on 5 March 2024", "approved by the board on 6 March 2024", "profit 3,000.0", "assets rose")
    got = {(r["seq"], r["kind"], r["status"]) for r in facts.compared(zh, en, ["r", "seq"]).collect()}
    assert got == {(0, "amount", "same"), (0, "amount", "differs"), (1, "share_count", "same"), (2, "date", "zh_only"), (2, "date", "en_only"), (3, "date", "differs"), (4, "amount", "unit_scale"), (5, "amount", "zh_only")}


def test_dividends_for_ten_shares_are_neither_amounts_nor_counts(spark):
    got = found(spark, "每10股派息1.50元，以总股本2,000股为基数，共计3,000.0元", "每 10 股派發現金股利港幣 2 元及每10股1.5元", "RMB1.00 (tax inclusive) per 10 shares", "hkd 0.255 per 10 shares, 7,000.5 thousand", "issued 10 shares")
    assert got == {0: [("amount", 3000.0, "元"), ("per_ten", 1.5, None), ("share_count", 2000.0, None)], 1: [("per_ten", 1.5, None), ("per_ten", 2.0, None)], 2: [("per_ten", 1.0, None)], 3: [("amount", 7000500.0, "thousand"), ("per_ten", 0.255, None)], 4: [("share_count", 10.0, None)]}


def test_events_of_one_row_group_are_read_on_all_cores(spark):
    """Segments in one partition are dealt out before any text is read, and not joined to few tasks after."""
    from veritally.operators import events

    said = "25 March 2025: the litigation of 海华贸易有限公司 is pending, the claim amount is RMB 100 million, number {}."
    rows = [(i, i % 7, i, "significant_events", said.format(i)) for i in range(64)]
    one = spark.createDataFrame(rows, "pair_id int, page int, seq int, section string, text string").coalesce(1)
    found = events.extracted(one, ["pair_id"])
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.count() == 64


def test_forms_of_a_text_are_made_once(spark):
    """Each group of each pattern took the rates per ten shares out of the text again."""
    from veritally.operators import facts as op

    blocks = spark.createDataFrame([("每10股派1.5元，共1,000股，收入2,000.5", None)], "text string, unit string")
    found = op.facts(blocks)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 2
    assert sorted((r["kind"], r["value"]) for r in found.collect()) == [("amount", 2000.5), ("per_ten", 1.5), ("share_count", 1000.0)]
    assert found.columns[:2] == ["text", "unit"] and not any(c.startswith("__") for c in found.columns)


def test_a_pattern_reads_a_text_once(spark):
    """Each group of each pattern searched the whole text again; sides with one fact went through a ranking all the same."""
    from veritally.operators import facts as op

    blocks = spark.createDataFrame([("2024年3月5日董事会批准，每10股派1.5元，共1,000股，收入2,000.5", None)], "text string, unit string")
    found = op.facts(blocks)
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") <= 6
    assert sorted((r["kind"], r["value"]) for r in found.collect()) == [("amount", 2000.5), ("date", 19787.0), ("per_ten", 1.5), ("share_count", 1000.0)]
