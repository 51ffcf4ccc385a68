"""Pairs of events that are no real differences, and those that are."""

import difflib
import random
import re

from veritally.functions import blocks
from veritally.operators import events, matching
from veritally.plans import checks
from veritally.sources.shared import cut

ROW = "pair_id int, side string, page int, seq int, section string, text string"
DEAL = "2025年3月1日，本行与阳光科技有限公司签订战略合作协议，金额为{}万元"


def real(spark, cases):
    """Kinds of real differences of each case (a, h, section), all in one job."""
    rows = [(n, side, 30 + i, i, section, text) for n, (a, h, section) in enumerate(cases) for side, texts in (("A", a), ("H", h)) for i, text in enumerate(texts)]
    found = checks.events(spark.createDataFrame(rows, ROW)).where("triage = 'real'").collect()
    return [sorted(r["diff_type"] for r in found if r["pair_id"] == n) for n in range(len(cases))]


def test_quiet_texts(spark):
    numbers = " ".join(map(str, range(30)))
    more = {
        "": True, "，女性董事与男性董事": True, "，年龄组别、女性董事与男性董事": False,
        "，独立非执行董事": False,  # it holds two of the other marks
        "，优化运营与智能审核": True, "，优化运营、智能审核与AI": False, "，" + numbers: True, "，见附注": True, "，见附注 " + numbers: False, "，□适用 √不适用": False,
    }
    got = real(spark, [([DEAL.format(100) + "。"], [DEAL.format(120) + x + "。"], "significant_events") for x in more])
    assert dict(zip(more, got)) == {x: ["event"] * differs for x, differs in more.items()}


def test_other_events_and_reports_that_contradict_themselves(spark):
    said = lambda year, n, amount: f"本集团发行{year}年度第{n}期公司债券，发行金额为人民币{amount}亿元。"
    dividend = "利润分配：董事会于{}决议派发现金股利，以总股本{}亿股为基数，每10股派息{}元，共计股利{}亿元。"
    cases = [
        ([dividend.format("2025年6月27日", 200, "1.50", 30)], [dividend.format("2024年8月11日", 250, "1.20", 3)], "significant_events", []),
        (["本集团2025年3月公开发行长期公司债券，发行金额为人民币400亿元。"], ["本集团2024年11月非公开发行短期公司债券，发行金额为人民币5亿元。"], "notes", []),
        (["股份变动：截至报告期末，公司总股本为200,000,000股。"], ["股份变动：截至2024年12月31日，公司总股本为11,167,000,000股。"], "share_changes", []),
        (["本行与阳光科技有限公司发生关联交易，交易金额为人民币100万元。"], ["本行与星河科技有限公司发生关联交易，交易金额为人民币1.2亿元。"], "significant_events", []),
        (["22.3 权益工具的相关信息在本财务报表附注中披露，需进一步确认。"], ["17.30 权益工具的相关信息在本财务报表附注中披露，需进一步确认。"], "notes", []),
        ([said(2025, n, v) for n, v in (("一", 20), ("二", 30), ("三", 40))], [said(2024, n, v) for n, v in (("一", 15), ("二", 28), ("三", 35))], "notes", []),
        ([DEAL.format(100), DEAL.format(120)], [], "significant_events", ["internal_event"]),
        ([DEAL.format(100), DEAL.format(120) + "，年龄组别、女性董事与男性董事"], [], "significant_events", []),
        ([DEAL.format(100) + "，已批准"], [DEAL.format(100) + "，已终止"], "significant_events", []),  # a status alone is none
        (["本集团总股本为 25,039,945 千股。"], ["The Group total share capital was 26,000,000 thousand shares."], "share_changes", ["event"]),
        (["25 March 2025: the litigation of 海华贸易有限公司 is pending, the claim amount is RMB 100 million."], ["25 March 2025: the litigation of 海华贸易有限公司 is pending, the claim amount is RMB 110 million."], "significant_events", ["event"]),
    ]
    assert real(spark, [c[:3] for c in cases]) == [c[3] for c in cases]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _events(spark):
    rows = [(n, side, 30 + i, i, "significant_events", DEAL.format(100 + n + i)) for n in range(4) for side in "AH" for i in range(3)]
    return cut(events.extracted(spark.createDataFrame(rows, ROW), ["pair_id", "side"]), "events")


def test_texts_of_a_pair_are_compared_once(spark):
    """A filter on the score took the ratio of texts with it, and so worked it out twice."""
    found = _events(spark)
    a, h = (events._side(found.where(f"side = '{s}'"), "pair_id", p) for s, p in (("A", "a_"), ("H", "h_")))
    scored = events.compared(events.blocked(a, h, "pair_id")).where("score >= 0.42")
    assert len(re.findall(r"ArrowEvalPython \[_ratios", _plan(scored))) == 1
    assert scored.count() == 36


def test_events_are_not_sent_whole_to_every_task(spark):
    """Stored events are small on disk, for their texts are alike, and were broadcast through the driver."""
    found = _events(spark)
    for df in (events.between(found), events.within(found)):
        assert "SortMergeJoin" in _plan(df) and "Broadcast" not in _plan(df)


def test_ratios_are_those_of_difflib(spark):
    r = random.Random(3)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    a, b = [], []
    for i in range(400):
        letters = r.choice(["ab", "海华星河0123456789", "abcdefghijklmnopqrstuvwxyz ,.😀"])
        x = word(letters, r.choice([1, 7, 60, 199, 200, 333]))
        y = "".join(c for c in x if r.random() < 0.9) + word(letters, r.choice([1, 9, 80])) if i % 3 else word(letters, r.choice([1, 30, 250]))
        a.append(x), b.append(y)
    want = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    assert blocks.ratios(a, b).tolist() == want
    got = spark.createDataFrame([("ab", "ab"), (None, "a"), ("", "")], "a string, b string").select(matching.sequence_ratio("a", "b").alias("r"), matching.pair_ratio("a", "b").alias("p")).collect()
    assert [tuple(x) for x in got] == [(1.0, 1.0), (0.0, 0.0), (0.0, 0.0)]
