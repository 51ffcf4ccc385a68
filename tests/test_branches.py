"""Branch rows of page texts and table cells, and their comparison."""

from veritally.operators import branches

TEXT, CELL = "pair_id int, side string, page int, seq int, text string", "pair_id int, side string, page int, `table` int, row int, col int, text string"


def rows(spark, texts, cells=()):
    out = branches.found(spark.createDataFrame(texts, TEXT), spark.createDataFrame(list(cells), CELL))
    return sorted((r["side"], r["name"], r["n"], r["asset"], r["page"]) for r in out.collect())


def test_rows_of_texts(spark):
    said = "分支机构\n北京分行 75 810,136 西城区\n本行上海分行　60 620,000\n短行分行 5 999\n深圳分行 1234 500,000\n廣州分行 40 410,000"
    got = rows(spark, [(1, "A", 3, 1, said), (1, "A", 4, 1, "北京分行 75 999,999"), (1, "A", 5, 1, None), (1, "A", 6, 1, ""), (1, "H", 9, 1, "支行 75 810,136")])
    assert got == [("A", "北京分行", 75, 810136.0, 3), ("A", "广州分行", 40, 410000.0, 3), ("A", "本行上海分行", 60, 620000.0, 3)]


def test_first_by_place_then_cells(spark):
    line = [(1, "H", 2, 0, 4, 2, "810,136"), (1, "H", 2, 0, 4, 0, "北京分行"), (1, "H", 2, 0, 4, 1, "75"), (1, "H", 2, 0, 5, 0, "濟南分行"), (1, "H", 2, 0, 5, 1, None), (1, "H", 2, 0, 5, 2, "30"), (1, "H", 2, 0, 5, 3, "300,000")]
    got = rows(spark, [(1, "H", 7, 2, "北京分行 75 700,000"), (1, "H", 7, 1, "北京分行 75 600,000 北京分行 75 500,000")], line)
    assert got == [("H", "北京分行", 75, 600000.0, 7), ("H", "济南分行", 30, 300000.0, 2)]


def test_assets_that_are_no_number(spark):
    assert rows(spark, [(1, "A", 1, 1, "北京分行 75 ,,,,,")]) == []


def test_comparison_is_gated(spark):
    name = lambda i: "一二三四五六七八"[i] + "地分行"
    said = lambda names, asset: "\n".join(f"{n} 7 {asset}" for n in names)
    six = [name(i) for i in range(6)]
    texts = [(1, "A", 1, 1, said(six, "100,000")), (1, "H", 1, 1, said(six[:3] + ["甲地分行", "乙地分行", "丙地分行"], "180,000")),
             (2, "A", 1, 1, said(six, "100,000")), (2, "H", 1, 1, said(six[:4] + ["甲地分行", "乙地分行"], "130,000")),
             (3, "A", 1, 1, said(six[:2], "100,000")), (3, "H", 1, 1, "一地分行 7 104,000\n二地分行 8 200,000"), (4, "A", 1, 1, said(six, "100,000"))]
    found = branches.found(spark.createDataFrame(texts, TEXT))
    got = sorted((r["pair_id"], r["name"], round(r["percent"], 6), r["severity"]) for r in branches.differences(found).collect())
    assert got == [(2, n, 30.0, "medium") for n in sorted(six[:4])] + [(3, "一地分行", 4.0, "info")]
    counts = {r["pair_id"]: tuple(r)[1:] for r in branches.diagnostics(found).collect()}
    assert counts == {1: (6, 6, 3, 0.5, 0), 2: (6, 6, 4, 0.6667, 4), 3: (2, 2, 2, 1.0, 1), 4: (6, 0, 0, 0.0, 0)}


def test_rows_need_evidence(spark):
    row = lambda side, asset, snippet: (1, side, "北京分行", 75, asset, 1, snippet)
    for snippet, n in (("北京分行 75 810,136", 1), ("北京分行 175 810,136", 0), ("上海分行 75 810,136", 0), ("北京分行 75 810,137", 0), ("", 0)):
        df = spark.createDataFrame([row("A", 810136.0, snippet), row("H", 5000.0, "北京分行 75 5000")], "pair_id int, side string, name string, n int, asset double, page int, snippet string")
        assert branches.differences(df).count() == n
