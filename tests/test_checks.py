from pyspark.sql import functions as F

from veritally.functions import predicates
from veritally.operators import aggregates, extract, spatial
from veritally.plans import checks
from veritally.sources import readers

ITEM = "pair_id string, side string, seq int, canonical_key string, value double, unit string, currency string, period string, page int, context string, confidence double, source string"


def items(spark, rows):
    full = [(p, s, i, k, v, u, "CNY", "2024", 1 + i, c, 0.9, "table") for i, (p, s, k, v, u, c) in enumerate(rows)]
    return spark.createDataFrame(full, ITEM)


def test_numeric(spark):
    rules = readers.rules(spark, [{"rule_id": "R", "targets": ["goodwill"], "tolerance": 5.0}])
    rows = [
        ("p", "A", "interest", 448182540.45, None, "main"), ("p", "A", "interest", 301550000.0, None, "main"), ("p", "H", "interest", 301550.0, "thousand", "main"),
        ("p", "A", "revenue", 10851821801.0, None, "main"), ("p", "H", "revenue", 9709834.0, "thousand", "main"),
        ("p", "A", "profit", 1000.0, None, "main"), ("p", "H", "profit", 700.0, None, "segment"),
        ("p", "A", "goodwill", 1000.0, None, "main"), ("p", "H", "goodwill", 1004.0, None, "main"),
        ("q", "A", "revenue", 100.0, None, "main"), ("q", "H", "revenue", 2024.0, None, "main"),
    ]
    got = {(r["pair_id"], r["canonical_key"]): (r["severity"], r["triage"]) for r in checks.numeric(items(spark, rows), rules).collect()}
    assert got == {("p", "revenue"): ("high", "real"), ("p", "profit"): ("medium", "unresolved")}


def test_currency_conversion(spark):
    a = {"total_assets": 367718196.0, "gross_profit": 14558069.0, "interest_income": 2845113.0}
    h = {"total_assets": 52271308.0, "gross_profit": 1956599.0, "interest_income": 398080.0}
    rows = [("p", "A", k, v, None, "main") for k, v in a.items()] + [("p", "H", k, v, None, "main") for k, v in h.items()]
    assert checks.numeric(items(spark, rows), readers.rules(spark, [])).count() <= 1


def test_disclosure_and_key_metrics(spark):
    rows = [("p", "A", "x", 100.0, None, "main"), ("p", "A", "x", 130.0, None, "main"), ("p", "H", "x", 100.5, None, "main")]
    got = checks.disclosure(items(spark, rows)).collect()
    assert [(r["severity"], r["triage"]) for r in got] == [("high", "real")]
    visual = spark.createDataFrame([("p", "A", "x", 1, 100.4)], "pair_id string, side string, canonical_key string, page int, value double")
    kinds = sorted(r["diff_type"] for r in checks.key_metrics(items(spark, rows), visual).collect())
    assert kinds == ["exact", "visual"]


def test_coverage_and_branches(spark):
    topics = spark.createDataFrame([("p", "A", "t", 100, 1), ("p", "H", "t", 300, 1), ("p", "A", "only", 5, 2), ("p", "H", "same", 5, 2), ("p", "A", "same", 6, 2)], "pair_id string, side string, topic string, words int, page int")
    known = spark.createDataFrame([("only", "H", "law")], "topic string, missing_side string, rationale string")
    got = {r["canonical_key"]: r["triage"] for r in checks.coverage(topics, known).collect()}
    assert got == {"t": "unresolved", "only": "expected"}
    rows = [("p", s, i, f"b{i}", 10, base + 1000.0 * i) for s, base in (("A", 100000.0), ("H", 200000.0)) for i in range(12)]
    found = checks.branches(spark.createDataFrame(rows, "pair_id string, side string, seq int, name string, n int, asset double"))
    assert found.count() == 12


def test_events_overlay_charts(spark):
    dividend = "The Board approved a cash dividend of RMB 2.50 per 10 shares, total dividends amounting to RMB {} million for 2024 annual profit distribution, payable on 2024-05-17."
    claim = "The litigation with 海华贸易有限公司 is pending, the claim amount is RMB {} million and the hearing is on 2024-08-09."
    rows = [("p", "A", 3, 1, "significant_events", dividend.format(120)), ("p", "H", 4, 1, "significant_events", dividend.format(150)), ("p", "A", 8, 2, "significant_events", claim.format(30)), ("p", "H", 9, 2, "significant_events", claim.format(30)), ("p", "H", 12, 3, "significant_events", claim.format(45)), ("p", "A", 5, 3, "bs", "Nothing of note happened in this period."), ("p", "H", 5, 4, None, None)]
    got = checks.events(spark.createDataFrame(rows, "pair_id string, side string, page int, seq int, section string, text string")).collect()
    assert {(r["diff_type"], r["canonical_key"], r["a_value"], r["h_value"], r["severity"], r["triage"]) for r in got} == {("event", "dividend_distribution", 1.2e8, 1.5e8, "critical", "real"), ("internal_event", "litigation", 3e7, 4.5e7, "critical", "real")}
    words = spark.createDataFrame([("p:A", 1, 0, "126,311", 0.0, 0.0, 40.0, 10.0, 0), ("p:A", 1, 1, "126,411", 0.0, 0.0, 40.0, 10.0, 1)], "doc_id string, page int, word_seq int, text string, x0 double, y0 double, x1 double, y1 double, stream_order int")
    over = checks.overlay(words).collect()
    assert [(r["a_value"], r["h_value"], r["pair_id"]) for r in over] == [(126411.0, 126311.0, "p")]
    point = "pair_id string, key string, page int, value double"
    charts = checks.charts(spark.createDataFrame([("p", "k", 10, 100.0), ("p", "m", 10, 5.0)], point), spark.createDataFrame([("p", "k", 12, 100.2), ("p", "m", 13, 9.0)], point), spark.createDataFrame([("p", "k", 13, 120.0)], point))
    assert [r["canonical_key"] for r in charts.collect()] == ["k"]
    every = checks.all_checks([checks.overlay(words), checks.overlay(words), charts])
    assert every.count() == 2


def test_bilingual(spark):
    units_ = spark.createDataFrame([("p", lang, i, i, "s", i, [f"n{i}"]) for lang in ("zh", "en") for i in range(4)], "pair_id string, lang string, unit int, page int, section string, seq int, signals array<string>")
    facts = spark.createDataFrame([("p", "zh", 2, "amount", "dividend", 2.5e9), ("p", "en", 2, "amount", "dividend", 2.503e10), ("p", "zh", 1, "amount", "loan", 2.5e9), ("p", "en", 1, "amount", "loan", 2.5e9)], "pair_id string, lang string, unit int, kind string, role string, value double")
    aligned, diffs, stats = checks.bilingual(units_, facts)
    assert {(r["i"], r["j"]) for r in aligned.collect()} == {(i, i) for i in range(4)}
    assert [r["canonical_key"] for r in diffs.collect()] == ["amount:dividend"]
    assert stats.first()["coverage"] == 1.0


def test_bilingual_pages_scales_and_rows(spark):
    """Neighbours across any page border meet; facts pair by least cost; rows pair within paired tables."""
    schema = "pair_id string, lang string, unit int, page int, section string, seq int, signals array<string>, topics array<string>, actions array<string>, glossary array<string>"
    units_ = spark.createDataFrame([("p", "zh", 1, 3, None, 1, [], ["t"], ["x"], []), ("p", "en", 7, 4, None, 1, [], ["t"], ["x"], []), ("p", "zh", 2, 40, None, 2, [], ["u"], [], []), ("p", "en", 8, 60, None, 2, [], ["u"], [], [])], schema)
    facts = spark.createDataFrame([("p", "zh", 1, "amount", "loan", 100.0), ("p", "zh", 1, "amount", "loan", 7.0), ("p", "en", 7, "amount", "loan", 7.0), ("p", "en", 7, "amount", "loan", 120.0)], "pair_id string, lang string, unit int, kind string, role string, value double")
    aligned, diffs, _ = checks.bilingual(units_, facts)
    assert {(r["i"], r["j"]) for r in aligned.collect()} == {(1, 7)}  # pages 40 and 60 are too far apart
    assert [(r["a_value"], r["h_value"]) for r in diffs.collect()] == [(100.0, 120.0)]
    row = "pair_id string, lang string, table string, row int, page int, title_keys array<string>, keys array<string>, unit string, values array<double>"
    rows = [("p", "zh", "t1", 1, 5, ["bs"], ["assets"], "百万元", [10.0, 9.0]), ("p", "zh", "t1", 2, 5, ["bs"], ["debt"], "百万元", [4.0]), ("p", "en", "e9", 3, 6, ["bs"], ["debt"], "million", [4.5]), ("p", "en", "e9", 4, 6, ["bs"], ["assets"], "million", [10.0, 9.0]), ("p", "en", "e8", 1, 90, ["cf"], ["cash"], None, [1.0])]
    paired, pairs, wrong = checks.table_rows(spark.createDataFrame(rows, row))
    assert [(r["zh_table"], r["en_table"]) for r in paired.collect()] == [("t1", "e9")]
    assert {(r["zh_row"], r["en_row"]) for r in pairs.collect()} == {(1, 4), (2, 3)}
    assert [(r["canonical_key"], r["a_value"], r["h_value"]) for r in wrong.collect()] == [("debt", 4e6, 4.5e6)]


def test_ids_keep_differences_apart(spark):
    """Two contradictions of one key on one page, of different years, stay two."""
    rows = [("p", "A", i, "x", v, None, "CNY", y, 1, "main", 0.9, "table") for i, (v, y) in enumerate([(100.0, "2023"), (130.0, "2023"), (100.0, "2024"), (130.0, "2024")])]
    found = checks.disclosure(spark.createDataFrame(rows, ITEM))
    assert found.count() == 2 and checks.all_checks([found]).count() == 2
    from veritally.functions.text import stable_id
    ids = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a|b", None, None)], "x string, y string, z string").select(stable_id("", F.col("x"), F.col("y"), F.col("z")).alias("id"))
    assert ids.distinct().count() == 3


def test_sheets(spark, tmp_path):
    from veritally.sources import sinks

    found = checks.disclosure(items(spark, [("p", "A", "x", 100.0, None, "main"), ("p", "A", "x", 130.0, None, "main")]))
    flags = spark.createDataFrame([("p", "blank")], "pair_id string, flag string")
    tables = sinks.sheets(found, spark.createDataFrame([("p", 1.0)], "pair_id string, coverage double"), flags)
    assert tables["evidence"].count() == 2 and tables["evidence"].columns == ["pair_id", "diff_id", "seq", "evidence"]
    sinks.export({k: v for k, v in tables.items() if k in ("diffs", "evidence", "by_type")}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/diffs").count() == 1


def test_maps_and_rules(spark):
    sections = spark.createDataFrame([("p", "A", "board", 3), ("p", "H", "directors", 4), ("p", "A", "risk", 9)], "pair_id string, side string, section string, page int")
    mapping = spark.createDataFrame([("board", "directors"), ("risk", "risks"), ("audit", "auditors")], "a_section string, h_section string")
    assert [(r["canonical_key"], r["evidence"][0]) for r in checks.framework(sections, mapping).collect()] == [("risk", "a_only")]
    texts = spark.createDataFrame([("p", "A", "we use hedges"), ("p", "H", "no such thing")], "pair_id string, side string, text string")
    rules = spark.createDataFrame([("r1", "Check that \"hedges\" are named"), ("r2", "Check \"thing\""), ("r3", "Check \"absent\"")], "rule_id string, check_logic string")
    assert {(r["canonical_key"], r["evidence"][0]) for r in checks.depth_rules(texts, rules).collect()} == {("r1", "a_only"), ("r2", "h_only")}


def test_standard(spark):
    diffs = spark.createDataFrame([("d1", "real"), ("d2", "expected")], "diff_id string, triage string")
    vectors = spark.createDataFrame([("d1", [1.0, 0.0]), ("d2", [0.0, 1.0])], "query_id string, vector array<double>")
    clauses = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)] + [(9, [0.0, 0.0])], "item_id long, vector array<double>")
    got = checks.standard(diffs, vectors, clauses, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["item_id"]) for r in got] == [("d1", 0), ("d1", 1), ("d1", 2)]


def test_extraction(spark):
    glossary = spark.createDataFrame([("total assets", "total_assets")], "form string, canonical_key string")
    cells = readers.grid_cells(spark.createDataFrame([(1, [["Item", "2024", "2023"], ["Total assets", "1,000", "900"], ["Odd row", "(5)", "-"]])], "t int, grid array<array<string>>"), ["t"], "grid")
    got = {(r["canonical_key"], r["col"]): (r["value"], r["confidence"], r["period"]["year"]) for r in extract.table_metrics(cells, glossary, ["t"]).collect()}
    assert got == {("total_assets", 1): (1000.0, 0.9, 2024), ("total_assets", 2): (900.0, 0.9, 2023), ("odd_row", 1): (-5.0, 0.5, 2024)}
    seg = spark.createDataFrame([(1, "Total assets of 12,345 million in 2024. Net profit was RMB 3,000 thousand."), (2, None)], "id int, text string")
    assert [(r["canonical_key"], r["value"], r["unit"]) for r in extract.text_metrics(seg, glossary, ["id"]).collect()] == [("total_assets", 12345.0, "million")]
    assert ("net_profit", 3000.0) in {(r["canonical_key"][-10:], r["value"]) for r in extract.generic_metrics(seg, ["id"]).collect()}
    facts = extract._facts("a dividend of RMB 2,503,994 thousand, about 3.5%")
    assert [(f["kind"], f["role"], f["value"], f["currency"]) for f in facts] == [("amount", "dividend", 2503994000.0, "CNY"), ("rate", "dividend", 3.5, None)]
    ev = extract.events(spark.createDataFrame([(1, 3, 0, "The Company issued a bond with Acme Capital Limited on 2024-03-01 at 3.5%."), (1, 3, 1, "The Company issued a bond with Acme Capital Limited on 2024-03-01 at 3.5%."), (1, 4, 2, "Nothing.")], "doc int, page int, seq int, text string"), ["doc"], [("bond", "bond")]).collect()
    assert len(ev) == 1 and ev[0]["topic"] == "bond" and ev[0]["dates"] == ["2024-03-01"] and "3.5%" in ev[0]["signature"]
    tree = extract.structure(spark.createDataFrame([(1, "bs", 3), (1, "is", 5), (1, None, 9)], "doc int, section string, page int"), ["doc"], {"bs": "statements", "is": "statements"})
    assert {(r["node"], r["level"], r["first_page"], r["last_page"]) for r in tree.collect()} == {("bs", 2, 3, 3), ("is", 2, 5, 5), ("statements", 1, 3, 5)}


def test_predicates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    s, a = F.lit, F.array
    assert one(predicates.context_bucket(s("Consolidated balance sheet"), s(None).cast("string"))) == "main"
    assert one(predicates.value_role(s("compared with the prior year"))) == "prior_period"
    assert one(predicates.contexts_compatible(s("main"), s("highlights"))) and not one(predicates.contexts_compatible(s("quarterly"), s("main")))
    assert one(predicates.magnitude_mismatch(s(1.0), s(2e9), s("amount"))) and not one(predicates.magnitude_mismatch(s(1.0), s(2.0), s("shares")))
    assert one(predicates.values_match(s(100.0), s(108.0), s("CNY"), s("HKD"))) and not one(predicates.values_match(s(100.0), s(90.0), s("CNY"), s("CNY")))
    assert one(predicates.sets_overlap(a(s(1.0), s(100.0)), a(s(100.5)), s("amount"))) and not one(predicates.sets_overlap(a(s(1.0)), a(s(1.001)), s("shares")))
    assert not one(predicates.anchored(a(s("2024")), a(s("2024")), s("bond"))) and one(predicates.anchored(a(s("2024")), a(s("2024")), s("loan")))
    assert one(predicates.branch_evidence(s("Beijing 75 810,136"), s("Beijing"), s(75), s(810136.0)))
    assert one(predicates.candidate(s(1.0), s(0.7), s("revenue"), s("main"))) and not one(predicates.candidate(s(1.0), s(0.6), s("revenue"), s("main")))
    assert one(predicates.key_metric(s("revenue"), s(1.0), s(0.6))) and one(predicates.comparison_item(s(False), s(0.9), s("table")))
    assert not one(predicates.material(s("short"))) and one(predicates.event_signal(s("an acquisition"), ("acqui",)))


def test_more_aggregates(spark):
    seg = spark.createDataFrame([(1, "bs", 3), (1, "bs", 4), (1, "is", 9)], "doc int, section string, page int")
    got = {(r["group"], r["section"]): (r["first_page"], r["last_page"]) for r in aggregates.page_ranges(seg, ["doc"], F.lit("fs")).collect()}
    assert got == {("fs", "bs"): (3, 4), ("fs", "is"): (9, 9), ("fs", None): (3, 9)}
    t = aggregates.table_coverage(seg, ["doc"], ["bs", "cf"]).first()
    assert (t["missing"], t["coverage"]) == (["cf"], 0.5)
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None)], "seq int, v string, w string")
    assert {r["seq"] for r in aggregates.first_wins(rows, [F.col("v"), F.col("w")], "seq").collect()} == {1, 3}
    model = spark.createDataFrame([("m1", "s1", "low")], "diff_id string, sig string, severity string")
    regex = spark.createDataFrame([("r1", "s1", "high"), ("r2", "s2", "high"), ("r3", "s3", "low")], "diff_id string, sig string, severity string")
    assert {r["diff_id"] for r in aggregates.merged_diffs(model, regex, ["sig"]).collect()} == {"m1", "r2"}
    k = aggregates.report_kpis(spark.createDataFrame([("done", 3, "2024-01-01 00:00:00", "2024-01-01 00:00:28"), ("failed", 0, "2024-01-01 00:00:00", "2024-01-01 00:01:00")], "status string, real int, started string, ended string")).first()
    assert (k["done"], k["failed"], k["real"], k["mean_seconds"]) == (1, 1, 3, 28.0)
    w = aggregates.warnings(spark.createDataFrame([("p", "blank"), ("p", "odd")], "pair_id string, flag string"), spark.createDataFrame([("blank", "scan", "high", True)], "flag string, category string, severity string, blocking boolean"))
    assert {(r["flag"], r["severity"], r["blocking"]) for r in w.collect()} == {("blank", "high", True), ("odd", "low", False)}
    assert aggregates.demand_selection(rows, ["v"], [F.col("seq")], 1).count() == 2
    a = spark.createDataFrame([(1, "a b"), (2, "x")], "page int, text string")
    b = spark.createDataFrame([(1, "ab c"), (2, "y"), (3, "z")], "page int, text string")
    assert {r["page"]: r["text"] for r in readers.merged_pages(a, b, ["page"]).collect()} == {1: "ab c", 2: "x\ny", 3: "z"}
    words = spark.createDataFrame([("d", 1, 0, "w", 0.0, 0.0, 10.0, 10.0, 5)], "doc_id string, page int, word_seq int, text string, x0 double, y0 double, x1 double, y1 double, stream_order int")
    spans = spark.createDataFrame([("d", 1, 0.0, 0.0, 20.0, 20.0, 2), ("d", 1, 0.0, 0.0, 20.0, 20.0, 8)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, span_order int")
    assert spatial.stream_order(words, spans).first()["stream_order"] == 8
