import pytest
from pyspark.sql import functions as F

from veritally.functions import dates, grading, numbers, text, units
from veritally.operators.rules import compiled


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, value", [("1,234.5", 1234.5), ("(5)", -5.0), ("（7）", -7.0), ("—", None), ("n/a", None), ("1 000", 1000.0), ("x", None)])
def test_parse_number(spark, raw, value):
    assert one(spark, numbers.parse_number(F.col("s")), s=raw) == value


@pytest.mark.parametrize("raw, value", [("total 1,234 in 2024", 1234.0), ("in 2024 it was 5,000", 5000.0), ("12% of 3,400", 3400.0), ("note 7", 7.0), ("none", None)])
def test_first_financial_number(spark, raw, value):
    assert one(spark, numbers.first_financial_number(F.col("s")), s=raw) == value


def test_numbers_near_labels(spark):
    s = "In 2024 total assets were 12,345.6 (note 5) million"
    assert one(spark, numbers.number_near_label(F.col("s"), F.lit("total assets")), s=s) == 12345.6
    assert one(spark, numbers.number_near_label(F.col("s"), F.lit("absent")), s=s) is None
    assert one(spark, numbers.closest_number_near_label(F.col("s"), F.lit("assets"), F.lit(12000.0)), s=s) == 12345.6
    assert one(spark, numbers.overlay_value(F.col("s")), s="(126,311)") == -126311.0
    assert one(spark, numbers.parse_number_anywhere(F.col("s")), s="is 1234567890123456789") is None
    assert one(spark, numbers.parse_chart_number(F.col("s")), s="about 45.5 %") == 45.5
    assert one(spark, numbers.first_number_of_row(F.array(F.lit("a"), F.lit("7"), F.lit("1,000")))) == 1000.0


@pytest.mark.parametrize("unit, value", [("RMB million", 1e6), ("百万元", 1e6), ("万元", 1e4), ("亿元", 1e8), ("thousand", 1e3), ("bn", 1e9), (None, 1.0), ("", 1.0)])
def test_multiplier(spark, unit, value):
    assert one(spark, units.multiplier(F.col("u").cast("string")), u=unit) == value


def test_units(spark):
    assert one(spark, units.in_hkd(F.lit(100.0), units.currency(F.lit("RMB million")))) == 108.0
    assert one(spark, units.event_multiplier(F.lit("万股"))) == 1e4
    assert one(spark, units.unit_fix_ratio(F.lit(5.0), F.lit(5000.0))) == 0.0
    assert one(spark, units.unit_fix_ratio(F.lit(5.0), F.lit(50.0))) == 0.0  # a factor of ten is one of the table (1e4 to 1e3)


@pytest.mark.parametrize("ratio, name", [(0.005, "low"), (0.01, "medium"), (0.05, "high"), (0.2, "critical")])
def test_grade(spark, ratio, name):
    assert one(spark, grading.grade(F.lit(ratio))) == name


def test_grading(spark):
    assert one(spark, grading.triaged(F.lit("critical"), F.lit("unresolved"))) == "medium"
    assert one(spark, grading.triaged(F.lit("high"), F.lit("expected"))) == "info"
    assert one(spark, grading.rank(F.lit("odd"))) == -1
    assert one(spark, grading.demoted(F.lit("high"))) == "medium"
    none = F.lit(None).cast("string")
    check = lambda a, h, au=none, hu=none: one(spark, grading.pair_check(F.lit(a), F.lit(h), au, hu, F.lit(0.0)))["kind"]
    assert check(100.0, 100.0) == "match" and check(100.0, 100.5) == "rounding" and check(100.0, 130.0) == "mismatch"
    assert check(5.0, 5000.0) == "unit_fix" and check(1000.0, 1.015, none, F.lit("thousand")) == "unit_conversion"
    kind = lambda a, h, f: one(spark, grading.match_kind(F.lit(a), F.lit(h), none, none, F.lit(0.0), F.lit(f)))
    assert kind(367718196.0, 52271308.0, 7.03) == "currency_conversion" and kind(100.0, 100.4, 1.0) == "direct" and kind(100.0, 150.0, 1.0) is None
    assert one(spark, grading.within_tolerance(F.lit(0.5), F.lit(0.505), F.lit("eps_basic"))) is True
    assert one(spark, grading.non_monetary(F.lit(2024.0))) is True


def test_text(spark):
    assert one(spark, text.normalise(F.lit("  總　負債  A "))) == "总 负债 a"
    assert one(spark, text.hamming(F.lit("126311"), F.lit("126411"))) == 1 and one(spark, text.hamming(F.lit("12"), F.lit("123"))) is None
    assert one(spark, text.language(F.lit("资产总额与负债"))) == "zh" and one(spark, text.language(F.lit("total assets"))) == "en"
    assert one(spark, text.language_vote(F.array(F.lit("zh"), F.lit("en")))) == "bilingual"
    assert one(spark, text.junk_label(F.lit("a b a b"))) is True and one(spark, text.junk_label(F.lit("Revenue"))) is False
    assert one(spark, text.garbled_key(F.lit("x"))) is True and one(spark, text.garbled_text(F.lit("a�"))) is True
    assert one(spark, text.first_keyword(F.lit("Cash flow"), [("cash", "cf"), ("flow", "x")])) == "cf"
    assert one(spark, text.quoted_terms(F.lit('needs "dividend" here'))) == ["dividend"]
    assert len(one(spark, text.fragments(F.lit("This is one sentence that is long. " * 10)))) == 10


def test_dates(spark):
    assert one(spark, dates.dates(F.lit("31 March 2024; April 2, 2024; 2024年5月6日"))) == ["2024-03-31", "2024-04-02", "2024-05-06"]
    assert one(spark, dates.quarter(F.lit("third quarter"))) == 3 and one(spark, dates.quarterly(F.lit("FAQ1 x"))) is False
    assert one(spark, dates.period(F.lit("2025-Q3"))).asDict() == {"year": 2025, "quarter": 3}
    assert one(spark, dates.date_role(F.lit("signed and completed"))) == "completion"


def test_rules(spark):
    names = {"a": F.lit(10.0), "b": F.lit(3.0), "c": F.lit(7.0)}
    assert one(spark, compiled("a == b + c", names)) is True and one(spark, compiled("a + 1 == b + c", names)) is False
    assert one(spark, compiled("0 < b <= c < a", names)) is True and one(spark, compiled("-a < b", names)) is True
    assert one(spark, compiled("a + 0.05 == b + c", names, tolerance=0.01)) is True
    for bad in ("__import__('os')", "a.b", "f(a)", "a if b else c", "zz", "'x'", "True"):
        with pytest.raises(ValueError):
            compiled(bad, names)


def test_a_printed_number_is_parsed_once(spark):
    """Each test of a number in a text parsed it again: the plans held 50 and 124 extractions."""
    s = spark.createDataFrame([("Note 12 of 2023: 35.5% and 6,123.45, total assets (\t1,234.5 )",)], "s string")
    df = s.select(numbers.first_financial_number(F.col("s")).alias("a"), numbers.number_near_label(F.col("s"), F.lit("total assets")).alias("b"), numbers.parse_number(F.lit(" (1 2,3　4'5) ")).alias("c"))
    assert [tuple(r) for r in df.collect()] == [(6123.45, 1234.5, -12345.0)]
    for one in ("a", "b"):
        assert df.select(one)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 4
