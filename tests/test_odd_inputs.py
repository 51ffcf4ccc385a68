"""Queries against their SQL on tables that the small ones have no like of."""

import duckdb
import pytest

from tests.conftest import same
from veritally import catalog


@pytest.fixture
def agree(spark, tmp_path):
    def run(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.sql(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        same(catalog.queries()[name](spark, str(tmp_path)), con.sql(catalog.oracle_sql()[name]).df())

    return run


@pytest.mark.parametrize("name", ["chinese_text_metrics", "text_metric_rules"])
def test_amounts_that_look_like_years(agree, name):
    agree(name, orders="SELECT i::BIGINT AS o_orderkey, 2000.0 + i AS o_totalprice, 'F' AS o_orderstatus, '2-HIGH' AS o_orderpriority FROM range(8) r(i)")


def test_pages_of_one_url(agree):
    agree("page_sources", pages="SELECT i::BIGINT AS page_id, 'http://a.example/' || i % 3 AS url FROM range(24) r(i)")


@pytest.mark.parametrize("name", ["branch_rows", "branch_differences", "branch_diagnostics"])
def test_branches_that_share_names(agree, name):
    """Keys of seven digits are cut to six, so that ten customers on two or three pages are one branch."""
    agree(name, customer="SELECT k AS c_custkey, 0 AS c_nationkey, 500.0 + k % 4000 AS c_acctbal FROM range(1000104, 1016104) r(k) WHERE k % 16 IN (5, 12)")


def test_rectangles_of_any_size_meet_once(spark):
    """Pairs by size and place are all pairs; boxes far larger than a cell are not laid out in cells."""
    import random

    from veritally.operators import spatial

    rng = random.Random(3)
    rows = [(i % 3 or None, i, x, y, x + w, y + h) for i in range(240) for x, y, w, h in [(rng.uniform(0, 9), rng.uniform(0, 9), rng.choice([0, 2, 7, 1e7]) * rng.uniform(0.4, 1), rng.choice([3, 5, 1e6]) * rng.uniform(0.4, 1))]]
    got = sorted((r["i"], r["j"]) for r in spatial.alike(spark.createDataFrame(rows, "g int, id int, x0 double, y0 double, x1 double, y1 double"), ["g"], "id", 0.3).selectExpr("a_id i", "b_id j").collect())
    want = []
    for a in rows:
        for b in rows:
            if a[0] and a[0] == b[0] and a[1] < b[1]:
                m = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
                s = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - m
                if m and m / s >= 0.3:
                    want.append((a[1], b[1]))
    assert got == sorted(want) and want


def test_texts_at_a_small_distance(agree):
    """Texts of several lengths, with copies and with many that share their end."""
    agree("hamming_pairs", part="SELECT i::BIGINT AS p_partkey, (5.0 + i % 97 * 1.1)::DOUBLE AS p_retailprice, (i * 7 % 13)::INTEGER AS p_size, 'B' || i % 3 AS p_brand FROM range(400) r(i)")
