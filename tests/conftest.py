import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = f"{root}:{os.environ.get('PYTHONPATH', '')}"
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def at(sf):
        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            path = f"{DATA}/{sf}/{t}.parquet"
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
        return con

    return at


def same(spark_df, frame):
    """Rows of a Spark result and a DuckDB frame agree, whatever their order."""
    got = spark_df.toPandas()
    assert sorted(got.columns) == sorted(frame.columns)
    key = sorted(frame.columns)
    assert len(got) == len(frame)
    text = lambda f: f[key].astype(object).map(lambda v: "null" if v is None or str(v) in ("<NA>", "nan", "NaT") else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)).sort_values(key).reset_index(drop=True)
    a, b = text(got), text(frame)
    bad = (a != b).any(axis=1)
    assert not bad.any(), f"{a[bad].head(3)}\n{b[bad].head(3)}"
