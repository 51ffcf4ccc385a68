"""Session, storage and sampling helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where it is unset and driver and executors are one process (a local master, as in tests) a folder of our own is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        at = f"file://{tempfile.mkdtemp(prefix='veritally-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, name: str = "step", small: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns the written table: its lineage ends there.

    small: a table of ids or links, for which one file for every four shuffle partitions (two a core at least) is enough.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    path = f"{shared_dir(spark)}/veritally/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by stored() that nothing reads any more, and lets Spark drop their shuffle files."""
    for df in tables:
        spark = df.sparkSession
        for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/veritally/" in f:
                path = spark._jvm.org.apache.hadoop.fs.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(column: str = "doc_id", parts: int = 4) -> Column:
    """crc32(id as text) mod parts = 2.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == 2, F.lit(False))


def sample(df: DataFrame, rows: int, key: str, strata: str | None = None, seed: int = 11) -> DataFrame:
    """About `rows` rows of df at most, chosen by a hash of `key`; all if there are no more.

    strata: a column with few values.  Each gets an equal share of the rows; what rare ones leave goes to the others.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30))
    if strata is None:
        n = df.count()
        return df if n <= rows else df.where(place < int(rows / n * (1 << 30)))
    counts = sorted(((r["count"], r[strata]) for r in df.groupBy(strata).count().collect()), key=lambda x: (x[0], str(x[1])))
    left, quota = rows, []
    for k, (n, value) in enumerate(counts):
        own = min(n, max(1, left // (len(counts) - k)))
        left = max(0, left - own)
        quota.append((value, 1 << 30 if own == n else max(1, round(own / n * (1 << 30)))))
    if all(q == 1 << 30 for _, q in quota):
        return df
    most = F.element_at(F.create_map(*(F.lit(x) for pair in quota for x in pair)), F.col(strata))
    return df.where(place < most)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of stored() in the shared folder: once the results that read them are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/veritally")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
