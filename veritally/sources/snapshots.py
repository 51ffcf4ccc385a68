"""Keyed upserts into a snapshot: a table of Parquet folders, one for each bucket of keys, named by a manifest.

A merge rewrites the buckets that it touches into new folders, then writes the next manifest under its number.  The manifest is
written aside and renamed to a name that must not exist, so a reader sees the old snapshot or the new one whole, of two
merges at once one fails, and a merge that dies leaves folders that no manifest names.  Manifests hold the last batch
of every stream that was merged, so a batch that comes again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

BUCKETS = 16


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict:
    """The latest manifest: version, schema, keys, order, buckets (folder by number), batches (last id by stream); version 0 if there is none."""
    at, fs = _path(spark, f"{path}/manifest")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    versions = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
    if not versions:
        return {"version": 0, "schema": None, "keys": [], "order": [], "buckets": {}, "batches": {}}
    return json.loads(spark.read.text(f"{path}/manifest/v{max(versions)}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, new: dict) -> None:
    aside, fs = _path(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    target, _ = _path(spark, f"{path}/manifest/v{new['version']}.json")
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise RuntimeError(f"another merge wrote version {new['version']} of {path} first")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot as it is now: one row for each key."""
    m = manifest(spark, path)
    if not m["version"]:
        raise FileNotFoundError(path)
    schema = T.StructType.fromJson(m["schema"])
    folders = [f"{path}/{f}" for f in m["buckets"].values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge(updates: DataFrame, path: str, keys: list[str], order: list[str], stream: str | None = None, batch: int | None = None, buckets: int = BUCKETS) -> bool:
    """Upserts updates by keys: of all rows of a key, old and new, the greatest by `order` stays (a tie: the new one).  False if the batch was merged before.

    Nulls in keys are equal to each other, in order they are least.  Columns must be those of the snapshot.
    """
    spark = updates.sparkSession
    m = manifest(spark, path)
    if stream is not None and batch is not None and m["batches"].get(stream, -1) >= batch:
        return False
    if m["version"] and (m["keys"] != keys or m["order"] != order or T.StructType.fromJson(m["schema"]).simpleString() != updates.schema.simpleString()):
        raise ValueError("keys, order and columns must be those of the snapshot")
    n = m.get("n", buckets)
    number = F.pmod(F.xxhash64(*keys), F.lit(n))

    def latest(rows: DataFrame) -> DataFrame:
        rank = F.struct(*order, "__new", F.xxhash64(*updates.columns))
        best = rows.groupBy("__b", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*updates.columns, "__new"), rank).alias("best"))
        return best.select("__b", "best.*")

    new = latest(updates.withColumn("__b", number).withColumn("__new", F.lit(1)))  # combined before it moves
    touched = sorted(r[0] for r in new.select("__b").distinct().collect())
    old_folders = [f"{path}/{m['buckets'][str(b)]}" for b in touched if str(b) in m["buckets"]]
    rows = new
    if old_folders:
        old = spark.read.schema(updates.schema).parquet(*old_folders).withColumn("__b", number).withColumn("__new", F.lit(0))
        rows = old.unionByName(new)
    kept = latest(rows).select(*updates.columns, F.col("__b").alias("bucket"))
    folder = f"data/{uuid.uuid4().hex}"
    if touched:
        kept.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    _publish(spark, path, {
        "version": m["version"] + 1, "schema": updates.schema.jsonValue(), "keys": keys, "order": order, "n": n,
        "buckets": m["buckets"] | {str(b): f"{folder}/bucket={b}" for b in touched}, "batches": m["batches"] | ({stream: batch} if stream is not None and batch is not None else {}),
    })
    return True


def merging(path: str, keys: list[str], order: list[str], stream: str):
    """For writeStream.foreachBatch: every micro-batch as a merge; one that is tried again after a failure leaves one row a key."""
    def run(batch: DataFrame, number: int) -> None:
        merge(batch, path, keys, order, stream, number)

    return run


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes data folders that the latest manifest does not name, and older manifests; only while nobody reads or merges.  Returns how many folders went."""
    m = manifest(spark, path)
    at, fs = _path(spark, f"{path}/data")
    gone = 0
    used = set(m["buckets"].values())
    for top in fs.listStatus(at) if fs.exists(at) else []:
        for f in fs.listStatus(top.getPath()):
            name = f"data/{top.getPath().getName()}/{f.getPath().getName()}"
            if f.isDirectory() and name not in used:
                fs.delete(f.getPath(), True)
                gone += 1
    for f in fs.listStatus(_path(spark, f"{path}/manifest")[0]):
        if f.getPath().getName() != f"v{m['version']}.json":
            fs.delete(f.getPath(), False)
    return gone
