"""Snapshots, report folders and the sweep, on small made cases."""

import os
import random

import pytest
from pyspark.sql import functions as F

from veritally.operators import spatial
from veritally.sources import reports, snapshots

ROW = "k int, at int, v string"


def test_merges_keep_one_row_a_key(spark, tmp_path):
    rng, path, have = random.Random(2), f"file://{tmp_path}/s", {}
    for step in range(4):
        rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(9)]), f"{step}-{i}") for i in range(40)]
        for k, at, v in rows:
            best = [r for r in rows if r[0] == k]
            top = max(r[1] if r[1] is not None else -1 for r in best)
            if (at if at is not None else -1) == top and top >= have.get(k, (-2,))[0]:
                have.setdefault(k, (top, set()))
                have[k] = (top, {r[2] for r in best if (r[1] if r[1] is not None else -1) == top})
        assert snapshots.merge(spark.createDataFrame(rows, ROW), path, ["k"], ["at"], buckets=4)
        got = snapshots.read(spark, path).collect()
        assert len(got) == len(have) and all(r["v"] in have[r["k"]][1] for r in got)
    assert snapshots.manifest(spark, path)["version"] == 4
    before = sorted(map(str, snapshots.read(spark, path).collect()))
    assert snapshots.vacuum(spark, path) > 0
    assert sorted(map(str, snapshots.read(spark, path).collect())) == before and snapshots.vacuum(spark, path) == 0


def test_repeated_batches_and_rival_merges(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    one, two = spark.createDataFrame([(1, 1, "a")], ROW), spark.createDataFrame([(1, 1, "b"), (2, 1, "c")], ROW)
    assert snapshots.merge(one, path, ["k"], ["at"], "s", 0)
    assert snapshots.merge(two, path, ["k"], ["at"], "s", 1) and not snapshots.merge(two, path, ["k"], ["at"], "s", 1) and not snapshots.merge(one, path, ["k"], ["at"], "s", 0)
    assert {tuple(r) for r in snapshots.read(spark, path).collect()} == {(1, 1, "b"), (2, 1, "c")}
    stale = snapshots.manifest(spark, path)
    assert snapshots.merge(one, path, ["k"], ["at"], "t", 0)
    with pytest.raises(RuntimeError):
        snapshots._publish(spark, path, stale | {"version": stale["version"] + 1})
    with pytest.raises(ValueError):
        snapshots.merge(one.withColumn("x", F.lit(1)), path, ["k"], ["at"])
    assert snapshots.merge(one.limit(0), path, ["k"], ["at"])


def test_a_stream_that_fails_and_comes_again(spark, tmp_path):
    path, source = f"file://{tmp_path}/s", str(tmp_path / "in")
    rows = lambda n: spark.createDataFrame([(k, n, f"{n}") for k in range(5 * n)], ROW).coalesce(1)
    rows(1).write.parquet(source)
    put, failed = snapshots.merging(path, ["k"], ["at"], "jobs"), []

    def once(batch, number):
        put(batch, number)
        if number == 1 and not failed:  # the merge is in, the stream does not know
            failed.append(number)
            raise RuntimeError("lost")

    def run():
        q = spark.readStream.schema(ROW).parquet(source).writeStream.foreachBatch(once).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    rows(2).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        run()
    version = snapshots.manifest(spark, path)["version"]
    run()
    assert failed and snapshots.manifest(spark, path)["version"] == version
    assert sorted(tuple(r) for r in snapshots.read(spark, path).collect()) == [(k, 2, "2") for k in range(10)]


def test_report_folders_are_pruned_before_they_are_read(spark, tmp_path):
    texts = {"p1/A/a.txt": "x\ny\r\n\nz", "p1/H/b.html": "<p>q</p>\n", "p2/H/c.md": "", "p2/A/d.pdf": "no", "p2/B/e.txt": "no", "p2/A/sub/f.txt": "no", "p2/A/g.TXT": "é" * 3_000_000 + "\nend"}
    for name, text in texts.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    lines = reports.load(spark, str(tmp_path))
    got = {(r["pair_id"], r["side"], r["name"], r["kind"], r["line"]): r["text"] for r in lines.collect()}
    assert {k: v for k, v in got.items() if k[2] != "g.TXT"} == {("p1", "A", "a.txt", "text", 0): "x", ("p1", "A", "a.txt", "text", 1): "y", ("p1", "A", "a.txt", "text", 2): "", ("p1", "A", "a.txt", "text", 3): "z", ("p1", "H", "b.html", "html", 0): "<p>q</p>"}
    assert [len(got["p2", "A", "g.TXT", "text", i]) for i in (0, 1)] == [3_000_000, 3]
    os.chmod(tmp_path / "p1/H/b.html", 0)
    reader = reports.ReportReader(f"file://{tmp_path}", 1)
    assert list(reader.pushFilters([reports.EqualTo(("side",), "A"), reports.In(("pair_id",), ("p1", "p9")), reports.EqualTo(("line",), 1)])) == [reports.EqualTo(("line",), 1)]
    assert [f[0].rpartition("/")[2] for p in reader.partitions() for f in p.files] == ["a.txt"]
    assert lines.where("side = 'A' AND line = 1").count() == 2
    assert lines.where("side = 'A' AND pair_id IN ('p1', 'p9')").count() == 4 and lines.where("pair_id = 'p7'").count() == 0


def test_sweep_equals_all_pairs_on_crowded_pages(spark):
    rng = random.Random(9)
    spans = [(d, p, x, y, x + rng.uniform(0, 120), y + rng.uniform(0, 90), n) for n in range(1500) for d, p, x, y in [(1, rng.choice([1, 2]), rng.uniform(-50, 600), rng.uniform(-50, 900))]]
    words = [(1, rng.choice([1, 2, 3]), n, x, y, x + 20, y + 8, "w") for n in range(1500) for x, y in [(rng.uniform(-50, 600), rng.uniform(-50, 900))]]
    words.append((1, 1, 9999, None, 0.0, 1.0, 1.0, "w"))
    got = {r["word_seq"]: r["stream_order"] for r in spatial.stream_order(spark.createDataFrame(words, "doc_id int, page int, word_seq int, x0 double, y0 double, x1 double, y1 double, t string"), spark.createDataFrame(spans, "doc_id long, page long, x0 double, y0 double, x1 double, y1 double, span_order int")).collect()}
    for d, p, n, x0, y0, x1, y1, _ in words:
        over = [s[6] for s in spans if x0 is not None and s[:2] == (d, p) and s[2] <= (x0 + x1) / 2 <= s[4] and s[3] <= (y0 + y1) / 2 <= s[5]]
        assert got[n] == max(over, default=None)
