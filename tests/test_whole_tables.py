from collections import defaultdict

import duckdb
import pytest

from tests.conftest import DATA
from veritally import catalog

AT = f"{DATA}/sf0.001"


def rows(sql):
    return duckdb.sql(sql.replace("@", AT)).fetchall()


@pytest.mark.parametrize("name", ["greedy_pairs", "sequential_pairs"])
def test_matching_reads_all_customers(spark, name):
    right, left = defaultdict(list), defaultdict(list)
    for nation, key, x in rows("SELECT s_nationkey, s_suppkey, s_acctbal FROM '@/supplier.parquet'"):
        right[nation].append((key, x))
    for nation, key, x in rows("SELECT c_nationkey, c_custkey, c_acctbal FROM '@/customer.parquet' ORDER BY c_custkey"):
        left[nation].append((key, x))
    want = set()
    for nation in left:
        a, b = set(), set()
        if name == "greedy_pairs":
            order = sorted((abs(x - y), i, j) for i, x in left[nation] for j, y in right[nation])
        else:
            order = [(s, i, j) for i, x in left[nation] for s, j in sorted((abs(x - y), j) for j, y in right[nation]) if 1 / (1 + s / 1000) >= 0.42]
        for _, i, j in order:
            if i not in a and j not in b:
                a.add(i)
                b.add(j)
                want.add((i, j))
    assert {(r["a"], r["b"]) for r in catalog.queries()[name](spark, AT).collect()} == want


def test_label_similarity_reads_all_parts(spark):
    want = set(rows("SELECT a.p_partkey, b.p_partkey FROM '@/part.parquet' a JOIN '@/part.parquet' b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey"))
    assert {(r["i"], r["j"]) for r in catalog.queries()["label_similarity"](spark, AT).collect()} == want


def test_kept_rectangles(spark):
    """Every rectangle in order of its id: kept unless it overlaps a kept one by half."""
    want = set()
    for (label,) in rows("SELECT DISTINCT label FROM '@/embeddings.parquet'"):
        kept = []
        where = "label IS NULL" if label is None else f"label = {label!r}"
        for i, a, b, c, d in rows(f"SELECT vec_id, embedding[1], embedding[2], embedding[3], embedding[4] FROM '@/embeddings.parquet' WHERE {where} ORDER BY vec_id"):
            box = (min(a, b), min(c, d), max(a, b), max(c, d))

            def share(o, box=box):
                w, h = max(0, min(box[2], o[2]) - max(box[0], o[0])), max(0, min(box[3], o[3]) - max(box[1], o[1]))
                union = (box[2] - box[0]) * (box[3] - box[1]) + (o[2] - o[0]) * (o[3] - o[1]) - w * h
                return w * h / union if union else 0

            if all(share(o) < 0.5 for o in kept):
                kept.append(box)
                want.add(i)
    assert {r["vec_id"] for r in catalog.queries()["iou_dedupe"](spark, AT).collect()} == want


def test_merged_boxes_stay_apart(spark):
    """No two boxes of a label that come out are near each other, and every rectangle lies in one of them."""
    boxes = defaultdict(list)
    for r in catalog.queries()["merged_boxes"](spark, AT).collect():
        boxes[r["label"]].append((r["x0"], r["y0"], r["x1"], r["y1"]))
    for own in boxes.values():
        for k, a in enumerate(own):
            assert not any(a[0] <= b[2] + 5 and b[0] <= a[2] + 5 and a[1] <= b[3] + 5 and b[1] <= a[3] + 5 for b in own[k + 1 :])
    for label, a, b, c, d in rows("SELECT label, embedding[1] * 1000, embedding[2] * 1000, embedding[3] * 1000, embedding[4] * 1000 FROM '@/embeddings.parquet'"):
        x0, y0, x1, y1 = min(a, b), min(c, d), max(a, b), max(c, d)
        assert any(o[0] <= x0 + 1e-3 and o[1] <= y0 + 1e-3 and o[2] >= x1 - 1e-3 and o[3] >= y1 - 1e-3 for o in boxes[label])


def test_label_similarity_values(spark):
    import difflib

    names = dict(rows("SELECT p_partkey, p_name FROM '@/part.parquet'"))
    for r in catalog.queries()["label_similarity"](spark, AT).limit(500).collect():
        x, y = names[r["i"]], names[r["j"]]
        ratio = difflib.SequenceMatcher(None, x, y).ratio()
        assert abs(r["similarity"] - round(max(ratio, 0.92) if x in y or y in x else ratio, 6)) < 1e-6


def test_hamming_pairs_are_not_sent_to_every_task(spark):
    """Ten rows a text with all its keys went through the driver to every task, for the file is small."""
    assert "Broadcast" not in catalog.queries()["hamming_pairs"](spark, AT)._jdf.queryExecution().executedPlan().toString()


def test_label_similarity_in_blocks(spark, tmp_path, monkeypatch):
    """Pairs are made from blocks of parts of one name; parts without a name were lost with all their pairs."""
    import difflib

    from veritally.plans import texts

    monkeypatch.setattr(texts, "BLOCK", 3)
    parts = [(i * 7 % 40, f"Brand#{i % 3}", (None, "red bolt", "red", "blue ring")[i % 4]) for i in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")

    def alike(x, y):
        if not x or not y:
            return 0.0
        ratio = difflib.SequenceMatcher(None, x, y).ratio()
        return round(max(ratio, 0.92) if x in y or y in x else ratio, 6)

    want = sorted((i, j, alike(x, y)) for i, b, x in parts for j, c, y in parts if b == c and i < j)
    assert sorted(map(tuple, catalog.queries()["label_similarity"](spark, str(tmp_path)).collect())) == want
