"""Numeric checks of keys with many items: against all pairs where those are few, and at a size where they are too many."""

import difflib
import random
import time

from pyspark.sql import functions as F

from tests.test_checks import ITEM
from veritally.functions import units
from veritally.plans import checks
from veritally.sources import readers

NAMED = ITEM + ", name string"


def relative(a, h):
    return abs(a - h) / max(abs(a), abs(h), 1e-9)


def all_pairs(rows):
    """Every pair of a key scored: open keys with the values of the best pair, and its state."""
    times = {None: 1.0, "thousand": 1e3, "万元": 1e4}
    by, best, agreed, out = {}, {}, {}, set()
    for p, s, seq, k, v, u, _, period, _, context, sure, source, name in rows:
        if v is not None and not 1990 <= v <= 2035 and not 0 < abs(v) < 50:
            label = (name or k).lower()
            by.setdefault((p, k), {"A": [], "H": []})[s].append((seq, v * times[u], context, sure, period, source, label, k in (name or "").lower(), v, times[u]))
    for key, sides in by.items():
        for a in sides["A"]:
            for h in sides["H"]:
                ok = None if (a[2] is None or h[2] is None) else a[2] == h[2] and a[2] != "unknown"
                sure = None if a[3] is None or h[3] is None else (a[3] + h[3]) / 2
                period = 0.8 if a[4] is None or h[4] is None else float(a[4] == h[4])
                source = (0.5 if a[5] == "table" else 0.25) + (0.5 if h[5] == "table" else 0.25)
                label = max(difflib.SequenceMatcher(None, a[6], h[6]).ratio(), (0.62, 0.72, 0.92)[a[7] + h[7]])
                ratio = relative(a[1], h[1])
                like = 0.0 if ratio != ratio else max(0.0, 1 - min(ratio, 1.0))
                score = None if ok is None or sure is None else 0.28 * ok + 0.24 * label + 0.20 * sure + 0.12 * period + 0.08 * source + 0.08 * like
                tests = (ok, None if sure is None else sure >= 0.88, label >= 0.62, period >= 0.5, source >= 0.5, None if score is None else score >= 0.72)
                state = "unresolved" if any(t is False for t in tests) else "real"
                best[key] = min(best.get(key, (2, 0, 0)), (1 if score is None else -score, a[0], h[0], a[1], h[1], state))
    factors = {}
    for p in {p for p, _ in best}:
        usable = [abs(b[3] / b[4]) for (q, _), b in best.items() if p == q and abs(b[3]) >= 1000 and abs(b[4]) >= 1000]
        rs = sorted(r if 4 <= r <= 10 else 1 / r for r in usable if 4 <= r <= 10 or 0.1 <= r <= 0.25)
        near = [r for r in rs if abs(r - rs[len(rs) // 2]) / rs[len(rs) // 2] <= 0.1] if len(rs) >= 2 else []
        if len(near) >= 3 or (len(near) == 2 and max(near) / min(near) <= 1.04):
            factors[p] = sum(near) / len(near)
    fixes = {x / y for x in units.FIX for y in units.FIX}
    for (p, k), b in best.items():
        least, factor = (25.0 if k in ("key1", "key2") else 0.0), factors.get(p)
        for a in by[p, k]["A"]:
            for h in by[p, k]["H"]:
                if a[2] == h[2] and a[2] not in (None, "unknown"):
                    ratio = relative(a[1], h[1])
                    if abs(a[1] - h[1]) <= least * a[9] or ratio <= 0.01 or (a[9] != h[9] and ratio <= 0.02) or min(relative(a[8] * q, h[8]) for q in fixes) <= 0.02 or (factor and relative(a[1], h[1] * factor) <= 0.05):
                        agreed[p, k] = True
        if (p, k) not in agreed:
            out.add((p, k, b[3], b[4], b[5]))
    return out


def test_equals_all_pairs(spark):
    """Few and many items a key, ties, units, values of both signs, nought and none, contexts and confidences that are null."""
    rnd, rows = random.Random(5), []
    for k in range(100):
        for i in range(rnd.choice([2, 4, 8, 40])):
            value = rnd.choice([rnd.uniform(60, 1900), 10 ** rnd.uniform(2, 9), -(10 ** rnd.uniform(2, 6)), rnd.choice([70.0, 5000.0])])
            if rnd.random() < 0.02:
                value = rnd.choice([0.0, float("nan"), float("inf"), None])
            context = rnd.choice(["main"] * 6 + ["segment", "unknown", None]) if k % 4 else rnd.choice(["unknown", "main", "segment"])
            sure = rnd.choice([0.9, 0.95, rnd.random(), None]) if k % 5 else None
            rows.append((f"p{k % 20}", "AH"[i % 2], i + 1, f"key{k // 20}", value, rnd.choice([None] * 4 + ["thousand", "万元"]), "CNY", rnd.choice(["2023", "2024", None]), i, context, sure, rnd.choice(["table", "text", None]), rnd.choice([None, "Alpha", f"the key{k // 20}", "beta"])))
    table = spark.createDataFrame(rows, NAMED)
    rules = readers.rules(spark, [{"rule_id": "R", "targets": ["key1", "key2"], "tolerance": 25.0}])
    want = all_pairs(rows)
    got = {(r["pair_id"], r["canonical_key"], r["a_value"], r["h_value"], r["triage"]) for r in checks.numeric(table, rules).collect()}
    assert len(want) > 20 and {repr(x) for x in got} == {repr(x) for x in want}


def test_one_key_of_many_items(spark):
    """20,000 items a side (400 million pairs, which took far longer than this allows)."""
    n = F.col("id")
    table = spark.range(40_000).select(F.lit("p").alias("pair_id"), F.when(n % 2 == 0, "A").otherwise("H").alias("side"), n.alias("seq"), F.lit("k").alias("canonical_key"), F.when(n % 2 == 0, 3000 + n / 400).otherwise(5e12 + n).alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("CNY").alias("currency"), F.lit("2024").alias("period"), F.lit(1).alias("page"), F.lit("main").alias("context"), (0.9 + (n * 7919 % 1000) / 1e4).alias("confidence"), F.lit("table").alias("source"))
    began = time.monotonic()
    got = checks.numeric(table, readers.rules(spark, [])).collect()
    assert len(got) == 1 and got[0]["triage"] == "real" and time.monotonic() - began < 90
