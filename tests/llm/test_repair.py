"""Repair of conversations against a search over all edits, whatever the blocks."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from tests.conftest import DATA
from veritally.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, at long, step int, n int, cost int"
WORD = set(map(chr, [0x20, *range(9, 14)]))


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 1:
            text = ""
        if k == 2:
            text = text.translate({ord(x): None for x in ".!?"})
        if k == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain(rows):
    """Report and hash by dynamic programming over suffixes, audits as whole strings."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}}
    left = plain_damage(rows)
    for c in {r[0] for r in left}:
        own = sorted((r for r in left if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], md5(r[3])))
        faults, seen = [], set()
        for _, _, role, text in own:
            shown = [x for x in text if x not in WORD]
            faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

        @lru_cache(maxsize=None)
        def best(i, state, spare):
            """Least (cost, audit, turns) from row i on; spare: turns that may still be put in here."""
            found = []
            if i == len(own):
                if state in ("", "a"):
                    found.append((0, "", ()))
            else:
                later = lambda cost, letter, to, turn: [(cost + x[0], letter + x[1], turn + x[2]) for x in [best(i + 1, to, 3)] if x]
                found += later(3, "D", state, ())
                if faults[i] in ("", "t"):
                    late = int(faults[i] == "t")
                    role, text = own[i][2], own[i][3]
                    if role[:1] in grammar[state]:
                        found += later(late, "K", grammar[state][role[:1]], (f"{role}:{text}",))
                    for new in ("user", "assistant"):
                        if new[0] in grammar[state]:
                            found += later(2 + late, "R", grammar[state][new[0]], (f"{new}:{text}",))
            for new in ("user", "assistant"):
                if spare and new[0] in grammar[state]:
                    x = best(i, grammar[state][new[0]], spare - 1)
                    if x:
                        found.append((2 + x[0], "I" + x[1], (f"{new}:",) + x[2]))
            return min(found) if found else None

        cost, audit, turns = best(0, "", 3)
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[c] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 5, 5, 5, 5) for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in repair.digest(df, repair.damaged(df)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], (c, [r for r in rows if r[0] == c])


def made(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["one.", "two", "", " \n", "three!", "four? ", "five.\t", "six", None, "é。", "Ends.)"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, longest)):
            turn = rng.choice([t, t, t, t, t + 3, None, -t, t // 2])
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "support"]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows


def test_all_conversations_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op12_repair(spark, f"{DATA}/sf0.01").collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("bits", [0, 1, 2, 10])
def test_odd_rows_in_blocks_of_any_size(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    odd = made(bits, 60, 14) + [(None, 1, "user", "null id."), (None, None, "assistant", "a."), (-5, 0, "user", "x."), (-5, 0, "user", "x."), (-5, 0, "user", "x.")]
    check(spark, odd)


def test_all_rows_dropped_and_empty_table(spark):
    gone = [(c, t, "user", "x.") for c in range(300) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    check(spark, gone)
    check(spark, [])


def test_long_conversation_spans_blocks(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), "long " * rng.randrange(1, 2000) + rng.choice([".", ""])) for t in range(220)]
    try:
        repair.BLOCK_BITS = 4
        check(spark, rows)
    finally:
        repair.BLOCK_BITS = 10
