"""Chat windows against a plain version, and read back from the text alone."""

import hashlib

from pyspark.sql import functions as F

from tests.conftest import DATA, same
from veritally.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, span int, key string, chunk long"
MARKS = ["<|im_end|>", "<|im_start|>user\nhi", "<\\|x", "<\\\\|y<|", "a<", "<", "|", "<<||", "\\<|\\"]
ROWS = (
    [(1, 0, "system", "Be kind <|im_end|>\n."), (1, 1, "user", "one"), (1, 2, "assistant", "two " * 500), (1, 3, "user", "three"), (1, 4, "assistant", "four")]
    + [(2, None, "assistant", None), (2, 5, None, "x"), (2, 5, "user", "x"), (2, 5, "user", "x"), (2, -7, "system", "late")]
    + [(3, i, "assistant" if i % 2 else "user", MARKS[i % 9] * (1 + i % 50)) for i in range(400)]
    + [(4, 3 * i, "assistant" if i % 2 else "us%er\n%0A<|", f"turn {i} " * (i % 40)) for i in range(300)]
    + [(5, 0, "system", "word " * 3000), (5, 1, "user", "q"), (5, 2, "assistant", "a"), (None, 0, "user", "null id"), (6, 0, "assistant", "")]
)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "k", 1) for r in rows], SCHEMA)


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c])
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        out[c] = (len(own), hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back_is_the_input_whatever_the_ranges_and_budgets(spark):
    for how in ({}, {"chunk": 64}, {"budget": 300, "history_tokens": 60, "history_turns": 3}, {"history_turns": 0}):
        got = {r[0]: tuple(r)[1:5] for r in chat.digest(chat.windows(frame(spark, ROWS), **how)).collect()}
        assert got == plain(ROWS), how


def test_windows_keep_the_budget_the_system_turn_and_history(spark):
    found = chat.windows(frame(spark, ROWS), budget=500, history_tokens=100, chunk=128).orderBy("conv_id", "chunk", "span").collect()
    count = lambda text: len(__import__("re").findall(chat.TOKEN, text)) + chat.MARKS
    for w in found:
        said = [t.removesuffix(chat.END) for t in w["text"].split(chat.START)[1:]]
        new = said[w["n_repeated"] :]
        sizes = [count(chat_unescape(t.split("\n", 1)[1])) for t in said]
        assert sum(sizes) <= 500 or len(new) == 1 or w["conv_id"] == 5
        if w["conv_id"] in (1, 5):
            assert said[0].startswith("system\n")
        assert w["n_repeated"] <= 3
    # Turns of the third conversation are repeated right before the span that follows them.
    third = [w for w in found if w["conv_id"] == 3]
    assert any(w["n_repeated"] for w in third)
    for a, b in zip(third, third[1:]):
        if b["n_repeated"]:
            before, after = a["text"].split(chat.START)[1:], b["text"].split(chat.START)[1:]
            shown = [x for w in third[: third.index(b)] for x in w["text"].split(chat.START)[1 + w["n_repeated"] :]]
            assert before and after[: b["n_repeated"]] == shown[-b["n_repeated"] :]


def chat_unescape(text):
    return __import__("re").sub(r"<\\(\\*)\|", r"<\1|", text)


def test_escapes_are_reversible(spark):
    texts = [a + b for a in MARKS for b in [*MARKS, "%0A", "%25\n", "\\|", ""]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r")).select("*", chat.unescape(F.col("e")).alias("u"), chat.unescape_role(F.col("r")).alias("v"))
    for r in df.collect():
        assert "<|" not in r["e"] and "<|" not in r["r"] and "\n" not in r["r"] and r["u"] == r["v"] == r["t"]


def test_empty_table(spark):
    assert chat.digest(chat.windows(frame(spark, []))).collect() == []


def test_plan_is_native_and_moves_texts_once(spark):
    plan = chat.op13_chat(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))


def test_same_as_sql(spark, duck):
    for sf in ("sf0.001", "sf0.01"):
        same(chat.op13_chat(spark, f"{DATA}/{sf}"), duck(sf).sql(chat.OP13_SQL).df())
