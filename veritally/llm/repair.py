"""Conversation structure repair (operator 12): the cheapest edits that make a conversation well formed.

Roles must read, by initials, ``(s?(ua)+)?``.  A turn is kept (0), given the role user or assistant (2) or deleted (3);
blank turns and duplicates must be deleted; an empty turn may be put in anywhere (2); a truncated turn that stays adds 1.
Nodes of the edit lattice are (turns done, state of the grammar); Dijkstra's search with the key (cost, audit), audit being
the initials of the edits, runs over it without building it and ends when it pops an accepting end node first.  An edit
fixes the role it gives, so the audit fixes the result.

Texts take no part in the search.  Rows move as 16-byte keys and flags; rows alike in turn, role and text are counted
before they move (the further copies are duplicates, deleted right after the first: `KDD` is less than any other order).
They are range-sorted over the cluster, and a conversation is a chain of blocks of at most ``BLOCK`` distinct rows.
Each block is searched on its own from every state; cost and rank of every (entry, exit) go to the conversation, where a
pass over its blocks picks the path: between blocks edits end with a row, so two audits always differ at some place
and a rank decides.  So no task holds a conversation's rows, only its blocks' 36 numbers each.

Defined cases: nulls in conv_id or turn are a space in `conv_id:turn` (damage); a null role or text is one space, so
blank; null turns come first; rows of one turn go by role, then a hash of the text, and repeated rows stay adjacent; a
conversation without rows left gives zeros; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import read, stored

BLOCK_BITS = 10
#: States of the grammar: nothing yet, after s, after u, after a.  By state: the role that comes next, and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NONE = 1 << 40


def edits(code: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, letter, state) of what can be done with a row.  code: `d` must go, else s, u, a or x (any other), in capitals if truncated."""
    out = [(DELETE, "D", state)]
    if code != "d":
        late = TRUNCATED if code.isupper() else 0
        out.append((REROLE + late, "R", NEXT[state][1]))
        if (state, code.lower()) in KEPT:
            out.append((late, "K", KEPT[state, code.lower()]))
    return out


@lru_cache(maxsize=4096)
def search(codes: str, entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """Dijkstra's search from the entry state: the best (cost, audit) by exit state.

    last: rows may be put in after the last row too, and the first accepting end node popped is the only one returned (as
    exit 0).  Else the exits of all states, each with a row as the last edit.
    """
    heap, done, ends, n = [(0, "", 0, entry)], set(), {}, len(codes)
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if last and state in (START, ASSISTANT):
                return {0: (cost, audit)}
            if not last:
                ends[state] = (cost, audit)
                continue
        else:
            for more, letter, to in edits(codes[i], state):
                if (i + 1, to) not in done:
                    heappush(heap, (cost + more, audit + letter, i + 1, to))
        if (i, NEXT[state][1]) not in done:
            heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state][1]))
    return ends


@lru_cache(maxsize=4096)
def summary(codes: str) -> tuple[list[int], list[int], list[int]]:
    """Costs and ranks (among the exits of an entry, by audit) of all 16 (entry, exit), and the cost to the end from each entry."""
    costs, ranks = [], []
    for entry in range(4):
        ends = search(codes, entry, False)
        place = {s: r for r, s in enumerate(sorted(ends, key=lambda s: ends[s][1]))}
        costs += [ends[s][0] if s in ends else NONE for s in range(4)]
        ranks += [place.get(s, 4) for s in range(4)]
    return costs, ranks, [search(codes, entry, True)[0][0] for entry in range(4)]


def path(blocks: list[tuple[list[int], list[int], list[int]]]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost and, per block, (entry, exit) of the path with the least (cost, audit); the last block's exit is -1."""
    best, back = {START: (0, 0)}, []  # state: cost, rank of the audit so far
    for costs, ranks, _ in blocks[:-1]:
        found = {}
        for s, (cost, rank) in best.items():
            for to in range(4):
                if costs[4 * s + to] < NONE:
                    found[to] = min(found.get(to, (NONE, 0, 0, 0)), (cost + costs[4 * s + to], rank, ranks[4 * s + to], s))
        order = {to: r for r, to in enumerate(sorted(found, key=lambda to: found[to][1:3]))}
        back.append({to: x[3] for to, x in found.items()})
        best = {to: (x[0], order[to]) for to, x in found.items()}
    total, _, state = min((cost + blocks[-1][2][s], rank, s) for s, (cost, rank) in best.items())
    out = [(state, -1)]
    for step in reversed(back):
        out.append((step[state], state))
        state = step[state]
    return total, out[::-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the damage that crc32(`conv_id:turn`) % 20 does; rows it drops have no copies."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows that are there, in order: conv_id, turn, role, text_key, pos, n (copies), fault (first fault of the first copy: blank, duplicate, truncated or none)."""
    seen = rows.where("copies > 0").select(
        "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_key"), "copies",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).cast("int").alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).cast("int").alias("cut"),
    )
    distinct = seen.groupBy("conv_id", "turn", "role", "text_key").agg(F.sum("copies").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_key")]
    placed = stored(distinct.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("pos", F.monotonically_increasing_id()), "placed")
    heads = placed.groupBy("conv_id", "role", "text_key").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("head"))
    fault = F.when(F.col("blank") == 1, "blank").when(F.col("head").isNull(), "duplicate").when(F.col("cut") == 1, "truncated").otherwise("none")
    return placed.join(heads, "pos", "left").select("conv_id", "turn", "role", "text_key", "pos", "n", fault.alias("fault"))


def blocks(rows: DataFrame) -> DataFrame:
    """conv_id, at (position of the first row), codes, initials, rows: runs of at most 2**BLOCK_BITS distinct rows of a conversation."""
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    own = F.array_sort(F.collect_list(F.struct("pos", "n", "turn", "role", "text_key", "fault", code.alias("code"), letter.alias("letter"))))
    grouped = rows.groupBy("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(own.alias("rows"))
    text = lambda field: F.array_join(F.transform("rows", lambda r: r[field]), "")
    return grouped.select("conv_id", F.col("rows")[0]["pos"].alias("at"), text("code").alias("codes"), text("letter").alias("initials"), "rows")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


@F.udf(_struct(costs=T.ArrayType(T.LongType()), ranks=T.ArrayType(T.IntegerType()), ends=T.ArrayType(T.LongType())), useArrow=True)
def _summary(codes):
    return summary(codes)


@F.udf(_struct(cost=T.LongType(), path=T.ArrayType(_struct(at=T.LongType(), entry=T.IntegerType(), exit=T.IntegerType()))), useArrow=True)
def _path(chain):
    total, steps = path([(list(b["costs"]), list(b["ranks"]), list(b["ends"])) for b in chain])
    return total, [(b["at"], *s) for b, s in zip(chain, steps)]


@F.udf(T.ArrayType(_struct(row=T.IntegerType(), letter=T.StringType(), role=T.StringType())), useArrow=True)
def _steps(codes, entry, exit):
    """The edits of a block: the row (null for one put in), the letter, and the role that it gets (null: its own)."""
    out, i, state = [], 0, entry
    for letter in search(codes, entry, exit < 0)[max(exit, 0)][1]:
        role, to = NEXT[state]
        if letter == "I":
            out.append((None, letter, role))
        else:
            out.append((i, letter, role if letter == "R" else None))
            to = {"D": state, "K": KEPT.get((state, codes[i].lower())), "R": to}[letter]
            i += 1
        state = to
    return out


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (conv_id, turn, role, text, copies): the repaired turns, and a report on each conversation that has rows.

    Turns: conv_id, at and step (their order), edit (K, R or I), turn, role, text.  Report: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit.
    """
    chain = stored(blocks(ordered(rows)), "blocks")
    each = lambda f: F.aggregate("rows", F.lit(0).cast("long"), lambda done, r: done + f(r))
    copies = lambda r, fault: F.when(r["fault"] == fault, r["n"]).otherwise(0)
    inner = F.size(F.filter(F.sequence(F.lit(1), F.length("initials")), lambda i: (i > 1) & ~F.substring(F.col("initials"), i - 1, F.lit(2)).isin("su", "ua", "au")))
    facts = chain.select(
        "conv_id", F.struct("at", _summary("codes").alias("s"), F.substring("initials", 1, 1).alias("first"), F.substring("initials", -1, 1).alias("final")).alias("b"),
        each(lambda r: copies(r, "blank")).alias("blank"),
        each(lambda r: F.when(r["fault"] == "duplicate", r["n"]).when(r["fault"] == "blank", 0).otherwise(r["n"] - 1)).alias("duplicate"),
        each(lambda r: (r["fault"] == "truncated").cast("long")).alias("truncated"),
        (inner + each(lambda r: r["n"] - 1)).alias("illegal"), (each(lambda r: r["n"] - 1) * DELETE).alias("more"),
    )
    flat = lambda b: F.struct(b["at"].alias("at"), b["s"]["costs"].alias("costs"), b["s"]["ranks"].alias("ranks"), b["s"]["ends"].alias("ends"))
    order = F.col("chain")
    across = F.size(F.filter(F.sequence(F.lit(1), F.size(order)), lambda i: (i > 1) & ~F.concat(order[F.greatest(i - 2, F.lit(0))]["final"], order[i - 1]["first"]).isin("su", "ua", "au")))
    found = stored(
        facts.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("chain"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "more")))
        .select("conv_id", "blank", "duplicate", "truncated", (F.col("illegal") + across).alias("illegal"), "more", _path(F.transform("chain", flat)).alias("best")), "paths",
    )
    route = found.select(F.inline("best.path")).withColumnRenamed("at", "block")
    done = chain.join(route, F.col("at") == F.col("block")).select("conv_id", "at", "rows", _steps("codes", "entry", "exit").alias("steps"))
    piece = F.array_join(F.transform("steps", lambda t: F.when(t["row"].isNull(), t["letter"]).otherwise(F.concat(t["letter"], F.repeat(F.lit("D"), (F.col("rows")[t["row"]]["n"] - 1).cast("int"))))), "")
    done = stored(done.withColumn("piece", piece), "edited")
    audits = done.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("audit"))
    turns = chain.select("conv_id", F.explode("rows.turn").alias("turn")).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    report = _merged("conv_id", found.select("conv_id", "blank", "duplicate", "truncated", "illegal", (F.col("best.cost") + F.col("more")).alias("cost")), audits, turns)
    left = done.select("conv_id", "at", "rows", F.posexplode("steps").alias("step", "e")).where("e.letter <> 'D'").withColumn("r", F.when(F.col("e.row").isNotNull(), F.col("rows")[F.col("e.row")]))
    left = left.select("conv_id", "at", "step", F.col("e.letter").alias("edit"), F.col("r.turn").alias("turn"), F.coalesce("e.role", "r.role").alias("role"), F.when(F.col("r").isNotNull(), _row_key(F.col("r.role"), F.col("r.text_key"), F.col("r.turn"))).alias("row_key"))
    texts = rows.where("copies > 0").select(_row_key(F.col("role"), F.md5(F.col("text").cast("binary")), F.col("turn")).alias("row_key"), "text").groupBy("row_key").agg(F.first("text").alias("text"))
    put_in = left.where("row_key IS NULL").select("conv_id", "at", "step", "edit", "turn", "role", F.lit("").alias("text"))
    return left.where("row_key IS NOT NULL").join(texts.hint("merge"), "row_key").select(*put_in.columns).unionByName(put_in), report


def _row_key(role: Column, text_key: Column, turn: Column) -> Column:
    """One key for conversation, turn, role and text, nulls told apart."""
    say = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    return F.unhex(F.md5(F.concat_ws("|", say(F.col("conv_id")), say(turn), F.md5(role.cast("binary")), text_key).cast("binary")))


def _merged(key: str, *parts: DataFrame) -> DataFrame:
    """The rows of all parts by key, nulls of the key included; each other column is in one part."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.groupBy(key).agg(*(F.max(c).alias(c) for c in whole.columns if c != key))


def _hashed(batches):
    """SHA-256 of `role:text` lines of each conversation, as its rows pass by in order: one conversation's state at a time."""
    conv, state, any_row = None, None, False
    for batch in batches:
        ids, lines, out = batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), []
        for c, line in zip(ids, lines):
            if not any_row or c != conv:
                if any_row:
                    out.append((conv, state.hexdigest()))
                conv, any_row, state = c, True, hashlib.sha256(line.encode())
            else:
                state.update(b"\n" + line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], ["conv_id", "repaired_sha256"])
    if any_row:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])


def digest(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of `conversations` (conv_id of a whole number type): the report of repair(rows) and the hash of the repaired turns.

    A hash over a conversation takes its turns in one order: they stream through one task and are never held.
    """
    turns, report = repair(rows)
    lines = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "at", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    hashes = lines.repartition("conv_id").sortWithinPartitions("conv_id", "at", "step").select("conv_id", "line").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = _merged("conv_id", report.withColumn("conv_id", F.col("conv_id").cast("long")), hashes, ids)
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return digest(conversations, damaged(conversations))
