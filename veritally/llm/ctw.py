"""Language-model scores by context-tree weighting, beside a smoothed unigram base.

Texts become a stream of bytes: lower-cased words, one space between, one end byte.  Every byte is eight binary
decisions; each decision has a context tree over the DEPTH bytes before.  A node holds how often 0 and 1 followed; its
Krichevsky-Trofimov estimate is mixed with those of all deeper contexts, the weight of a node being the posterior
probability that the context ends there, from the block probabilities of the whole training stream:
P_w = P_e / 2 + prod(P_w of the longer contexts) / 2.  Contexts that never occurred end the mixture.

No node is dropped and nothing is broadcast that grows with the corpus: each part of the documents (as they are read)
asks for the values of its own distinct words and (DEPTH+1)-grams and tells how often they occur in training.

* Asks are dealt by hash: words by themselves, grams by their TOP nearest context bytes, so that a task holds whole subtrees.
* Counts are added up by task and stored: the distinct grams of all training texts.  Sums for the contexts of TOP-1
  bytes go to the driver, which finishes the upper levels (at most 2**24 nodes, whatever the corpus).
* Each task works out the weights of its subtrees and the probability of every gram that was asked for, and answers
  part by part.  Where there are many parts, several tasks share a subtree's asks and each has its counts.
* Each part meets the answers and adds up its texts' scores.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels as K
from .common import held_out, read, stored
from .substrings import _planes, _unplanes

#: Context bytes of the deepest nodes; context bytes by which subtrees are dealt.
DEPTH, TOP = 5, 3
#: Tasks that share the subtrees, documents to a task of words, parts whose asks one task answers, bytes of a part.
SUBTREES, WORD_DOCS, SHARE, PART_BYTES = 256, 4000, 256, 16 << 20
#: Answers are whole multiples of 1 / SCALE in 24 bits: down to 1e-128, exact to 4e-6 (a text's sum to about that times the root of its length).
SCALE = 1 << 17
#: Bytes of text that are scored at a time.
SLICE = 256 << 10
#: Distinct grams held at once while counts are added up.
HELD = 1_500_000
FOLDS = 7
END = 10  # a byte that no word holds
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray, K.Words]:
    """(bytes of all texts joined, first byte of each text and the end, words): every text as words, spaces, END."""
    w = K.words(column, "space", lower=True)
    length = w.end - w.start
    wide = np.bincount(w.text_of, length + 1, minlength=len(column)).astype(np.int64)
    wide[w.counts == 0] = 1
    first = np.append(0, np.cumsum(wide))
    out = np.full(int(first[-1]), 32, np.uint8)
    out[first[1:] - 1] = END
    rank = np.cumsum(length + 1) - (length + 1)
    at = rank - (rank[w.first[:-1].clip(max=max(len(rank) - 1, 0))] - first[:-1])[w.text_of] if len(rank) else rank
    inside = K.ranges(length)
    out[np.repeat(at, length) + inside] = _LOWER[w.buf[np.repeat(w.start, length) + inside]]
    return out, first, w


def grams(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each byte with the DEPTH before it: byte DEPTH+1 of the number is the byte, the next lower its nearest context.

    Before a text stand END bytes.
    """
    n = len(data)
    out = data.astype(np.uint64) << np.uint64(8 * DEPTH)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    for k in range(1, DEPTH + 1):
        before = np.full(n, END, np.uint8)
        before[k:] = data[: n - k]
        before[place < k] = END
        out |= before.astype(np.uint64) << np.uint64(8 * (DEPTH - k))
    return out


def lgamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) of whole numbers."""
    u, back = np.unique(n, return_inverse=True)
    return np.array([math.lgamma(x + 0.5) for x in u.tolist()])[back]


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    u, back = np.unique(a + b, return_inverse=True)
    return lgamma_half(a) + lgamma_half(b) - math.log(math.pi) - np.array([math.lgamma(x + 1.0) for x in u.tolist()])[back]


def decisions(context: np.ndarray, byte: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, prefix, zeros, ones) of all nodes of one depth."""
    node, bit = [], []
    for j in range(8):
        node.append(context << np.uint64(8) | np.uint64(1 << j) | byte >> np.uint64(8 - j))
        bit.append((byte >> np.uint64(7 - j)) & np.uint64(1))
    u, back = np.unique(np.concatenate(node), return_inverse=True)
    one = np.concatenate(bit) == 1
    c = np.tile(count, 8)
    ones = np.bincount(back[one], c[one], minlength=len(u)).astype(np.int64)
    zeros = np.bincount(back[~one], c[~one], minlength=len(u)).astype(np.int64)
    return u >> np.uint64(8), u & np.uint64(255), zeros, ones


@dataclass
class Level:
    """Nodes of one depth: sorted numbers (context, then the bits of the byte so far), log odds of a 1, weights."""

    node: np.ndarray
    odds: np.ndarray
    weight: np.ndarray

    def find(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether it exists, log odds, weight) of each node."""
        if not len(self.node):
            return np.zeros(len(node), bool), np.zeros(len(node)), np.ones(len(node))
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return self.node[at] == node, self.odds[at], self.weight[at]


def level_of(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray | None) -> tuple[Level, np.ndarray]:
    """A level from its counts and the sums of log P_w of the children (None: leaves), and its log P_w."""
    pe = log_kt(zeros, ones)
    pw = pe if split is None else np.logaddexp(pe, split) - math.log(2)
    weight = np.ones(len(pe)) if split is None else np.exp(pe - pw - math.log(2))
    return Level(node, np.log((ones + 0.5) / (zeros + 0.5)), weight), pw


def subtrees(gram: np.ndarray, count: np.ndarray) -> tuple[dict[int, Level], tuple[np.ndarray, ...]]:
    """The levels TOP..DEPTH of whole subtrees, and (node, zeros, ones, sum of log P_w of the children) for depth TOP-1."""
    byte, context = gram >> np.uint64(8 * DEPTH), gram & np.uint64((1 << (8 * DEPTH)) - 1)
    out, split = {}, None
    for depth in range(DEPTH, TOP - 2, -1):
        at, prefix, zeros, ones = decisions(context >> np.uint64(8 * (DEPTH - depth)), byte, count)
        node = at << np.uint64(8) | prefix
        if depth < DEPTH:
            split = np.bincount(np.searchsorted(node, parent), pw, minlength=len(node))
        if depth < TOP:
            return out, (node, zeros, ones, split)
        out[depth], pw = level_of(node, zeros, ones, split)
        parent = at >> np.uint64(8) << np.uint64(8) | prefix  # the farthest byte, the lowest, goes


def upper(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray) -> dict[int, Level]:
    """The levels TOP-1..0 from the nodes of depth TOP-1; depth 0 always has all 255 nodes."""
    order = np.argsort(node)
    node, zeros, ones, split = node[order].astype(np.uint64), zeros[order], ones[order], split[order]
    out = {}
    for depth in range(TOP - 1, -1, -1):
        out[depth], pw = level_of(node, zeros, ones, split)
        up = node >> np.uint64(16) << np.uint64(8) | node & np.uint64(255) if depth > 1 else node & np.uint64(255)
        node, back = np.unique(up, return_inverse=True)
        zeros, ones, split = (np.bincount(back, x, minlength=len(node)) for x in (zeros, ones, pw))
        zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
    every = np.arange(1, 256).astype(np.uint64)
    known, odds, weight = out[0].find(every)
    out[0] = Level(every, np.where(known, odds, 0.0), np.where(known, weight, 1.0))
    return out


def log10_of(gram: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """Log10 of the probability of each gram's last byte after its context."""
    byte, context = gram >> np.uint64(8 * DEPTH), gram & np.uint64((1 << (8 * DEPTH)) - 1)
    total = np.zeros(len(gram))
    for j in range(8):
        prefix = np.uint64(1 << j) | byte >> np.uint64(8 - j)
        p, deeper = np.zeros(len(gram)), np.zeros(len(gram), bool)
        for depth in range(DEPTH, -1, -1):
            own = context >> np.uint64(8 * (DEPTH - depth)) if depth else np.zeros(len(gram), np.uint64)
            live, odds, weight = levels[depth].find(own << np.uint64(8) | prefix)
            kt = 1 / (1 + np.exp(-odds))
            p = np.where(live, np.where(deeper, weight * kt + (1 - weight) * p, kt), p)
            deeper |= live
        bit = (byte >> np.uint64(7 - j)) & np.uint64(1)
        total += np.log10(np.where(bit == 1, p, 1 - p))
    return total


ROWS = "kind int, to int, part long, n long, total long, keys binary, counts binary"
WORD, GRAM, ENDS, MODEL = 0, 1, 2, 3


def _values(x: np.ndarray) -> bytes:
    wide = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _unvalues(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return out.view("<u8").ravel().astype(np.int64)


def _row(kind: int, to: int, part: int, keys: np.ndarray, counts: np.ndarray) -> tuple:
    """Sorted keys and their counts as a row."""
    wide = int(np.diff(keys, prepend=np.uint64(0)).max(initial=0)).bit_length()
    return kind, to, part, len(keys), int(counts.sum()), _planes(keys, max(1, -(-wide // 8))), _values(counts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], ["kind", "to", "part", "n", "total", "keys", "counts"])


def _runs(key: np.ndarray):
    edges = np.flatnonzero(np.diff(key, prepend=-1, append=-1)) if len(key) else np.zeros(1, int)
    return zip(edges[:-1], edges[1:])


def _added(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys of (keys, counts) and the sums of their counts."""
    keys = np.concatenate([k for k, _ in pairs])
    order = np.argsort(keys)
    keys, counts = keys[order], np.concatenate([c for _, c in pairs])[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def part_of(spark) -> Column:
    """The part of a row: its partition as read, by a hash of the id where partitions have many times PART_BYTES."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()
    digits = size.rstrip("kmgtpib")
    shares = max(1, int(digits) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[size[len(digits) :].rstrip("ib")[:1]] // PART_BYTES)
    return (F.spark_partition_id().cast("long") * shares + F.pmod(F.xxhash64("id"), F.lit(shares))).alias("part")


def bucket_of(gram: np.ndarray) -> np.ndarray:
    """Task of a gram: by its TOP nearest context bytes."""
    return (K.mix((gram >> np.uint64(8 * (DEPTH - TOP))) & np.uint64((1 << 8 * TOP) - 1)) % np.uint64(SUBTREES)).astype(np.int64)


def gather(documents: DataFrame, words: int) -> DataFrame:
    """What parts ask and tell, from documents (id, held_out, part, text).

    WORD, GRAM: distinct keys of a part by task `to`, with their counts in training documents.  ENDS: training documents (n).
    """

    def dealt(kind: int, part: int, found: list) -> list[tuple]:
        u, c = _added(found)
        to = bucket_of(u) if kind == GRAM else (u % np.uint64(words)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        u, c, to = u[order], c[order], to[order]
        return [_row(kind, int(to[a]), part, u[a:b], c[a:b]) for a, b in _runs(to)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        told, held, docs = defaultdict(list), 0, 0
        for b in batches:
            parts, train = b["part"].to_numpy(), ~b["held_out"].to_numpy(zero_copy_only=False)
            docs += int(train.sum())
            for i, j in K.slices(b["text"]):
                data, first, w = stream(b["text"].slice(i, j - i))
                g, text = grams(data, first), np.repeat(np.arange(j - i), np.diff(first))
                of_text, group = np.unique(parts[i:j] * 2 + train[i:j], return_inverse=True)
                for k, x in enumerate(of_text.tolist()):
                    for kind, keys, own in ((WORD, w.hash, w.text_of), (GRAM, g, text)):
                        u, c = np.unique(keys[group[own] == k] if len(of_text) > 1 else keys, return_counts=True)
                        if len(u):
                            had = told[kind, x // 2]
                            had.append((u, c.astype(np.int64) * (x % 2)))
                            held += len(u)
                            if len(had) > 16:  # what is held stays near the distinct keys
                                had[:], held = [new := _added(had)], held - sum(len(y) for y, _ in had)
                                held += len(new[0])
                if held > HELD:
                    for (kind, part), found in told.items():
                        yield _batch(dealt(kind, part, found))
                    told, held = defaultdict(list), 0
        for (kind, part), found in told.items():
            yield _batch(dealt(kind, part, found))
        yield _batch([(ENDS, 0, -1, docs, 0, b"", b"")])

    return documents.mapInArrow(run, ROWS)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """(row, keys, counts) one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            yield r, _unplanes(r["keys"], r["n"]), _unvalues(r["counts"] or b"", r["n"])


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training counts of the distinct grams of one task, added up as they are read, as one row."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    to, more = 0, 0
    for r, keys, counts in _unpacked(batches):
        use, to = counts > 0, r["to"]
        held.append((keys[use], counts[use]))
        more += int(use.sum())
        if more > max(HELD, len(held[0][0])):
            held, more = [_added(held)], 0
    yield _batch([_row(MODEL, to, -1, *_added(held))])


def answered_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Total training counts of the words of one task: a row for each that came, and one (part -1) with the number of known words and their sum."""
    asked = [(r["part"], keys, counts) for r, keys, counts in _unpacked(batches)]
    u, total = _added([(k, c) for _, k, c in asked])
    for part, keys, _ in asked:
        yield _batch([_row(WORD, 0, part, keys, total[np.searchsorted(u, keys)])])
    yield _batch([(MODEL, 0, -1, int((total > 0).sum()), int(total.sum()), b"", b"")])


SUMS = "node long, zeros long, ones long, split double"


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the upper levels need of each task's subtrees."""
    K.lean()
    for _, keys, counts in _unpacked(batches):
        if len(keys):
            node, zeros, ones, split = subtrees(keys, counts)[1]
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(zeros), pa.array(ones), pa.array(split)], ["node", "zeros", "ones", "split"])


def answered_grams(batches: Iterator[pa.RecordBatch], above: dict[int, Level]) -> Iterator[pa.RecordBatch]:
    """log10 of the probability of every gram that the parts ask, in steps of 1 / SCALE; one row of kind MODEL has the counts."""
    K.lean()
    asked, levels = [], {d: Level(*(np.zeros(0, t) for t in (np.uint64, float, float))) for d in range(TOP, DEPTH + 1)}
    for r, keys, counts in _unpacked(batches):
        if r["kind"] == MODEL and len(keys):
            levels = subtrees(keys, counts)[0]
        elif r["kind"] == GRAM:
            asked.append((r["part"], keys))
    if not asked:
        return
    u = np.unique(np.concatenate([k for _, k in asked]))
    value = np.concatenate([log10_of(u[i : i + 200_000], levels | above) for i in range(0, len(u), 200_000)])
    value = np.minimum(np.round(-value * SCALE), (1 << 24) - 1).astype(np.int64)
    for part, keys in asked:
        yield _batch([_row(GRAM, 0, part, keys, value[np.searchsorted(u, keys)])])


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _known(told: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the answers of one kind and their values, read row by row so that little is held twice."""
    use = told.filter(pa.compute.equal(told["kind"], kind))
    total, at = int(use["n"].to_numpy().sum()), 0
    keys, values = np.empty(total, np.uint64), np.empty(total, np.int64 if kind == WORD else np.int32)
    for _, k, v in _unpacked(iter(use.to_batches())):
        keys[at : at + len(k)], values[at : at + len(k)] = k, v
        at += len(k)
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def _looked_up(known: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    u, back = np.unique(keys, return_inverse=True)
    at = np.searchsorted(known[0], u)
    if len(u) and (at[-1] >= len(known[0]) or (known[0][at] != u).any()):
        raise RuntimeError("the partitions of the documents changed between two readings: store the documents first")
    return known[1][at][back]


def _score(docs: pa.Table, told: pa.Table, n: int, v: int, ends: int) -> pa.Table:
    words, contexts = _known(told, WORD), _known(told, GRAM)
    out, size = [], n + v + 1
    for b in docs.select(["id", "held_out", "text"]).to_batches():
        for i, j in K.slices(b["text"], SLICE):
            data, first, w = stream(b["text"].slice(i, j - i))
            c, text = _looked_up(words, w.hash), w.text_of
            base = np.bincount(text, np.log10((c + 1) / size), minlength=j - i) + math.log10((ends + 1) / size)
            score = np.add.reduceat(_looked_up(contexts, grams(data, first)), first[:-1]) / -SCALE
            out.append(pa.table({"doc_id": b["id"].slice(i, j - i), "held_out": b["held_out"].slice(i, j - i), "n_tokens": w.counts + 1, "n_known": np.bincount(text, c > 0, minlength=j - i).astype(np.int64) + (ends > 0), "train_tokens": np.full(j - i, n), "base_score": base, "score": score}))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()


def log_probability(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for every row.

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out of training.  Null texts count as empty: their
    only token is the end.  Rows are handled one by one, repeated ids too; other columns are not read.  A very long text is
    handled as a whole, in its part.  The documents are read twice, in the same partitions: a table, or a stored one.
    """
    spark = documents.sparkSession
    base = documents.select(F.col("doc_id").cast("long").alias("id"), held_out("doc_id", FOLDS).alias("held_out"), "text")
    docs = base.select("id", "held_out", part_of(spark), "text")
    seen = stored(gather(docs, max(64, documents.count() // WORD_DOCS)), "gathered", small=True)
    ends, parts = seen.agg(F.coalesce(F.sum(F.when(F.col("kind") == ENDS, F.col("n"))), F.lit(0)), F.coalesce(F.max("part"), F.lit(0)) + 1).first()
    told = stored(seen.where(F.col("kind") == WORD).groupBy("to").applyInArrow(answered_words, ROWS), "answers", small=True)
    n, v = told.where(F.col("kind") == MODEL).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = n + ends, v + (ends > 0)
    asked = seen.where(F.col("kind") == GRAM)
    counts = asked
    if parts > SHARE:  # first by shares of the parts, so that no task reads all of a large corpus
        counts = counts.withColumn("__share", F.floor(F.col("part") / SHARE)).groupBy("to", "__share").applyInArrow(merged, ROWS)
    model = stored(counts.groupBy("to").applyInArrow(merged, ROWS), "model", small=True)
    top = model.mapInArrow(sums, SUMS).groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "split"))).toArrow()
    above = spark.sparkContext.broadcast(upper(*(top[c].to_numpy() for c in ("node", "zeros", "ones", "split"))))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from answered_grams(batches, above.value)

    shares = parts // SHARE + 1
    dealt = asked.withColumn("counts", F.lit(None).cast("binary")).withColumn("__share", F.pmod(F.xxhash64("part"), F.lit(shares))).unionByName(model.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<long>"))))
    values = dealt.groupBy("to", "__share").applyInArrow(answer, ROWS)

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        K.lean()
        return _score(a, b, int(n), int(v), int(ends))

    every = told.where(F.col("kind") == WORD).unionByName(values)
    return docs.groupBy("part").cogroup(every.groupBy("part")).applyInArrow(score, OUT)


def op6_lm(spark, sf_dir: str) -> DataFrame:
    return log_probability(read(spark, sf_dir, "documents"))
