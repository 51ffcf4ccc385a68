"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Sentence s gets p_s = sigmoid(b + sum of the weights of its features);
the document's probability is the noisy-or 1 - prod(1 - p_s).  Only document labels are needed to train:
the gradient of the document loss reaches each sentence in proportion to its own p_s, so the weights come to
point at the offending sentences, which `locate` returns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import held_out, read, sample
from .features import features

#: Documented bounds: rows that the model is fitted on, bits of the feature table.
TRAIN_ROWS, BITS = 8000, 18
#: Features besides whole words: n-grams inside words (none) and beginnings of words, in bytes.  Insults are stems with many
#: endings; chosen by four-fold cross-validation inside the training fold of the sf0.1 tables (README).
SIZES, PREFIXES = (), (5, 6, 7, 8)
#: Standard errors by which a feature must be more frequent in documents of label 1 to be used.
SCREEN = 3.0
#: Times by which its share of documents of label 1 must exceed that of label 0.
RATIO = 3.0
ENDS = b".!?\n"


def sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence of each feature, text of each sentence, its first byte, its end) of a slice of texts."""
    f, where, w = features(column, BITS, SIZES, PREFIXES)
    _, offsets = K.text_bytes(column)
    cut = np.isin(w.buf, np.frombuffer(ENDS, np.uint8))
    begins = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(cut) + 1]))
    begins = begins[begins < offsets[-1]]
    own = np.searchsorted(begins, where, side="right") - 1
    used = np.unique(own)
    begin = begins[used]
    end = np.append(begins, offsets[-1])[used + 1] if len(used) else begin
    text = np.searchsorted(offsets, begin, side="right") - 1
    return f, np.searchsorted(used, own), text, begin, np.minimum(end, offsets[text + 1])


@dataclass
class NoisyOr:
    weight: np.ndarray
    bias: float
    empty: float

    def logits(self, f: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(own, self.weight[f], minlength=n)

    def score(self, column: pa.Array) -> np.ndarray:
        f, own, text, _, _ = sentences(column)
        z = np.logaddexp(0, self.logits(f, own, len(text)))
        out = 1 - np.exp(-np.bincount(text, z, minlength=len(column)))
        out[np.bincount(text, minlength=len(column)) == 0] = self.empty
        return np.clip(out, 0.0, 1.0)


def fit(texts: pa.Array, y: np.ndarray, steps: int = 1500, batch: int = 256, rate: float = 0.25, decay: float = 2e-5) -> NoisyOr:
    """AdaGrad on the document loss.  Without both labels the model is the constant base rate."""
    y = y.astype(float)
    rng = np.random.default_rng(7)
    bags, base = [], float(y.mean()) if len(y) else 0.0
    if not len(y) or base in (0.0, 1.0):
        return NoisyOr(np.zeros(1 << BITS), -30.0 if base == 0 else 30.0, base)
    order = rng.permutation(len(y))
    seen = np.zeros((2, 1 << BITS))
    for rows in (order[i : i + batch] for i in range(0, len(y), batch)):
        f, own, text, _, _ = sentences(texts.take(pa.array(rows)))
        by_text = np.unique(text[own].astype(np.int64) << BITS | f)
        for label in (0, 1):
            of = by_text[y[rows][by_text >> BITS] == label]
            seen[label] += np.bincount(of & ((1 << BITS) - 1), minlength=1 << BITS)
    # Only features that documents of label 1 hold clearly oftener carry evidence; the rest stay at 0.
    n1, n0, both = y.sum(), (1 - y).sum(), seen.sum(0)
    z = (seen[1] / n1 - seen[0] / n0) / np.sqrt((both + 1) / len(y) * (1 / n1 + 1 / n0))
    keep = (z >= SCREEN) & (seen[1] >= 3) & (seen[1] / n1 >= RATIO * (seen[0] + 1) / n0)
    for rows in (order[i : i + batch] for i in range(0, len(y), batch)):
        f, own, text, _, _ = sentences(texts.take(pa.array(rows)))
        pairs = np.unique(own[keep[f]].astype(np.int64) << BITS | f[keep[f]])
        bags.append(((pairs & ((1 << BITS) - 1)), pairs >> BITS, text.astype(np.int32), y[rows]))
    w, b = np.zeros(1 << BITS), -4.0
    gw, gb = np.full(1 << BITS, 1e-2), 1e-2
    for _ in range(-(-steps // len(bags))):
        for k in rng.permutation(len(bags)):
            f, own, text, t = bags[k]
            z = b + np.bincount(own, w[f], minlength=len(text))
            s = np.bincount(text, np.logaddexp(0, z), minlength=len(t))
            d = np.where(t > 0.5, -np.exp(-s) / np.maximum(-np.expm1(-s), 1e-6), 1.0)
            dz = d[text] / (1 + np.exp(-np.clip(z, -40, 40)))
            g = np.bincount(f, dz[own], minlength=1 << BITS) / len(t) + decay * w
            gw += g * g
            w -= rate * g / np.sqrt(gw)
            q = dz.sum() / len(t)
            gb += q * q
            b -= rate * q / np.sqrt(gb)
    return NoisyOr(w, float(b), base)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> NoisyOr:
    """Fits on about `rows` labelled documents at most outside the held-out fold.

    Their ids are chosen from the labels alone, by hash; only these, a bounded number, meet the texts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    chosen = sample(known, rows, "doc_id")
    got = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "__toxic").toArrow()
    model = fit(got["text"].combine_chunks(), got["__toxic"].to_numpy())
    del got
    K.trim()
    return model


def score(documents: DataFrame, model: NoisyOr, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.  Null and wordless texts get the training base rate.

    One row out per row in (repeated ids too); other columns of the input are neither read nor needed.  A score of exactly
    the threshold is predicted 1.  A very long text is scored as a whole, sentence by sentence.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, model.empty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        m = NoisyOr(*shared.value)
        for b in batches:
            out = [m.score(b["text"].slice(i, j - i)) for i, j in K.slices(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(np.concatenate(out) if out else np.zeros(0))], ["doc_id", "held_out", "score"])

    kept = documents.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), "text")
    return kept.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(documents: DataFrame, model: NoisyOr, threshold: float = 0.3) -> DataFrame:
    """The rows of documents (all columns) whose score is below the threshold, without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, model.empty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        m = NoisyOr(*shared.value)
        for b in batches:
            for i, j in K.slices(b["text"]):
                part = b.slice(i, j - i)
                yield part.filter(pa.array(m.score(part["text"]) < threshold))

    return documents.mapInArrow(run, documents.schema)


def locate(documents: DataFrame, model: NoisyOr, least: float = 0.3) -> DataFrame:
    """doc_id, sentence (number), start, end (bytes in UTF-8), text, score of each sentence with p_s >= least."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, model.empty))
    schema = "doc_id long, sentence int, start long, end long, text string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        m = NoisyOr(*shared.value)
        for b in batches:
            for i, j in K.slices(b["text"]):
                column = b["text"].slice(i, j - i)
                f, own, text, begin, end = sentences(column)
                p = 1 / (1 + np.exp(-np.clip(m.logits(f, own, len(text)), -40, 40)))
                hit = np.flatnonzero(p >= least)
                data, offsets = K.text_bytes(column)
                number = np.arange(len(text)) - np.searchsorted(text, text)
                yield pa.RecordBatch.from_arrays([
                    b["doc_id"].slice(i, j - i).take(pa.array(text[hit])), pa.array(number[hit].astype(np.int32)),
                    pa.array(begin[hit] - offsets[text[hit]]), pa.array(end[hit] - offsets[text[hit]]),
                    pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(begin[hit], end[hit])], pa.string()), pa.array(p[hit]),
                ], ["doc_id", "sentence", "start", "end", "text", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return score(documents, train(documents, read(spark, sf_dir, "labels")))
