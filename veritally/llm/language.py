"""Language identification by hierarchical discrimination.

First a linear support vector machine for each language family (one against the rest) picks the family;
then one-versus-one machines between the languages of that family vote, ties going to the larger sum of
margins.  Features are hashed words and byte n-grams of the whole text, L2-normalised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import held_out, read, sample
from .features import features, text_of

#: Documented bounds: rows that the model is fitted on (their whole texts), bits of the feature table; length of byte n-grams.
TRAIN_ROWS, BITS, SIZES = 6000, 17, (3,)
#: Families of closely related languages by ISO 639-1 code; others are families of their own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic",
}


@dataclass
class Hierarchy:
    langs: list[str]
    families: list[list[int]]
    weight: np.ndarray  # machine x feature, the last column is the bias
    pairs: list[tuple[int, int]]

    def margins(self, f: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Signed distance of each text to each machine's plane."""
        out = np.empty((len(self.weight), n))
        norm = norms(f, text, n)
        for k, w in enumerate(self.weight):
            out[k] = np.bincount(text, w[f], minlength=n) / norm + w[-1]
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language (-1: no letter) and confidence of each text."""
        n = len(column)
        f, where, w = features(column, BITS, SIZES)
        text = text_of(where, column)
        if not self.langs:
            return np.full(n, -1), np.zeros(n)
        lang, sure = np.zeros(n, int), np.ones(n)
        at = self.margins(f, text, n)
        votes = np.zeros((len(self.langs), n))
        nf = len(self.families) if len(self.families) > 1 else 0
        family = at[:nf].argmax(0) if nf else np.zeros(n, int)
        if nf:
            top = np.sort(at[:nf], axis=0)
            sure = logistic(2 * (top[-1] - top[-2]))
        for k, (a, b) in enumerate(self.pairs):
            m = at[nf + k]
            votes[a] += (m > 0) + logistic(m) * 1e-3
            votes[b] += (m <= 0) + logistic(-m) * 1e-3
        for i, own in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            best = votes[own][:, rows].argmax(0)
            lang[rows] = np.array(own)[best]
            for k, (a, b) in enumerate(self.pairs):
                if a in own:
                    won = rows[(lang[rows] == a) | (lang[rows] == b)]
                    sure[won] = np.minimum(sure[won], logistic(2 * np.abs(at[nf + k][won])))
        bare = ~has_letter(column, w)
        lang[bare], sure[bare] = -1, 0.0
        return lang, sure


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def norms(f: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Square root of each text's number of features: their length if all differ, an upper bound within a constant else."""
    return np.sqrt(np.maximum(np.bincount(text, minlength=n), 1))


def has_letter(column: pa.Array, w: K.Words) -> np.ndarray:
    """Whether a text holds a letter.  ASCII is read from the bytes; only texts without ASCII letters are decoded."""
    data, offsets = K.text_bytes(column)
    low = data | 32
    ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = np.diff(ascii_letter[offsets]) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def svm(rows: list[tuple[np.ndarray, np.ndarray, int]], y: list[np.ndarray], rate: float = 2.0, steps: int = 240) -> np.ndarray:
    """Linear support vector machine: AdaGrad on the hinge loss with an L2 term.  rows: (features, text of each, texts) by batch; y: 1, -1, or 0 (left out)."""
    w, g2, decay = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-3), 1e-5
    use = [k for k, t in enumerate(y) if (t != 0).any()]
    for step in range(steps if use else 0):
        f, text, n = rows[k := use[step % len(use)]]
        norm, t = norms(f, text, n), y[k]
        m = np.bincount(text, w[f], minlength=n) / norm + w[-1]
        d = np.where((t != 0) & (t * m < 1), -t, 0.0) / max(1, (t != 0).sum())
        g = decay * w
        g[:-1] += np.bincount(f, (d / norm)[text], minlength=1 << BITS)
        g[-1] += d.sum()
        g2 += g * g
        w -= rate / np.sqrt(len(use)) * g / np.sqrt(g2)
    return w


def fit(texts: pa.Array, lang: list[str], batch: int = 400) -> Hierarchy:
    langs = sorted(set(lang))
    named = {}
    for i, x in enumerate(langs):
        named.setdefault(FAMILIES.get(x, x), []).append(i)
    families = [named[k] for k in sorted(named)]
    number = np.array([langs.index(x) for x in lang], int)
    family = np.zeros(len(langs), int)
    for i, own in enumerate(families):
        family[own] = i
    order, rows, y = np.random.default_rng(5).permutation(len(lang)), [], []
    for i in range(0, len(lang), batch):
        column = texts.take(pa.array(part := order[i : i + batch]))
        f, where, _ = features(column, BITS, SIZES)
        rows.append((f, text_of(where, column).astype(np.int16), len(part)))
        y.append(number[part])
    pairs = [p for own in families for p in combinations(own, 2)]
    weight = [svm(rows, [np.where(family[t] == i, 1, -1) for t in y]) for i in range(len(families))] if len(families) > 1 else []
    weight += [svm(rows, [np.where(t == a, 1, np.where(t == b, -1, 0)) for t in y]) for a, b in pairs]
    return Hierarchy(langs, families, np.array(weight, np.float32).reshape(-1, (1 << BITS) + 1), pairs)


def train(documents: DataFrame, rows: int = TRAIN_ROWS) -> Hierarchy:
    """Fits on the whole texts of about `rows` documents at most outside the held-out fold, the same number of each language.

    A language with fewer documents than its share gives all that it has, so a rare one is learned too.
    """
    pool = documents.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = sample(pool.select("doc_id", "text", "lang"), rows, "doc_id", strata="lang").select("text", "lang").toArrow()
    model = fit(got["text"].combine_chunks(), got["lang"].to_pylist())
    del got
    K.trim()
    return model


def identify(documents: DataFrame, model: Hierarchy) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; `und` with score 0 where the text is null or has no letter."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.lean()
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for b in batches:
            out = [m.predict(b["text"].slice(i, j - i)) for i, j in K.slices(b["text"])] or [(np.zeros(0, int), np.zeros(0))]
            lang, sure = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(names[lang], pa.string()), pa.array(sure)], ["doc_id", "held_out", "lang_pred", "score"])

    kept = documents.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), "text")
    return kept.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_language(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return identify(documents, train(documents))
