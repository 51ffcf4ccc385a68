"""Terms in unsegmented text: one automaton over all forms, run in Arrow batches where the texts are read.

Chinese has no spaces, so terms are looked for at every place of a text, all at once (Aho-Corasick).  A table of forms of
any size works: it goes to the driver and out again in shards of at most ``SHARD_CHARS`` characters by hash, each an
automaton of its own that a Python worker builds once; a text passes all of them in the task that reads it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as texts_
from ..sources.shared import spread

#: Characters of forms in one automaton, and so in one broadcast: under 100 MB built.
SHARD_CHARS = 1 << 20
_BUILT: dict = {}


def shaped(column: Column, how: str) -> Column:
    """A text as terms are looked for in it.  words: simplified, lower case, runs of all but a-z, digits and CJK as one space; compact: those left out, letters of any language kept; raw: as it is."""
    if how == "raw":
        return column
    simple = F.lower(texts_.simplify(column))
    if how == "compact":
        return F.regexp_replace(simple, r"[^\p{L}\p{N}]+", "")
    return F.trim(F.regexp_replace(simple, r"[^a-z0-9㐀-䶿一-鿿豈-﫿]+", " "))


def automaton(key: str, forms: Iterable[str]):
    """Forms as an automaton whose values are (number, length); the last few are kept by key."""
    if key not in _BUILT:
        while len(_BUILT) >= 8:
            _BUILT.pop(next(iter(_BUILT)))
        a = ahocorasick.Automaton()
        for i, form in enumerate(forms):
            a.add_word(form, (i, len(form)))
        if len(a):
            a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def _latin(c: str) -> bool:
    return c.isascii() and c.isalnum()


def found(a, text: str, whole_words: bool, once: bool = False) -> list[tuple[int, int, int]]:
    """(start, end, number) of every form at every place, or (once) at its first.  whole_words: a form that begins or ends with a Latin letter or digit has no other beside it."""
    if not len(a):
        return []
    out, seen = [], set()
    for last, (number, n) in a.iter(text):
        if number in seen:
            continue
        start, end = last - n + 1, last + 1
        if whole_words and ((start and _latin(text[start - 1]) and _latin(text[start])) or (end < len(text) and _latin(text[end]) and _latin(text[last]))):
            continue
        out.append((start, end, number))
        if once:
            seen.add(number)
    return out


def leftmost_longest(hits: list[tuple]) -> list[tuple]:
    """Hits (start, end, ...) without overlaps: the first, of those that start together the longest, then on from its end."""
    out, at = [], 0
    for h in sorted(hits, key=lambda h: (h[0], -h[1])):
        if h[0] >= at:
            out.append(h)
            at = h[1]
    return out


def _shards(forms: DataFrame, most: int) -> Iterable[list]:
    """Rows (form, ...) of distinct forms in lists of about `most` characters at most, by hash of the form."""
    chars = forms.agg(F.coalesce(F.sum(F.length("form")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, math.ceil(chars / most))
    for k in range(n):
        yield forms.where(F.pmod(F.xxhash64("form"), F.lit(n)) == k).collect()


def _forms(glossary: DataFrame, shape: str) -> DataFrame:
    """form, terms: the other columns of the glossary's rows of each shaped form, as array<struct>."""
    others = [c for c in glossary.columns if c != "form"]
    rows = glossary.select(shaped(F.col("form"), shape).alias("form"), F.struct(*others).alias("term") if others else F.struct(F.lit(True).alias("known")).alias("term")).where(F.length("form") > 0)
    return rows.groupBy("form").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def term_hits(texts: DataFrame, glossary: DataFrame, text: str, shape: str = "words", whole_words: bool = True, positions: bool = False, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """texts with an array `hits` of struct(form, start, end, terms), by start, then the longest first.

    glossary(form, ...): terms holds the other columns of all rows of the form (array<struct>).  Forms are shaped like the
    texts and are `form` in the result; empty ones match nothing.  start and end count characters of the shaped text; without
    `positions` each form is listed once, at its first place.
    """
    forms = _forms(glossary, shape)
    kind = T.ArrayType(T.StructType([T.StructField("form", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("terms", forms.schema["terms"].dataType)]))
    spark = texts.sparkSession
    parts = []
    for shard in _shards(forms, shard_chars):
        shared = spark.sparkContext.broadcast(([r["form"] for r in shard], [[t.asDict(True) for t in r["terms"]] for r in shard]))
        parts.append(_matcher(shared, uuid.uuid4().hex, kind, whole_words, positions)("__shaped"))
    hits = F.array_sort(F.concat(*parts), lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["end"] - x["end"])) if len(parts) > 1 else parts[0]
    return spread(texts).withColumn("__shaped", F.coalesce(shaped(F.col(text), shape), F.lit(""))).withColumn("hits", hits).drop("__shaped")


def _matcher(shared, key: str, kind: T.DataType, whole_words: bool, positions: bool):
    @F.pandas_udf(kind)
    def match(column: pd.Series) -> pd.Series:
        forms, terms = shared.value
        a = automaton(key, forms)

        def one(text: str) -> list[dict]:
            hits = sorted(found(a, text, whole_words, once=not positions), key=lambda h: (h[0], -h[1]))
            return [{"form": forms[i], "start": s, "end": e, "terms": terms[i]} for s, e, i in hits]

        return pd.Series([one(x) for x in column])

    return match


def glossary_hits(texts: DataFrame, glossary: DataFrame, text: str, shape: str = "words", whole_words: bool = True) -> DataFrame:
    """texts with each glossary row whose form occurs in the text; Latin forms as whole words, Chinese ones anywhere."""
    others = [c for c in glossary.columns if c != "form"]
    hit = term_hits(texts, glossary, text, shape, whole_words).select(*texts.columns, F.explode("hits").alias("__h")).select(*texts.columns, F.col("__h.form").alias("form"), F.explode("__h.terms").alias("__t"))
    return hit.select(*texts.columns, "form", *[F.col("__t")[c].alias(c) for c in others])


def segmented(texts: DataFrame, glossary: DataFrame, text: str, shape: str = "words") -> DataFrame:
    """texts with the terms that it reads as, left to right without overlaps, the longest first: form, start, end, terms in rows.

    Only what is read leaves the Python workers, as a start and the number of a form; forms and terms are joined then.
    """
    spark = texts.sparkSession
    forms = _forms(glossary, shape)
    kind, rows, shared = forms.schema["terms"].dataType, [], []
    for shard in _shards(forms, SHARD_CHARS):
        shared.append((spark.sparkContext.broadcast([r["form"] for r in shard]), uuid.uuid4().hex, len(rows)))
        rows += [(len(rows) + i, r["form"], r["terms"]) for i, r in enumerate(shard)]
    named = spark.createDataFrame(rows, T.StructType([T.StructField("__n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("terms", kind)]))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def read(column: pd.Series) -> pd.Series:
        tables = [(automaton(key, b.value), base) for b, key, base in shared]

        def one(value: str) -> list[int]:
            longest: dict[int, tuple[int, int]] = {}
            for a, base in tables:
                for start, end, i in found(a, value, True):
                    if start not in longest or longest[start][0] < end:
                        longest[start] = (end, base + i)
            out, at = [], 0
            for start in sorted(longest):
                if start >= at:
                    at, number = longest[start]
                    out.append(start << 31 | number)
            return out

        return pd.Series([one(x) for x in column])

    hits = spread(texts).withColumn("__at", F.explode(read(F.coalesce(shaped(F.col(text), shape), F.lit("")))))
    placed = hits.withColumn("__n", F.col("__at").bitwiseAND((1 << 31) - 1)).withColumn("start", F.shiftright("__at", 31).cast("int")).join(F.broadcast(named), "__n")
    return placed.select(*texts.columns, "form", "start", (F.col("start") + F.length("form")).alias("end"), "terms")


#: Terms that count embedded in a longer text although they are short.
SHORT_KEYS = ("inventory", "total_assets")


def lookup(texts: DataFrame, glossary: DataFrame, text: str, short: tuple[str, ...] = SHORT_KEYS) -> DataFrame:
    """texts with canonical_key of the glossary(form, canonical_key[, ord]) form that the text is, else of the longest that it holds.

    Both in simplified lower-case shape.  Held forms have four characters or more without spaces and marks (two for the keys
    `short`) and are no numbers; of equal length the first by ord, then form, wins.  No term: null.
    """
    ordered = glossary if "ord" in glossary.columns else glossary.withColumn("ord", F.lit(0))
    n = F.length(shaped(F.col("form"), "compact"))
    held = ordered.where(((n >= 4) | ((n >= 2) & F.col("canonical_key").isin(*short))) & ~shaped(F.col("form"), "compact").rlike(r"^\d+$"))
    hits = term_hits(texts, held.select("form", "ord", "canonical_key"), text, "compact", whole_words=False)
    best = F.element_at(F.array_sort(F.transform("hits", lambda h: F.struct((-F.length(h["form"])).alias("n"), h["terms"][0]["ord"].alias("ord"), h["form"].alias("form"), h["terms"][0]["canonical_key"].alias("canonical_key")))), 1)
    plain = lambda c: F.lower(F.trim(texts_.simplify(c)))
    exact = ordered.groupBy(plain(F.col("form")).alias("__form")).agg(F.min_by("canonical_key", F.struct("ord", "form")).alias("__exact"))
    whole = hits.withColumn("__form", plain(F.col(text))).withColumn("__held", F.when(F.size("hits") > 0, best["canonical_key"])).drop("hits")
    return whole.join(exact, "__form", "left").withColumn("canonical_key", F.coalesce("__exact", "__held")).drop("__form", "__exact", "__held")


def converted(texts: DataFrame, table: DataFrame, text: str, out: str) -> DataFrame:
    """texts with `out`: the text with every form of table(form, into) replaced, leftmost and longest first; what is replaced is not read again.

    The first value of a form that occurs twice counts.  Null texts stay null.
    """
    spark = texts.sparkSession
    rows = table.where(F.length("form") > 0).groupBy("form").agg(F.min("into").alias("into"))
    shared = [(spark.sparkContext.broadcast(([r["form"] for r in shard], [r["into"] for r in shard])), uuid.uuid4().hex) for shard in _shards(rows, SHARD_CHARS)]

    @F.pandas_udf(T.StringType())
    def convert(column: pd.Series) -> pd.Series:
        tables = [(automaton(key, b.value[0]), b.value[1]) for b, key in shared]

        def one(value: str | None) -> str | None:
            if value is None:
                return None
            hits = leftmost_longest([(s, e, into[i]) for a, into in tables for s, e, i in found(a, value, False)])
            parts, at = [], 0
            for start, end, into in hits:
                parts += (value[at:start], into)
                at = end
            return "".join(parts) + value[at:]

        return pd.Series([one(x) for x in column])

    return spread(texts).withColumn(out, convert(text))


def first_in_table(texts: DataFrame, table: list[tuple[str, str]], text: str, out: str, head: int) -> DataFrame:
    """texts with `out`: the code of the first keyword, in the order of the table, that the first `head` characters hold in lower case."""
    spark = texts.sparkSession
    first: dict[str, tuple[int, str]] = {}
    for i, (keyword, code) in enumerate(table):
        first.setdefault(keyword.lower(), (i, code))
    shared, key = spark.sparkContext.broadcast((list(first), list(first.values()))), uuid.uuid4().hex

    @F.pandas_udf(T.StringType())
    def detect(column: pd.Series) -> pd.Series:
        keywords, codes = shared.value
        a = automaton(key, keywords)
        return pd.Series([min((codes[i] for _, _, i in found(a, x, False)), default=(0, None))[1] if x else None for x in column])

    return spread(texts).withColumn(out, detect(F.lower(F.substring(text, 1, head))))
