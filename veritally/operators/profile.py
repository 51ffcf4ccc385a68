"""A report's profile in one pass over its segments: figures, narratives and structure."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import numbers, text as texts_
from ..sources.shared import folder
from . import extract, terms


def tagged(segments: DataFrame, glossary: DataFrame, keys: list[str]) -> DataFrame:
    """segments(keys, page, seq, section, text) as rows of all three parts: keys, part, name, value, chars, page, seq, text.

    metric: a glossary form with the number near it; narrative: a segment of a section; structure: its place in the tree.
    """
    hit = terms.term_hits(segments, glossary.select("form", "canonical_key"), "text")
    plain = F.lower(texts_.simplify(F.col("text")))
    none = F.lit(None)
    row = lambda part, name, value=None, chars=None, text=None: F.struct(F.lit(part).alias("part"), name.alias("name"), (value if value is not None else none).cast("double").alias("value"), (chars if chars is not None else none).cast("long").alias("chars"), (text if text is not None else none).cast("string").alias("text"))
    figures = F.transform(F.flatten(F.transform("hits", lambda h: F.transform(h["terms"], lambda t: F.struct(h["form"].alias("form"), t["canonical_key"].alias("key"))))), lambda h: row("metric", h["key"], numbers.number_near_label(plain, h["form"], 60)))
    told = F.col("section").isNotNull()
    narrative = F.when(told, F.array(row("narrative", F.col("section"), chars=F.length("text"), text=F.substring("text", 1, 200)))).otherwise(F.array(row("narrative", F.lit("other"), chars=F.length("text"), text=F.substring("text", 1, 200))))
    place = F.when(told, F.array(row("structure", extract.section_code(F.col("section"))))).otherwise(F.filter(F.array(row("structure", F.lit(""))), lambda x: F.lit(False)))
    every = F.concat(F.filter(figures, lambda m: m["value"].isNotNull()), narrative, place)
    return hit.select(*keys, "page", "seq", F.inline(every))


def build(segments: DataFrame, glossary: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """metrics, narratives and structure of each report; the segments are read once.

    The rows of all parts are written once, a folder for each part, to the shared folder, and the parts are read from there.
    metrics: keys, name, value, page of the first place; narratives: keys, name, chars, segments, first_page, opening;
    structure: keys, name, first_page, last_page.
    """
    spark = segments.sparkSession
    path = f"{folder(spark)}/veritally/profile-{uuid.uuid4().hex}"
    rows = tagged(segments, glossary, keys)
    rows.write.partitionBy("part").parquet(path)
    schema = rows.drop("part").schema
    part = lambda name: spark.read.schema(rows.schema).parquet(path).where(F.col("part") == name).select(*schema.names)
    return {
        "metrics": part("metric").groupBy(*keys, "name").agg(F.min_by("value", F.struct("page", "seq", "value")).alias("value"), F.min("page").alias("page"), F.count("*").alias("places")),
        "narratives": part("narrative").groupBy(*keys, "name").agg(F.sum("chars").alias("chars"), F.count("*").alias("segments"), F.min("page").alias("first_page"), F.min_by("text", F.struct("page", "seq", "text")).alias("opening")),
        "structure": part("structure").groupBy(*keys, "name").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page")),
    }


#: Words that are no keywords.
STOPWORDS = ("the", "and", "for", "are", "was", "with", "that", "this", "from", "has", "have", "公司", "本公司", "报告期", "报告", "期内", "年度")


def keywords(texts: DataFrame, keys: list[str], text: str, top: int = 20, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """keys, word, n, rank of the most frequent words of a text: pieces of six to two CJK characters, each length cut on its own from the left, and Latin words of three letters or more; ties by first place."""
    simple, low = texts_.simplify(F.col(text)), F.lower(F.col(text))
    pieces = [F.regexp_extract_all(simple, F.lit(f"([一-龥]{{{n}}})"), F.lit(1)) for n in range(6, 1, -1)]
    every = texts.select(*keys, F.posexplode(F.concat(*pieces, F.regexp_extract_all(low, F.lit("([a-z]{3,})"), F.lit(1)))).alias("at", "word"))
    counted = every.where(~F.col("word").isin(*stopwords)).groupBy(*keys, "word").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    best = counted.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "at", "word"))), 1, top).alias("best"))
    return best.select(*keys, F.posexplode("best").alias("rank", "b")).select(*keys, "b.word", (-F.col("b.n")).alias("n"), (F.col("rank") + 1).alias("rank"))
