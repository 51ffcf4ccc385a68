"""Sources: segments, table grids, HTML, keyed chunks, rule files and answer keys.  Inputs are DataFrames or paths of Spark's readers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def route(path: Column, side: Column) -> Column:
    """Parser of a file: A always PDF, H by suffix."""
    low = F.lower(path)
    return F.when(side == "A", "pdf").when(low.rlike(r"\.html?$"), "html").when(low.endswith(".pdf"), "pdf").otherwise("unknown")


def segments(pages: DataFrame, keys: list[str], text: str, section: Column, least: int = 5) -> DataFrame:
    """Blocks between blank lines of `least` characters or more, numbered, with the section last seen on the page.

    section: a Column of `block`, null where a block names none.
    """
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    blocks = pages.select(*keys, F.posexplode(F.split(text, r"\n\s*\n|\n")).alias("seq", "raw")).withColumn("block", F.trim("raw")).drop("raw").where(F.length("block") >= least)
    return blocks.withColumn("section", F.last(section, True).over(w))


def grid_cells(tables: DataFrame, keys: list[str], grid: str) -> DataFrame:
    """row, col, text, is_header (row 0) of a column array<array<string>>, in row-major order."""
    rows = tables.select(*keys, F.posexplode(grid).alias("row", "cells"))
    return rows.select(*keys, "row", F.posexplode("cells").alias("col", "text")).withColumn("is_header", F.col("row") == 0)


def useful_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of tables with two rows and columns, four filled cells and two numbers or more."""
    filled = F.length(F.trim("text")) > 0
    return cells.groupBy(*keys).agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"), F.count_if(filled).alias("filled"), F.count_if(F.col("text").rlike(r"^\s*[(\-]?\d[\d,.]*\)?%?\s*$")).alias("numbers")).where("rows >= 2 AND cols >= 2 AND filled >= 4 AND numbers >= 2")


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags out, the usual entities decoded, white space as one."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def html_cells(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Cells of the tables of pages: table, row, col, text."""
    tables = pages.select(*keys, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table", "t"))
    rows = tables.select(*keys, "table", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    return rows.select(*keys, "table", "row", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("col", "c")).select(*keys, "table", "row", "col", html_text(F.col("c")).alias("text"))


def chunks(files: DataFrame, name: str, text: str) -> DataFrame:
    """Knowledge base: front matter as a map, one chunk for each level-1 heading: name, seq, title, body, meta."""
    front = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---\n", 1)
    pairs = F.filter(F.split(front, "\n"), lambda x: x.rlike(r"^\w+:"))
    meta = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.split(x, ":")[0], F.trim(F.regexp_replace(x, r"^\w+:", ""))))))
    body = F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "")
    cut = files.select(name, F.when(front != "", meta).alias("meta"), F.posexplode(F.split(F.concat(F.lit("\n"), body), r"\n# ")).alias("seq", "chunk")).where("trim(chunk) <> ''")
    return cut.select(name, "seq", F.trim(F.split("chunk", "\n")[0]).alias("title"), F.trim(F.regexp_replace("chunk", r"^[^\n]*\n?", "")).alias("body"), "meta")


def candidate_pages(pages: DataFrame, doc: str, page: str, core: str, total: str) -> DataFrame:
    """doc, page worth table extraction: core pages and their neighbours, or all pages of a document without any."""
    near = pages.where(core).select(doc, F.explode(F.array(F.col(page) - 1, F.col(page), F.col(page) + 1)).alias("page"), total)
    some = near.where(F.col("page").between(1, F.col(total))).select(doc, "page").distinct()
    none = pages.select(doc, F.col(page).alias("page")).join(some.select(doc).distinct(), doc, "left_anti")
    return some.unionByName(none)


def rules(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Enabled rules in order of rule_id: ord, rule_id, targets, expression, tolerance, severity, enabled."""
    rows = [(i, r["rule_id"], list(r.get("targets", [])), r.get("expression"), float(r.get("tolerance") or 0), r.get("severity", "medium"), True) for i, r in enumerate(sorted((r for r in entries if r.get("enabled", True)), key=lambda r: r["rule_id"]))]
    return spark.createDataFrame(rows, "ord int, rule_id string, targets array<string>, expression string, tolerance double, severity string, enabled boolean")


def rule_file(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON or (where a YAML parser is installed) YAML file: a list, or a map with the list under `rules`; read by Spark."""
    raw = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        data = json.loads(raw)
    except ValueError:
        import yaml

        data = yaml.safe_load(raw)
    return rules(spark, data["rules"] if isinstance(data, dict) else data)


def answer_key(rows: DataFrame) -> DataFrame:
    """Normalises both header forms of answer keys; rows without a page or value go: ord, page, topic, original_value, tampered_value, expected_rule_id."""
    names = {c.lower(): c for c in rows.columns}
    pick = lambda *opts: F.coalesce(*[F.col(names[o]) for o in opts if o in names], F.lit(None)).cast("string")
    out = rows.select(pick("ord", "no", "id").try_cast("int").alias("ord"), F.regexp_extract(pick("page", "page_no"), r"(\d+)", 1).try_cast("int").alias("page"), pick("topic", "item").alias("topic"), pick("original_value", "original").alias("original_value"), pick("tampered_value", "tampered").alias("tampered_value"), pick("expected_rule_id", "rule").alias("expected_rule_id"))
    return out.where("page IS NOT NULL AND coalesce(original_value, tampered_value, topic) IS NOT NULL")


def uncached(files: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Files whose content and parser version are not in the cache(key)."""
    keyed = files.withColumn("key", F.concat(F.sha2("content", 256), F.lit("-" + version)))
    return keyed.join(cache.select("key"), "key", "left_anti")


def merged_pages(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Page texts of two engines: one if the other holds it without regard to white space, else both, a first."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    j = a.select(*keys, F.col("text").alias("ta")).join(b.select(*keys, F.col("text").alias("tb")), keys, "full_outer")
    x, y = bare(F.col("ta")), bare(F.col("tb"))
    return j.select(*keys, F.when(x.contains(y), F.coalesce("ta", F.lit(""))).when(y.contains(x), F.col("tb")).otherwise(F.concat_ws("\n", "ta", "tb")).alias("text"))


def lines_of(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row a line (as of OCR), for extraction by label."""
    return pages.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("seq", "text")).where("trim(text) <> ''")
