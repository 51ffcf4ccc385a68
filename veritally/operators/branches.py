"""Branch offices of banks, read from page texts and table cells, and compared between the sides of a pair of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import grading, text

#: A name of two to six characters before the word for a branch, a number of offices, and assets in millions.
ROW = r"([一-龥]{2,6}分行)[\s　 ]+(\d{1,3})[\s　 ]+([\d,]{5,12})"
#: Characters of place names, each before its simplified form, that texts in general don't convert.
PLACES = "廣广烏乌魯鲁齊齐瀋沈臺台長长蘇苏寧宁廈厦門门連连薩萨無无錫锡盧卢莊庄島岛龍龙濟济鄭郑蘭兰貴贵陽阳慶庆漢汉濱滨爾尔煙烟內内銀银灣湾"


def place(c: Column) -> Column:
    """A branch's name as names are compared: simplified, without white space."""
    return F.regexp_replace(F.translate(text.simplify(c), PLACES[::2], PLACES[1::2]), r"[\s　 ]+", "")


def _lines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, line: the cells of each row that hold anything, by column, a space between."""
    held = cells.withColumn("text", F.trim("text")).where("text <> ''")
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]), " ")
    return held.groupBy(*keys, "row").agg(row.alias("line"))


def found(segments: DataFrame, cells: DataFrame | None = None, keys: tuple[str, ...] = ("pair_id", "side")) -> DataFrame:
    """keys, name, n, asset, page, snippet: the first row of each branch, page texts before table cells.

    segments(keys, page, seq, text); cells(keys, page, table, row, col, text), whose rows are read as lines.  A row whose
    assets are no number is none.  Only the first match of a name leaves each task.
    """
    parts = [segments.select(*keys, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), "page", F.col("seq").cast("long").alias("seq"), text.simplify(F.col("text")).alias("line"))]
    if cells is not None:
        lines = _lines(cells, [*keys, "page", "table"])
        parts.append(lines.select(*keys, F.lit(1).alias("kind"), F.col("table").cast("long").alias("at"), "page", F.col("row").cast("long").alias("seq"), text.simplify(F.col("line")).alias("line")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    hits = every.where(F.col("line").contains("分行")).select(*keys, "kind", "at", "page", "seq", F.posexplode(F.regexp_extract_all("line", F.lit(ROW), F.lit(0))).alias("place", "snippet"))
    part = lambda k: F.regexp_extract("snippet", ROW, k)
    read = hits.select(*keys, place(part(1)).alias("name"), part(2).cast("int").alias("n"), F.replace(part(3), F.lit(","), F.lit("")).try_cast("double").alias("asset"), "page", "snippet", F.struct("kind", "page", "at", "seq", "place").alias("order"))
    first = read.where("asset IS NOT NULL").groupBy(*keys, "name").agg(F.min_by(F.struct("n", "asset", "page", "snippet"), "order").alias("row"))
    return first.select(*keys, "name", "row.*")


def evident(name: Column, n: Column, asset: Column, snippet: Column) -> Column:
    """The snippet holds the name, the number as a word of its own and the assets, with or without separators."""
    line = F.regexp_replace(snippet, r"[\s　 ]+", " ")
    whole = F.format_number(asset, 0)
    number = F.array_contains(F.split(line, r"(?U)\W+"), n.cast("string"))
    return place(line).contains(name) & number & (line.contains(whole) | F.replace(line, F.lit(","), F.lit("")).contains(F.replace(whole, F.lit(","), F.lit(""))))


def aligned(rows: DataFrame, key: str = "pair_id", least: float = 0.6) -> DataFrame:
    """key, name and the row of either side (null where it has none), with a_count, h_count, matched, ratio and confident of the pair.

    A pair is confident if both sides have branches in common and the smaller has under five or `least` of its own matched.
    """
    side = lambda s, p: rows.where(F.col("side") == s).select(key, "name", F.struct("n", "asset", "page", "snippet").alias(p))
    met = side("A", "a").join(side("H", "h"), [key, "name"], "full_outer")
    sizes = met.groupBy(key).agg(F.count("a").alias("a_count"), F.count("h").alias("h_count"), F.count_if(F.col("a").isNotNull() & F.col("h").isNotNull()).alias("matched"))
    fewer = F.least("a_count", "h_count")
    ratio = F.when(fewer > 0, F.round(F.col("matched") / fewer, 4)).otherwise(0.0)
    confident = (F.col("matched") > 0) & ((fewer < 5) | (F.col("matched") / fewer >= least))
    return met.join(sizes.withColumns({"ratio": ratio, "confident": confident}), key)


def _differs() -> Column:
    sure = lambda p: evident(F.col("name"), F.col(f"{p}.n"), F.col(f"{p}.asset"), F.col(f"{p}.snippet"))
    return F.coalesce(F.col("confident") & (F.col("a.n") == F.col("h.n")) & (F.col("a.asset") != F.col("h.asset")) & sure("a") & sure("h"), F.lit(False))


def differences(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """Branches of confident pairs with equal numbers of offices and other assets: both rows, percent of side A's assets, severity."""
    percent = F.when(F.col("a.asset") != 0, (F.col("h.asset") - F.col("a.asset")) / F.col("a.asset") * 100).otherwise(0.0)
    both = aligned(rows, key).where(_differs())
    flat = [F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("a", "h") for c in ("n", "asset", "page", "snippet")]
    return both.select(key, "name", *flat, percent.alias("percent"), grading.branch_grade(F.abs(percent)).alias("severity"))


def diagnostics(rows: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row a pair: branches of either side, matched ones, their share of the smaller side, and differences."""
    return aligned(rows, key).groupBy(key, "a_count", "h_count", "matched", "ratio").agg(F.count_if(_differs()).alias("differences"))
