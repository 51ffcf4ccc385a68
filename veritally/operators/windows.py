"""Operators over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def islands(rows: DataFrame, keys: list[str], at: str, gap: int, seq: str) -> DataFrame:
    """Adds chunk: a new number wherever `at` is more than `gap` after the row before."""
    w = Window.partitionBy(*keys).orderBy(at, seq)
    jump = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("__jump", jump).withColumn("chunk", F.sum("__jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__jump")


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """0-based position and size of each group."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("position", F.row_number().over(w.orderBy(*order)) - 1).withColumn("group_size", F.count("*").over(w))


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, True).over(w))


def carried_labels(rows: DataFrame, keys: list[str], order: list[str], label: str, valid: str) -> DataFrame:
    """Rows without a label inherit the label before; an invalid label resets it to null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col(label).isNotNull(), F.struct(F.when(F.col(valid), F.col(label)).alias("l")))
    return rows.withColumn("inherited", F.last(mark, True).over(w)["l"])


def propagated(pages: DataFrame, keys: list[str], page: str, section: str, most: int = 5) -> DataFrame:
    """A section reaches up to `most` following pages that have none."""
    w = Window.partitionBy(*keys).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col(section).isNotNull(), F.struct(F.col(page).alias("p"), F.col(section).alias("s")))
    last = F.last(mark, True).over(w)
    return pages.withColumn("__m", last).withColumn("section_filled", F.when(F.col(page) - F.col("__m.p") <= most, F.col("__m.s"))).drop("__m")


def headers(cells: DataFrame, keys: list[str], row: str, col: str, text: str) -> DataFrame:
    """Adds header: the texts of the header cells above in the same column, joined."""
    w = Window.partitionBy(*keys, col).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("header", F.array_join(F.collect_list(F.when(F.col("is_header"), F.col(text))).over(w), " "))


def column_texts(cells: DataFrame, keys: list[str], row: str, col: str, text: str) -> DataFrame:
    """Adds header: the texts of all cells above in the same column, data rows too, blank ones passed over, joined by spaces."""
    w = Window.partitionBy(*keys, col).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.length(F.trim(text)) > 0, F.trim(text))
    return cells.withColumn("header", F.array_join(F.collect_list(said).over(w), " "))


def latest(rows: DataFrame, keys: list[str], at: str, seq: str) -> DataFrame:
    """Last write wins."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc(), F.col(seq).desc())
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
