"""Sinks: one named table for each sheet, partitions replaced by pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.grading import rank


def save(df: DataFrame, path: str, partition: str = "pair_id") -> None:
    """Replaces only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def sheets(diffs: DataFrame, coverage: DataFrame, warnings: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report by name."""
    ordered = diffs.orderBy(rank(F.col("severity")).desc(), "triage", "diff_type", "canonical_key", "diff_id")
    by = lambda c: diffs.groupBy(c).agg(F.count("*").alias("n"))
    return {
        "diffs": ordered,
        "real": ordered.where("triage = 'real'"),
        "expected": ordered.where("triage = 'expected'"),
        "cards": ordered.where("severity IN ('high', 'critical')"),
        "evidence": diffs.select("pair_id", "diff_id", F.posexplode("evidence").alias("seq", "evidence")),
        "coverage": coverage,
        "warnings": warnings,
        "by_severity": by("severity"),
        "by_type": by("diff_type"),
    }


def export(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")
