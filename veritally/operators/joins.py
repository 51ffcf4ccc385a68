"""Alignment of two sides: joins by key, many-to-many candidates, rules, and what one side lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import grading, units
from . import terms


def align(a: DataFrame, h: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of the sides' one row for each key; other columns get the prefix a_ or h_."""
    side = lambda df, p: df.select(*keys, *[F.col(c).alias(p + c) for c in df.columns if c not in keys], F.lit(True).alias(p + "has"))
    return side(a, "a_").join(side(h, "h_"), keys, "full_outer").withColumn("status", F.when(F.col("a_has") & F.col("h_has"), "matched").when(F.col("a_has"), "a_only").otherwise("h_only")).drop("a_has", "h_has")


def compare(aligned: DataFrame, a: str, h: str) -> DataFrame:
    """Adds ratio, severity and triage; one-sided rows are medium and unresolved."""
    ratio = units.relative_delta(F.col(a), F.col(h))
    both = F.col("status") == "matched"
    severity = F.when(both, grading.grade(ratio)).otherwise("medium")
    state = grading.triage(F.lit(False), ~both)
    return aligned.withColumn("ratio", F.when(both, ratio)).withColumn("triage", state).withColumn("severity", grading.triaged(severity, F.col("triage")))


def best_candidates(a: DataFrame, h: DataFrame, key: str, score: Column, order: list[Column], top: int = 1) -> DataFrame:
    """The best `top` pairs of each key of an equi-join, by score, then order.

    Use columns a.* and h.* with names of their own.  A hot key is a case for AQE's skew join; the rank that follows is
    bounded by a group limit, which Spark applies before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), *order)
    return a.join(h, key).withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def exact_mismatches(a: DataFrame, h: DataFrame, key: str, av: str, hv: str, order: list[str], most: float = 0.01, top: int = 8) -> DataFrame:
    """Pairs of a key that differ by `most` at most but not 0, the `top` closest of each key."""
    ratio = units.relative_delta(F.col(av), F.col(hv))
    w = Window.partitionBy(key).orderBy("ratio", *order)
    near = a.join(h, key).withColumn("ratio", ratio).where((F.col("ratio") > 0) & (F.col("ratio") <= most))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("severity", grading.exact_grade(F.col("ratio")))


def internal_pairs(items: DataFrame, key: str, seq: str, value: str, page: str, least: float = 0.05, cap: int = 3) -> DataFrame:
    """Contradictions within one side: pairs of a key (smaller seq first) whose values differ, by `least` if pages do; `cap` for each key.

    The first `cap` pairs by i, j, values and pages.  The rows of least seq meet all others of their key first; only keys
    that have less than `cap` pairs then go through all pairs, and of rows alike in value and page just the first `cap`,
    for later ones cannot be in the first `cap` pairs.  So a key with very many rows costs in proportion to them.
    """
    rows = items.select(F.col(key).alias("__key"), F.col(seq).alias("__s"), F.col(value).alias("__v"), F.col(page).alias("__p"))
    left = lambda df: df.select("__key", F.col("__s").alias("i"), F.col("__v").alias("left_value"), F.col("__p").alias("left_page"))
    right = lambda df: df.select("__key", F.col("__s").alias("j"), F.col("__v").alias("right_value"), F.col("__p").alias("right_page"))
    ratio = units.relative_delta(F.col("left_value"), F.col("right_value"))
    first = Window.partitionBy("__key").orderBy("i", "j", "left_value", "right_value", "left_page", "right_page")

    def contradictions(a: DataFrame, b: DataFrame) -> DataFrame:
        pairs = left(a).join(right(b), "__key").where("i < j").withColumn("ratio", ratio)
        real = pairs.where((F.round("left_value", 2) != F.round("right_value", 2)) & ((F.col("left_page") == F.col("right_page")) | (F.col("ratio") >= least)))
        return real.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= cap)

    heads = rows.withColumn("__r", F.rank().over(Window.partitionBy("__key").orderBy("__s"))).where("__r = 1").drop("__r")
    of_heads = contradictions(heads, rows)
    done = of_heads.where(F.col("rank") == cap).select("__key")
    alike = Window.partitionBy("__key", "__v", "__p").orderBy("__s")
    rest = rows.withColumn("__r", F.rank().over(alike)).where(F.col("__r") <= cap).drop("__r").join(done, "__key", "left_anti")
    every = of_heads.join(done, "__key", "left_semi").unionByName(contradictions(rest, rest))
    return every.withColumnRenamed("__key", key).withColumn("severity", grading.internal_grade(F.col("ratio")))


def first_rule(items: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """items with rule_id and tolerance of the first rule (by ord) whose targets hold the key; tolerance 0 without one."""
    first = rules.where("enabled").select(F.explode("targets").alias(key), "ord", "rule_id", "tolerance").groupBy(key).agg(F.min_by(F.struct("rule_id", "tolerance"), "ord").alias("r"))
    return items.join(first, key, "left").withColumn("rule_id", F.col("r.rule_id")).withColumn("tolerance", F.coalesce(F.col("r.tolerance"), F.lit(0.0))).drop("r")


def one_sided(a: DataFrame, h: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that has them."""
    left = a.select(key).distinct().join(h, key, "left_anti").withColumn("side", F.lit("A"))
    return left.unionByName(h.select(key).distinct().join(a, key, "left_anti").withColumn("side", F.lit("H")))


def whitelisted(diffs: DataFrame, whitelist: DataFrame, key: str) -> DataFrame:
    """Left join of expected differences by key and missing side: adds expected, rationale."""
    known = whitelist.select(key, "missing_side", "rationale", F.lit(True).alias("expected"))
    return diffs.join(known, [key, "missing_side"], "left").withColumn("expected", F.coalesce("expected", F.lit(False)))


def gated_branches(a: DataFrame, h: DataFrame, name: str, count: str, asset: str, least: float = 0.6) -> DataFrame:
    """Branches on both sides with equal counts and other assets, if enough of the smaller side is matched.

    The gate is confident if the smaller side has under five branches or `least` of them are matched.
    """
    side = lambda df, p: df.select(name, F.col(count).alias(p + "count"), F.col(asset).alias(p + "asset"))
    both = side(a, "a_").join(side(h, "h_"), name)
    sizes = a.agg(F.count("*").alias("na")).crossJoin(h.agg(F.count("*").alias("nh"))).crossJoin(both.agg(F.count("*").alias("nb")))  # one row each
    gate = sizes.select(((F.least("na", "nh") < 5) | (F.col("nb") / F.least("na", "nh") >= least)).alias("confident"))
    percent = F.abs(F.col("a_asset") - F.col("h_asset")) / F.greatest(F.abs("a_asset"), F.abs("h_asset"), F.lit(1e-9)) * 100
    return both.crossJoin(F.broadcast(gate)).where("confident AND a_count = h_count AND a_asset != h_asset").withColumn("percent", percent).withColumn("severity", grading.branch_grade(F.col("percent")))


def bucketed_range(a: DataFrame, b: DataFrame, on: list[str], x: str, y: str, width: int) -> DataFrame:
    """Pairs with equal `on` and |x - y| <= width, as an equi-join on buckets of that width (b is filed in three)."""
    left = a.withColumn("__b", F.floor(F.col(x) / width))
    right = b.withColumn("__b", F.explode(F.array(*[F.floor(F.col(y) / width) + d for d in (-1, 0, 1)])))
    return left.join(right, [*on, "__b"]).where(F.abs(F.col(x) - F.col(y)) <= width).drop("__b")


def candidate_blocks(a: DataFrame, b: DataFrame, width: int, top: int = 20) -> DataFrame:
    """Paragraph candidates: a page band, the same section, or a shared signal; the `top` nearest of each paragraph.

    a(i, page, section, seq, signals), b(j, page2, section2, seq2, signals2).
    """
    band = bucketed_range(a, b, [], "page", "page2", width)
    section = a.join(b, a["section"] == b["section2"])
    shared = a.withColumn("__s", F.explode("signals")).join(b.withColumn("__s", F.explode("signals2")), "__s").drop("__s")
    every = band.unionByName(section).unionByName(shared).dropDuplicates(["i", "j"])
    same = (F.col("section") == F.col("section2")).cast("int")
    w = Window.partitionBy("i").orderBy(same.desc_nulls_last(), F.abs(F.col("page") - F.col("page2")), F.abs(F.col("seq") - F.col("seq2")), "j")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def without_shadows(internal: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """internal(v1, v2) without pairs that equal an overlay pair (w1, w2), in either order, up to one power of ten."""
    n = "__row"
    numbered = internal.withColumn(n, F.monotonically_increasing_id())
    power = lambda v, w: F.log10(F.abs(F.col(v) / F.col(w)))
    whole = lambda x: F.abs(x - F.round(x)) < 1e-9
    straight = whole(power("v1", "w1")) & (F.abs(power("v1", "w1") - power("v2", "w2")) < 1e-9)
    turned = whole(power("v1", "w2")) & (F.abs(power("v1", "w2") - power("v2", "w1")) < 1e-9)
    pairs = overlay.select(*[F.col(k).alias("__o_" + k) for k in keys], "w1", "w2")
    same = [F.col(k) == F.col("__o_" + k) for k in keys]
    condition = straight | turned
    for s in same:
        condition = condition & s
    return numbered.join(pairs, condition, "left_anti").drop(n)


def longest_embedded(texts: DataFrame, glossary: DataFrame, key: str, text: str) -> DataFrame:
    """key and the canonical key of the longest glossary form in its text."""
    return terms.glossary_hits(texts, glossary, text).groupBy(key).agg(F.max_by("canonical_key", F.struct(F.length("form"), "form")).alias("canonical_key"))


def three_way(a: DataFrame, b: DataFrame, c: DataFrame, key: str, most: float = 0.01) -> DataFrame:
    """key, va, vb, vc of values from three places whose spread is over `most`; one missing place is passed over."""
    joined = a.join(b, key, "full_outer").join(c, key, "full_outer")
    high, low = F.greatest("va", "vb", "vc"), F.least("va", "vb", "vc")
    return joined.withColumn("spread", (high - low) / F.greatest(F.abs(high), F.lit(1e-9))).where(F.col("spread") > most)
