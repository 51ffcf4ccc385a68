"""Choice of one row for a key, audits, distributions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def pick(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; end the order with a sequence column, so that ties are defined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def best_by_key(items: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Highest confidence, tables first, then the largest absolute value."""
    return pick(items, keys, [F.col("confidence").desc(), (F.col("source") == "table").desc(), F.abs("value").desc(), F.col(seq), F.col("page"), F.col("value")])


def primary_occurrence(items: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Largest absolute value, then confidence."""
    return pick(items, keys, [F.abs("value").desc(), F.col("confidence").desc(), F.col(seq), F.col("page"), F.col("source"), F.col("value")])


def modal_value(items: DataFrame, keys: list[str]) -> DataFrame:
    """Among the rows of highest confidence, the most frequent value, then the earliest page: keys, value, page, n."""
    top = items.withColumn("__c", F.max("confidence").over(Window.partitionBy(*keys))).where("confidence = __c")
    counted = top.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min("page").alias("page"))
    return pick(counted, keys, [F.col("n").desc(), F.col("page"), F.col("value")])


def narratives(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of words, union of pages and keywords, first evidence."""
    return blocks.groupBy(*keys).agg(F.sum("word_count").alias("word_count"), F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))).alias("keywords"), F.min_by("evidence", "seq").alias("evidence"))


def page_audit(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Missing, blank and unsegmented pages, ratio and flag of each document.

    pages: doc, total_pages, scanned, text_pages, segment_pages (arrays of int).
    """
    expected = F.sequence(F.lit(1), F.col("total_pages"))
    ratio = F.size("scanned") / F.col("total_pages")
    return pages.select(doc, F.array_sort(F.array_except(expected, "scanned")).alias("missing"), F.array_sort(F.array_except("scanned", "text_pages")).alias("blank"), F.array_sort(F.array_except("text_pages", "segment_pages")).alias("unsegmented"), ratio.alias("coverage"), F.when(ratio < 1, "incomplete").otherwise("complete").alias("flag"))


def currency_factor(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Conversion factor of each group from the ratios of its best pairs (a_norm, h_norm).

    Ratios of 4 to 10, or their inverse, around the upper median within 10 %: at least three, or two within 4 %.
    """
    raw = F.abs(F.col("a_norm") / F.col("h_norm"))
    ratio = F.when(raw.between(4, 10), raw).when(raw.between(0.10, 0.25), 1 / raw)
    usable = pairs.where("abs(a_norm) >= 1000 AND abs(h_norm) >= 1000").withColumn("r", ratio).where("r IS NOT NULL")
    lists = usable.groupBy(*group).agg(F.sort_array(F.collect_list("r")).alias("rs")).where("size(rs) >= 2")
    middle = lists.withColumn("median", F.element_at("rs", F.floor(F.size("rs") / 2).cast("int") + 1))
    near = middle.withColumn("near", F.filter("rs", lambda r: F.abs(r - F.col("median")) / F.col("median") <= 0.10))
    ok = (F.size("near") >= 3) | ((F.size("near") == 2) & (F.array_max("near") / F.array_min("near") <= 1.04))
    mean = F.aggregate("near", F.lit(0.0), lambda s, x: s + x) / F.size("near")
    return near.where(ok).select(*group, "median", F.size("near").alias("n"), mean.alias("factor"))


def dense_counts(rows: DataFrame, one: tuple[str, list[str]], two: tuple[str, list[str]]) -> DataFrame:
    """Counts by two columns with a row for every pair of the given values, zeros too (the values are fixed lists)."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in one[1] for b in two[1]], f"{one[0]} string, {two[0]} string")
    counts = rows.groupBy(one[0], two[0]).agg(F.count("*").alias("n"))
    return grid.join(counts, [one[0], two[0]], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def recall_precision(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One row: expected, hits, false positives, recall, precision; found rows of triage expected are no false positives."""
    e = expected.select(*keys).distinct().withColumn("__e", F.lit(1))
    f = found.select(*keys, "triage").groupBy(*keys).agg(F.min(F.col("triage") == "expected").alias("__x"), F.lit(1).alias("__f"))
    both = e.join(f, keys, "full_outer")
    hit = F.count_if(F.col("__e").isNotNull() & F.col("__f").isNotNull())
    wrong = F.count_if(F.col("__e").isNull() & ~F.col("__x"))
    got = both.agg(F.count("__e").alias("expected"), hit.alias("hits"), wrong.alias("false_positives"))
    return got.withColumn("recall", F.try_divide("hits", "expected")).withColumn("precision", F.try_divide("hits", F.col("hits") + F.col("false_positives")))


def summary(diffs: DataFrame) -> DataFrame:
    """One row of counts by severity and triage."""
    return diffs.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")], *[F.count_if(F.col("triage") == t).alias(t) for t in ("real", "expected", "unresolved")])


#: Counts of a comparison by rule of the difference.
RULE_COUNTS = {
    "unresolved_candidate_count": "low_confidence_candidate", "currency_converted_match_count": "currency_converted_match", "context_mismatch_count": "context_mismatch",
    "llm_semantic_review_count": "llm_semantic_review", "key_metric_exact_diff_count": "key_metric_exact_mismatch", "visual_text_layer_mismatch_count": "visual_text_layer_mismatch",
    "text_overlay_tamper_count": "text_overlay_tamper", "internal_event_diff_count": "event_internal_fact_match", "event_fact_diff_count": "event_fact_match",
}
SCOPES = {"cross_report_diff_count": "cross_report", "a_internal_diff_count": "a_internal", "h_internal_diff_count": "h_internal"}


def comparison_summary(diffs: DataFrame, coverage: DataFrame, warnings: DataFrame, facts: DataFrame, narratives: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row of counts for each key that any of the tables has.

    diffs(triage, rule_id, diff_type, scope), coverage(category, status), warnings(side, blocking, category),
    facts(side, canonical_key), narratives(side).  Each table is counted where it lies; the counts then meet by key.
    """
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    sides = lambda name: [is_("side", s).alias(f"{s.lower()}_{name}") for s in ("A", "H")]
    parts = [
        diffs.groupBy(key).agg(
            F.count("*").alias("total_diff_count"), *[is_("triage", t).alias(f"{t}_diff_count") for t in ("real", "expected", "unresolved")], *[is_("rule_id", r).alias(n) for n, r in RULE_COUNTS.items()],
            is_("diff_type", "internal").alias("internal_inconsistency_count"), *[F.count_if((F.col("scope") == s) & F.col("triage").isin("real", "unresolved", "expected")).alias(n) for n, s in SCOPES.items()],
        ),
        coverage.groupBy(key).agg(F.count("*").alias("coverage_count"), F.count_if((F.col("category") == "event") & (F.col("status") == "matched")).alias("matched_event_count"), is_("status", "a_only").alias("a_only_count"), is_("status", "h_only").alias("h_only_count")),
        warnings.groupBy(key).agg(F.count("*").alias("warning_count"), F.count_if("blocking").alias("blocking_warning_count"), F.count_if("blocking").alias("core_warning_count"), is_("category", "auxiliary_chart").alias("aux_warning_count"), *sides("warning_count")),
        facts.groupBy(key).agg(*sides("fact_count"), *[F.count_distinct(F.when(F.col("side") == s, F.col("canonical_key"))).alias(f"{s.lower()}_metric_keys") for s in ("A", "H")]),
        narratives.groupBy(key).agg(*sides("narrative_blocks")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.groupBy(key).agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in whole.columns if c != key])


def page_ranges(segments: DataFrame, keys: list[str], group: Column) -> DataFrame:
    """First and last page of each section, and of each group of sections (section null)."""
    own = segments.where("section IS NOT NULL").withColumn("group", group)
    out = own.rollup(*keys, "group", "section").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.grouping("group").alias("__g"))
    return out.where("__g = 0").drop("__g")


def table_coverage(tables: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Required sections that no table covers, and the covered share."""
    need = F.array(*[F.lit(r) for r in required])
    return tables.groupBy(*keys).agg(F.collect_set("section").alias("covered")).select(*keys, F.array_sort(F.array_except(need, "covered")).alias("missing"), (F.size(F.array_intersect(need, "covered")) / len(required)).alias("coverage"))


def first_wins(rows: DataFrame, keys: list[Column], seq: str) -> DataFrame:
    """The first row of each combination of key expressions, which may be null."""
    named = {f"__k{i}": k for i, k in enumerate(keys)}
    return pick(rows.withColumns(named), list(named), [F.col(seq)]).drop(*named)


def merged_diffs(model: DataFrame, regex: DataFrame, signature: list[str]) -> DataFrame:
    """Model rows first; rows by regular expression only if high or worse and their signature is new."""
    every = model.withColumn("__o", F.lit(0)).unionByName(regex.where("severity IN ('high', 'critical')").withColumn("__o", F.lit(1)))
    return pick(every, signature, [F.col("__o"), F.col("diff_id")]).drop("__o")


def demand_selection(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group by priority (the cap is the feature: later steps cost by row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def report_kpis(jobs: DataFrame) -> DataFrame:
    """jobs(status, real, started, ended): done, failed, real differences, mean seconds."""
    seconds = F.unix_seconds(F.col("ended").cast("timestamp")) - F.unix_seconds(F.col("started").cast("timestamp"))
    return jobs.agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.when(F.col("status") == "done", F.col("real"))).alias("real"), F.avg(F.when(F.col("status") == "done", seconds)).alias("mean_seconds"))


def profile_summary(items: DataFrame, keys: list[str]) -> DataFrame:
    """Snapshot of a profile for export: items as structs in order, and counts."""
    return items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "canonical_key", "value", "page"))).alias("items"), F.count("*").alias("n"), F.count_distinct("canonical_key").alias("n_keys"))


def warnings(flags: DataFrame, table: DataFrame) -> DataFrame:
    """flags(pair_id, flag) with category, severity and blocking of a fixed table; unknown flags are low and don't block."""
    out = flags.join(table, "flag", "left")
    return out.withColumn("category", F.coalesce("category", F.lit("other"))).withColumn("severity", F.coalesce("severity", F.lit("low"))).withColumn("blocking", F.coalesce("blocking", F.lit(False)))
