"""Line deduplication: a suffix array of the corpus over line ids, by prefix doubling.  DataFrame functions only.

Documents are sequences of line ids, one after the other.  Round k ranks the suffixes of the corpus by their first 2**k
lines: the pair of ranks of the two halves is the key, distinct keys are sorted over range partitions, and their
places are the new ranks.  Suffixes of one rank are an interval of the suffix array whose longest common prefix (LCP) is
2**k lines or more; suffixes alone in theirs drop out, so the rounds shrink fast, and they end when no run repeats.

Then the intervals get their exact LCP, from the highest level down: an interval of m lines is split by the ranks of
the next 2**j lines; suffixes that meet an earlier one there go on in the narrower interval, the first of
each stays in the wider one in the name of all.  What a suffix is left with is the longest run of lines from it on that
also begins at an earlier position: a maximal repeat.

A run counts if it has two lines or more, or one line of at least `least_chars` characters.  Lines of runs that count are
deleted, so of every repeated run the first copy (by doc_id, then line) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, read, stored

LEAST_CHARS = 30
#: Bits of a line number in a position; the bits above hold the number of the document.
_LINE = 25


def positions(documents: DataFrame) -> DataFrame:
    """doc_id, twin, doc (number in order of doc_id), lines: array of (line id, characters); blank lines have no id.

    Numbers are dense: the sizes of the range partitions (a row for each) give each its first one.  Documents of
    2**25 lines or more, and more than 2**38 documents, are refused by an error.
    """
    line = lambda x: F.struct(F.when(F.length(F.trim(x)) > 0, F.xxhash64(x)).alias("id"), F.length(x).alias("chars"))
    split = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _twin(F.col("text")).alias("twin"), F.transform(F.split("text", "\n"), line).alias("lines"))
    kept = stored(split.where(F.col("lines").isNotNull()), "split")
    number = F.monotonically_increasing_id()
    ordered = kept.dropDuplicates(["doc_id", "twin"]).repartitionByRange("doc_id", "twin").sortWithinPartitions("doc_id", "twin")
    out = stored(ordered.withColumn("part", F.shiftright(number, 33)).withColumn("row", number.bitwiseAND((1 << 33) - 1)), "sequences", small=True)
    dropped(kept)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    first = out.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    fits = F.when((F.size("lines") < 1 << _LINE) & (F.col("first") + F.col("row") < 1 << (63 - _LINE)), F.col("first") + F.col("row")).otherwise(F.raise_error(F.lit("too many lines in a document or too many documents")).cast("long"))
    return out.join(first.hint("broadcast"), "part").select("doc_id", "twin", fits.alias("doc"), "lines")


def _twin(text: Column) -> Column:
    return F.xxhash64(text)


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, first (position), rank of every key that more than one of the rows (pos, by) has: places in the range sort of the keys."""
    shared = rows.groupBy(*by).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select(*by, "first")
    return stored(shared.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__rank", F.monotonically_increasing_id()), "ranks", small=True)


def suffix_array(sequences: DataFrame) -> list[DataFrame]:
    """For 1, 2, 4, ... lines: pos, rank and first (least position of the rank) of all suffixes that share so many lines with another."""
    lines = sequences.select("doc", F.posexplode("lines").alias("line", "s")).where("s.id IS NOT NULL")
    named = lines.select((F.shiftleft(F.col("doc"), _LINE) + F.col("line")).alias("pos"), F.col("s.id").alias("name"), F.col("s.chars").alias("chars"))
    keys, levels, size = _ranked(named, ["name"]), [], 1
    levels.append(stored(named.join(keys, "name").select("pos", F.col("__rank").alias("rank"), "first", "chars"), "level", small=True))
    while True:
        here = Window.partitionBy(F.shiftright("pos", _LINE)).orderBy("pos").rangeBetween(size, size)
        longer = levels[-1].withColumn("next", F.max("rank").over(here)).where("next IS NOT NULL").select("pos", "rank", "next")
        keys = _ranked(longer, ["rank", "next"])
        if keys.isEmpty():
            return levels
        levels.append(stored(longer.join(keys, ["rank", "next"]).select("pos", F.col("__rank").alias("rank"), "first"), "level", small=True))
        size *= 2


def repeated_runs(sequences: DataFrame) -> DataFrame:
    """pos, chars of its line, and length of the longest run of lines from pos on that also begins at an earlier position."""
    levels = suffix_array(sequences)
    later = [x.where("first < pos").select("pos") for x in levels]
    # Intervals: (lines, first) names one, as different intervals of one length have no suffix in common.
    inside = None
    for j in range(len(levels) - 2, -1, -1):
        own = levels[j + 1].select("pos", F.lit(2 << j).alias("lines"), "first")
        if j + 2 < len(levels):
            own = own.join(later[j + 2], "pos", "left_anti")
        inside = own if inside is None else inside.unionByName(own)
        next_ = levels[j].select((F.col("pos")).alias("at"), F.col("rank").alias("next"))
        split = stored(inside.withColumn("at", F.col("pos") + F.col("lines")).join(next_, "at", "left").select("pos", "lines", "first", "next"), "split", small=True)
        parts = split.where("next IS NOT NULL").groupBy("lines", "first", "next").agg(F.min("pos").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
        met = split.join(parts, ["lines", "first", "next"], "left")
        # The head of a part stands in both, the rest of it in the narrower one, what is alone in the wider one.
        wide = F.struct(F.col("lines"), F.col("first"))
        deep = F.struct((F.col("lines") + (1 << j)).alias("lines"), F.col("head").alias("first"))
        where = F.when(F.col("head").isNull(), F.array(wide)).when(F.col("head") == F.col("pos"), F.array(wide, deep)).otherwise(F.array(deep))
        before, inside = split, stored(met.select("pos", F.explode(where).alias("i")).select("pos", "i.lines", "i.first"), "intervals", small=True)
        dropped(before)
    single = levels[0].where("first < pos").select("pos", F.lit(1).alias("lines"), "chars")
    every = single if inside is None else single.unionByName(inside.where("first < pos").select("pos", "lines"), allowMissingColumns=True)
    return every.groupBy("pos").agg(F.max("lines").alias("length"), F.max("chars").alias("chars"))


def deleted(sequences: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc, gone: the numbers of the lines to delete, longest: lines of the longest run found at an earlier place too.

    Every line of a repeated run is itself repeated, so the runs that cover a line begin at rows before it.
    """
    counts = (F.col("length") > 1) | (F.col("chars") >= least_chars)
    so_far = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = repeated_runs(sequences).withColumn("doc", F.shiftright("pos", _LINE)).withColumn("end", F.when(counts, F.col("pos") + F.col("length")))
    covered = runs.withColumn("reach", F.max("end").over(so_far)).where("reach > pos")
    line = F.col("pos").bitwiseAND((1 << _LINE) - 1).cast("int")
    return covered.groupBy("doc").agg(F.collect_list(line).alias("gone"), F.max(F.when(counts, F.col("length"))).alias("longest"))


def dedup_lines(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """All columns of documents with `text` without the deleted lines, and n_lines, n_removed, longest_run.

    Null text: 0 lines, stays null.  An empty text has one blank line.  Blank lines are never deleted and end a run.
    Rows that repeat both id and text are the same document and get the same result.  Rows with a null id come
    first in the order of documents.  Columns of the input named as the three new ones are
    replaced; names that begin with two underscores are reserved.
    """
    sequences = positions(documents)
    gone = deleted(sequences, least_chars)
    marks = sequences.select("doc", "doc_id", "twin").join(gone, "doc").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("doc_id").isNull().alias("__none"), F.col("twin").alias("__twin"), F.col("gone").alias("__gone"), F.col("longest").alias("__longest"))
    keep = documents.drop("n_lines", "n_removed", "longest_run")
    cast = F.col("doc_id").cast("long")
    rows = keep.withColumn("__id", F.coalesce(cast, F.lit(-(1 << 63)))).withColumn("__none", cast.isNull()).withColumn("__twin", _twin(F.col("text")))
    joined = rows.join(marks, ["__id", "__none", "__twin"], "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: F.element_at(F.col("__keep"), i + 1)), "\n"))
    flags = F.when(F.col("__gone").isNotNull(), F.transform(F.sort_array(F.array_union(F.transform(left, lambda i: i * 2 + 1), F.transform("__gone", lambda i: i * 2))), lambda v: v % 2 == 1))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    counted = joined.withColumn("__keep", flags).withColumn("n_lines", n.cast("long")).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).withColumn("longest_run", F.coalesce("__longest", F.lit(0)).cast("long"))
    return counted.withColumn("text", text).select(*keep.columns, "n_lines", "n_removed", "longest_run")


def op9_lines(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP9_SQL = f"""
WITH l AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS line, s, trim(s) <> '' AS used
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), p AS (
  SELECT *, CASE WHEN used AND lead(used) OVER d THEN lead(s) OVER d END AS nxt FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY line)
), e AS (
  SELECT *, used AND length(s) >= {LEAST_CHARS} AND row_number() OVER (PARTITION BY s, used ORDER BY doc_id, line) > 1 AS one,
         nxt IS NOT NULL AND row_number() OVER (PARTITION BY s, nxt ORDER BY doc_id, line) > 1 AS two
  FROM p
), g AS (
  SELECT *, one OR two OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY line), false) AS gone FROM e
), k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text
  FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, k.text
FROM documents d LEFT JOIN k USING (doc_id)
"""
