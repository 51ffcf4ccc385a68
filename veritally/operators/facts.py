"""Facts in aligned paragraphs of two languages: amounts, share counts and dates, with units that an earlier block declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, text as texts_, units
from ..sources.shared import cut
from . import matching

_NUMBER = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
_UNIT = "十亿元|亿元|百万元|万元|千元|元|billion|million|thousand"
#: A block that declares the unit, and maybe the currency, of what follows it.
DECLARED = rf"(?i)(?:单位\s*[:：]\s*|unit\s*[:：]\s*|expressed in\s+|\(\s*in\s+|^\s*\()((?:人民币|港币|美元|rmb|hk\$|us\$)?)\s*'?({_UNIT})"
#: Words that tell what a date is about, in either language.
DATE_CONTEXTS = {
    "corporate": ("成立", "上市", "并购", "合并", "重组", "改制", "设立", "创办", "established", "founded", "listed", "ipo", "merger", "acquisition", "restructuring"),
    "governance": ("董事会", "股东大会", "会议", "决议", "批准", "通过", "审议", "board", "shareholders", "meeting", "approved", "passed", "adopted"),
    "disclosure": ("签署", "发布", "披露", "公告", "signed", "published", "disclosed", "announced"),
}
#: A rate for each ten shares, in either language (of simplified text in lower case).
PER_TEN = r"每\s*10\s*股.{0,28}?(?:人民币|港币|港元|美元)?\s*(\d+(?:\.\d+)?)\s*元|(?:rmb|hkd|usd)\s*(\d+(?:\.\d+)?)\s*(?:\([^)]+\))?\s*per\s*10\s*shares"
SHARE_UNITS = {"亿股": 1e8, "万股": 1e4, "千股": 1e3, "thousand": 1e3, "million": 1e6, "billion": 1e9}
#: Facts are alike if they differ by this share at most; a ratio is explained by a unit within this share.
SAME, SCALE = 1e-3, 0.05


def with_context(blocks: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """blocks with unit, currency and year as last declared in the report up to and in the block (null before any)."""
    plain = texts_.simplify(F.col("text"))
    told = F.regexp_extract(plain, DECLARED, 0)  # few blocks declare anything; the parts are read in what matched
    said = F.regexp_extract(told, DECLARED, 2)
    money = F.regexp_extract(told, DECLARED, 1)
    w = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, True).over(w)
    year = F.regexp_extract(plain, r"(?i)(?:for the year ended .{0,12}|year )((?:19|20)\d{2})|((?:19|20)\d{2})\s*年度", 0)
    marked = blocks.withColumn("__unit", F.nullif(F.lower(said), F.lit(""))).withColumn("__money", units.currency(F.nullif(F.lower(money), F.lit("")))).withColumn("__year", F.nullif(F.regexp_extract(year, r"((?:19|20)\d{2})", 1), F.lit("")))
    return marked.withColumn("unit", last("__unit")).withColumn("currency", last("__money")).withColumn("year", last("__year")).drop("__unit", "__money", "__year")


def _found(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<g0 (the whole), g1, ...>> of all matches; the text is read once, the groups are read in the matches."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("g0"), *[F.regexp_extract(m, pattern, k).alias(f"g{k}") for k in range(1, groups + 1)]))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).cast("double")


def facts(blocks: DataFrame) -> DataFrame:
    """blocks(text, unit, ...) with their facts in rows: kind, value, raw, own_unit, about.

    per_ten: a dividend for each ten shares, which is neither an amount nor a share count.
    share_count: 股, 千股, 万股, 亿股, shares, million shares.  amount: a number with separators or decimals, in its own
    unit or the one inherited, in base units; percentages, share counts and dates are none.  date: days since 1970, and
    what it is about by the words around it.
    """
    # The forms of the text are columns of their own, or each would be made again for every group of every pattern.
    forms = blocks.withColumn("__whole", F.lower(texts_.simplify(F.col("text"))))
    whole, plain, rest = F.col("__whole"), F.col("__plain"), F.col("__rest")
    forms = forms.withColumn("__rated", _found(whole, PER_TEN, 2))
    forms = forms.withColumn("__plain", F.when(F.size("__rated") > 0, F.regexp_replace(whole, PER_TEN, " ")).otherwise(whole))
    shares = rf"(?i){_NUMBER}\s*(亿股|万股|千股|股|(?:thousand |million |billion )?shares?\b)"
    scale = lambda u: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SHARE_UNITS.items() for x in kv]), F.trim(F.regexp_replace(u, "shares?$", ""))), F.lit(1.0))
    fact = lambda kind, value, raw, unit, about: F.struct(F.lit(kind).alias("kind"), value.alias("value"), raw.alias("raw"), unit.alias("own_unit"), about.alias("about"))
    none = F.lit(None).cast("string")
    rated = F.transform("__rated", lambda m: fact("per_ten", F.round(F.concat(m["g1"], m["g2"]).cast("double"), 4), F.trim(m["g0"]), none, none))
    counted = F.transform(_found(plain, shares, 2), lambda m: fact("share_count", _number(m["g1"]) * scale(m["g2"]), m["g0"], F.nullif(F.regexp_replace(m["g2"], r"^股$|\s*shares?\s*$", ""), F.lit("")), none))
    # What is a share count, a date or a rate is taken out before amounts are looked for.
    forms = forms.withColumn("__rest", F.regexp_replace(F.regexp_replace(plain, shares, " "), r"(?:19|20)\d{2}[-/.年]\d{1,2}[-/.月]\d{1,2}日?|\d{1,2} [a-z]+,? (?:19|20)\d{2}|[a-z]+ \d{1,2}, (?:19|20)\d{2}|\d+(?:\.\d+)?\s?%", " "))
    amounts = rf"{_NUMBER}\s*({_UNIT})?"
    real = F.filter(_found(rest, amounts, 2), lambda m: (m["g2"] != "") | m["g1"].contains(",") | m["g1"].contains("."))
    own = lambda m: F.nullif(m["g2"], F.lit(""))
    money = F.transform(real, lambda m: fact("amount", _number(m["g1"]) * units.multiplier(F.coalesce(own(m), F.col("unit"))), m["g0"], F.coalesce(own(m), F.col("unit")), none))
    told = F.transform(dates.dates(F.col("text")), lambda d: fact("date", F.datediff(F.try_to_timestamp(d, F.lit("yyyy-MM-dd")), F.lit("1970-01-01")).cast("double"), d, none, _about(whole)))
    return forms.select(*[F.col(c) for c in blocks.columns], F.inline(F.concat(rated, counted, money, told)))


def _about(plain: Column) -> Column:
    """Kinds of events that a block's words name, joined by bars."""
    return F.concat_ws("|", *[F.when(plain.rlike("|".join(words)), F.lit(kind)) for kind, words in DATE_CONTEXTS.items()])


def _held(zh: DataFrame, en: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of both languages by keys and kind: arrays zh and en, in order of their values."""
    fact = F.struct("value", "own_unit", "about")
    side = lambda df, p: df.select(*keys, "kind", F.lit(p).alias("__p"), fact.alias("__f"))
    of = lambda p: F.array_sort(F.collect_list(F.when(F.col("__p") == p, F.col("__f")))).alias(p)
    return side(zh, "zh").unionByName(side(en, "en")).groupBy(*keys, "kind").agg(of("zh"), of("en"))


def _linked(kind: Column, one: Column, two: Column) -> Column:
    return (kind != "date") | F.arrays_overlap(F.split(one, r"\|"), F.split(two, r"\|")) & (one != "")


def _ranked(held: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with several facts of a side: the closest pairs first, and what is left of either side."""
    side = lambda p: held.select(*keys, "kind", F.posexplode(p).alias(p + "n", "f")).select(*keys, "kind", (F.col(p + "n") + 1).alias(p + "_n"), *[F.col("f." + c).alias(f"{p}_{c}") for c in ("value", "own_unit", "about")])
    a, b = side("zh"), side("en")
    both = a.join(b, [*keys, "kind"])
    linked = _linked(F.col("kind"), F.col("zh_about"), F.col("en_about"))
    group = F.concat_ws("\1", *[F.coalesce(F.col(k).cast("string"), F.lit("\2")) for k in keys], "kind")
    scored = both.where(linked).withColumn("__g", group).withColumn("__s", -units.relative_delta(F.col("zh_value"), F.col("en_value")))
    pairs = matching.greedy(scored, "__g", "zh_n", "en_n", "__s", least=-1e300)
    left = a.withColumn("__g", group).join(pairs.select("__g", "zh_n", "en_n"), ["__g", "zh_n"], "full_outer")
    whole = left.join(b.withColumn("__g", group).drop(*keys, "kind"), ["__g", "en_n"], "full_outer")
    lost = b.withColumn("__g", group).select("__g", "en_n", *[F.col(k).alias("__" + k) for k in (*keys, "kind")])
    whole = whole.join(lost, ["__g", "en_n"], "left")
    for k in (*keys, "kind"):
        whole = whole.withColumn(k, F.coalesce(k, "__" + k))
    return whole


def compared(zh: DataFrame, en: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of aligned blocks (equal keys) paired one to one within a kind, the closest first: keys, kind, zh_value, en_value, status.

    status: same; unit_scale where the ratio is that of the units that the sides name; differs; zh_only and en_only.  Dates
    only pair if both are about one kind of event.
    """
    held = cut(_held(zh, en, keys), "facts")
    mine, theirs = F.size("zh"), F.size("en")
    both = (mine > 0) & (theirs > 0)
    for k in (*keys, "kind"):
        both &= F.col(k).isNotNull()
    many = both & (mine + theirs > 2)
    z, e = F.col("zh")[0], F.col("en")[0]
    # One fact a side needs no ranking: it is paired, or each stays alone.
    linked = F.coalesce(_linked(F.col("kind"), z["about"], e["about"]) & units.relative_delta(z["value"], e["value"]).isNotNull(), F.lit(False))
    none = F.lit(None).cast(held.schema["zh"].dataType.elementType)
    alone = F.concat(F.transform("zh", lambda f: F.struct(f.alias("zh"), none.alias("en"))), F.transform("en", lambda f: F.struct(none.alias("zh"), f.alias("en"))))
    few = held.where(~many).select(*keys, "kind", F.inline(F.when(both & linked, F.array(F.struct(z.alias("zh"), e.alias("en")))).otherwise(alone)))
    each = few.select(*keys, "kind", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("zh", "en") for c in ("value", "own_unit", "about")])
    whole = each.unionByName(_ranked(held.where(many), keys).select(each.columns))
    delta = units.relative_delta(F.col("zh_value"), F.col("en_value"))
    ratio = F.greatest(F.abs("zh_value"), F.abs("en_value")) / F.greatest(F.least(F.abs("zh_value"), F.abs("en_value")), F.lit(1e-9))
    z, e = _scale(F.col("zh_own_unit")), _scale(F.col("en_own_unit"))
    expected = F.when((z > 1) & (e > 1) & (z != e), F.greatest(z, e) / F.least(z, e)).when((z > 1) & F.col("en_own_unit").isNull(), z).when((e > 1) & F.col("zh_own_unit").isNull(), e)
    scaled = F.coalesce((F.col("kind") != "date") & (F.abs(ratio / expected - 1) <= SCALE), F.lit(False))
    status = F.when(F.col("en_value").isNull(), "zh_only").when(F.col("zh_value").isNull(), "en_only").when(F.when(F.col("kind") == "date", F.col("zh_value") == F.col("en_value")).otherwise(delta <= SAME), "same").when(scaled, "unit_scale").otherwise("differs")
    return whole.select(*keys, "kind", "zh_value", "en_value", status.alias("status"))


def _scale(unit: Column) -> Column:
    shares = F.element_at(F.create_map(*[F.lit(x) for kv in SHARE_UNITS.items() for x in kv]), unit)
    return F.coalesce(shares, units.multiplier(unit))
