"""Carrier queries of terms in unsegmented text, of script conversion and of sections.

The tables hold no Chinese, so their own words are written in Chinese characters letter by letter: terms overlap, nest and
meet word borders in the way that the words do.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import text
from ..operators import extract, sections, terms
from .registry import query

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A character for each letter, simplified and traditional.
SIMPLE = "资产总额负债营业收入净利润税现金流动权益存货股本合计"
TRADITIONAL = "資產總額負債營業收入淨利潤稅現金流動權益存貨股本合計"


def _chinese(c: str, alphabet: str) -> Column:
    return F.translate(F.lower(c), LETTERS, alphabet)


def _word(letters: str) -> str:
    return letters.translate(str.maketrans(LETTERS, SIMPLE))


_FORMS = [("th", "t1"), ("the", "t2"), ("er", "t3"), ("tion", "t4"), ("ing", "t3"), ("in", "t5"), ("ion", "t5"), ("e", "t6"), ("entha", "t7"), ("and", "t1"), ("de", "t8"), ("ha", "t8")]
_ORDERED = sorted((_word(f) for f, _ in _FORMS), key=lambda f: -len(f))
_VALUES = ", ".join(f"('{_word(f)}', '{k}')" for f, k in _FORMS)
_SHAPED = f"regexp_replace(translate(lower(text), '{LETTERS}', '{SIMPLE}'), '[^a-z0-9㐀-䶿一-鿿豈-﫿]+', ' ', 'g')"


@query(f"""WITH k(form, key) AS (VALUES {_VALUES}), w AS (SELECT doc_id, unnest(regexp_extract_all({_SHAPED}, '{"|".join(_ORDERED)}')) AS form FROM documents)
SELECT doc_id, key, count(*) AS n FROM w JOIN k USING (form) GROUP BY ALL""")
def unsegmented_terms(t, spark):
    """Every text read left to right as terms, the longest first, in a text of traditional characters."""
    glossary = spark.createDataFrame([(_word(f), k) for f, k in _FORMS], "form string, key string")
    docs = t("documents").select("doc_id", _chinese("text", TRADITIONAL).alias("text"))
    return terms.segmented(docs, glossary, "text").select("doc_id", F.explode("terms.key").alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("n"))


@query(f"""WITH k(form, key) AS (VALUES {_VALUES}), d AS (SELECT doc_id, {_SHAPED} AS s FROM documents)
SELECT doc_id, key, count(*) AS forms FROM d JOIN k ON contains(s, form) GROUP BY ALL""")
def embedded_terms(t, spark):
    """All forms that occur at any place of a text, by key."""
    glossary = spark.createDataFrame([(_word(f), k) for f, k in _FORMS], "form string, key string")
    hits = terms.glossary_hits(t("documents").select("doc_id", _chinese("text", SIMPLE).alias("text")), glossary, "text")
    return hits.groupBy("doc_id", "key").agg(F.count("*").alias("forms"))


#: Letters as characters of which some convert otherwise in a phrase.
_MIXED = "蓋額總產著債覆核瞭利藉乾麼答甚徵淨業望作口資準備皇后"
_PHRASES = [("覆核", "复核"), ("答覆", "答复"), ("覆蓋", "覆盖"), ("著作", "著作"), ("瞭望", "瞭望"), ("藉口", "借口"), ("甚麼", "什么")]
_SINGLE = {**dict(zip(text.TRADITIONAL, text.SIMPLIFIED)), "著": "着", "乾": "干", "瞭": "了", "麼": "么", "徵": "征"}
_OTHERS = sorted((a, _SINGLE[a]) for a in set(_MIXED) if _SINGLE.get(a, a) != a)


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(lower(text), '{LETTERS}', '{_MIXED}'), '{"|".join(a for a, _ in _PHRASES)}|(?s:.)') AS w FROM documents),
m AS (SELECT MAP {{{", ".join(f"'{a}': '{b}'" for a, b in [*_PHRASES, *_OTHERS])}}} AS m)
SELECT doc_id, md5(coalesce(array_to_string(list_transform(w, lambda x: coalesce(m[x], x)), ''), '')) AS simplified FROM d, m""")
def phrase_conversion(t, spark):
    """Traditional text to simplified, phrases before their characters."""
    table = spark.createDataFrame([*_PHRASES, *_OTHERS], "form string, into string")
    docs = t("documents").select("doc_id", _chinese("text", _MIXED).alias("text"))
    return terms.converted(docs, table, "text", "simple").select("doc_id", F.md5(F.coalesce("simple", F.lit("")).cast("binary")).alias("simplified"))


@query("""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), x AS (SELECT doc_id, regexp_replace(lower(line), '[^a-zäöüßàâçéèêëîïôûùœáíñóúü0-9]+', '', 'g') AS c, lower(trim(line)) AS e FROM d),
k(form, key, ord) AS (VALUES ('tion', 'k1', 1), ('entha', 'k2', 2), ('license', 'k3', 3), ('andth', 'k4', 4), ('thehe', 'k5', 5), ('password', 'k6', 6)),
h AS (SELECT doc_id, c, e, (SELECT arg_min(key, -length(form) * 100 + ord) FROM k WHERE contains(c, form)) AS key FROM x)
SELECT doc_id, key AS canonical_key, count(*) AS n FROM h WHERE key IS NOT NULL GROUP BY ALL""")
def embedded_lookup(t, spark):
    """The key of each line of a text by its longest embedded term, spaces and marks aside."""
    glossary = spark.createDataFrame([("tion", "k1", 1), ("En tha", "k2", 2), ("license", "k3", 3), ("and th", "k4", 4), ("the-he", "k5", 5), ("Password", "k6", 6)], "form string, canonical_key string, ord int")
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return terms.lookup(lines, glossary, "line").where("canonical_key IS NOT NULL").groupBy("doc_id", "canonical_key").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'revenue' WHEN '2-HIGH' THEN 'net_profit' WHEN '3-MEDIUM' THEN 'total_assets' WHEN '4-NOT SPECIFIED' THEN 'cash_equivalents' ELSE 'equity' END AS canonical_key,
  CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS value, CASE o_orderstatus WHEN 'O' THEN '万元' WHEN 'F' THEN '百万元' ELSE '亿元' END AS unit FROM orders) SELECT k, canonical_key, value, unit FROM l""")
def chinese_text_metrics(t, spark):
    """Labels in simplified and traditional characters, without spaces about them, with the amounts that follow."""
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "本公司實現營業收入").when(F.col("o_orderpriority") == "2-HIGH", "归属净利润为").when(F.col("o_orderpriority") == "3-MEDIUM", "年末資產總額達").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "现金及现金等价物余额").otherwise("股東權益合計")
    unit = F.when(F.col("o_orderstatus") == "O", "萬元").when(F.col("o_orderstatus") == "F", "百万元").otherwise("億元")
    lines = t("orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("報告期內"), label, F.format_number("o_totalprice", 2), unit, F.lit("。")).alias("text"))
    glossary = spark.createDataFrame([("营业收入", "revenue"), ("净利润", "net_profit"), ("资产总额", "total_assets"), ("现金及现金等价物", "cash_equivalents"), ("股东权益合计", "equity"), ("net profit", "net_profit")], "form string, canonical_key string")
    return extract.text_metrics(lines, glossary, ["k"]).select("k", "canonical_key", "value", "unit")


_TABLE = [("license", "notes"), ("tionth", "risk"), ("ing", "mda"), ("password", "esg"), ("the", "financial_statements"), ("der", "notes"), ("que", "company_profile")]
_TITLES = [("entha", "bs"), ("erly", "pl"), ("thean", "cf"), ("ander", "equity")]
_TALK = ("ione", "been")


def _case(pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains(h, '{k}') THEN '{c}'" for k, c in pairs) + " END"


_FOUND = f"""WITH x AS (SELECT source AS report, CAST(doc_id // 3 AS BIGINT) AS page, doc_id AS seq, left(lower(text), 200) AS h FROM documents),
f AS (SELECT report, page, seq, {_case(_TITLES)} AS title, {" OR ".join(f"contains(h, '{k}')" for k in _TALK)} AS talk, {_case(_TABLE)} AS other FROM x),
s AS (SELECT report, page, seq, CASE WHEN title IS NOT NULL THEN CASE WHEN talk THEN 'mda' ELSE title END ELSE other END AS section FROM f)"""


@query(_FOUND + """, o AS (SELECT report, page, arg_max(section, seq) AS own FROM s WHERE section IN ('bs', 'pl', 'cf', 'equity') GROUP BY ALL)
SELECT s.seq, CASE WHEN (section IS NULL OR section = 'financial_statements') AND NOT EXISTS (SELECT 1 FROM o WHERE o.report = s.report AND o.page = s.page)
  THEN coalesce((SELECT arg_max(own, o.page) FROM o WHERE o.report = s.report AND o.page BETWEEN s.page - 5 AND s.page - 1), section) ELSE section END AS section FROM s""")
def section_detection(t, spark):
    """Three texts a page, a report for each source: keywords by the order of their tables, then statements over the pages that follow."""
    pages = t("documents").select(F.col("source").alias("report"), F.floor(F.col("doc_id") / 3).alias("page"), F.col("doc_id").alias("seq"), "text")
    found = sections.detected(pages, "text", _TABLE, _TITLES, _TALK)
    return sections.carried(found, ["report"], "page", "seq").select("seq", "section")
