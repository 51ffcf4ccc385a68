"""Text predicates and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Traditional characters, each before its simplified form.
PAIRS = (
    "資资產产總总額额負负債债營营業业淨净潤润稅税項项幣币億亿萬万權权儲储銀银關关聯联報报務务狀状況况損损現现動动變变東东數数賬账帳账"
    "貸贷賃赁購购贖赎贈赠費费應应佔占歸归屬属匯汇兌兑滙汇擔担證证減减價价獲获層层論论與与討讨會会計计師师審审電电貿贸貨货質质壓压壞坏"
    "備备準准併并綜综發发還还餘余註注冊册攤摊銷销舊旧團团國国際际號号檢检驗验單单開开環环責责優优譽誉險险舉举監监幹干後后於于實实繳缴"
    "補补雜杂當当處处點点類类級级經经濟济專专員员職职勞劳廠厂設设庫库預预長长遞递轉转讓让無无約约終终續续維维護护範范圍围"
)
TRADITIONAL, SIMPLIFIED = PAIRS[::2], PAIRS[1::2]
#: Phrases whose characters convert in another way than alone, for `operators.terms.converted`.
PHRASES = (
    ("答覆", "答复"), ("覆核", "复核"), ("回覆", "回复"), ("覆蓋", "覆盖"), ("著作", "著作"), ("著名", "著名"), ("顯著", "显著"), ("著", "着"),
    ("乾隆", "乾隆"), ("乾坤", "乾坤"), ("乾", "干"), ("瞭望", "瞭望"), ("瞭", "了"), ("藉口", "借口"), ("甚麼", "什么"), ("麼", "么"),
    ("徵收", "征收"), ("徵", "征"), ("皇后", "皇后"), ("裏", "里"), ("準備", "准备"), ("賬面", "账面"), ("註冊資本", "注册资本"),
)
CJK = r"[一-鿿]"


def simplify(text: Column) -> Column:
    return F.translate(text, TRADITIONAL, SIMPLIFIED)


def normalise(text: Column) -> Column:
    """Simplified, lower case, runs of white space (full-width spaces too) as one, trimmed."""
    return F.lower(F.trim(F.regexp_replace(simplify(text), r"[\s　 ]+", " ")))


def snake_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\W+", "_"), "^_+|_+$", "")


def branch_name(text: Column) -> Column:
    return F.regexp_replace(simplify(text), r"[\s　]+", "")


def share_of(text: Column, pattern: str) -> Column:
    """Share of the characters that match."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(F.lit(0.0))


def language(text: Column) -> Column:
    """zh with over 30 % CJK, else en with over 60 % ASCII letters, digits and spaces, else bilingual."""
    return F.when(share_of(text, CJK) > 0.3, "zh").when(share_of(text, r"[A-Za-z0-9\s]") > 0.6, "en").otherwise("bilingual")


def language_vote(languages: Column) -> Column:
    """Strict plurality of an array of languages, else bilingual; empty: en."""
    n = lambda x: F.size(F.filter(languages, lambda v: v == x))
    zh, en, both = n("zh"), n("en"), n("bilingual")
    return F.when(F.size(languages) == 0, "en").when((zh > en) & (zh > both), "zh").when((en > zh) & (en > both), "en").otherwise("bilingual")


def garbled_text(text: Column) -> Column:
    """Replacement characters, or under half of the visible characters are letters, digits or CJK."""
    return F.coalesce((F.instr(text, "�") > 0) | (share_of(F.regexp_replace(text, r"\s", ""), r"[A-Za-z0-9À-ɏ一-鿿]") < 0.5), F.lit(True))


def garbled_key(key: Column) -> Column:
    return F.coalesce((F.length(key) < 2) | ((F.length(key) > 10) & (share_of(key, r"[A-Za-z0-9_一-鿿]") < 0.5)), F.lit(True))


def bigrams(words: Column) -> Column:
    return F.transform(F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))


def junk_label(label: Column) -> Column:
    """Page marks, over 40 characters without punctuation, or a repeated word pair."""
    pairs = bigrams(F.split(F.lower(label), r"\s+"))
    return label.rlike(r"(?i)^(page|table of contents|contents|\d+)$") | ((F.length(label) > 40) & ~label.rlike(r"[.,;:!?]")) | (F.size(F.array_distinct(pairs)) < F.size(pairs))


def detail_level(n: Column) -> Column:
    return F.when(n < 200, "brief").when(n < 1000, "medium").otherwise("detailed")


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and 12 hexadecimal digits of the SHA-1 of the parts joined by a bar; a null has a mark of its own, bars within parts are escaped."""
    safe = [F.coalesce(F.regexp_replace(p.cast("string"), r"([\\|])", r"\\$1"), F.lit("\\N")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *safe)), 1, 12))


def hamming(a: Column, b: Column) -> Column:
    """Substitutions between texts of one length; null if lengths differ."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), differ)


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def words(text: Column) -> Column:
    """Distinct lower-case ASCII words of three letters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)))


def first_keyword(text: Column, table: list[tuple[str, str]]) -> Column:
    """Code of the first keyword of an ordered table that the text contains."""
    out = F.lit(None).cast("string")
    for keyword, code in reversed(table):
        out = F.when(F.lower(text).contains(keyword), F.lit(code)).otherwise(out)
    return out


def fragments(text: Column) -> Column:
    """Whole if under 260 characters, else cut after sentence ends, pieces of 20 to 360 characters kept."""
    cut = F.filter(F.transform(F.split(text, r"(?<=[.;!?。；！？])"), lambda x: F.trim(x)), lambda x: F.length(x).between(20, 360))
    return F.when(F.length(text) < 260, F.array(text)).otherwise(cut)


def keyword_counts(text: Column) -> Column:
    """array<struct<word,n>> of words of three letters or more, most frequent first, ties by the word."""
    every = F.array_sort(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)))
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  (evaluated once, not for each element)

    def counts(words: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == 1) | (F.get(words, i - 1) != F.get(words, i - 2)))
        run = lambda starts: F.transform(starts, lambda at, k: F.struct((at - F.coalesce(F.get(starts, k + 1), F.size(words) + 1)).alias("m"), F.get(words, at - 1).alias("word")))
        return let(begins, run)

    counted = F.when(F.size(every) > 0, let(every, counts)).otherwise(F.array().cast("array<struct<m:int,word:string>>"))
    return F.transform(F.slice(F.array_sort(counted), 1, 20), lambda s: F.struct(s["word"].alias("word"), (-s["m"]).alias("n")))


def quoted_terms(logic: Column) -> Column:
    """Quoted terms of a check's logic, else the phrase after the verb disclose."""
    quoted = F.regexp_extract_all(logic, F.lit("[\"'“「]([^\"'”」]+)[\"'”」]"), F.lit(1))
    phrase = F.regexp_extract(logic, r"(?i)disclos\w*\s+(?:the\s+)?([\w ]{3,40})", 1)
    return F.when(F.size(quoted) > 0, quoted).when(phrase != "", F.array(phrase)).otherwise(F.array().cast("array<string>"))
