import unicodedata

import pytest
from pyspark.sql import functions as F

from cardloom import refdata
from cardloom.functions import text
from cardloom.plans import catalogue


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize("f, value, wanted", [
    (text.strip_diacritics, "مُحَمَّد", "محمد"), (text.strip_diacritics, "محمــــد", "محمد"), (text.clean_noise, "[ محمد ] | حسن", "محمد حسن"), (text.merge_article, "ال قاهرة", "القاهرة"),
    (text.merge_article, "مدينة ال منصورة", "مدينة المنصورة"), (text.normalize_arabic, "احمد", "أحمد"), (text.normalize_arabic, "مصطفي", "مصطفى"), (text.normalize_arabic, "فاطمه", "فاطمة"),
    (text.normalize_arabic, "عبدالله", "عبد الله"), (text.normalize_arabic, "الله", "الله"), (text.normalize_arabic, "عبد الله", "عبد الله"), (text.normalize_arabic, "له", "له"), (text.normalize_arabic, "محمد ABC", "محمد ABC"),
    (lambda c: text.normalize_arabic(c, True), "محمد ABC", "محمد"), (lambda c: text.normalize_arabic(c, True), "é محمد", "é محمد"), (text.normalize_arabic, "١٢ شارع النيل", "١٢ شارع النيل"), (text.normalize_arabic, "زغلولاوي", "زغلولاوي"),
    (text.normalize_arabic, "ﻣﺤﻤﺪ", "محمد"), (text.normalize_arabic, None, ""), (text.normalize_arabic, " \t ", ""), (text.contains_arabic, "abc", False), (text.contains_arabic, "a ﷲ", True), (text.western_digits, "١۲3", "123"),
])
def test_functions(spark, f, value, wanted):
    assert one(spark, value, f) == wanted


def test_normalising_twice_is_once(spark):
    for value in ("مُحَمَّد  [احمد] ال قاهرة عبدالرحمن", "فاطمه الزهراء ABC", "ال  ال قاهرة"):
        first = one(spark, value, text.normalize_arabic)
        assert one(spark, first, text.normalize_arabic) == first


def test_similarity_and_suggestions():
    assert text.similarity("الزقازيف", "الزقازيق") == 87.5 and text.similarity("", "") == 100 and text.similarity("ab", "") == 0
    assert round(text.similarity("محمو", "محمود"), 1) == 88.9 and text.similarity("محمو", "محمد") == 75.0
    assert text.suggest("الزقازيف", "address", 85) == "الزقازيق" and text.suggest("الزقازيف", "address", 92) == "الزقازيف"
    assert text.suggest("حسي", "name", 50) == "حسي" and text.suggest("الزقازيف", "other", 10) == "الزقازيف"


def test_corrected_text_keeps_its_words(spark):
    df = spark.createDataFrame([("الزقازيف شارع xyz", "address"), (None, "name"), ("", "name")], "t string, k string")
    got = [r[0] for r in df.select(text.correct_text(F.col("t"), F.col("k"), 85.0)).collect()]
    assert got == ["الزقازيق شارع xyz", None, ""]


def test_suggestions_equal_a_look_at_every_entry():
    def plainly(token, kind, threshold):
        entries = refdata.LEXICONS[kind]
        if len(token) < refdata.MIN_CORRECTED or token in entries:
            return token
        a, b = sorted(((text.similarity(token, e), -k) for k, e in enumerate(entries)), reverse=True)[:2]
        return token if a[0] < threshold or a[0] - b[0] < refdata.AMBIGUITY_MARGIN else entries[-a[1]]

    for kind, entries in refdata.LEXICONS.items():
        assert plainly("wordy", kind, 50) == text.suggest("wordy", kind, 50) == "wordy"
        for k, e in enumerate(entries):
            for word in (e, e[:-1] + "ف", e[1:], e + "ة", e[::-1], "abcd", e[:2] + entries[k - 1][2:]):
                for threshold in (50, 85, 92):
                    assert text.suggest(word, kind, threshold) == plainly(word, kind, threshold)


def test_every_word_of_a_document_is_corrected(spark, tmp_path):
    rows = [(116, "word " * 3000 + "الزقازيف end الزقازيف", "ar"), (117, None, "ar"), (118, "", "ar")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalogue.queries()["fuzzy_correct"](spark, str(tmp_path)).collect()}
    assert got[116].text.startswith(rows[0][1])
    size = len(refdata.COMMON_NAMES + refdata.ADDRESS_TERMS)
    wanted = "الزقازيق" if 116 % size >= len(refdata.COMMON_NAMES) else "الزقازيف"
    assert wanted == "الزقازيق" and got[116].corrected.split()[:3003] == ["word"] * 3000 + [wanted, "end", wanted]
    assert got[117].text and got[118].text


def test_whole_texts_are_read(spark, tmp_path):
    long = "word " * 3000 + "[مُحَمَّد] ال قاهرة احمد مدرسه ١٢ end"
    spark.createDataFrame([(k, long, "ar") for k in range(12)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {
        "contains_arabic": (True, 12), "strip_diacritics": ("[محمد]", 12), "western_digits": (" 12 end", 12), "merge_article": ("القاهرة", 12),
        "ta_marbuta": ("مدرسة", 12), "orthographic": (" أحمد ", 12), "drop_latin": (" احمد ", 12), "normalize_arabic": (" القاهرة أحمد مدرسة ", 12),
    }
    for name, (part, n) in wanted.items():
        got = [[v for k, v in r.asDict().items() if k != "doc_id"][0] for r in catalogue.queries()[name](spark, str(tmp_path)).collect()]
        assert sum(v is True if part is True else part in v for v in got) == n, name
        assert part is True or all((v.count("word") == 3000) for v in got if name not in ("drop_latin", "normalize_arabic")), name


def test_compatibility_forms_are_composed(spark):
    """Row by row against Python's own composition, then the same steps."""
    texts = ["ﻻ ﷲ ﷺ", "ﺍﺣﻤﺪ ﻓﺎﻃﻤﻪ", "ﬁne ½ ™ Ⅷ", "a b c", "é é", None, "", "…", "１２３ ＡＢＣ", "ﺍﻝ ﻗﺎﻫﺮﻩ"]
    rows = [(k, t, None if t is None else unicodedata.normalize("NFKC", t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, t string, c string")
    got = df.select("k", text.normalize_arabic(F.col("t")).alias("a"), text.normalize_composed(F.col("c")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and {r.k: r.a for r in got}[1] == "أحمد فاطمة" and {r.k: r.a for r in got}[9] == "القاهرة"
