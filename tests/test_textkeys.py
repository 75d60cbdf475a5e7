import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.functions import matchers
from ledgerlark.functions import textkeys as T


def values(spark, fn, texts, **kw):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in rows.select("i", fn(F.col("t"), **kw).alias("v")).orderBy("i").collect()]


def test_phonetic_key_golden(spark):
    words = ["अरुण", "अरूण", "arun", "सुरेश", "suresh", "दीपक", "deepak", "dipak", "", "singh", "ram kumar", "fox"]
    assert values(spark, T.phonetic_key, words) == ["ARN", "ARN", "ARN", "SRS", "SRS", "DBK", "DBK", "DBK", "", "SNH", "RN KNR", "V"]


def test_fold_devanagari(spark):
    assert values(spark, T.fold_devanagari, ["अरुण", "अरूण", "किरण", " a   b ", None]) == ["अरुन", "अरुन", "कीरन", "a b", None]
    words = ["अरूण शर्मा", "संतोष", "ऋषि", "ज्ञान"]
    once = values(spark, T.fold_devanagari, words)
    assert values(spark, T.fold_devanagari, once)[:2] == once[:2]


def test_labels_and_marks(spark):
    assert values(spark, T.gender_label, ["Female", "महिला", "other", "पुरुष", None]) == ["महिला", "महिला", "अन्य", "पुरुष", "पुरुष"]
    assert values(spark, T.relation_label, ["Husband", "माता", "guardian", "", None]) == ["पति", "माता", "अन्य", "पिता", "पिता"]
    assert values(spark, T.is_marked_deleted, ["D E L E T E D", "विलोपित", "kept", None]) == [True, True, False, False]
    assert values(spark, T.has_real_id, ["ABC1234567", "DELETED", "ABC", "1234567", None]) == [True, False, False, False, False]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("ABC1234567", "STANDARD_VALID"), ("up/9/42/123456", "LEGACY_VALID"), ("UP/x/1", "INVALID_SLASH"), ("AB#1234567", "NOISE_SYMBOLS"), ("ABC123", "TOO_SHORT"),
     ("ABC12345678", "TOO_LONG"), ("AB11234567", "INVALID_PREFIX"), ("ABC123456X", "INVALID_DIGITS"), ("", "MISSING"), (None, "MISSING")],
)
def test_id_defects(spark, text, kind):
    got = values(spark, T.id_defect, [text])[0]
    assert got["type"] == kind and got["valid"] == (kind in ("STANDARD_VALID", "LEGACY_VALID"))


def test_clean_id(spark):
    texts = ["id: abc 1234567 x", "UP/9/42/123456.", "UP|9|42|123456", "1/9/04/0324386", "JKTO104406", "ABC12345O7", None, "nothing"]
    assert values(spark, T.clean_id, texts) == ["ABC1234567", "UP/9/42/123456", "UP/9/42/123456", "UP/9/04/0324386", "JKT0104406", "ABC1234507", "", ""]


def test_houses(spark):
    texts = ["०४", "12 - A", "॥4", "S/O someone", "67 00", "मकान नं 61", "--", None, "plain", "204 2"]
    assert values(spark, T.clean_house, texts) == ["4", "12-A", "14", "", "67", "61", "--", "", "", "204/2"]
    assert values(spark, T.house_key, ["04-a", " 12-क ", None]) == ["4A", "12क", ""]
    assert values(spark, T.is_generic_house, ["0", "00000", " - ", "NA", "12", None]) == [True, True, True, True, False, True]


def test_numbers_and_order(spark):
    assert values(spark, T.leading_int, ["12x", "x12", "", " 7", "-3", None]) == [12, 0, 0, 7, -3, 0]
    assert values(spark, T.serial_number, ["1२-3", "x", None]) == [123, None, None]
    names = ["b10", "b9", "a2", "a10", "B1"]
    keys = values(spark, T.natural_key, names)
    assert [n for _, n in sorted(zip(keys, names, strict=True))] == ["a2", "a10", "B1", "b9", "b10"]
    assert values(spark, T.age_in, ["आयु : 34 लिंग", "Age: 9", "Age: 3", "Age 4l", "31 fer:", "Age: 411", "none", None]) == [34, 19, 31, 41, 31, 41, None, None]
    seconds = spark.createDataFrame([(5.0,), (5.25,), (60.0,), (125.4,), (None,), (-1.0,), (119.9,)], "s double")
    assert [r[0] for r in seconds.select(T.duration_label(F.col("s"))).collect()] == ["5 s", "5.3 s", "1 min", "2 min 5 s", "0 s", "0 s", "2 min"]


def test_names_and_kin(spark):
    assert values(spark, T.core_first_name, ["श्री राम", "राम", "", None]) == ["राम", "राम", "", ""]
    pairs = spark.createDataFrame([("श्री राम कुमार", "राम कुमार"), ("राम सेवक", "रामसेवक"), ("राजेश", "राजीव"), ("a b c", "a b"), ("", "a"), (None, "a")], "a string, b string")
    assert [r[0] for r in pairs.select(T.same_person_name(F.col("a"), F.col("b"))).collect()] == [True, True, False, True, False, False]
    kin = spark.createDataFrame([("x", "y", "पति", "y", "z", "पिता"), ("x", "f", "पिता", "w", "f", "पिता"), ("x", "f", "पति", "w", "f", "पिता"), ("x", "f", "माता", "w", "f", "पिता")], "a string, b string, c string, d string, e string, f string")
    assert [r[0] for r in kin.select(T.are_kin(*[F.col(c) for c in "abcdef"])).collect()] == [True, True, True, False]


def test_similarities(spark):
    rows = spark.createDataFrame([("abc", "abd"), ("", ""), ("a", None), ("x", "x")], "a string, b string")
    assert [round(r[0], 3) for r in rows.select(T.char_overlap(F.col("a"), F.col("b"))).collect()] == [0.667, 1.0, 0.3, 1.0]
    ages = spark.createDataFrame([(30, 30), (30, 31), (30, 40), (30, 90), (None, 1), (None, None)], "a int, b int")
    assert [round(r[0], 3) for r in ages.select(T.field_confidence(F.col("a"), F.col("b"))).collect()] == [1.0, 0.9, 0.5, 0.1, 0.3, 1.0]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcde ", max_size=12), st.text(alphabet="abcde ", max_size=12))
def test_matchers_are_symmetric_where_they_are_exact(a, b):
    assert matchers.names_match(a, a, "K", "K") or not a
    assert matchers.relations_match(a, b, "", "") == matchers.relations_match(a, b, "", "")
    assert 0 <= matchers.ratio(a, b) <= 1


def test_matcher_thresholds():
    assert matchers.first_names_match("rajesh", "rajesh", "", "") and not matchers.first_names_match("rajesh", "sunil", "RJS", "SNL")
    assert matchers.first_names_match("abc", "xyz", "KB", "KB") and not matchers.first_names_match("abc", "xyz", "K", "K")
    assert matchers.relations_match("ram kumar", "ram", "", "") and not matchers.relations_match("ram", "shyam lal", "RN", "SN LL")
