import pytest
from pyspark.sql import functions as F

from amalgam.functions import text as T
from amalgam.functions.similarity import indel_ratio, jaro_winkler


def values(spark, rows, expr, type_="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {type_}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(("dayfirst", "rows", "wanted"), [
    (True, ["11/04/1988", "1988-04-11", "1988/04/11", "11-Apr-1988", "04/11/1988", "31/02/1988", "25/03/1955 10:20", "Apr 11 1988", "11 apr 1988", "13/25/1990", "x", None], ["1988-04-11", "1988-04-11", "1988-04-11", "1988-04-11", "1988-11-04", None, "1955-03-25", "1988-04-11", "1988-04-11", None, None, None]),
    (False, ["04/11/1988", "25/03/1955"], ["1988-04-11", "1955-03-25"]),
])
def test_dates(spark, dayfirst, rows, wanted):
    assert values(spark, rows, lambda c: T.normalize_date(c, dayfirst)) == wanted


def test_soundex_and_names(spark):
    assert values(spark, ["mamat", "maamat", "mmamat", "mmt", "mamt", "mmat"], T.soundex) == ["M530"] * 6
    assert values(spark, ["tymczak", "pfister", "lloyd", "lee", "o'hara", None, ""], T.soundex) == ["T520", "P123", "L430", "L000", "O600", None, None]
    assert values(spark, ["3ka", "  ANNA  b ", "ﬁona", "", None], T.normalize_person_name) == ["eka", "anna b", "fiona", None, None]
    assert values(spark, ["Jl. Merdeka no. 3", "É–é", "!!"], T.normalize_text) == ["jl merdeka no 3", "é é", None]


def test_phones_and_devices(spark):
    assert values(spark, ["001-449.977.1729x282", "+62 8123 0000001", "0812 33", "x12", None], T.normalize_phone) == ["14499771729", "6281230000001", "81233", None, None]
    assert values(spark, ["A b;c|,D ", ";", None], T.normalize_device_ids) == [["ab", "c", "d"], None, None]
    assert values(spark, [" A@B.Com ", "", None], T.normalize_email) == ["a@b.com", None, None]


def test_labels_keys_scores(spark):
    assert values(spark, ["match", "no_match", "0", "bukan", "", None, "Beda Orang"], T.label_of) == ["match", "no_match", "no_match", None, None, None, "no_match"]
    assert values(spark, ["5.0", "7", "ab", None], T.key_text) == ["5", "7", "ab", None]
    assert values(spark, ["a1#", "abc"], lambda c: T.corruption_score(c, "master_first_name_std")) == [3, 0]


def test_similarities():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert jaro_winkler("abc", "xyz") == 0 and jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1
    assert indel_ratio("abcd", "abcd") == 100 and indel_ratio("abc", "xyz") == 0
    assert indel_ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)


def test_shapes(spark):
    from amalgam.operators.profile import shape_findings, shape_report, validate

    df = spark.createDataFrame([("a@b.com", "449.977.1729x282", "11/04/1988"), ("budi@", "N/A", "not a date"), ("", "", ""), (None, None, None), ("  ", "021-abc", "25/03/1955")], "email string, phone string, dob string")
    rows = {r.field: r.asDict() for r in shape_report(df).collect()}
    assert (rows["email"]["non_blank"], rows["email"]["blank"], rows["email"]["unshaped"]) == (2, 3, 1)
    assert rows["phone"]["unshaped"] == 1 and (rows["dob"]["non_blank"], rows["dob"]["unshaped"]) == (3, 1)
    assert shape_findings([{"field": "email", "non_blank": 2, "unshaped": 2}], 1)[0] == ["email: no value has its shape", "customer_pk: duplicated values"]
    assert validate(df)["status"] == "rejected"
