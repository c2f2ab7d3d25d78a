"""Golden cases of the text functions, as Columns and as kernels."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import kernels as K
from quillspark.functions import text as X

MONEY = [("22.60", 22.6), ("22-60", 22.6), ("7 - 40", 7.4), ("1,28", 1.28), ("2=50", 2.5), ("RM 60.31", 60.31), ("1,234.56", 1234.56), ("3O.OO", 30.0), ("Z1.32", 21.32), ("226", 226.0), ("22.6", 22.6), ("-0.01", 0.01), ("", None), ("abc", None), (None, None), (".50", 0.5)]
DATES = [("Tarikh: 14/03/2024", "2024-03-14"), ("Rabu, 10-05-2017", "2017-05-10"), ("12 Disember 2023", "2023-12-12"), ("5 Ogos 2021", "2021-08-05"), ("3 Mac 2020", "2020-03-03"), ("03/25/2024", "2024-03-25"), ("28-FEB-2018", "2018-02-28"), ("March 5, 2019", "2019-03-05"), ("99/99/2020 5 Mei 21", "2021-05-05"), ("31/02/2024", "2024-02-31"), ("none", None)]
TIMES = [("Masa: 10:25 pagi", "10:25"), ("Masa: 7:30 malam", "19:30"), ("Tiae 21;51", "21:51"), ("12:05 am", "00:05"), ("x", None)]
KEYS = [("Café  Ñandú!", "cafe nandu"), (None, ""), ("A b-C", "a b c"), ("...", "")]
GRAPHIC = [("| PASAR MINI | |", "PASAR MINI"), ("LOT 1851-A & 1851-B", "LOT 1851-A & 1851-B"), ("|,| ——.", "|,|"), ("——.", ""), ("AEON (M) BHD", "AEON (M) BHD"), ("", ""), (None, None)]
LANGUAGES = [("jumlah tunai baki cukai tarikh resit", "ms"), ("total cash change tax date time", "en"), ("jumlah tunai baki cukai total cash change", "mixed"), ("", "unknown"), (None, "unknown")]


@pytest.mark.parametrize(("f", "kernel", "cases"), [
    (X.parse_money, K.money, MONEY), (X.normalize_date, lambda s: (K.date(s) or [None])[0], DATES), (X.normalize_time, lambda s: (K.clock(s) or [None])[0], TIMES),
    (X.normalize_key, K.key, KEYS), (X.strip_graphic_noise, K.without_graphics, GRAPHIC), (X.detect_language, None, LANGUAGES),
])
def test_columns_and_kernels(spark, f, kernel, cases):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, a string")
    got = {r.k: r.v for r in df.select("k", f(F.col("a")).alias("v")).collect()}
    assert got == {k: w for k, (_, w) in enumerate(cases)}
    if kernel:
        assert [kernel(a) for a, _ in cases] == [w for _, w in cases]


def test_amounts_of_a_line(spark):
    cases = [("Rabu, 10-05-2017 Time 21:51", []), ("1.00 X 21.32   21.32", [1.0, 21.32, 21.32]), ("2 180.00", [2180.0]), ("tel 012-3456789 5.00", [5.0])]
    df = spark.createDataFrame([(a,) for a, _ in cases], "a string")
    assert [r.v for r in df.select(X.money_values(F.col("a")).alias("v")).collect()] == [w for _, w in cases]
    assert [[v for v, *_ in K.amounts(a)] for a, _ in cases] == [w for _, w in cases]
    assert K.amounts("😀 5.00") == [(5.0, 2, 6)]


def test_only_the_first_occurrence_counts(spark):
    df = spark.createDataFrame([("xab ab",), ("cd ab",), ("(ab)",), ("",)], "a string")
    assert [r[0] for r in df.select(X.contains_any(F.col("a"), ["ab", "cd"])).collect()] == [None, "ab", "ab", None]


def test_lines_keep_their_offsets(spark):
    df = spark.createDataFrame([("a\n😀c\n",)], "a string")
    assert [tuple(x) for x in df.select(X.lines_of(F.col("a")).alias("v")).first().v] == [("a", 0), ("😀c", 2), ("", 5)]


TEXT = "PERNIAGAAN\nTOTAL 22-60\nCASH 30.00\nInv R000039737"


def test_locate():
    assert TEXT[slice(*K.locate(TEXT, "30.00"))] == "30.00"
    assert TEXT[slice(*K.locate(TEXT, "22.60"))] == "22-60"
    assert "3973" in TEXT[slice(*K.locate(TEXT, "R00039737"))]
    assert K.locate(TEXT, "unrelated thing") is None and K.locate(TEXT, "") is None and K.locate(None, "x") is None


def test_similarity():
    assert K.similarity("Café", "cafe") == 1.0 and K.similarity("", "x") == 0.0
    address = "No 88, Jalan Tuanku Abdul Rahman, 50100 Kuala Lumpur"
    assert K.similarity("Kuala Lumpor", address) < 0.5 < 0.9 < K.partial_similarity("Kuala Lumpor", address)


@pytest.mark.parametrize(("reply", "found"), [
    ('{"a":1}', {"a": 1}), ('```json\n{"a":1}\n```', {"a": 1}), ('{"a":1} and more', {"a": 1}), ('{"a":1,}', {"a": 1}), ("{'a': None}", {"a": None}), ("garbage", None), (None, None),
    ('{"u": 54.40 / 3, "b": 1}', {"u": 18.13, "b": 1}), ('{"u": 5 / 0}', {"u": None}), ('{"m":"A","t":1.5,"items":[{"name":"B","t":2', {"m": "A", "t": 1.5, "name": "B", "t": 1.5, "_partial": True}),
    ('{"u": 5 * -2}', {"u": -10.0}), ('{"a": "say \\"hi\\"", "n": 12, "b": [', {"a": 'say "hi"', "n": 12, "_partial": True}), ('{"a": None, "b": true}', {"a": None, "b": True}), ("[1]", None),
])
def test_parse_json(reply, found):
    assert K.parse_json(reply) == found
