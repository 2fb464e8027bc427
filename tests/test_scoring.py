"""Band edges and gaps, references, extensions, periods and phonetic keys."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wardline.functions import phonetic
from wardline.functions import scoring as S

RR, SPO2, HR, SBP, TEMP = "9279-1", "59408-5", "8867-4", "8480-6", "8310-5"
CASES = [
    (RR, "8", 3), (RR, "8.5", 0), (RR, "9", 1), (RR, "11", 1), (RR, "11.5", 0), (RR, "12", 0), (RR, "20", 0),
    (RR, "20.5", 0), (RR, "21", 2), (RR, "24", 2), (RR, "24.5", 0), (RR, "25", 3),
    (SPO2, "91", 3), (SPO2, "91.5", 0), (SPO2, "92", 2), (SPO2, "93", 2), (SPO2, "93.5", 0), (SPO2, "94", 1),
    (SPO2, "95", 1), (SPO2, "95.5", 0), (SPO2, "96", 0),
    (HR, "40", 3), (HR, "40.5", 0), (HR, "41", 1), (HR, "50", 1), (HR, "50.5", 0), (HR, "51", 0), (HR, "90", 0),
    (HR, "90.5", 0), (HR, "91", 1), (HR, "110", 1), (HR, "110.5", 0), (HR, "111", 2), (HR, "130", 2),
    (HR, "130.5", 0), (HR, "131", 3),
    (SBP, "90", 3), (SBP, "90.5", 0), (SBP, "91", 2), (SBP, "100", 2), (SBP, "100.5", 0), (SBP, "101", 1),
    (SBP, "110", 1), (SBP, "110.5", 0), (SBP, "111", 0), (SBP, "219", 0), (SBP, "219.5", 0), (SBP, "220", 3),
    (TEMP, "35", 3), (TEMP, "35.004", 0), (TEMP, "35.05", 0), (TEMP, "35.1", 1), (TEMP, "36", 1), (TEMP, "36.1", 0), (TEMP, "36.2", 0),
    (TEMP, "38", 0), (TEMP, "38.1", 0), (TEMP, "38.2", 1), (TEMP, "39", 1), (TEMP, "39.1", 0), (TEMP, "39.2", 2),
    (HR, None, 0), (None, "200", 0), ("0000-0", "200", 0),
]


def test_score_edges_and_gaps(spark):
    rows = [(k, code, None if v is None else Decimal(v), n) for k, (code, v, n) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k int, code string, value decimal(18,6), points int")
    wrong = df.where(S.news2_score(F.col("code"), F.col("value")) != F.col("points")).collect()
    assert wrong == []


def test_patient_id(spark):
    df = spark.createDataFrame([("Patient/7",), ("Group/7",), (None,), ("patient/7",)], "r string")
    assert [r[0] for r in df.select(S.patient_id(F.col("r"))).collect()] == ["7", None, None, None]


EXT = "struct<url: string, valueInteger: int, valueString: string, extension: array<struct<url: string, valueString: string>>>"


def test_extensions(spark):
    rows = [
        (1, [("http://news2-score", 4, None, None)]),
        (2, [("other", 1, None, None)]),
        (3, None),
        (4, [("http://patient-location", None, None, [("block", "East")]), ("http://news2-score", None, None, None)]),
    ]
    df = spark.createDataFrame(rows, f"k int, e array<{EXT}>")
    changed = df.select("k", S.set_extension(F.col("e"), S.SCORE_URL, "valueInteger", F.lit(9), EXT).alias("e"))
    got = {r["k"]: [(e["url"], e["valueInteger"]) for e in r["e"]] for r in changed.collect()}
    assert got[1] == [("http://news2-score", 9)]
    assert got[2] == [("other", 1), ("http://news2-score", 9)]
    assert got[3] == [("http://news2-score", 9)]
    assert got[4] == [("http://patient-location", None), ("http://news2-score", 9)]
    blocks = {r[0]: r[1] for r in df.select("k", S.block_of(F.col("e"))).collect()}
    assert blocks == {1: None, 2: None, 3: None, 4: "East"}
    scores = df.select("k", S.extract_score(F.col("e"), F.lit(None).cast("int"), F.lit(Decimal("-2.7"))))
    assert {r[0]: r[1] for r in scores.collect()} == {1: 4, 2: -2, 3: -2, 4: -2}


def test_first_code(spark):
    df = spark.sql("SELECT named_struct('coding', array(named_struct('code', 'a'), named_struct('code', 'b'))) AS c UNION ALL SELECT named_struct('coding', cast(array() as array<struct<code: string>>))")
    assert [r[0] for r in df.select(S.first_code(F.col("c"))).collect()] == ["a", None]


def test_partial_dates(spark):
    df = spark.createDataFrame([("2014",), ("2014-02",), ("2014-02-28",)], "d string")
    got = df.select(S.date_low(F.col("d")).cast("string"), S.date_high(F.col("d")).cast("string")).collect()
    assert [tuple(r) for r in got] == [("2014-01-01", "2015-01-01"), ("2014-02-01", "2014-03-01"), ("2014-02-28", "2014-03-01")]


@pytest.mark.parametrize(
    ("name", "key"),
    [("Müller-Lüdenscheidt", "65752682"), ("Wikipedia", "3412"), ("Breschnew", "17863"), ("Müller", "657"), ("Heinz Classen", "068586"), ("", "")],
)
def test_cologne(name, key):
    assert phonetic.cologne(name) == key


def test_phonetic_columns(spark):
    df = spark.createDataFrame([("Meyer",), (None,), ("Maier",)], "n string")
    rows = df.select(phonetic.cologne_phonetic("n"), phonetic.soundex(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("67", "M600"), (None, None), ("67", "M600")]
