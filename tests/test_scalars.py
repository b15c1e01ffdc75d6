import pytest
from pyspark.sql import functions as F

from wattloom.functions import banding as B
from wattloom.functions import scalars as S
from wattloom.functions import scoring


@pytest.mark.parametrize(
    ("provenance", "c", "k", "want"),
    [("session", 0, 0, 0.50), ("consolidated", 0, 0, 0.75), ("verified", 1, 0, 0.75), ("verified", 3, 0, 0.83), ("verified", 4, 0, 0.86), ("verified", 4, 2, 0.67), ("nonsense", 0, 0, 0.5), ("session", -3, 0, 0.5), ("session", 10**6, 0, 0.99), ("session", 0, 10**6, 0.05), (None, 0, 0, 0.5)],
)
def test_confidence(spark, provenance, c, k, want):
    df = spark.createDataFrame([(provenance, c, k)], "p string, c long, k long")
    assert float(df.select(S.derive_confidence(F.col("p"), F.col("c"), F.col("k"))).first()[0]) == want


def test_budgets_and_tokens(spark):
    df = spark.createDataFrame([(4000, "one two  three"), (8000, ""), (0, None)], "b int, t string")
    assert [tuple(r) for r in df.select(S.effective_budget(F.col("b")), S.count_tokens(F.col("t"))).collect()] == [(3600, 3), (7200, 0), (0, 0)]


def test_keywords(spark):
    t = "Saw E-001 and GroundFailure on Terra 54 at coastal, firmware 3.1.2; then GroundFailure again"
    df = spark.createDataFrame([(t,), ("generic words",), (None,)], "t string")
    got = [r[0] for r in df.select(S.extract_keywords(F.col("t"))).collect()]
    assert got == [sorted(["E-001", "GroundFailure", "Terra 54", "coastal", "3.1.2"]), [], []]


@pytest.mark.parametrize(
    ("value", "refs"),
    [
        (None, []), ("", []), ("null", []), ("a:1", ["a:1"]), ('["a:1", ["b:2", ["c:3"]], "a:1"]', ["a:1", "b:2", "c:3"]), ('["a:1", "[\\"b:2\\"]", "[\\"c:3\\"]"]', ["a:1", "b:2", "c:3"]),
        ('"[\\"[\\\\\\"a:1\\\\\\"]\\"]"', ["a:1"]), ('["A:1", 5, null, ":x", "x:"]', []), ('{"k": "a:1"}', ["a:1"]),
    ],
)
def test_flatten(value, refs):
    assert S.flatten_one(value)[0] == refs


def test_flatten_counts():
    refs, recovered, nested, dropped, unmatched = S.flatten_one('["a:1", "[\\"b:2\\"]", "[\\"c:3\\"]"]')
    assert (refs, recovered, nested, dropped) == (["a:1", "b:2", "c:3"], 2, 0, 0)
    assert S.flatten_one('["Bad:ref here", 7]')[3:] == (2, ["Bad:ref here"])
    assert S.flatten_one('["[broken"]') == ([], 0, 0, 1, ["[broken"])  # bracketed and no JSON: reported, colon or not
    assert S.flatten_one("null") == S.flatten_one("") == ([], 0, 0, 1, [])  # one value that is no reference
    assert S.flatten_one('["\\"a:1\\""]') == ([], 0, 0, 1, ['"a:1"'])  # a quoted text is no layer
    assert S.flatten_one('[["a:1", {"k": ["b:1"]}], "[[1]]"]') == (["a:1", "b:1"], 1, 4, 1, [])
    assert S.flatten_one(None) == ([], 0, 0, 0, [])


WINDOW = "voltage_stddev double, max_temp_c double, error_count long, max_earth_leak double, status_changes long"


@pytest.mark.parametrize(
    ("row", "features", "score"),
    [
        ((2.0, 30.0, 0, 1.5, 2), {}, 0.0), ((10.0, 30.0, 0, 1.5, 2), {"voltage_instability": 0.5}, 0.125), ((50.0, 100.0, 20, 30.0, 50), {"voltage_instability": 1.0, "thermal_stress": 1.0, "error_rate": 1.0, "earth_leakage": 1.0, "status_flapping": 1.0}, 1.0),
        ((10.0, 30.0, 3, 1.0, 2), {"voltage_instability": 0.5, "error_rate": 0.6}, 0.275), ((None, None, None, None, None), {}, 0.0),
    ],
)
def test_breakdown(spark, row, features, score):
    df = spark.createDataFrame([row], WINDOW).withColumn("b", scoring.breakdown())
    got = df.select("b", scoring.score_of_breakdown(F.col("b"))).first()
    assert (got[0], got[1]) == (features, score)


def test_stream_score_is_not_clamped_by_term(spark):
    df = spark.createDataFrame([(20.0, 30.0, 0, 1.0, 2)], WINDOW).withColumn("b", scoring.breakdown())
    assert tuple(df.select(scoring.stream_score(), scoring.score_of_breakdown(F.col("b"))).first()) == (0.375, 0.25)


def test_bands_of_nulls(spark):
    df = spark.createDataFrame([(None,)], "x double")
    got = df.select(B.band_power("x", "x"), B.band_temperature("x"), B.band_fan("x", "x"), B.band_connectivity("x"), B.band_errors("x")).first()
    assert tuple(got) == ("power: none", "temperature: cool", "fan: idle", None, "errors: none")


def test_adjudicated(spark):
    df = spark.createDataFrame([('[{"ref":"a:1","outcome":"fixed","at":"x"},{"outcome":"y"}]',), ("oops",), (None,)], "t string")
    assert [len(r[0]) for r in df.select(S.adjudicated(F.col("t"))).collect()] == [1, 0, 0]
