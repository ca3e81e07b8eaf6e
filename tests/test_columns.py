from pyspark.sql import functions as F

from finquarry.functions import columns as C


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_scores_and_weights(spark):
    assert one(spark, C.score_between(45, 90, 40)) == 90
    assert one(spark, C.score_between(120, 90, 40)) == 0
    assert one(spark, C.score_between(5, 3, 3)) is None
    assert one(spark, C.score_between(F.lit(None).cast("double"), 0, 10)) is None
    assert one(spark, C.weighted_score([(F.lit(None).cast("double"), 0.5), (80, 0.25)])) == 80
    assert one(spark, C.weighted_score([(F.lit(None).cast("double"), 0.5)])) is None


def test_growth_and_ladders(spark):
    assert round(one(spark, C.cagr(100, 121, 2)), 6) == 10
    assert one(spark, C.cagr(-1, 121, 2)) is None
    assert [one(spark, C.grade(s)) for s in (88, 79.9, 73, 39)] == ["A+", "B+", "B+", "F"]
    assert one(spark, C.grade(F.lit(None).cast("double"))) is None
    assert [one(spark, C.band(s)) for s in (75, 44, 10)] == ["Strong", "Weak", "Poor"]
    assert [one(spark, C.snap_to_dividend_frequency(g)) for g in (365, 91, 30, 182, 60)] == [1, 4, 12, 2, 6]
    assert one(spark, C.annualise(21.0, 2.0)) is not None and one(spark, C.annualise(21.0, 0.5)) is None


def test_wrapped_numbers_and_reits(spark):
    for text, want in (("5", 5.0), ('{"raw": 7.5, "fmt": "7.5"}', 7.5), ("{}", None), ("NaN", None), ("x", None), (None, None)):
        assert one(spark, C.unwrap_num(F.lit(text).cast("string"))) == want
    assert one(spark, C.is_reit(F.lit("REIT - Retail"))) and not one(spark, C.is_reit(F.lit(None).cast("string")))
    assert one(spark, C.is_reit_word(F.lit("  reit retail"))) and not one(spark, C.is_reit_word(F.lit("REITS")))
