import pytest
from pyspark.sql import functions as F

from weftline.operators import checks


def test_keys_and_sets(spark):
    df = spark.createDataFrame([(["b", "a", "x"],), (None,), ([],)], "k array<string>")
    got = [tuple(r) for r in df.select(checks.unknown_keys(F.col("k"), ["a"]), checks.missing_keys(F.col("k"), ["a", "c"])).collect()]
    assert got == [(["b", "x"], ["c"]), ([], ["a", "c"]), ([], ["a", "c"])]
    r = spark.range(1).select(checks.same_set(F.array(F.lit(1), F.lit(2), F.lit(1)), F.array(F.lit(2), F.lit(1))), checks.same_set(F.array(F.lit(1)), F.array(F.lit(2)))).first()
    assert tuple(r) == (True, False)


def test_rules_and_numbers(spark):
    df = spark.createDataFrame([("5", 1), ("true", 2), ("1.0", None), (" -3 ", 4), (None, 5)], "t string, n int")
    assert [r[0] for r in df.select(checks.whole_number(F.col("t"), -5)).collect()] == [5, None, None, -3, None]
    assert [r[0] for r in df.select(checks.violations({"big": F.col("n") > 3, "odd": F.col("n") % 2 == 1})).collect()] == [["odd"], [], [], ["big"], ["big", "odd"]]
    with pytest.raises(Exception, match="n is 5"):
        checks.required(df, F.col("n") == 5, F.concat(F.lit("n is "), F.col("n").cast("string"))).collect()


def test_agreement(spark, rows):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "k int, v string, w int")
    b = spark.createDataFrame([(1, "x", None), (2, "q", 2), (4, "z", 1)], "k int, v string, w int")
    assert rows(checks.agreement(a, b, ["k"], ["v", "w"])) == [(1, "both", []), (2, "both", ["v", "w"]), (3, "left", []), (4, "right", [])]


def test_secrets(spark):
    df = spark.createDataFrame([("a secret here",), ("fine",), (None,)], "text string")
    assert checks.holding_secrets(df, ["secret", " "]).count() == 1 and checks.holding_secrets(df, []).count() == 0


def test_parameter_count(spark):
    got = spark.range(1).select(checks.parameter_count(F.lit(3), F.lit(64), F.lit(256), F.lit(1000))).first()[0]
    assert int(got) == 3 * (4 * 64 * 64 + 2 * 64 * 256 + 2 * 64) + 64 + 1000 * 64
