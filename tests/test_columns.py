import math

from pyspark.sql import functions as F

from cohortloom.functions.columns import (
    coalesce_columns,
    flag_labels,
    if_else,
    least_or_null,
    parse_number,
    select_containing,
    tidy_round,
)
from cohortloom.functions.stats import two_sided_p


def test_branch_with_unknown_condition_is_null(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    result = df.select(if_else(F.col("c"), F.lit(1), F.lit(2)).alias("x")).collect()
    assert [r.x for r in result] == [1, 2, None]


def test_least_or_null(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (3, None)], "a int, b int")
    assert [r.x for r in df.select(least_or_null(F.col("a"), F.col("b")).alias("x")).collect()] == [1, None, None]


def test_coalesce_of_like_and_unlike_types(spark):
    df = spark.createDataFrame([(None, "x", 5), (1, "y", None)], "a int, b string, c int")
    like = df.select(coalesce_columns(df, ["a", "c"]).alias("r"))
    unlike = df.select(coalesce_columns(df, ["a", "b"]).alias("r"))
    assert like.dtypes == [("r", "int")] and [r.r for r in like.collect()] == [5, 1]
    assert unlike.dtypes == [("r", "string")] and [r.r for r in unlike.collect()] == ["x", "1"]


def test_flag_labels_and_parse_number(spark):
    df = spark.createDataFrame([(True, False), (None, True)], "in_cycle_1 boolean, in_cycle_2 boolean")
    assert [tuple(r) for r in df.select(*flag_labels(df, "in_", "in_cycle_")).collect()] == [("1", None), (None, "2")]
    texts = spark.createDataFrame([("2",), ("cycle 3 of 4",), ("1,234.5",), ("-7",), ("none",), (None,)], "t string")
    assert [r.n for r in texts.select(parse_number(F.col("t")).alias("n")).collect()] == [2.0, 3.0, 1234.5, -7.0, None, None]


def test_select_containing_ignores_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Event_a int, other int, time_b int")
    assert select_containing(df, "event", "TIME").columns == ["Event_a", "time_b"]


def test_tidy_round_has_no_negative_zero(spark):
    value = spark.createDataFrame([(-1e-12,)], "x double").select(tidy_round(F.col("x")).alias("x")).collect()[0].x
    assert math.copysign(1, value) == 1


def test_two_sided_p_matches_erfc(spark):
    zs = [0.0, 1e-9, 0.3, 1.0, 1.96, -2.5, 2.82, 2.83, 4.0, 8.0, 30.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").select(two_sided_p(F.col("z")).alias("p"))
    for z, row in zip(zs, df.collect()):
        exact = math.erfc(abs(z) / math.sqrt(2))
        assert abs(row.p - exact) < 1e-9 * exact
