"""User code that fails in a row without failing the job."""

import pytest
from pyspark.sql import functions as F

from docquery.functions import text as tx
from docquery.functions.scripts import script
from docquery.operators import aggregations as a, predicates as p, relevance as r, vectors as v

ROWS = [(1, "a", 2.0, 0.0, {"x": "3"}), (2, "12", 9.0, 3.0, {"x": "n/a"}), (3, None, None, 1.0, None)]


def each(spark, *codes):
    df = spark.createDataFrame(ROWS, "id int, t string, a double, b double, s struct<x: string>")
    found = df.orderBy("id").select(*[script(c).alias(f"c{i}") for i, c in enumerate(codes)]).collect()
    return [[row[i] for row in found] for i in range(len(codes))]


def test_what_fails_is_null(spark):
    got = each(spark, "a / b", "t + 1", "s.x * 2", "log(b - 1)", "sqrt(0 - a)", "a % b", "10 ** 400", "toFloat64(t)", "div(a, b)", "a / b if b > 0 else 7", "-a")
    assert got[:3] == [[None, 3.0, None], [None, 13.0, None], [6.0, None, None]]
    assert got[3][0] is None and got[3][1] == pytest.approx(0.6931471805599453) and got[3][2] is None
    assert got[4:] == [[None, None, None], [None, 0.0, None], [None] * 3, [0.0, 12.0, 0.0], [0.0, 3.0, 0.0], [7.0, 3.0, None], [-2.0, -9.0, None]]


def test_conditions_and_spellings(spark):
    got = each(spark, "a / b > 1 OR t = 'a'", "NOT (a <> 2)", "t in ('a', '12') and 1 < a <= 9", "t is null", "a IS NOT NULL", "'x = y' == 'x = y'", "levenshtein(t, '21')", "t == 12", "seconds(toTime(t)) < 0")
    assert got[:6] == [[True, True, None], [True, False, None], [True, True, None], [False, False, True], [True, True, False], [True] * 3]
    assert got[6:8] == [[2.0, 1.0, None], [None, True, None]] and got[8][0] is True


@pytest.mark.parametrize("code", ["a +", "__import__('os')", "a[0]", "f(1)", "lambda: 1", "(x for x in a)", "a is 3", "log(1, 2)"])
def test_other_code_is_refused(code):
    with pytest.raises(ValueError):
        script(code)


def test_errors_are_false_skipped_or_zero(spark):
    df = spark.createDataFrame(ROWS, "id int, t string, a double, b double, s struct<x: string>")
    assert [x.id for x in df.where(p.expression("a / b > 1").match).collect()] == [2] and df.where(p.negation(p.expression("1 / (b - b) > 1")).match).count() == 3
    assert df.where(p.expression("'\"true\"'").match).count() == 3 and df.where(p.expression("t + 1 > 0").match).count() == 1
    assert df.agg(a.scripted("a / b", "avg", "x", 1), a.scripted("t", "count", "y"), a.scripted("log(0)", "sum", "z", 5)).first()[:] == (4.0, 1.0, 5.0)
    buckets = spark.createDataFrame([(1, 6.0, 0.0), (2, 6.0, 3.0)], "n int, q double, z double")
    out = a.bucket_scripts(buckets, ("each", "n / z", {"n": "q", "z": "z"}), ("n", "e + 1", {"e": "each"})).orderBy("z")
    assert [tuple(x) for x in out.collect()] == [(1.0, 6.0, 0.0, 0.0), (3.0, 6.0, 3.0, 2.0)]  # a variable may have a column's name
    scored = df.orderBy("id").select(r.modified(F.lit(2.0), [("a / b", 2.0), ("toFloat64(b)", 1.0)]).alias("s"))
    assert [x.s for x in scored.collect()] == [0.0, 36.0, 2.0]


def test_values_that_are_no_numbers(spark):
    df = spark.createDataFrame([("1", [("2",), ("x",)]), ("x", [(None,)]), (None, None), ("30", [])], "n string, l array<struct<v: string>>")
    assert [tuple(x) for x in a.ranges(df, "n", [("low", 0, 10), ("high", 10, 0)]).collect()] == [("low", 1), ("high", 1)]
    assert a.nested_metric(df.withColumn("k", F.lit(1)), ["k"], "l", "v", "avg", "m").first().m == 2.0
    assert a.facets(spark.createDataFrame([("a",), ("a\t",), ("\n a",)], "f string"), ["f"]).collect()[0][1:] == ("a", 3)
    vectors = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [0.0]), (4, [3.0, 4.0])], "id int, v array<double>")
    assert [tuple(x) for x in v.nearest(vectors, "id", "v", [0.0, 0.0], 3).collect()] == [(4, 5.0)]


def test_distance_with_swaps_as_a_column(spark):
    words = ["", "a", "ab", "ba", "ca", "abc", "acb", "kitten", "sitting", "çé", "éç"]
    df = spark.createDataFrame([(x, y) for x in words for y in words] + [(None, "a")], "x string, y string")
    got = {(q.x, q.y): q.d for q in df.select("x", "y", tx.osa_column(F.col("x"), F.col("y")).alias("d")).collect()}
    assert got.pop((None, "a")) is None and got == {(x, y): tx.osa_distance(x, y) for x in words for y in words}
