"""Cases in which results were wrong or calls failed once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docquery.functions import fields as fx, text as tx
from docquery.operators import aggregations as a, carbon as c, entities as e, joins, predicates as p, relevance as r, vectors as v
from docquery.sources import documents as src
from docquery.streaming import jobs as streams


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_index_loses_emptied_partitions_and_deleted_keys(spark, tmp_path):
    schema, place = "id int, k string, gone boolean", {n: str(tmp_path / n) for n in ("in", "out", "state")}
    for batch in ([(1, "a", False), (3, "b", False), (4, "c", False), (5, None, False)], [(1, "b", False), (4, None, True)], [(1, "b", False)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(place["in"])
        streams.index_changes(spark.readStream.schema(schema).parquet(place["in"]), place["out"], place["state"], "id", "k", deleted="gone")
    assert rows_of(e.read_index(spark, place["out"]), "id", F.col("k").cast("string")) == [(1, "b"), (3, "b")]
    index = src.Index(place["out"], ("k",))
    spark.read.parquet(place["out"]).withColumnRenamed("k", "composite_key").write.partitionBy("composite_key").parquet(str(tmp_path / "named"))
    assert src.scan(spark, {"n": src.Index(str(tmp_path / "named"), index.fields)}, "n", {"k": "a"}).count() == 0


def test_outage_of_the_primary_falls_back(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    regions = spark.createDataFrame([("norway",), ("mars",)], "region string")
    primary = spark.createDataFrame([("norway", at(1), 5.0)], "region string, ts timestamp, rating double")
    spare = spark.createDataFrame([("NO", at(6), 7.0)], "zone string, ts timestamp, rating double")
    got = rows_of(c.interval_report(regions, primary, spare), F.minute("start_date"), "region", "rating")
    assert got == [(0, "mars", 0.0), (0, "norway", 5.0), (5, "mars", 0.0), (5, "norway", 7.0)]


def test_messy_values_are_skipped_and_keys_trimmed(spark):
    df = spark.createDataFrame([(" x", "1", ["a", "b"]), ("x", "n/a", ["b", None]), ("x \t", None, None), ("y", "2.5", [])], "k string, n string, l array<string>")
    m = a.terms(df, ["k"], a.metric("sum", "n", "s"), a.metric("count", "n", "c"), a.metric("nothing", "n", "no"), a.metric("cardinality", "n", "d", nulls=True))
    assert rows_of(m, *m.columns) == [("x", 3, 1.0, 1, 3.0), ("y", 1, 2.5, 1, 1.0)]
    assert rows_of(a.cardinality(df, ["k"], "l", "n"), "k", "n") == [("x", 3.0), ("y", 0.0)]
    assert rows_of(a.cardinality(df, [], "l", "n"), "n") == [(3.0,)]
    assert df.limit(0).agg(a.metric("cardinality", "n", "d", nulls=True)).first()[0] == 0


def test_trees_of_three_levels(spark):
    kind = "array<struct<v: string, c: array<struct<v: string, c: array<struct<v: string>>>>>>"
    df = spark.createDataFrame([([("r", [("s", [("t",), ("u",)]), ("w", [])]), ("x", None)],), (None,)], f"a {kind}")
    depth = e.depth_of(df.schema["a"].dataType, "c")
    got = df.select(e.leaves(F.col("a"), "c", depth).alias("l")).collect()
    assert depth == 2 and [x.v for x in got[0].l] == ["t", "u", "w", "x"] and got[1].l is None


def test_nearest_takes_any_key_and_skips_broken_vectors(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [None, 1.0]), ("f", [1.0]), (None, [1.0, 1.0])], "id string, x array<double>")
    got = rows_of(v.nearest_of_each(df, df, "id", "x", 2, "euclidean"), "query", "rank", "id")
    assert got == [("a", 1, "a"), ("a", 2, "b"), ("b", 1, "a"), ("b", 2, "b"), ("c", 1, "c"), ("c", 2, "a")]


def test_own_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, 7), (2, 8)], "k int, _key int")
    assert rows_of(joins.with_flag(df, "in", "k", df.where("k = 1"), "k"), "k", "_key", "in") == [(1, 7, True), (2, 8, False)]
    assert rows_of(joins.in_subquery(df, "k", df.where("k = 1"), "k"), "k") == [(1,)]
    named = spark.createDataFrame([("q", 1.0)], "_i string, x double")
    assert a.ranges(named, "x", [("all", 0, 0)]).first()["count"] == 1


def test_as_of_carries_values_over_buckets(spark):
    left = spark.createDataFrame([("a", t) for t in range(0, 100, 7)] + [("b", 5), (None, 3), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 10, 1), ("a", 11, 2), ("a", 11, 3), ("a", 60, 4), (None, 1, 9), ("c", 1, 9)], "k string, t int, v int")
    want = [(k, t, max(((r.t, r.v) for r in right.collect() if r.k == k and k and t is not None and r.t <= t), default=(0, None))[1]) for k, t in (tuple(x) for x in left.collect())]
    for bucket in (1, 20, 1000):
        assert rows_of(joins.as_of(left, right, "k", "t", "t", ["v"], bucket), "k", "t", "v") == sorted(want, key=str)


def test_cases_and_times(spark):
    df = spark.createDataFrame([(1,), (5,)], "x int")
    assert rows_of(df.where(p.case(filter=p.equal(F.col("x"), 1), bool=p.equal(F.col("x"), 5)).filter), "x") == [(5,)]
    assert df.where(p.case().filter).count() == 2
    zero = spark.createDataFrame([("x",), (None,)], "t string").select(fx.to_time(F.col("t")).cast("string").alias("t"))
    assert {r.t for r in zero.collect()} == {"0001-01-01 00:00:00"}


def test_hashed_grams_are_as_many_as_grams(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", "c"],), (["a"],), ([],), (["a", "b"],)], "t array<string>")
    got = df.select(F.size(tx.gram_hashes(F.col("t"))).alias("h"), F.size(tx.ngrams(F.col("t"))).alias("n")).collect()
    assert all(r.h == r.n for r in got)


def test_late_rows_are_counted(spark, tmp_path):
    at, counts = (lambda m: dt.datetime(2024, 1, 1, 0, m)), []
    for i, batch in enumerate(([("r", at(50), 1.0)], [("r", at(1), 2.0), ("r", at(59), 3.0)])):
        spark.createDataFrame(batch, "region string, ts timestamp, rating double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        df = spark.readStream.schema("region string, ts timestamp, rating double").parquet(str(tmp_path / "in"))
        streams.run_available(streams.interval_ratings(df, "1 minute"), str(tmp_path / "out"), str(tmp_path / "state"), on_late=counts.append)
    assert counts == [0, 1]


def test_contracts_of_nested_items_choices_and_references(spark):
    contract = {
        "type": "object",
        "definitions": {"tag": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 2}}}},
        "properties": {
            "tags": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"$ref": "#/definitions/tag"}},
            "size": {"enum": [1, 2.5, None, True, "1"]},
            "a.b 'c'": {"type": ["integer", "null"], "multipleOf": 3},
            "id": {"anyOf": [{"type": "string"}, {"type": "integer", "exclusiveMinimum": 10}]},
            "one": {"oneOf": [{"minimum": 5}, {"maximum": 7}]},
            "never": {"not": {"type": "string"}},
        },
        "additionalProperties": {"type": "number"},
    }
    good = ['{"tags": [{"name": "ab"}, {"name": "cd"}], "size": 2.50, "a.b \'c\'": 9, "id": "x", "one": 4, "never": 1, "other": 0.5}', '{"size": null, "a.b \'c\'": null, "id": 11, "one": 8}', '{"size": true}', "{}", '{"size": "1"}']
    bad = {
        '{"tags": [{"name": "ab"}, {"name": "x"}, {}]}': {"$.tags[].name breaks minLength", "$.tags[].name is required"},
        '{"tags": [3]}': {"$.tags[] is no object"},
        '{"tags": [{"name": "ab"}, {"name": "ab"}]}': {"$.tags has equal items"},
        '{"tags": []}': {"$.tags breaks minItems"},
        '{"size": "2.5"}': {"$.size is none of the values"},
        '{"size": false}': {"$.size is none of the values"},
        '{"a.b \'c\'": 4}': {"$.a.b 'c' breaks multipleOf"},
        '{"a.b \'c\'": "z"}': {"$.a.b 'c' is no integer or null"},
        '{"id": 10}': {"$.id fits none of the choices"},
        '{"one": 6}': {"$.one does not fit one of the choices alone"},
        '{"never": "x"}': {"$.never fits what it must not"},
        '{"other": "x"}': {"$.* is no number"},
        "[1]": {"$ is no object"},
    }
    docs = spark.createDataFrame([(x,) for x in [*good, *bad]], "t string")
    found = {r[0]: set(r[1]) for r in docs.select("t", e.contract_errors(F.parse_json("t"), contract)).collect()}
    assert found == {**dict.fromkeys(good, set()), **bad}
    assert docs.limit(1).select(e.contract_errors(F.lit(None).cast("variant"), contract)).first()[0] == []
    with pytest.raises(ValueError):
        e.contract_errors(F.parse_json("t"), {"definitions": {"n": {"items": {"$ref": "#/definitions/n"}}}, "$ref": "#/definitions/n"})


def test_filter_before_analysis_loses_no_match(spark):
    texts = ["At't-Ion THANEDBLE", "at'tion's thaned'ble", "attion", "x at's'tion, thanedble's", "attions thanedble", "", None, "thanedble attion"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = F.coalesce(tx.analysed_phrase(F.col("t"), stem=False), F.array())
    for every in (True, False):
        holds = F.array_contains(words, "attion") & F.array_contains(words, "thanedble") if every else F.arrays_overlap(words, F.array(F.lit("attion"), F.lit("thanedble")))
        got = df.select(holds.alias("a"), F.coalesce(r.could_hold(F.col("t"), ["attion", "thanedble"], every), F.lit(False)).alias("b")).collect()
        assert any(x.a for x in got) and all(x.b or not x.a for x in got) and not all(x.b for x in got)
