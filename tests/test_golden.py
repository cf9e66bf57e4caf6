"""Small frames with results worked out by hand, and plain twins of what SQL cannot express."""

import datetime as dt
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docquery.functions import fields as fx, geo, text as tx
from docquery.operators import aggregations as a, carbon as c, entities as e, joins, predicates as p, relevance as r, search as s, vectors as v
from docquery.sources import documents as src
from docquery.streaming import jobs as streams


def values(df, column):
    return [x[0] for x in df.select(column).collect()]


def test_missing_is_false_for_every_operation(spark):
    df = spark.createDataFrame([("10",), ("10.0",), (None,), (" 12 ",), ("12d",)], "x string")
    x = F.col("x")
    ask = lambda cond: [bool(b) for b in values(df, cond.match)]
    assert ask(p.equal(x, "10", text=True)) == [True, False, False, False, False]
    assert ask(p.not_equal(x, "10", text=True)) == [False, True, False, True, True]
    assert ask(p.not_within_list(x, "10, 11")) == [False, True, False, True, True]
    assert ask(p.compare(x, "gte", "5", text=True)) == [True, True, False, False, False]
    assert ask(p.missing(x)) == [False, False, True, False, False]
    assert ask(p.negation(p.equal(x, "10"))) == [False, True, True, True, True]


def test_dates_as_text(spark):
    df = spark.createDataFrame([("2024-01-02",), ("1/2/2024",), ("2024-01-02T00:00:00Z",), ("2024-01-02 00:00:00",), ("5",)], "x string")
    assert values(df, p.equal(F.col("x"), "2024-01-02", text=True).match) == [True] * 4 + [False]
    assert values(df, p.within_range(F.col("x"), "1", text=True).match) == [False] * 4 + [True]


def test_first_list_of_a_bool_decides(spark):
    yes, no = p.Cond.of(F.lit(True), 2.0), p.Cond.of(F.lit(False), 9.0)
    ask = lambda cond: spark.range(1).select(cond.match, cond.score).first()[:]
    assert ask(p.boolean()) == (True, 0.0)
    assert ask(p.boolean(All=[yes, yes], One=[no])) == (True, 4.0)
    assert ask(p.boolean(One=[no, yes])) == (True, 2.0)
    assert ask(p.boolean(None_=[no, no])) == (True, 0.0)
    assert ask(p.boolean(Not=[no, yes])) == (True, 0.0)
    with pytest.raises(ValueError):
        p.boolean(All=[yes], Not=[no], strict=True)


def test_documents_without_schema(spark):
    df = spark.createDataFrame([('{"a":{"b":10.0,"c":1e7,"d":true,"e":null,"f":[1],"g":"x"}}',)], "j string").select(F.parse_json("j").alias("d"))
    d = F.col("d")
    assert df.select(*[fx.text_at(d, f"a.{k}") for k in "bcdefgh"]).first()[:] == ("10", "10000000", "true", None, None, "x", None)
    n = spark.createDataFrame([(10.0,), (0.5,), (1e20,), (1.5e-7,), (-3.0,)], "x double")
    assert values(n, fx.number_text(F.col("x"))) == ["10", "0.5", "100000000000000000000", "0.00000015", "-3"]
    assert spark.range(1).select(fx.div(F.lit("4"), F.lit("0")), fx.add(F.lit("x"), F.lit(2)), fx.pluck(F.lit('{"k":1,"s":"t"}'), "k"), fx.pluck(F.lit('{"s":"t"}'), "s"), fx.pluck(F.lit("no"), "s")).first()[:] == (0.0, 2.0, "", "t", "")


def test_projection(spark):
    df = spark.createDataFrame([(1, {"a": 2.0}, [1], 0.5)], "id int, s struct<a: double>, l array<int>, _score double")
    assert s.project(df, ["id", "s.a", "l", "none"]).first().asDict() == {"id": 1, "s.a": "2", "_score": 0.5}


def stem(w):
    """A plain twin of the stemmer."""
    vowel = lambda x: re.search("[aeiou]|.y", x) is not None
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss") and len(w) > 3:
        w = w[:-1]
    before = w
    if w.endswith("eed"):
        w = w[:-1] if vowel(w[:-3]) else w
    elif w.endswith("ed") and vowel(w[:-2]):
        w = w[:-2]
    elif w.endswith("ing") and vowel(w[:-3]):
        w = w[:-3]
    if w != before and len(w) > 1 and w[-1] == w[-2] and w[-1] not in "lsz":
        w = w[:-1]
    for longer, back, rules in ((5, 5, tx._LONG), (4, 3, [(x, "") for x in tx._SHORT])):
        if len(w) > longer and vowel(w[:-back]):
            w = next((w[: -len(x)] + y for x, y in rules if w.endswith(x)), w)
    return w


def test_stemmer(spark):
    rng = random.Random(2)
    ends = ["", "s", "es", "ies", "sses", "ed", "eed", "ing", "ational", "tional", "alize", "icate", "iciti", "fulness", "al", "ance", "er", "ic", "able", "ant", "ize"]
    words = ["agreed", "national", "hopping", "falling", "ponies", "caresses", "cats", "ss", "as", "yy", "rhythm", "sing", "relational", "hopefulness"]
    words += ["".join(rng.choice("abcdeinorstyz") for _ in range(rng.randrange(1, 6))) + rng.choice(ends) for _ in range(600)]
    got = spark.createDataFrame([(words,)], "w array<string>").select(tx.stemmed(F.col("w"))).first()[0]
    assert got == [stem(w) for w in words]
    assert stem("agreed") == "agre" and stem("national") == "nate"


def test_analysis(spark):
    df = spark.createDataFrame([("The dog's café-high, don't 42 1e5 inf x running RUNNING",), (None,)], "t string")
    assert values(df, tx.analysed_phrase(F.col("t"))) == [["dog", "caf", "high", "dont", "run", "run"], []]
    assert values(df, tx.analysed(F.col("t")))[0][:7] == ["dog", "caf", "high", "dont", "run", "dog caf", "caf high"]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edit_distance_bounds(x, y):
    def levenshtein(u, w):
        row = list(range(len(w) + 1))
        for i, p_ in enumerate(u, 1):
            row, last = [i], row
            for j, q in enumerate(w, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p_ != q)))
        return row[-1]

    d = tx.osa_distance(x, y)
    assert d == tx.osa_distance(y, x) and d <= levenshtein(x, y) <= 2 * d


def test_relevance(spark):
    assert tx.osa_distance("ab", "ba") == 1 and tx.osa_distance("ca", "abc") == 3
    assert r.best_phrase("a x b".split(), ["a", "b"], 1, 0) == (1, 0) and r.best_phrase("a x y b".split(), ["a", "b"], 1, 0) is None
    df = spark.createDataFrame([(1, "quick fox"), (2, "quikc brown"), (3, None)], "id int, t string")
    assert {x[0]: x[1] for x in r.fuzzy_frame(df, "id", F.col("t"), "QUICK", 1).collect()} == {1: 2.0, 2: 1.0}
    assert {x[0]: x[1] for x in r.fuzzy_frame(df, "id", F.col("t"), "fox", 0).collect()} == {1: 0.0}
    tokens = spark.createDataFrame([(["aa", "xx", "bb"],), (["bb"],), (None,)], "t array<string>")
    cond = r.phrase(F.col("t"), ["aa", "bb"], slop=1)
    assert [tuple(x) for x in tokens.select(cond.match, cond.score).collect()] == [(True, 1 * 2.5 * 0.5), (False, 0.0), (False, 0.0)]
    one = spark.range(1)
    ask = lambda fs, how: one.select(r.modified(F.lit(3.0), fs, how)).first()[0]
    null = F.lit(None).cast("double")
    assert ask([(F.lit(2.0), 2.0), (null, 1.0)], "multiply") == 12.0 and ask([(F.lit(0.0), 1.0), (F.lit(5.0), 1.0)], "multiply") == 15.0
    assert ask([(F.lit(2.0), 1.0)], "sum") == 6.0 and ask([(null, 1.0)], "replace") == 1.0 and ask([(F.lit(2.0), 2.0), (null, 1.0)], "replace") == 4.0


def test_phrase_twin_over_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select("doc_id", tx.analysed_phrase(F.col("text"), False).alias("t")).persist()
    cond = r.phrase(F.col("t"), ["attion", "anea"], slop=2, fuzz=1)
    for row in docs.select("t", cond.match.alias("m")).collect():
        assert row.m == (r.best_phrase(row.t, ["attion", "anea"], 2, 1) is not None)
    docs.unpersist()


def test_geo(spark):
    df = spark.createDataFrame([("1, 2", (1.0, 2.0), [2.0, 1.0]), ("x", None, None)], "t string, s struct<lat: double, lon: double>, l array<double>")
    for point in (geo.point_of_text(F.col("t")), geo.point_of_struct(F.col("s")), geo.point_of_pair(F.col("l"))):
        assert [tuple(x) for x in df.select(*point).collect()] == [(1.0, 2.0), (None, None)]
    lat, lon = F.lit(0.5), F.lit(0.5)
    tri = [(0.0, 0.0), (0.0, 2.0), (2.0, 0.0)]
    got = spark.range(1).select(geo.inside(lat, lon, tri), geo.inside(F.lit(1.5), F.lit(1.5), tri), geo.inside(lat, lon, tri[:2]), geo.within(lat, lon, (0.5, 1.5), 70, "miles"), geo.within(lat, lon, (0.5, 1.5), 69, "miles"), geo.near_line(lat, lon, [(0.0, 0.0), (0.0, 1.0)], 60, exact=True), geo.near_line(lat, lon, [(0.0, 0.0)], 1e9)).first()
    assert list(got) == [True, False, False, True, False, True, False]


def test_aggregation_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "k string, x double")
    m = a.terms(df, ["k"], *[a.metric(n, "x", n) for n in ("sum", "avg", "median", "min", "max", "std_dev", "count")], a.metric("percentile", "x", "p0", p=0), a.metric("percentile", "x", "p101", p=101)).orderBy("k").collect()
    assert tuple(m[0]) == ("a", 2, 4.0, 2.0, 2.0, 1.0, 3.0, pytest.approx(2**0.5), 2, 2.0, 2.0)
    assert tuple(m[1]) == ("b", 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0)
    assert [tuple(x) for x in a.ranges(df, "x", [("z", 9, 10), ("all", 0, 0), ("never", 0, 2)]).collect()] == [("z", 0), ("all", 3), ("never", 0)]
    assert a.date_histogram(df, "x", "week").count() == 0
    assert a.stats_of(df.limit(0), "x").count() == 0 and a.stats_of(df.limit(0), "x", False).first()[:] == (0, None, None, 0.0, 0.0)
    assert df.agg(a.scripted("x", "avg", "s", 10)).first()[0] == pytest.approx(19 / 3) and df.limit(0).agg(a.scripted("x", "max", "s", 7)).first()[0] == 7
    assert sorted(tuple(x) for x in a.facets(df, ["k"]).collect()) == [("k", "a", 2), ("k", "b", 1)]


def test_sorting_and_paging(spark):
    df = spark.createDataFrame([(1, "10"), (2, "9"), (3, None), (4, "x")], "id int, k string")
    asc, desc = ([x.id for x in s.page(df, s.order_by(df, [("k", d)], ["id"])).collect()] for d in ("asc", "desc"))
    assert asc == [3, 2, 1, 4] and desc == asc[::-1]
    whole = [x.id for o in range(0, 6, 2) for x in s.page(df, s.order_by(df, [("k", "asc")], ["id"]), o, 2).collect()]
    assert whole == asc and s.page(df, [], 9, 2).count() == 0 and s.page(df, [], -1, 0).count() == 4
    assert [x.id for x in s.page(df, s.order_by(df, [("k", "sideways")], ["id"])).collect()] == [1, 2, 3, 4]


def test_joins_edges(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (None,)], "j int")
    assert values(joins.in_subquery(left, "k", right, "j"), "k") == [1] and values(joins.not_in_subquery(left, "k", right, "j"), "k") == [2]
    day = lambda h: dt.datetime(2024, 1, 1, h)
    b = spark.createDataFrame([("a", day(1), 1), ("a", day(3), 3)], "k string, t timestamp, v int")
    x = spark.createDataFrame([("a", day(0)), ("a", day(3)), ("b", day(5))], "k string, at timestamp")
    assert sorted(map(str, values(joins.as_of(x, b, "k", "at", "t", ["v"]), "v"))) == ["3", "None", "None"]


def test_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [4.0, 4.0])], "id long, x array<double>")
    assert values(df, v.on_sphere(F.col("x")))[:2] == [[0.0, 0.0], [0.6, 0.8]]
    assert values(df.limit(1), v.distance("cosine", F.col("x"), F.col("x"))) == [1.0]
    same = spark.createDataFrame([(0, [1.0, 7.0]), (1, [2.0, 7.0])], "id long, x array<double>")
    assert values(v.min_max(same, "x").orderBy("id"), "x") == [[0.0, 0.0], [1.0, 0.0]]
    for metric in ("euclidean", "manhattan", "cosine"):
        got = v.nearest_of_each(df, df, "id", "x", 5, metric)
        one = v.nearest(df, "id", "x", [3.0, 4.0], 5, metric)
        assert [(x.id, round(x.distance, 9)) for x in got.where("query = 1").orderBy("rank").collect()] == [(x.id, round(x.distance, 9)) for x in one.collect()]
    assert v.nearest_of_each(df, df.limit(0), "id", "x", 5).count() == 0


def test_carbon_lines(spark):
    lines = [
        (1, 0, "REPORT RequestId: r1 Duration: 61000.6 ms Billed Duration: 61001 ms Memory Size: 512 MB Max Memory Used: 80 MB Init Duration: 9.5 ms"),
        (1, 1, "REPORT RequestId: r1 Function: f Path: null X-Any-REGIONS: a,b X-Any-INTENSITIES: 1.6,2 X-Any-REGION: b"),
        (2, 0, "REPORT RequestId: r2 Path: /p"),
    ]
    got = {x.batch_id: x for x in c.records(spark.createDataFrame(lines, "batch_id int, line_no int, message string")).collect()}
    assert (got[1].duration, got[1].billed_duration, got[1].init_duration, got[1].memory_size, got[1].max_memory_used) == (61001, 61001, 10, 512, 80)
    assert (got[1].path, got[1].routed, got[1].grid, got[2].path, got[2].routed, got[2].grid) == (None, True, {"a": 2, "b": 2}, "/p", False, None)
    e1, e2 = spark.range(1).select(c.electricity(F.lit(61000), F.lit(1792)), c.electricity(F.lit(61000), F.lit(1792), False)).first()
    assert e1 == pytest.approx(2.12 / 3600) and e2 == pytest.approx(61 * 2.12 / 3600)
    grid = spark.createDataFrame([("a", 0.0), ("b", -1.0)], "region string, intensity double")
    service = spark.createDataFrame([("s", [("a", None), ("b", [])])], "name string, regions array<struct<region: string, paths: array<string>>>")
    assert c.best_regions(service, spark.createDataFrame([("s", "/x")], "service string, path string"), grid).first()[:] == ("s", "/x", "eastus")
    globs = spark.createDataFrame([("/a/*",), ("/a/**",), ("/a.?",)], "g string")
    assert values(globs, F.rlike(F.lit("/a/b/c"), c.glob_regex(F.col("g")))) == [False, True, False]


def test_entities(spark):
    df = spark.createDataFrame([(1, "a@b.c", [("x",), (None,)]), (2, "no", []), (3, None, None)], "id int, mail string, items array<struct<name: string>>")
    rules = {"mail": ["required", "email"], "items": ["required"], "items.name": ["required"]}
    assert values(df.orderBy("id"), e.required_errors(df, rules)) == [["items.name: required"], ["mail: email", "items: required"], ["mail: required", "items: required"]]
    contract = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 2}, "t": {"enum": ["a"], "maxLength": 3}, "l": {"type": "array", "items": {"type": "string"}}, "m": {"format": "email"}}}
    docs = spark.createDataFrame([('{"n":2,"t":"a","l":["x"]}',), ('{"n":1.5,"z":0}',), ('{"t":"bbbb","l":[1],"m":"x"}',), ("[]",)], "j string").select(F.parse_json("j").alias("d"))
    sizes = [len(x) for x in values(docs, e.contract_errors(F.col("d"), contract))]
    assert sizes[0] == 0 and sizes[1] == 3 and sizes[2] >= 4 and sizes[3] == 1
    assert values(docs, e.contract_errors(F.col("d"), {})) == [[]] * 4
    keys = e.composite_key(spark.createDataFrame([("a", "b"), (None, "b")], "x string, y string"), ["x", "y"])
    assert values(keys, "composite_key") == ["a:b", None]
    flat = e.expanded(spark.createDataFrame([(1, [("x",), ("y",)])], "id int, l array<struct<n: string>>"))
    assert sorted(tuple(x) for x in flat.collect()) == [(1, "x"), (1, "y")]
    stamps = e.with_timestamps(spark.createDataFrame([("2024-01-01T00:00:00Z",), ("x",)], "At string"))
    assert stamps.columns == ["at", "at_ts"] and [x is not None for x in values(stamps, "at_ts")] == [True, False]
    grants = spark.createDataFrame([("u", 1, "2", "t", 3)], "user string, type int, resource string, asset string, op int")
    owned = spark.createDataFrame([("1", "u"), ("2", "w"), ("3", "w")], "id string, userId string")
    assert sorted(values(e.writable(owned, "u", "userId", "id", grants, 1, "t", 3), "id")) == ["1", "2"]


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("eyJhIjoxfQ==",), ("bm8=",), ("***",)], "n string")
    good, bad = src.decoded(rows, "n", "a int")
    assert values(good, "a") == [1] and bad.count() == 2
    index = src.Index(str(tmp_path / "i"), ("x", "y", "z"))
    assert src.composite(index, {"x": "a", "z": "c"}) == "a::c"
    with pytest.raises(ValueError):
        src.composite(index, {})
    with pytest.raises(ValueError):
        src.static(spark, [], "a int")
    spark.createDataFrame([(1, "a::c"), (2, "b::c")], "id int, composite_key string").write.partitionBy("composite_key").parquet(index.path)
    assert values(src.scan(spark, {"n": index}, "n", {"x": "a", "z": "c"}), "id") == [1]
    out = str(tmp_path / "numbers")
    src.write_numbers(spark.createDataFrame([(1.5, 2.0)], "a double, b double"), out)
    assert spark.read.text(out).first()[0] == "1.500000,2.000000" and src.matrix(spark, out, 2).first().v == [1.5, 2.0]
    src.write_json(spark.createDataFrame([(1,)], "id int"), str(tmp_path / "j"), compressed=True)
    assert values(src.by_ids(src.read_entities(spark, str(tmp_path / "j")), "id", [1, 2]), "id") == [1]
    landed = spark.createDataFrame([('[{"location":"a","rating":1.5},{}]',), ("[]",)], "b string")
    assert [tuple(x) for x in src.landed_emissions(landed, "b").collect()] == [("a", 1.5)]
    reply = spark.createDataFrame([('{"ba":"z","percent":"x","moer":"1.5","point_time":"2024-01-01T00:00:00Z"}',)], "b string")
    assert src.landed_index(reply, "b").first()[:3] == ("z", None, 1.5)


def test_index_stream_moves_rows(spark, tmp_path):
    schema, place = "id int, k string, v int", {n: str(tmp_path / n) for n in ("in", "out", "state")}
    for batch in ([(1, "a", 1), (2, "a", 1), (3, "b", 1)], [(1, "b", 2), (2, "a", 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(place["in"])
        streams.index_changes(spark.readStream.schema(schema).parquet(place["in"]), place["out"], place["state"], "id", "k")
    got = spark.read.parquet(place["out"]).select("id", F.col("k").cast("string"), "v").collect()
    assert sorted(tuple(x) for x in got) == [(1, "b", 2), (2, "a", 1), (3, "b", 1)]


def test_best_region_reads_all_orders(spark, sf, tmp_path):
    from docquery.plans.catalogue import QUERIES

    for name in ("nation", "region", "orders"):
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        (rows.where("o_orderkey >= 40") if name == "orders" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["best_region"](spark, str(tmp_path)).count() == QUERIES["best_region"](spark, sf).count() > 0
