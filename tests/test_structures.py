"""Posting index, deletion keys, exact ranks, grid cells and deep trees against plain versions."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquery.functions import geo, text as tx
from docquery.operators import entities as e, fuzzy, places, postings as ix, ranks, relevance as r, search as s, trees


def rows_of(df, *columns):
    return sorted((tuple(x) for x in (df.select(*columns) if columns else df).collect()), key=str)


def test_postings_equal_analysed_texts_after_changes(spark, tmp_path):
    rng = random.Random(1)
    words = ["apple", "banana", "cherry", "date", "fig", "grape", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    index = ix.PostingIndex(str(tmp_path / "i"), "id", "t", "v")
    schema = "id int, t string, v int, gone boolean"
    first = [(i, text(rng.randint(0, 15)), 1, False) for i in range(40)] + [(90, None, 1, False)]
    ix.update(spark, index, spark.createDataFrame(first, schema), "gone")
    second = [(i, text(12), 3, False) for i in range(0, 40, 3)] + [(i, None, 3, True) for i in range(1, 40, 9)] + [(6, "old apple banana", 2, False)]
    ix.update(spark, index, spark.createDataFrame(second, schema), "gone")
    ix.update(spark, index, spark.createDataFrame([(3, "apple banana apple banana", 2, False), (None, "apple", 9, False)], schema), "gone")  # late, and without a key
    latest = {}
    for row in sorted(first + second, key=lambda x: x[2]):
        latest[row[0]] = row
    live = spark.createDataFrame([x for x in latest.values() if not x[3]], schema)
    docs = live.select("id", tx.analysed_phrase(F.coalesce("t", F.lit(""))).alias("t")).select("id", "t", tx.analysed(F.col("t")[0]).alias("_"), tx.gram_hashes(F.col("t")).alias("g"))
    for query in ("apple banana", "banana the cherry apple", "fig"):
        wanted = r.query_tokens(spark, query)
        assert rows_of(ix.match(spark, index, wanted, 2.0).select("id", F.round("score", 9))) == rows_of(s.matched(docs, r.match_hashed(F.col("g"), wanted, 2.0)).select("id", F.round("_score", 9)))
        wanted = r.query_tokens(spark, query, phrase=True)
        assert rows_of(ix.phrase(spark, index, wanted).select("id", F.round("score", 9))) == rows_of(s.matched(docs, r.phrase(F.col("t"), wanted)).select("id", F.round("_score", 9)))
    stem = r.query_tokens(spark, "apple", phrase=True)[0]
    df = {x.term: x.df for x in ix.document_frequency(spark, index, [stem, "none"]).collect()}
    assert df == {stem: docs.where(F.array_contains("t", stem)).count(), "none": 1}
    plan = ix.read(spark, index, [stem])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters")[1]
    assert ix.match(spark, index, []).count() == 0 and ix.phrase(spark, index, []).count() == 0


def test_one_of_the_rows_of_a_key_makes_its_postings(spark, tmp_path):
    """Equal versions, other texts: places are those of one text, not of both; a document that goes has none."""
    index = ix.PostingIndex(str(tmp_path / "i"), "id", "t", "v", stem=False)
    texts = {"apple banana", "cherry grape banana"}
    rows = [(1, t, 1, False) for t in sorted(texts)] + [(2, "apple banana", 1, False)] * 2 + [(3, "apple", 1, False), (3, "apple", 2, True)]
    ix.update(spark, index, spark.createDataFrame(rows, "id int, t string, v int, gone boolean"), "gone")
    found = {}
    for x in ix.read(spark, index, ["apple", "banana", "cherry", "grape"]).collect():
        found.setdefault(x.doc, {}).update({i: x.term for i in x.positions} | {"n": x.tokens})
    text = lambda at: " ".join(at[i] for i in range(at["n"]))
    assert set(found) == {1, 2} and text(found[1]) in texts and text(found[2]) == "apple banana" and len(found[2]) == 3
    assert {x.term: x.df for x in ix.document_frequency(spark, index, ["banana"]).collect()} == {"banana": 2}


def test_postings_of_pieces():
    rng = random.Random(2)
    docs = [[rng.choice("abcd") for _ in range(rng.choice([0, 1, 3, 9]))] for _ in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array(docs, pa.list_(pa.string()))], names=["doc", "t"])
    assert max(p.num_rows for p in ix._pieces(batch, 5)) > 1 and [d for p in ix._pieces(batch, 5) for d in p.column("doc").to_pylist()] == list(range(30))
    got = [(x["term"], d, at) for out in ix._postings(ix._pieces(batch, 5)) for x in out.to_pylist() for d, at in zip(x["doc"], x["positions"], strict=True)]
    assert sorted(got) == sorted((w, d, [i for i, v in enumerate(t) if v == w]) for d, t in enumerate(docs) for w in set(t))


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_deletion_keys_find_all_near_words(spark, edits):
    rng = random.Random(edits)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 10))) for _ in range(60)}) + ["éa", "aé"]
    values = rng.sample(words, 12) + ["", "abcabcabcabcabc"]
    frame = lambda x, name: spark.createDataFrame([(w,) for w in [*x, None]], f"{name} string")
    got = {(x.word, x.value): x.distance for x in fuzzy.near_values(frame(words, "w"), "w", frame(values, "v"), "v", edits).collect()}
    assert got == {(w, v): d for w in words for v in set(values) if (d := tx.osa_distance(w, v)) <= edits}


def test_fuzzy_matches_equal_one_value_at_a_time(spark):
    docs = spark.createDataFrame([(1, "The kitten sat"), (2, "sitting mitten, KITTNE"), (3, None), (4, "smitten")], "id int, t string")
    values = spark.createDataFrame([("Kitten",), ("sat",), ("sat",)], "v string")
    for k in (0, 1, 2):
        want = [(x.id, v, x.fuzzy_score) for v in ("Kitten", "sat") for x in r.fuzzy_frame(docs, "id", F.col("t"), v, k).collect()]
        assert rows_of(fuzzy.fuzzy_matches(docs, "id", F.col("t"), values, "v", k)) == sorted(want, key=str)


def test_ranks_of_a_hot_group(spark):
    rng = random.Random(3)
    data = [("hot", float(rng.choice([rng.randrange(3000), 7, rng.random()]))) for _ in range(6000)] + [("small", 1.0), ("small", 2.0), ("one", 5.0), ("none", None), (None, 3.0)]
    df = spark.createDataFrame([(k, None if x is None else repr(x)) for k, x in data] + [("hot", "n/a"), ("hot", "NaN")], "k string, x string")
    names = {"p0": 0.02, "p50": 50, "p99": 99.5, "p100": 100, "odd": 400}
    got = {x.k: x for x in ranks.percentiles(df, ["k"], "x", names, in_order=50).collect()}
    numbers = spark.createDataFrame(data, "k string, x double").where("k is not null")
    want = numbers.groupBy("k").agg(*[F.coalesce(F.percentile("x", (p if p <= 100 else 50) / 100), F.lit(0.0)).alias(n) for n, p in names.items()]).collect()
    assert set(got) == {x.k for x in want} == {"hot", "small", "one", "none"}
    for x in want:
        assert [got[x.k][n] for n in names] == pytest.approx([x[n] for n in names], abs=1e-9)
    assert ranks.percentiles(numbers, [], "x", {"m": 50}).first().m == numbers.agg(F.median("x")).first()[0]
    assert ranks.percentiles(numbers.limit(0), ["k"], "x", {"m": 50}).count() == 0


@pytest.mark.parametrize("margin", [2, 0, -40])
def test_ranks_in_brackets_of_large_groups(spark, monkeypatch, margin):
    """Only what the brackets hold is counted by value; brackets that miss their rank, as with a margin below 0, change nothing."""
    monkeypatch.setattr(ranks, "MARGIN", margin)
    tables = []
    monkeypatch.setattr(ranks, "kept", lambda df, name, keep=ranks.kept: tables.append((name, keep(df, name))) or tables[-1][1])
    rows = spark.range(30000).select(F.when(F.col("id") % 3 < 2, "a").otherwise("b").alias("k"), F.when(F.col("id") % 7 == 0, 0.5).otherwise(F.rand(1)).alias("x"))
    rows = ranks.kept(rows, "rows")
    names = {"p50": 50, "p90": 90, "low": 0.1, "top": 100}
    got = {x.k: x for x in ranks.percentiles(rows, ["k"], "x", names, in_order=100, accuracy=500).collect()}
    for x in rows.groupBy("k").agg(*[F.percentile("x", p / 100).alias(n) for n, p in names.items()]).collect():
        assert [got[x.k][n] for n in names] == pytest.approx([x[n] for n in names], abs=1e-12)
    counted = {name: df for name, df in tables if name in ("counts", "inside")}
    assert margin < 2 or next(iter(counted.values())).count() < 30000 / 20


def test_cells_find_what_each_test_finds(spark):
    rng = random.Random(4)
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)] + [(400, 10.0, 179.9), (401, 10.0, -179.9), (402, 89.9, 0.0), (403, None, 1.0), (404, 0.0, 190.0)]
    points = spark.createDataFrame(spots, "id int, lat double, lon double")
    shapes = [(f"c{i}", "circle", [(rng.uniform(-90, 90), rng.uniform(-180, 180))], rng.choice([1.0, 300.0, 5000.0, 19000.0])) for i in range(25)]
    shapes += [("date", "circle", [(10.0, 180.0)], 50.0), ("pole", "circle", [(88.0, 90.0)], 400.0), ("all", "circle", [(0.0, 0.0)], 21000.0)]
    shapes += [(f"p{i}", "polygon", [(rng.uniform(-80, 80), rng.uniform(-170, 170)) for _ in range(rng.randint(2, 6))], None) for i in range(25)]
    shapes += [(f"l{i}", "line", [(rng.uniform(-80, 80), rng.uniform(-170, 170)) for _ in range(rng.randint(1, 4))], rng.choice([100.0, 2000.0])) for i in range(15)] + [("same", "line", [(5.0, 5.0), (5.0, 5.0)], 900.0)]
    df = spark.createDataFrame([*shapes, ("null", "circle", None, 1.0), ("odd", "square", [(1.0, 1.0)], 1.0)], "shape string, kind string, points array<struct<lat: double, lon: double>>, km double")
    test = {"circle": lambda at, km: geo.within(F.col("lat"), F.col("lon"), at[0], km), "polygon": lambda at, _: geo.inside(F.col("lat"), F.col("lon"), at), "line": lambda at, km: geo.near_line(F.col("lat"), F.col("lon"), at, km)}
    flags = points.select("id", *[test[kind](at, km).alias(name) for name, kind, at, km in shapes]).collect()
    want = sorted((x.id, name) for x in flags for name, *_ in shapes if x[name])
    assert len(want) > 500 and sorted(tuple(x) for x in places.located(points, "id", "lat", "lon", df).collect()) == want
    assert places.located(points, "id", "lat", "lon", df.limit(0)).count() == 0
    plan = places.located(points, "id", "lat", "lon", df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_trees_of_any_depth(spark):
    rng = random.Random(5)

    def tree(depth):
        return {"name": f"n{rng.randrange(9)}", **({"attributes": [tree(depth - 1) for _ in range(rng.randint(0, 3))]} if depth and rng.random() < 0.8 else {})}

    def walk(node, path):
        below = node.get("attributes") or []
        yield tuple(path), node["name"], not below
        for i, c in enumerate(below):
            yield from walk(c, [*path, i])

    deep = {"name": "end"}
    for i in range(14):
        deep = {"name": f"d{i}", "attributes": [deep]}
    data = {i: [tree(i % 6) for _ in range(i % 3)] for i in range(9)} | {90: [deep]}
    rows = [(i, json.dumps(t)) for i, t in data.items()] + [(91, None), (92, "[1, null, {\"name\": \"x\", \"attributes\": 5}]"), (93, '{"name": "only"}'), (94, '"text"')]
    df = spark.createDataFrame(rows, "id int, t string").select("id", F.try_parse_json("t").alias("t"))
    got = rows_of(trees.nodes(df, "id", F.col("t"), "attributes").select("id", "path", F.try_variant_get("node", "$.name", "string"), "leaf"))
    want = [(i, list(p), n, leaf) for i, roots in data.items() for k, t in enumerate(roots) for p, n, leaf in walk(t, [k])] + [(92, [2], "x", True), (93, [0], "only", True)]
    assert got == sorted(want, key=str)
    contract = {"required": ["name"], "properties": {"name": {"pattern": "^[nd]"}}}
    bad = {(x.id, tuple(x.path)) for x in trees.tree_errors(df, "id", F.col("t"), "attributes", lambda n: e.contract_errors(n, contract)).collect()}
    assert bad == {(i, tuple(p)) for i, p, n, _ in want if n[0] not in "nd"}
    assert trees.leaves(df.where("id > 93"), "id", F.col("t"), "attributes").count() == 0


def test_best_regions_by_beginnings_of_globs(spark):
    """Against every glob of every region for every path."""
    from docquery.operators import carbon as c

    rng = random.Random(6)
    part = lambda: rng.choice(["a", "b", "ab", "*", "**", "?", "a?", "x.y"])
    offers = {s: [(f"r{i}", None if rng.random() < 0.1 else ["/" + "/".join(part() for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 3))]) for i in range(6)] for s in "stu"}
    offers["u"] = [(r, p or ["/zzz"]) for r, p in offers["u"]]
    rated = {f"r{i}": rng.randint(-2, 20) for i in range(5)}
    calls = [(s, "/" + "/".join(rng.choice(["a", "b", "ab", "x.y", "xzy", ""]) for _ in range(rng.randint(0, 3)))) for s in "stuv" for _ in range(40)]
    regex = lambda g: "^" + "".join({"\1": ".*", "*": "[^/]*", "?": "."}.get(x, re.escape(x)) for x in g.replace("**", "\1")) + "$"
    want = {}
    for s_, path in calls:
        fit = [(rated[r_], r_) for r_, ps in offers.get(s_, []) if rated.get(r_, 0) > 0 and (not ps or any(re.match(regex(g), path) for g in ps))]
        want[s_, path] = min(fit)[1] if fit else "eastus"
    services = spark.createDataFrame(list(offers.items()), "name string, regions array<struct<region: string, paths: array<string>>>")
    got = c.best_regions(services, spark.createDataFrame(calls, "service string, path string"), spark.createDataFrame(list(rated.items()), "region string, intensity int"))
    assert {(x.service, x.path): x.region for x in got.collect()} == want and len(set(want.values())) > 3


def test_savings_with_a_region_twice(spark):
    from docquery.operators import carbon as c

    grid = spark.createDataFrame([(1, "a", 5.0), (1, "a", 4.0), (1, "b", 2.0)], "report int, region string, intensity double")
    assert [tuple(x)[2:5] for x in c.savings(spark.createDataFrame([(1, "a")], "report int, region string"), grid).collect()] == [(4.0, "b", 2.0)]


def test_multiples_of_decimals(spark):
    docs = spark.createDataFrame([("0.3",), ("0.35",), ("1e30",), ("-0.7",)], "t string").select("t", F.parse_json("t").alias("d"))
    assert {x.t for x in docs.where(F.size(e.contract_errors(F.col("d"), {"multipleOf": 0.1})) == 0).collect()} == {"0.3", "-0.7", "1e30"}


def test_lines_parse_as_by_a_pattern_for_each_label(spark):
    from docquery.operators import carbon as c

    pool = ["RequestId:", "Function:", "Path:", "X-A-SERVICE:", "X-Grid-REGION:", "X-Q-REGIONS:", "X-Q-INTENSITIES:", "UserId:", "null", "abc", "12.5", "Duration:", "Billed", "Init", "Billed Duration:", "Memory Size:", "Max Memory Used:", "4..5", "7ms", "xDuration:", "\n", "X-A-B-SERVICE:"]
    rng = random.Random(7)
    rows = [(i, 0, rng.choice(["", " "]) + rng.choice([" ", "\t", "  "]).join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(500)] + [(500, 0, None)]
    df = spark.createDataFrame(rows, "batch_id int, line_no int, message string")
    value = lambda label: F.nullif(F.nullif(F.regexp_extract("message", rf"(?:^|\s){label}\s+(\S+)", 1), F.lit("")), F.lit("null"))
    number = lambda label: F.round(F.nullif(F.regexp_extract("message", rf"{label}\s+([0-9.]+)", 1), F.lit("")).try_cast("double")).cast("int")
    assert rows_of(c.parsed_lines(df)) == rows_of(df.select("batch_id", "line_no", *[value(x) for x in c.TEXTS.values()], *[number(x) for x in c.NUMBERS.values()]))


def test_equal_places_and_figures_are_tested_once(spark):
    points = spark.range(300).select("id", F.lit(10.0).alias("lat"), (F.col("id") % 2 * 90.0).alias("lon"))
    at = F.array(F.struct(F.lit(10.5).alias("lat"), F.lit(0.0).alias("lon")))
    shapes = spark.range(200).select(F.concat(F.lit("s"), F.col("id") % 199).alias("shape"), F.lit("circle").alias("kind"), at.alias("points"), (100.0 + F.col("id") % 2).alias("km"))
    spots = points.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct()
    assert places.figures_at(spots, shapes.drop("shape").distinct()).count() == 2
    found = places.located(points, "id", "lat", "lon", shapes)
    assert found.count() == 150 * 200 and found.distinct().count() == 150 * 199 and found.where("id % 2 = 1").isEmpty()


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    text = '{"attributes": [{"a": 1}, ' * 14 + '{"a": 0}' + "]}" * 14
    df = spark.createDataFrame([(1, text)], "id int, t string").select("id", F.parse_json("t").alias("t"))
    rounds, kept = [], trees.kept
    monkeypatch.setattr(trees, "kept", lambda d, name: (rounds.append(name), kept(d, name))[1])
    assert rows_of(trees.leaves(df, "id", F.col("t"), "attributes"), F.size("path")) == sorted([(i,) for i in range(2, 16)] + [(15,)], key=str)
    assert len(rounds) == 2


def test_a_phrase_meets_each_word_of_a_text_once(monkeypatch):
    """Against the plain search of every start, with the distances that it needs counted."""
    def plain(doc, query, slop, fuzz):
        best = None
        for start in range(len(doc)):
            used, edits, at = 0, tx.osa_distance(doc[start], query[0]), start
            if edits > fuzz:
                continue
            for q in query[1:]:
                found = next(((i, d) for i in range(at + 1, len(doc)) if (d := tx.osa_distance(doc[i], q)) <= fuzz), None)
                if found is None or (used := used + found[0] - at - 1) > slop:
                    break
                at, edits = found[0], edits + found[1]
            else:
                if best is None or used < best[0]:
                    best = (used, edits)
        return best

    rng = random.Random(8)
    for _ in range(400):
        doc, query = [["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(n)] for n in (rng.randint(0, 25), rng.randint(1, 4))]
        slop, fuzz = rng.randint(0, 5), rng.randint(0, 2)
        assert r.best_phrase(doc, query, slop, fuzz) == plain(doc, query, slop, fuzz)
    asked, distance = [], tx.osa_distance
    monkeypatch.setattr(tx, "osa_distance", lambda a, b: (asked.append(a), distance(a, b))[1])
    r.best_phrase(["attion", "anea", "other"] * 500, ["attion", "anea", "eriner"], 3, 1)
    assert len(asked) <= 9


def test_usage_lines_are_cut_into_words_once(spark):
    """A text's label is a word whose value is the next one, a label or a header's too; one search a line finds all numbers."""
    from docquery.operators import carbon as c

    lines = ["X-REGION: a X-H_1-REGION: b", "Function: X-A-REGION: c", "X-A-SERVICE: Path: RequestId:", "Duration: 7.6ms Billed Duration:\t8 Path: null", " UserId: ", None]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(lines)], "batch_id int, line_no int, message string")
    got = {x.batch_id: {k: v for k, v in x.asDict().items() if v is not None and k not in ("batch_id", "line_no")} for x in c.parsed_lines(df).collect()}
    assert got == {0: {"region": "b"}, 1: {"function": "X-A-REGION:", "region": "c"}, 2: {"service": "Path:", "path": "RequestId:"}, 3: {"duration": 8, "billed_duration": 8}, 4: {}, 5: {}}
    assert c.parsed_lines(df)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
