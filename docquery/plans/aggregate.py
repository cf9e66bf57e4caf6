"""Aggregation queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquery.operators import aggregations as a, predicates as p, search as s, vectors as v
from docquery.operators.predicates import expression
from docquery.operators.ranks import percentiles
from docquery.operators.relevance import modified
from docquery.plans.registry import query, table
from docquery.plans.search import order_documents


@query(
    "terms_metrics",
    """SELECT l_returnflag, count(*) AS count, round(sum(l_quantity), 4) AS total, round(avg(l_extendedprice), 6) AS mean, median(l_quantity) AS middle,
       min(l_discount) AS low, max(l_tax) AS high, round(stddev_samp(l_quantity), 8) AS deviation, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90,
       CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS suppliers, count(l_quantity) AS n,
       (SELECT m FROM (SELECT l_returnflag AS f, l_linenumber AS m, count(*) AS c FROM lineitem GROUP BY ALL) x WHERE x.f = l.l_returnflag ORDER BY c DESC, m LIMIT 1) AS common
       FROM lineitem l GROUP BY l_returnflag""",
)
def terms_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 A6-A15."""
    m = a.metric
    out = a.terms(table(spark, sf_dir, "lineitem"), ["l_returnflag"], m("sum", "l_quantity", "total"), m("avg", "l_extendedprice", "mean"), m("median", "l_quantity", "middle"), m("min", "l_discount", "low"), m("max", "l_tax", "high"), m("std_dev", "l_quantity", "deviation"), m("percentile", "l_extendedprice", "p90", p=90), m("cardinality", "l_suppkey", "suppliers"), m("count", "l_quantity", "n"), m("mode", "l_linenumber", "common"))
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6), "deviation": F.round("deviation", 8), "p90": F.round("p90", 6)})


@query(
    "global_metrics",
    "SELECT count(*) AS count, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean FROM orders",
)
def global_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    out = a.whole(table(spark, sf_dir, "orders"), a.metric("sum", "o_totalprice", "total"), a.metric("avg", "o_totalprice", "mean"))
    return out.select("count", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"))


@query(
    "range_buckets",
    """SELECT key, count(o_totalprice) AS count, coalesce(round(avg(o_totalprice), 6), 0) AS mean
       FROM (VALUES ('low', 0, 100000), ('mid', 100000, 250000), ('none', -2, -1), ('high', 250000, 1e18)) b(key, f, t)
       LEFT JOIN orders ON o_totalprice >= f AND o_totalprice < t GROUP BY key""",
)
def range_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: an empty bucket and an open end."""
    buckets = [("low", 0, 100000), ("mid", 100000, 250000), ("none", -2, -1), ("high", 250000, 0)]
    return a.ranges(table(spark, sf_dir, "orders"), "o_totalprice", buckets, F.round(F.avg("o_totalprice"), 6).alias("mean"))


@query(
    "date_histogram",
    "SELECT strftime(ts, '%Y-%m-%d %H') AS key, count(*) AS count, round(sum(value), 6) AS total FROM events GROUP BY 1",
)
def date_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    return a.date_histogram(table(spark, sf_dir, "events"), "ts", "hour", F.round(F.sum("value"), 6).alias("total"))


@query(
    "nested_agg",
    "SELECT l_returnflag, count(*) AS count, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag",
)
def nested_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: child buckets over unnested rows."""
    rows = a.nested(order_documents(spark, sf_dir), "lines", ["l_orderkey"])
    return a.terms(rows, ["l_returnflag"], F.round(F.avg("l_quantity"), 6).alias("mean"))


@query(
    "nested_metric",
    "SELECT l_orderkey % 10 AS bucket, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1",
)
def nested_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A roll-up over arrays without exploding them."""
    rows = order_documents(spark, sf_dir).withColumn("bucket", F.col("l_orderkey") % 10)
    return a.nested_metric(rows, ["bucket"], "lines", "l_extendedprice", "avg", "mean").withColumn("mean", F.round("mean", 4))


@query(
    "sub_aggs",
    "SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY ALL",
)
def sub_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21."""
    return a.sub_aggregation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", F.round(F.sum("l_quantity"), 4).alias("total"))


@query(
    "top_hits",
    """SELECT o_custkey, CAST(rank AS INT) AS rank, o_orderkey, o_totalprice FROM
       (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
)
def top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return a.top_hits(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, ["o_orderkey", "o_totalprice"])


@query(
    "bucket_script",
    """SELECT l_returnflag, count(*) AS count, round(sum(l_quantity), 4) AS quantity, round(sum(l_quantity) / count(*), 6) AS each, round(sum(l_quantity) / count(*) * 2 + 1, 6) AS more
       FROM lineitem GROUP BY l_returnflag""",
)
def bucket_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later script sees an earlier one's result."""
    buckets = a.terms(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.sum("l_quantity").alias("quantity"))
    out = a.bucket_scripts(buckets, ("each", "q / n", {"q": "quantity", "n": "count"}), ("more", "e * 2 + m", {"e": "each", "m": "one"}))
    out = out.withColumn("more", F.col("more") + 1)
    return out.select("l_returnflag", "count", F.round("quantity", 4).alias("quantity"), F.round("each", 6).alias("each"), F.round("more", 6).alias("more"))


@query(
    "stats_bucket",
    """SELECT count(t) AS stat_count, min(t) AS stat_min, max(t) AS stat_max, round(sum(t), 4) AS stat_sum, round(avg(t), 6) AS stat_avg, round(stddev_pop(t), 6) AS stat_std_dev
       FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM orders GROUP BY o_custkey)""",
)
def stats_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19 A20."""
    out = a.stats_of(a.terms(table(spark, sf_dir, "orders"), ["o_custkey"]), "count")
    return out.withColumns({"stat_sum": F.round("stat_sum", 4), "stat_avg": F.round("stat_avg", 6), "stat_std_dev": F.round("stat_std_dev", 6)})


@query(
    "facets",
    """SELECT 'l_returnflag' AS facet, l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY ALL
       UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL
       UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY ALL""",
)
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return a.facets(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "scripted_metric",
    """SELECT l_linestatus, round(10 + sum(l_quantity * l_discount), 4) AS total, round((10 + sum(l_quantity * l_discount)) / count(*), 8) AS mean,
       round(min(l_quantity * l_discount), 6) AS low, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY l_linestatus""",
)
def scripted_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    code = "l_quantity * l_discount"
    out = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(a.scripted(code, "sum", "total", 10), a.scripted(code, "avg", "mean", 10), a.scripted(code, "min", "low"), a.scripted(code, "count", "n"))
    return out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 8), "low": F.round("low", 6)})


@query(
    "nested_facet",
    """SELECT p AS value, count(*) AS count FROM (SELECT o_orderpriority || '/' || o_orderstatus AS p FROM orders)
       WHERE contains(lower(p), 'i') GROUP BY p ORDER BY count DESC, value LIMIT 10""",
)
def nested_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names two arrays deep, those with the search text."""
    term = F.struct(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("humanName"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array(F.struct(F.collect_list(term).alias("terms"))).alias("featureSets"))
    return a.nested_facet(rows, "featureSets", "terms", "humanName", "I")


@query(
    "regroup",
    """SELECT o_custkey AS id, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS items FROM orders GROUP BY o_custkey""",
)
def regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25."""
    rows = a.regrouped(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], "grid")
    return rows.select(F.col("o_custkey").alias("id"), F.size("grid").cast("long").alias("n"), F.array_join(F.transform("grid", lambda x: x["o_orderkey"].cast("string")), ",").alias("items"))


_V = "CAST(embedding AS DOUBLE[])"


@query(
    "knn_euclid",
    f"""SELECT vec_id, round(list_distance({_V}, (SELECT {_V} FROM embeddings WHERE vec_id = 0)), 6) AS distance
        FROM embeddings ORDER BY list_distance({_V}, (SELECT {_V} FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 25""",
)
def knn_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 V4: one query, the row of the first id."""
    rows = table(spark, sf_dir, "embeddings")
    first = rows.where("vec_id = 0").select("embedding").first()[0]
    return v.nearest(rows, "vec_id", "embedding", first, 25).select("vec_id", F.round("distance", 6).alias("distance"))


@query(
    "knn_cosine",
    f"""WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings),
        d AS (SELECT q.vec_id AS query, e.vec_id, 1 - list_cosine_similarity(q.v, e.v) AS distance FROM e q, e WHERE q.vec_id % 50 = 0)
        SELECT query, vec_id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) <= 10""",
)
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 V4: a set of queries against all rows, in blocks."""
    rows = table(spark, sf_dir, "embeddings")
    return v.nearest_of_each(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("query", "vec_id", F.round("distance", 6).alias("distance"))


@query(
    "minmax_scale",
    f"""WITH e AS (SELECT vec_id, unnest({_V}) AS x, generate_subscripts({_V}, 1) AS i FROM embeddings),
        m AS (SELECT i, min(x) AS lo, max(x) AS hi FROM e GROUP BY i)
        SELECT vec_id, round(sum((x - lo) / (hi - lo)), 6) AS total, round(max((x - lo) / (hi - lo)), 6) AS most FROM e JOIN m USING (i) GROUP BY vec_id""",
)
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1."""
    rows = v.min_max(table(spark, sf_dir, "embeddings"), "embedding")
    return rows.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.array_max("embedding"), 6).alias("most"))


@query(
    "unit_sphere",
    f"SELECT vec_id, round({_V}[1] / sqrt(list_dot_product({_V}, {_V})), 8) AS first FROM embeddings",
)
def unit_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(v.on_sphere(F.col("embedding")), F.lit(0)), 8).alias("first"))


@query(
    "scaled_features",
    """WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
       SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 8) AS scaled, (p_size + p_size * 2) / 2.0 AS cyan FROM part, m""",
)
def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5."""
    rows = v.scaled_columns(table(spark, sf_dir, "part"), ["p_retailprice"])
    rows = v.with_inks(rows.withColumns({"r": F.col("p_size") * 3, "g": F.col("p_size"), "b": F.col("p_size") * 2}), "r", "g", "b")
    return rows.select("p_partkey", F.round("p_retailprice", 8).alias("scaled"), "cyan")


@query(
    "messy_metrics",
    """WITH m AS (SELECT l_returnflag AS k, l_orderkey % 7 AS o, l_quantity AS q, l_linenumber AS i FROM lineitem),
       v AS (SELECT k, CASE WHEN o = 0 THEN NULL WHEN o = 1 THEN NULL ELSE q END AS x, CASE WHEN o = 0 THEN NULL ELSE i END AS tag FROM m),
       e AS (SELECT DISTINCT k, unnest(CASE WHEN o = 0 THEN [] WHEN o = 1 THEN [NULL, i] ELSE [i, i + 1] END) AS t FROM m),
       c AS (SELECT k, CAST(count(*) AS DOUBLE) AS tags FROM e GROUP BY k)
       SELECT k, count(*) AS count, round(coalesce(sum(x), 0), 4) AS total, round(coalesce(avg(x), 0), 6) AS mean, coalesce(min(x), 0) AS low, coalesce(max(x), 0) AS high, round(coalesce(median(x), 0), 6) AS middle,
       count(x) AS n, CAST(count(DISTINCT tag) + max(CASE WHEN tag IS NULL THEN 1 ELSE 0 END) AS DOUBLE) AS kinds, any_value(c.tags) AS tags FROM v JOIN c USING (k) GROUP BY k""",
)
def messy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with blanks, text that is no number, nulls, arrays, a metric that is none."""
    o = F.col("l_orderkey") % 7
    number = F.when(o == 0, F.lit(None)).when(o == 1, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string"))
    key = F.when(o < 3, F.concat(F.lit(" "), "l_returnflag")).otherwise(F.concat(F.col("l_returnflag"), F.lit("\t ")))
    i = F.col("l_linenumber").cast("int")
    tags = F.when(o == 0, F.array().cast("array<int>")).when(o == 1, F.array(F.lit(None).cast("int"), i)).otherwise(F.array(i, i + 1))
    rows = table(spark, sf_dir, "lineitem").select(key.alias("k"), number.alias("x"), F.when(o != 0, i).alias("tag"), tags.alias("tags"))
    m = a.metric
    out = a.terms(rows, ["k"], m("sum", "x", "total"), m("avg", "x", "mean"), m("min", "x", "low"), m("max", "x", "high"), m("median", "x", "middle"), m("count", "x", "n"), m("cardinality", "tag", "kinds", nulls=True), m("no_such", "x", "none"))
    out = out.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6), "middle": F.round("middle", 6)})
    return out.join(a.cardinality(rows, ["k"], "tags", "tags"), "k")


@query(
    "capped_listing",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000",
)
def capped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing has at most 1000 rows; the cap is the feature."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return s.listed(rows, s.order_by(rows, [("o_totalprice", "desc")], ["o_orderkey"])).select("o_orderkey")


@query(
    "case_precedence",
    """SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice >= 100000 AND o_totalprice < 200000 WHEN o_orderkey % 4 = 1 THEN o_orderstatus = 'F' WHEN o_orderkey % 4 = 2 THEN o_orderstatus IN ('P', 'O') ELSE true END""",
)
def case_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a range before a term, a term before a filter, and an empty case, each over a quarter of the rows."""
    status, price, part = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderkey") % 4
    cases = [
        p.case(term=p.equal(status, "F"), range=p.within_range(price, 100000, 200000)),
        p.case(filter=p.equal(status, "P"), term=p.equal(status, "F")),
        p.case(filter=p.within_list(status, "P, O")),
        p.case(),
    ]
    rows = table(spark, sf_dir, "orders")
    return rows.where(p.one_of(*[p.all_of(p.flag(part == i), c) for i, c in enumerate(cases)]).filter).select("o_orderkey")


_MESSY = "CASE WHEN l_linenumber % 4 = 0 THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS a, l_linenumber % 3 AS b"


def _messy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a text field that is a number or none, and one that is 0 in every third line."""
    text = F.when(F.col("l_linenumber") % 4 == 0, "n/a").otherwise(F.col("l_quantity").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", text.alias("a"), (F.col("l_linenumber") % 3).alias("b"))


@query(
    "faulty_scripts",
    f"""WITH m AS (SELECT l_returnflag, TRY_CAST(a AS DOUBLE) / nullif(b, 0) AS r, b, TRY_CAST(a AS DOUBLE) AS x FROM (SELECT l_returnflag, {_MESSY} FROM lineitem) y)
       SELECT l_returnflag, count(*) AS count, count(*) FILTER (r > 10 OR l_returnflag = 'N') AS n_match, round(10 + sum(r), 4) AS total, round((10 + sum(r)) / count(r), 8) AS mean, round(min(r), 8) AS low, CAST(count(r) AS DOUBLE) AS n,
         CAST(0 AS DOUBLE) AS nothing, round(count(*) / (10 + sum(r)), 8) AS share, round(sum(3 + coalesce(r, 0) * 0.5 + CASE WHEN b = 2 THEN 7 ELSE 0 END + coalesce(x, 0)), 2) AS score
       FROM m GROUP BY l_returnflag""",
)
def faulty_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User code that fails in some rows, in conditions, scores, metrics and over buckets."""
    cond = expression("a / b > 10 OR levenshtein(l_returnflag, 'N') = 0")
    score = modified(F.lit(2.0), [("a / b", 0.5), ("7 + log(b - 1)", 1.0), ("a", 1.0), ("sqrt(0 - 1)", 3.0)], "sum")
    rows = _messy_lines(spark, sf_dir).withColumns({"hit": cond.match.cast("int"), "score": score})
    code = "a / b"
    made = a.terms(rows, ["l_returnflag"], F.sum("hit").alias("n_match"), a.scripted(code, "sum", "total", 10), a.scripted(code, "avg", "mean", 10), a.scripted(code, "min", "low"), a.scripted(code, "count", "n"), F.sum("score").alias("score"))
    out = a.bucket_scripts(made, ("nothing", "n / (m - m)", {"n": "count", "m": "count"}), ("share", "n / t + gone", {"n": "count", "t": "total", "gone": "none"}))
    return out.withColumns({c: F.round(c, d) for c, d in (("total", 4), ("mean", 8), ("low", 8), ("share", 8), ("score", 2))})


@query(
    "messy_buckets",
    f"""WITH m AS (SELECT l_orderkey, {_MESSY} FROM lineitem), x AS (SELECT *, TRY_CAST(a AS DOUBLE) AS v FROM m)
       SELECT 'range' AS kind, key, count(v) AS count, CAST(coalesce(round(sum(v), 4), 0) AS DOUBLE) AS total FROM (VALUES ('low', 0, 10), ('high', 10, 1e18), ('none', -5, -1)) k(key, f, t) LEFT JOIN x ON v >= f AND v < t GROUP BY key
       UNION ALL SELECT 'facet', CAST(b AS VARCHAR), count(*), 0 FROM x GROUP BY b
       UNION ALL SELECT 'nested', CAST(l_orderkey % 10 AS VARCHAR), 0, coalesce(round(sum(v), 4), 0) FROM x GROUP BY l_orderkey % 10""",
)
def messy_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is no number, and values with any white space at their ends."""
    rows = _messy_lines(spark, sf_dir)
    ranges = a.ranges(rows, "a", [("low", 0, 10), ("high", 10, 0), ("none", -5, -1)], a.metric("sum", "a", "total"))
    padded = rows.select(F.concat(F.element_at(F.array(F.lit(""), F.lit(" "), F.lit("\t"), F.lit("\n ")), (F.col("l_orderkey") % 4 + 1).cast("int")), F.col("b").cast("string"), F.lit("\t")).alias("b"))
    held = rows.groupBy("l_orderkey").agg(F.collect_list(F.struct("a")).alias("lines")).withColumn("bucket", (F.col("l_orderkey") % 10).cast("string"))
    nested = a.nested_metric(held, ["bucket"], "lines", "a", "sum", "total")
    parts = [
        ranges.select(F.lit("range").alias("kind"), "key", "count", "total"),
        a.facets(padded, ["b"]).select(F.lit("facet").alias("kind"), F.col("value").alias("key"), "count", F.lit(0.0).alias("total")),
        nested.select(F.lit("nested").alias("kind"), F.col("bucket").alias("key"), F.lit(0).cast("long").alias("count"), "total"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("total", F.round("total", 4))


@query(
    "rank_metrics",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS middle, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.001), 6) AS low,
       max(l_extendedprice) AS top FROM lineitem GROUP BY l_returnflag""",
)
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ranks of groups that are no one task's."""
    out = percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"middle": 50, "p90": 90, "low": 0.1, "top": 100})
    return out.withColumns({c: F.round(c, 6) for c in ("middle", "p90", "low")})
