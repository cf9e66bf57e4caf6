"""Search, predicate, subquery and listing queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquery.functions import fields as fx, geo
from docquery.operators import joins, predicates as p, search as s
from docquery.operators import places
from docquery.plans.registry import query, table


@query(
    "filter_term_range_page",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10""",
)
def filter_term_range_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 F7 F11 O1 O4 P3."""
    cond = p.boolean(All=[p.equal(F.col("o_orderstatus"), "F"), p.within_range(F.col("o_totalprice"), 1000)])
    controls = s.Controls(sorts=[("o_totalprice", "desc")], tiebreak=["o_orderkey"], source=["o_orderkey", "o_orderstatus", "o_totalprice"], offset=10, limit=50)
    return s.search([(table(spark, sf_dir, "orders"), cond)], controls).hits.drop("_score")


@query(
    "total_hits",
    "SELECT count(*) AS total_hits FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice < 200000",
)
def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 F14 O5."""
    cond = p.within_list(F.col("o_orderstatus"), "O, P")
    return s.search([(table(spark, sf_dir, "orders"), cond)], s.Controls(post_filter=p.compare(F.col("o_totalprice"), "lt", 200000.0))).total


@query(
    "bool_none_not",
    """SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 150000)
       AND NOT (o_orderpriority LIKE '1%') AND o_orderpriority <> '5-LOW'""",
)
def bool_none_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None of two, not the first, and a not-equal."""
    none = p.boolean(None_=[p.equal(F.col("o_orderstatus"), "F"), p.compare(F.col("o_totalprice"), "gt", 150000.0)])
    negated = p.boolean(Not=[p.starts_with(F.col("o_orderpriority"), "1"), p.exists(F.col("o_orderkey"))])
    return s.matched(table(spark, sf_dir, "orders"), p.boolean(All=[none, negated, p.not_equal(F.col("o_orderpriority"), "5-LOW")])).select("o_orderkey")


_PROPS = "try_cast(json_extract_string(props, '$.k') AS BIGINT)"


@query(
    "exists_missing",
    f"""SELECT event_id, {_PROPS} IS NOT NULL AS has_k, json_extract_string(props, '$.absent') IS NULL AS no_absent,
        CAST({_PROPS} AS VARCHAR) AS k FROM events""",
)
def exists_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths into free-form documents."""
    doc = table(spark, sf_dir, "events").withColumn("doc", F.try_parse_json("props"))
    has, no = p.exists(fx.raw_at(F.col("doc"), "k")), p.missing(fx.raw_at(F.col("doc"), "absent"))
    return doc.select("event_id", has.match.alias("has_k"), no.match.alias("no_absent"), fx.text_at(F.col("doc"), "k").alias("k"))


@query(
    "contains_prefix_in",
    """SELECT c_custkey, c_mktsegment FROM customer WHERE contains(c_name, '1') AND ends_with(c_mktsegment, 'Y')
       AND c_nationkey IN (1, 3, 5, 7, 9) AND c_mktsegment NOT IN ('BUILDING')""",
)
def contains_prefix_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 F4 F5."""
    conds = [p.contains(F.col("c_name"), "1"), p.ends_with(F.col("c_mktsegment"), "Y"), p.within_list(F.col("c_nationkey"), [1, 3, 5, 7, 9]), p.not_within_list(F.col("c_mktsegment"), "BUILDING")]
    return s.matched(table(spark, sf_dir, "customer"), p.all_of(*conds)).select("c_custkey", "c_mktsegment")


@query(
    "text_comparison",
    """SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'
       AND try_cast(json_extract_string(props, '$.k') AS DOUBLE) >= 20""",
)
def text_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and numbers that are text."""
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.get_json_object("props", "$.k").alias("k"))
    conds = p.all_of(p.within_range(F.col("at"), "2024-01-10", "1/20/2024", text=True), p.compare(F.col("k"), "gte", "20", text=True))
    return s.matched(rows, conds).select("event_id")


@query("expression_condition", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 40000 AND l_quantity < 45")
def expression_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User code in Spark SQL."""
    return s.matched(table(spark, sf_dir, "lineitem"), p.expression("l_extendedprice * (1 - l_discount) > 40000 AND l_quantity < 45")).select("l_orderkey", "l_linenumber")


@query(
    "number_text",
    """SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole, CASE WHEN o_custkey % 7 = 0 THEN 0.0 ELSE o_totalprice / (o_custkey % 7) END AS ratio FROM orders""",
)
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical number text and safe arithmetic."""
    return table(spark, sf_dir, "orders").select("o_orderkey", fx.number_text(F.floor("o_totalprice").cast("double")).alias("whole"), fx.div(F.col("o_totalprice"), F.col("o_custkey") % 7).alias("ratio"))


@query("semi_subquery", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def semi_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1."""
    return joins.in_subquery(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity") > 48).select("o_orderkey")


@query("anti_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    return joins.not_in_subquery(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F").select("c_custkey")


@query(
    "existence_or",
    """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
       OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR c_acctbal < 0""",
)
def existence_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subqueries under One."""
    rows = joins.with_flag(table(spark, sf_dir, "customer"), "rich", "c_custkey", table(spark, sf_dir, "orders"), "o_custkey", F.col("o_totalprice") > 400000)
    rows = joins.with_flag(rows, "near", "c_nationkey", table(spark, sf_dir, "nation"), "n_nationkey", F.col("n_regionkey") == 1)
    return s.matched(rows, p.boolean(One=[p.flag(F.col("rich")), p.flag(F.col("near")), p.compare(F.col("c_acctbal"), "lt", 0)])).select("c_custkey")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array of structs."""
    line = F.struct("l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))


@query(
    "nested_any",
    "SELECT l_orderkey, max(l_quantity) AS best FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 GROUP BY l_orderkey",
)
def nested_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any element matches, the best score counts."""
    def line(x):
        return p.Cond.of((x["l_returnflag"] == "R") & (x["l_quantity"] >= 45), x["l_quantity"])

    return s.matched(order_documents(spark, sf_dir), p.nested_any(F.col("lines"), line)).select("l_orderkey", F.col("_score").alias("best"))


@query(
    "union_all_search",
    """SELECT * FROM (SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000) ORDER BY price DESC, id LIMIT 200""",
)
def union_all_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No duplicates are dropped."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    queries = [(rows, p.equal(F.col("o_orderstatus"), "F")), (rows, p.compare(F.col("price"), "gt", 200000.0))]
    return s.search(queries, s.Controls(sorts=[("price", "desc")], tiebreak=["id"], limit=200)).hits.select("id", "price")


@query(
    "access_filter",
    """SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3 OR c_nationkey = 3 OR c_custkey % 11 = 0""",
)
def access_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user 3 in one of the lists, or a page for everyone."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    read = F.array((key % 10).cast("string"), F.when(key % 11 == 0, "*").otherwise("-"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", read.alias("r"), F.array(nation.cast("string")).alias("w"), F.array().cast("array<string>").alias("d"))
    return s.matched(rows, p.readable("3", F.col("r"), F.col("w"), F.col("d"), public=True)).select("c_custkey")


@query(
    "score_modifiers",
    """SELECT o_orderkey, round(2.0 * (CASE WHEN o_custkey % 3 = 0 THEN 1.5 * o_custkey ELSE o_totalprice * 0.001 * 1.5 * o_custkey END), 2) AS product,
       round(2.0 + 1 + o_totalprice * 0.001, 6) AS total FROM orders WHERE o_orderstatus = 'P'""",
)
def score_modifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product whose running 0 gives way, and a sum that starts at 1."""
    from docquery.operators.relevance import modified

    first = F.when(F.col("o_custkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice"))
    functions = [(first, 0.001), (F.expr("cast(null as double)"), 5.0), (F.expr("o_custkey"), 1.5)]
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return rows.select("o_orderkey", F.round(modified(F.lit(2.0), functions), 2).alias("product"), F.round(modified(F.lit(2.0), [(F.col("o_totalprice"), 0.001), functions[1]], "sum"), 6).alias("total"))


_POINT = "CAST(event_id % 170 - 85 AS DOUBLE) AS lat, CAST((event_id * 7) % 360 - 180 AS DOUBLE) AS lon"
_KM = "6371.0 * 2 * atan2(sqrt({a}), sqrt(1 - {a}))"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", (e % 170 - 85).cast("double").alias("lat"), ((e * 7) % 360 - 180).cast("double").alias("lon"))


@query(
    "geo_radius",
    f"""WITH pts AS (SELECT event_id, {_POINT} FROM events),
        a AS (SELECT *, pow(sin(radians(lat - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(lat)) * pow(sin(radians(lon + 74.0) / 2), 2) AS a FROM pts)
        SELECT event_id, round({_KM.format(a="a")}, 6) AS km FROM a WHERE {_KM.format(a="a")} <= 2500""",
)
def geo_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1 G2 G6."""
    pts = _points(spark, sf_dir).withColumn("place", F.struct("lat", "lon"))
    lat, lon = geo.point_of_struct(F.col("place"))
    return pts.where(geo.within(lat, lon, (40.0, -74.0), 2500)).select("event_id", F.round(geo.haversine(40.0, -74.0, lat, lon), 6).alias("km"))


@query(
    "geo_polygon",
    f"""WITH pts AS (SELECT event_id, {_POINT} FROM events)
        SELECT event_id FROM pts WHERE lat > -10 AND lat < 30 AND lon > 0.5 AND lon < 60.5""",
)
def geo_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box and a polygon of two points, which holds nothing; points from "lat,lon" text."""
    pts = _points(spark, sf_dir).withColumn("text", F.concat_ws(", ", "lat", "lon"))
    lat, lon = geo.point_of_text(F.col("text"))
    box = [(-10.5 + 0.5 + 1e-9, 0.5), (-10.5 + 0.5 + 1e-9, 60.5), (30.0 - 1e-9, 60.5), (30.0 - 1e-9, 0.5)]
    return pts.where(geo.inside_any(lat, lon, [box, [(0.0, 0.0), (1.0, 1.0)]])).select("event_id")


@query(
    "geo_line",
    f"""WITH pts AS (SELECT event_id, {_POINT} FROM events),
        a AS (SELECT event_id, pow(sin(radians(lat - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(lat)) * pow(sin(radians(lon - 20.0) / 2), 2) AS a,
          pow(sin(radians(lat - 30.0) / 2), 2) + cos(radians(30.0)) * cos(radians(lat)) * pow(sin(radians(lon - 50.0) / 2), 2) AS b FROM pts)
        SELECT event_id FROM a WHERE least({_KM.format(a="a")}, {_KM.format(a="b")}) <= 1500""",
)
def geo_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the original formula the distance to each segment's start, the last point of the line not among them."""
    return _points(spark, sf_dir).where(geo.near_line(F.col("lat"), F.col("lon"), [(10.0, 20.0), (30.0, 50.0), (60.0, 100.0)], 1500)).select("event_id")


@query(
    "listing_search",
    """SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey % 5 = 2 GROUP BY l_orderkey
       HAVING bool_or(l_returnflag = 'R') AND bool_or(l_linenumber = 3)""",
)
def listing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, an attribute by text, another by number."""
    a = F.array(
        F.struct(F.lit("flag").alias("name"), F.col("l_returnflag").alias("value"), F.lit(0).alias("intValue")),
        F.struct(F.lit("line").alias("name"), F.lit("").alias("value"), F.col("l_linenumber").alias("intValue")),
    )
    ads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.explode(a).alias("a")).groupBy("id").agg(F.collect_list("a").alias("attributes"))
    ads = ads.withColumn("typeId", (F.col("id") % 5).cast("string"))
    cond = p.listing("2", F.col("typeId"), F.col("attributes"), {"flag": ["R"], "line": [3]})
    return s.matched(ads, cond).select("id", (F.size("attributes") / 2).cast("long").alias("n"))


@query(
    "mixed_text_sort",
    """SELECT event_id, k, row_number() OVER (ORDER BY k IS NOT NULL, try_cast(k AS DOUBLE) IS NULL, try_cast(k AS DOUBLE) NULLS FIRST, k NULLS FIRST, event_id) AS place
       FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN event_type ELSE CAST(event_id % 50 AS VARCHAR) END AS k FROM events)
       ORDER BY place LIMIT 500""",
)
def mixed_text_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: missing first, then numbers as numbers, then text; the place is the page's own row order."""
    from pyspark.sql import Window

    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(e % 5 == 1, F.col("event_type")).when(e % 5 != 0, (e % 50).cast("string")).alias("k"))
    order = s.order_by(rows, [("k", "asc")], ["event_id"])
    top = s.page(rows, order, limit=500)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


_FAR = "12742 * atan2(sqrt(h), sqrt(1 - h))"


@query(
    "geo_shapes",
    f"""WITH pts AS (SELECT event_id, {_POINT} FROM events), s AS (SELECT s_suppkey AS k, CAST(s_suppkey * 7 % 140 - 70 AS DOUBLE) AS a, CAST(s_suppkey * 37 % 330 - 165 AS DOUBLE) AS b FROM supplier),
        met AS (SELECT event_id, k, lat, lon, a, b, pow(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin(radians(lon - b) / 2), 2) AS h FROM pts, s)
        SELECT event_id, 'c' || CAST(k AS VARCHAR) AS shape FROM met WHERE {_FAR} <= 250 + k % 5 * 100 AND lat BETWEEN a - 8 AND a + 8
        UNION ALL SELECT event_id, 'p' || CAST(k AS VARCHAR) FROM met WHERE abs(lat - a) / 5.3 + abs(lon - b) / 7.7 < 1
        UNION ALL SELECT event_id, 'l' || CAST(k AS VARCHAR) FROM met WHERE k % 3 = 0 AND {_FAR} <= 333""",
)
def geo_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points in a table of circles, polygons and lines; two vertices make no polygon."""
    k, a, b = F.col("s_suppkey"), (F.col("s_suppkey") * 7 % 140 - 70).cast("double"), (F.col("s_suppkey") * 37 % 330 - 165).cast("double")
    at = lambda north, east: F.struct((a + north).alias("lat"), (b + east).alias("lon"))
    shape = lambda letter, kind, points, km: F.struct(F.concat(F.lit(letter), k).alias("shape"), F.lit(kind).alias("kind"), F.array(*points).alias("points"), km.cast("double").alias("km"))
    made = [
        shape("c", "circle", [at(0, 0)], 250 + k % 5 * 100),
        shape("p", "polygon", [at(5.3, 0), at(0, 7.7), at(-5.3, 0), at(0, -7.7)], F.lit(None)),
        shape("q", "polygon", [at(50, 0), at(0, 90)], F.lit(None)),
        F.when(k % 3 == 0, shape("l", "line", [at(0, 0), at(3, 4)], F.lit(333))),
    ]
    shapes = table(spark, sf_dir, "supplier").select(F.inline(F.array_compact(F.array(*made))))
    return places.located(_points(spark, sf_dir), "event_id", "lat", "lon", shapes)


@query("piped_listing", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def piped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step of a listing gets what the one before it left, and one that gives nothing is skipped."""
    steps = [lambda d: d.where("o_orderstatus <> 'P'"), lambda d: None, lambda d: d.where("o_totalprice > 100000"), lambda d: s.listed(d, [F.desc("o_totalprice"), F.col("o_orderkey")])]
    return s.piped(table(spark, sf_dir, "orders"), *steps).select("o_orderkey", "o_orderstatus")
