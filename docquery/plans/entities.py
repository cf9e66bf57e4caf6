"""Source, projection, listing and access queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquery.functions import fields as fx
from docquery.operators import aggregations as a, carbon as c, entities as e, joins, predicates as p, search as s
from docquery.operators import trees
from docquery.plans.registry import query, spread_table, table
from docquery.session import shared_dir
from docquery.sources import documents as src


@query("decoded_documents", "SELECT CAST(o_orderkey AS INT) AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 3")
def decoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base64 JSON, a tenth of it no JSON, which is kept apart."""
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    text = F.when(F.col("o_orderkey") % 10 == 3, F.lit("{no json")).otherwise(body)
    return src.decoded(table(spark, sf_dir, "orders").select(F.base64(text.cast("binary")).alias("name")), "name", "id int, status string")[0]


@query("composite_scan", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def composite_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written by its composite key, and one key's partition read."""
    place = shared_dir(spark)
    fields = ("o_orderstatus", "o_orderpriority")
    definitions = spark.createDataFrame([("by_state", "order", place, list(fields)), ("other", "customer", "", [])], "id string, entity string, path string, fields array<string>")
    e.composite_key(table(spark, sf_dir, "orders"), list(fields)).repartition("composite_key").write.partitionBy("composite_key").parquet(place)
    known = {r.id: src.Index(r.path, tuple(r.fields), r.entity) for r in src.indexes_of(definitions, "order").collect()}
    return src.scan(spark, known, "by_state", {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey")


@query("numbers_round_trip", "SELECT round(CAST(embedding[1] AS DOUBLE), 6) AS a, round(CAST(embedding[2] AS DOUBLE), 6) AS b FROM embeddings")
def numbers_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed decimals as CSV, read again as a matrix."""
    place = shared_dir(spark)
    src.write_numbers(table(spark, sf_dir, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b")), place)
    return src.matrix(spark, place, 2).select(F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))


@query("stored_entities", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def stored_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzipped JSON, and the rows of a table of ids."""
    place = shared_dir(spark)
    src.write_json(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), place, compressed=True)
    ids = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return src.by_ids(src.read_entities(spark, place, "c_custkey long, c_mktsegment string"), "c_custkey", ids)


@query("timestamps_detected", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS made_ts FROM orders")
def timestamps_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is a time becomes one, other text does not."""
    made = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.col("o_orderpriority"))
    return e.with_timestamps(table(spark, sf_dir, "orders").select("o_orderkey", made.alias("Made"))).select("o_orderkey", F.col("made_ts").cast("timestamp_ntz").alias("made_ts"))


@query("dotted_projection", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE CAST(o_custkey AS VARCHAR) || '.5' END AS customer FROM orders")
def dotted_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested number as text under its dotted name, the array left out."""
    number = F.col("o_custkey") + F.when(F.col("o_custkey") % 2 == 0, 0.0).otherwise(0.5)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(number.alias("key")).alias("customer"), F.array("o_orderkey").alias("heavy"))
    return s.project(rows, ["o_orderkey", "customer.key", "heavy"]).withColumnsRenamed({"customer.key": "customer"})


@query("unwrapped_hits", "SELECT o_orderkey, o_orderstatus FROM orders")
def unwrapped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed search responses, a page for each customer."""
    hit = F.struct(F.struct("o_orderkey", "o_orderstatus").alias("_source"))
    pages = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.struct(F.collect_list(hit).alias("hits")).alias("hits"))
    return fx.unwrapped(pages, "hits.hits", "_source")


@query("landed_index", "SELECT s_name AS name, CASE WHEN s_suppkey % 5 <> 4 THEN CAST(s_suppkey * 3 AS INT) END AS percent FROM supplier")
def landed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with text fields, two for each region, one of them with a percent that is none."""
    key = F.col("s_suppkey")
    def reply(percent, day):
        return F.to_json(F.struct(F.col("s_name").alias("ba"), percent.cast("string").alias("percent"), F.lit("1.5").alias("moer"), F.lit(f"2024-01-0{day}T00:00:00Z").alias("point_time")))

    rows = table(spark, sf_dir, "supplier")
    bodies = rows.select(F.explode(F.array(reply(key, 1), reply(F.when(key % 5 != 4, key * 3).cast("string"), 2))).alias("body"))
    regions = rows.select(F.col("s_name").alias("ba"), F.col("s_name").alias("name"))
    return c.current_index(regions, src.landed_index(bodies, "body")).select("name", "percent")


@query("landed_emissions", "SELECT c_custkey, c_name AS location, CAST(c_custkey AS DOUBLE) + 0.5 AS rating FROM customer WHERE c_custkey % 3 <> 0")
def landed_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first element of each response, none from an empty one."""
    one = F.struct(F.col("c_name").alias("location"), (F.col("c_custkey") + 0.5).cast("double").alias("rating"))
    body = F.when(F.col("c_custkey") % 3 != 0, F.to_json(F.array(one, one))).otherwise(F.lit("[]"))
    return src.landed_emissions(table(spark, sf_dir, "customer").select("c_custkey", body.alias("body")), "body")


@query("attribute_kinds", "SELECT l_orderkey AS id, 'line' AS name, CAST(l_linenumber AS VARCHAR) AS value, CAST(l_orderkey % 3 AS INT) AS kind FROM lineitem WHERE l_orderkey % 3 <> 2")
def attribute_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes with the kind that their listing's type gives them; a type that is not known gives none."""
    row = F.struct(F.lit("line").alias("name"), F.col("l_linenumber").cast("string").alias("value"))
    ads = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(row).alias("attributes")).withColumn("type_id", F.col("id") % 3)
    types = ads.where("type_id < 2").select("type_id").distinct().select(F.col("type_id").alias("id"), F.array(F.struct(F.lit("line").alias("name"), F.col("type_id").cast("int").alias("type"))).alias("attributes"))
    return joins.attribute_filters(ads, types).select("id", "name", "value", "kind")


@query("listings_prepared", "SELECT c_custkey AS id, 2 AS n_attributes, CAST(c_nationkey AS INT) AS number, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS n_terms FROM customer")
def listings_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 L2 L3 L4: attributes and terms as leaves, typed, the selected terms only."""
    def leaf(kind, value):
        return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))

    none = F.array().cast("array<struct<type: int, value: string>>")
    tree = F.array(F.struct(F.lit(2).alias("type"), F.lit("").alias("value"), F.array(leaf(0, F.col("c_nationkey"))).alias("attributes")), F.struct(F.lit(1).alias("type"), F.col("c_name").alias("value"), none.alias("attributes")))
    term = F.struct(F.col("c_mktsegment").alias("humanName"), (F.col("c_nationkey") % 2 == 0).alias("selected"))
    sets = F.array(F.struct(F.lit("s").alias("id"), F.array(F.struct(F.lit("top").alias("humanName"), F.lit(False).alias("selected"), F.array(term).alias("terms"))).alias("terms")))
    rows = e.listing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), tree.alias("attributes"), sets.alias("featureSets")))
    return rows.select("id", F.size("attributes").alias("n_attributes"), F.get("attributes", F.lit(0))["intValue"].alias("number"), F.size(F.get("featureSets", F.lit(0))["terms"]).alias("n_terms"))


@query("owned_or_granted", "SELECT c_custkey FROM customer WHERE c_custkey % 6 = 1 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000)")
def owned_or_granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that user 1 owns or has a grant to write."""
    rich = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 300000")
    grants = rich.select(F.lit("1").alias("user"), F.lit(1).alias("type"), F.col("o_custkey").alias("resource"), F.lit("customer").alias("asset"), F.lit(2).alias("op"))
    rows = table(spark, sf_dir, "customer").withColumn("userId", (F.col("c_custkey") % 6).cast("string"))
    return e.writable(rows, "1", "userId", "c_custkey", grants, 1, "customer", 2).select("c_custkey")


@query("named_pages", "SELECT page_id FROM pages WHERE url LIKE 'https://%' AND page_id IN (1, 2, 3, 5, 8, 13, 21, 34)")
def named_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of names, and a prefix."""
    return s.matched(table(spark, sf_dir, "pages"), p.all_of(p.starts_with(F.col("url"), "https://"), p.within_list(F.col("page_id"), [1, 2, 3, 5, 8, 13, 21, 34]))).select("page_id")


@query(
    "aggregation_bundle",
    """SELECT 'status' AS name, o_orderstatus AS key, count(*) AS count FROM orders WHERE o_totalprice > 100000 GROUP BY ALL
       UNION ALL SELECT 'year', strftime(o_orderdate, '%Y'), count(*) FROM orders WHERE o_totalprice > 100000 GROUP BY ALL""",
)
def aggregation_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two named aggregations of one search, which then has no hits."""
    named = {"status": lambda d: a.terms(d, ["o_orderstatus"]).withColumnRenamed("o_orderstatus", "key"), "year": lambda d: a.date_histogram(d, "o_orderdate", "year")}
    found = s.search([(table(spark, sf_dir, "orders"), p.compare(F.col("o_totalprice"), "gt", 100000.0))], s.Controls(aggregations=named))
    return s.union_all([d.select(F.lit(n).alias("name"), "key", "count") for n, d in found.aggregations.items()])


@query("report_lookup", "SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the first match of a small table."""
    lookup = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.first_match(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), lookup, "c_nationkey", "n_name").select("c_custkey", "n_name", "n_regionkey")


_CHAIN = "o_orderkey % 9"


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trees of up to nine levels: each level has a leaf and the next level, named by its depth and the order."""
    depth = (F.col("o_orderkey") % 9).cast("int")
    opened = F.transform(F.sequence(F.lit(0), depth), lambda i: F.concat(F.lit('{"name": "n'), i.cast("string"), F.lit('", "value": '), (F.col("o_orderkey") % 4 + i).cast("string"), F.lit(', "attributes": [{"name": "leaf'), i.cast("string"), F.lit('", "value": 1}, ')))
    text = F.concat(F.array_join(opened, ""), F.lit('{"name": "end", "value": "none"}'), F.repeat(F.lit("]}"), depth + 1))
    return spread_table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(text).alias("tree"))


@query(
    "deep_leaves",
    f"""SELECT o_orderkey, '0' || repeat('.1', CAST(i AS INT)) || '.0' AS path, 'leaf' || CAST(i AS VARCHAR) AS name FROM (SELECT o_orderkey, unnest(range(0, {_CHAIN} + 1)) AS i FROM orders)
        UNION ALL SELECT o_orderkey, '0' || repeat('.1', CAST({_CHAIN} + 1 AS INT)), 'end' FROM orders""",
)
def deep_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 L3: leaves of trees whose depth is in the data, not in the type."""
    found = trees.leaves(_chains(spark, sf_dir), "o_orderkey", F.col("tree"), "attributes")
    return found.select("o_orderkey", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), F.try_variant_get("node", "$.name", "string").alias("name"))


@query(
    "deep_contract",
    f"""WITH n AS (SELECT o_orderkey, i, o_orderkey % 4 + i AS v FROM (SELECT o_orderkey, unnest(range(0, {_CHAIN} + 1)) AS i FROM orders))
        SELECT o_orderkey, '0' || repeat('.1', CAST(i AS INT)) AS path FROM n WHERE v > 7
        UNION ALL SELECT o_orderkey, '0' || repeat('.1', CAST({_CHAIN} + 1 AS INT)) FROM orders""",
)
def deep_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract that refers to itself, broken at any depth by a number that is too large or is none."""
    contract = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "value": {"type": "number", "maximum": 7}}}
    return trees.tree_errors(_chains(spark, sf_dir), "o_orderkey", F.col("tree"), "attributes", lambda n: e.contract_errors(n, contract)).select("o_orderkey", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"))
