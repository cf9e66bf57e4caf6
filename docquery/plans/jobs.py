"""Carbon, entity, access and streaming jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquery.functions import fields as fx
from docquery.operators import carbon as c, entities as e, joins, predicates as p
from docquery.operators.search import Hooks
from docquery.plans.registry import query, table
from docquery.session import shared_dir
from docquery.sources import documents as src, snapshots as sn
from docquery.streaming import jobs as streams

#: Regions and intensities that the rendered usage lines carry.
GRID = {"eastus": 400, "norway": 30, "westeurope": 250}


def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as usage lines: two lines a batch, the second with the headers of half of the calls."""
    ev = table(spark, sf_dir, "events")
    ms = F.floor(F.abs("value") * 1000).cast("int")
    first = F.concat(F.lit("REPORT RequestId: "), F.col("event_id"), F.lit(" Duration: "), ms, F.lit(".4 ms Billed Duration: "), ms + 1, F.lit(" ms Memory Size: 512 MB Max Memory Used: 90 MB"))
    head = F.concat(F.lit(" X-Grid-REGIONS: " + ",".join(GRID) + " X-Grid-INTENSITIES: " + ",".join(str(v) for v in GRID.values()) + " X-Grid-REGION: norway"))
    second = F.concat(F.lit("REPORT RequestId: "), F.col("event_id"), F.lit(" Function: "), F.col("event_type"), F.lit(" Path: /x UserId: null"), F.when(F.col("event_id") % 2 == 0, head).otherwise(F.lit("")))
    return ev.select(F.col("event_id").alias("batch_id"), F.col("ts").cast("timestamp").alias("ts"), F.posexplode(F.array(first, second)).alias("line_no", "message"))


_MS = "CAST(floor(abs(value) * 1000) AS INT)"


@query(
    "carbon_records",
    f"""SELECT CAST(event_id AS VARCHAR) AS request_id, event_type AS function, {_MS} AS duration, {_MS} + 1 AS billed_duration, 512 AS memory_size,
        CASE WHEN event_id % 2 = 0 THEN 'norway' ELSE 'eastus' END AS region, event_id % 2 = 0 AS routed, CASE WHEN event_id % 2 = 0 THEN 3 END AS n_regions FROM events""",
)
def carbon_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 K2 K3."""
    made = c.with_region(c.records(usage_lines(spark, sf_dir)).withColumn("aws", F.lit("us-east-1")), "aws")
    return made.select("request_id", "function", "duration", "billed_duration", "memory_size", "region", "routed", F.when(F.col("grid").isNotNull(), F.size("grid")).alias("n_regions"))


@query(
    "carbon_counterfactual",
    f"""WITH r AS (SELECT event_id, floor({_MS} / 1000) % 60 AS s FROM events WHERE event_id % 2 = 0)
        SELECT CAST(event_id AS VARCHAR) AS request_id, region, region = 'norway' AS called, round(2.12 * s / 3600 * 512 / 1792, 10) AS electricity,
        round(2.12 * s / 3600 * 512 / 1792 * intensity, 8) AS carbon FROM r, (VALUES ('eastus', 400), ('norway', 30), ('westeurope', 250)) g(region, intensity)""",
)
def carbon_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 K5 J4 J6."""
    rows = c.actual_and_others(c.records(usage_lines(spark, sf_dir)).where("routed"))
    return rows.select("request_id", "region", "called", F.round("electricity", 10).alias("electricity"), F.round("carbon", 8).alias("carbon"))


@query(
    "best_region",
    """WITH grid AS (SELECT n_name AS region, CAST(n_nationkey AS DOUBLE) - 3 AS intensity, n_regionkey FROM nation),
       offers AS (SELECT r_name AS service, g.region, intensity FROM region JOIN grid g ON g.n_regionkey = r_regionkey),
       calls AS (SELECT DISTINCT r_name AS service, '/api/' || CAST(o_orderkey % 4 AS VARCHAR) AS path FROM region, orders)
       SELECT c.service, c.path, coalesce((SELECT o.region FROM offers o WHERE o.service = c.service AND o.intensity > 0 AND (c.path LIKE '/api/%' AND (o.intensity % 2 = 0 OR c.path = '/api/1'))
       ORDER BY o.intensity, o.region LIMIT 1), 'eastus') AS region FROM calls c""",
)
def best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even intensities serve all of /api, the others one path."""
    grid = table(spark, sf_dir, "nation").select(F.col("n_name").alias("region"), (F.col("n_nationkey").cast("double") - 3).alias("intensity"), "n_regionkey")
    offer = F.struct("region", F.when(F.col("intensity") % 2 == 0, F.array(F.lit("/api/*"))).otherwise(F.array(F.lit("/api/1"))).alias("paths"))
    services = grid.groupBy("n_regionkey").agg(F.collect_list(offer).alias("regions")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("name"), "regions")
    keys = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).alias("k")).distinct()
    names = F.array(*[F.lit(r[0]) for r in table(spark, sf_dir, "region").select("r_name").collect()])
    calls = keys.select(F.explode(names).alias("service"), F.concat(F.lit("/api/"), "k").alias("path"))
    return c.best_regions(services, calls, grid.select("region", "intensity"))


@query(
    "saving_report",
    """WITH g AS (SELECT o_custkey AS report, o_orderkey AS region, o_totalprice - 100000 AS intensity FROM orders), b AS (SELECT report, min(intensity) AS m FROM g WHERE intensity > 0 GROUP BY report)
       SELECT report, region, round(intensity - coalesce(m, 0), 6) AS difference, CASE WHEN intensity > coalesce(m, 0) THEN 'improvable' WHEN intensity = coalesce(m, 0) THEN 'best' ELSE 'unknown' END AS message FROM g LEFT JOIN b USING (report)""",
)
def saving_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a customer's orders as the regions of a report."""
    grid = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report"), F.col("o_orderkey").alias("region"), (F.col("o_totalprice") - 100000).alias("intensity"))
    return c.savings(grid.select("report", "region"), grid).select("report", "region", F.round("difference", 6).alias("difference"), "message")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("r"), F.col("user_id") % 5).alias("region"), (F.col("value") + F.col("event_id") * 0).alias("rating"), "event_id")


@query(
    "grid_report_interval",
    """WITH e AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS w, 'r' || CAST(user_id % 5 AS VARCHAR) AS region, ts, value FROM events),
       l AS (SELECT w, region, arg_max(value, ts) AS rating FROM e GROUP BY ALL)
       SELECT s.w AS start_date, r.region, round(coalesce(l.rating, f.rating, 0), 6) AS rating FROM (SELECT DISTINCT w FROM e) s, (VALUES ('r0'), ('r1'), ('norway'), ('mars')) r(region)
       LEFT JOIN l ON l.w = s.w AND l.region = r.region LEFT JOIN l f ON f.w = s.w AND f.region = 'r4' AND r.region = 'norway'""",
)
def grid_report_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 K9: primary rating, else the fallback zone's, else 0."""
    rows = _readings(spark, sf_dir)
    regions = spark.createDataFrame([("r0",), ("r1",), ("norway",), ("mars",)], "region string")
    spare = rows.where("region = 'r4'").select(F.lit("NO").alias("zone"), "ts", "rating")
    out = c.report_rows(c.report_maps(c.interval_report(regions, rows, spare)))
    return out.select(F.col("start_date").cast("timestamp_ntz").alias("start_date"), "region", F.round("rating", 6).alias("rating"))


@query(
    "asof_report",
    """SELECT a.event_id, b.value AS last_value FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) b ON a.user_id = b.user_id AND a.ts >= b.ts""",
)
def asof_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    ev = table(spark, sf_dir, "events")
    right = ev.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    return joins.as_of(ev.select("event_id", "user_id", "ts"), right, "user_id", "ts", "ts", ["last_value"]).select("event_id", "last_value")


@query(
    "grant_check",
    """WITH g AS (SELECT DISTINCT CAST(c_custkey % 7 AS VARCHAR) AS u, c_nationkey AS r, c_mktsegment AS a FROM customer WHERE c_acctbal > 5000)
       SELECT c_custkey, EXISTS (SELECT 1 FROM g WHERE g.u = CAST(c_custkey % 11 AS VARCHAR) AND g.r = c_nationkey AND g.a = c_mktsegment) AS granted FROM customer""",
)
def grant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 L9."""
    def asked(modulus):
        return (F.col("c_custkey") % modulus).cast("string").alias("user"), F.lit(1).alias("type"), F.col("c_nationkey").alias("resource"), F.col("c_mktsegment").alias("asset"), F.lit(2).alias("op")

    rows = table(spark, sf_dir, "customer")
    grants = rows.where("c_acctbal > 5000").select(*asked(7))
    half = grants.where("resource < 12")
    return joins.grant_flags(rows.select("c_custkey", *asked(11)), half, grants.where("resource >= 12")).select("c_custkey", "granted")


@query(
    "two_hop_nav",
    """WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey // 8 END AS parent, c_acctbal > 5000 AS mine FROM customer), roots AS (SELECT DISTINCT coalesce(parent, id) AS root FROM n WHERE mine)
       SELECT id, parent FROM n WHERE id IN (SELECT root FROM roots) OR parent IN (SELECT root FROM roots)""",
)
def two_hop_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a tree, of whom those with a large balance are readable."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.floor(F.col("c_custkey") / 8).cast("long")).alias("parent"), (F.col("c_acctbal") > 5000).alias("mine"))
    return joins.two_hops(rows, "id", "parent", joins.root_ids(rows.where("mine"), "id", "parent")).select("id", "parent")


_SENT = "event_type = 'purchase'"


def _messages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sent = ev.where(_SENT).select(F.col("event_id").alias("id"), F.col("user_id").alias("sender"), (F.col("user_id") + 1).alias("recipient"), "ts")
    return sent, ev.where("event_type = 'signup'").select(F.col("event_id").alias("conn_id"), F.col("user_id").alias("user"), F.col("ts").alias("created"))


_FANOUT = f"""WITH m AS (SELECT event_id AS id, unnest([user_id, user_id + 1]) AS u, ts FROM events WHERE {_SENT})
       SELECT m.id, m.u AS user, e.event_id AS conn_id FROM m JOIN events e ON e.user_id = m.u AND e.event_type = 'signup' AND e.ts <= m.ts AND e.ts > m.ts - INTERVAL 1 HOUR"""


@query("message_fanout", _FANOUT)
def message_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 F21."""
    return joins.fan_out(*_messages(spark, sf_dir)).select("id", "user", "conn_id")


@query(
    "conversation_merge",
    """SELECT conv_id, turn, role FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, role FROM conversations WHERE role = 'assistant'""",
)
def conversation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of a talk, each once."""
    from docquery.operators.search import piped, union_all

    rows = table(spark, sf_dir, "conversations")
    return piped(rows.where("role = 'user'"), lambda d: union_all([d, rows.where("role = 'assistant'")]), lambda d: None, lambda d: d.select("conv_id", "turn", "role"))


@query(
    "required_errors",
    """SELECT o_orderkey, (CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END) AS n_errors FROM orders""",
)
def required_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5."""
    rows = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise(F.lit("")))
    errors = e.required_errors(rows, {"status": ["required"], "o_totalprice": ["required", "min:50000"]})
    return rows.select("o_orderkey", F.size(errors).alias("n_errors"))


@query(
    "contract_errors",
    """SELECT event_id, (CASE WHEN k > 50 THEN 1 ELSE 0 END) + (CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) + 1 AS n_errors
       FROM (SELECT *, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maximum, a pattern, and a field that is never there."""
    contract = {"type": "object", "required": ["k", "owner"], "properties": {"k": {"type": "integer", "maximum": 50}, "kind": {"type": "string", "pattern": "^(?!signup)"}}}
    body = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("event_type").alias("kind")))
    rows = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(body).alias("doc"))
    return rows.select("event_id", F.size(e.contract_errors(F.col("doc"), contract)).alias("n_errors"))


@query(
    "change_detection",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 5 = 1 THEN 'gone' WHEN o_orderkey % 5 = 2 THEN 'changed' ELSE 'same' END AS action FROM orders""",
)
def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L8 S11."""
    rows, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    new = rows.where(k != 1).withColumn("o_totalprice", F.when(k == 2, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return e.changes(rows.where(k != 0), new, "o_orderkey")


@query("upsert_latest", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM orders")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("version"), F.lit("old").alias("origin"))
    new = rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(2).alias("version"), F.lit("new").alias("origin"))
    return e.upserted(rows, new, "o_orderkey", "version").select("o_orderkey", "origin")


@query(
    "composite_keys",
    "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment || ':' || c_name END AS composite_key FROM customer",
)
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing field fails the row."""
    rows = table(spark, sf_dir, "customer").withColumn("c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_name")))
    return e.composite_key(rows, ["c_mktsegment", "c_name"]).select("c_custkey", "composite_key")


@query(
    "attribute_flatten",
    """SELECT l_orderkey, l_linenumber, l_shipdate, v AS value, CASE WHEN k = 0 THEN CAST(l_linenumber AS INT) ELSE 0 END AS int_value, CASE WHEN k = 3 THEN l_quantity ELSE 0 END AS float_value
       FROM lineitem, LATERAL (VALUES (0, CAST(l_linenumber AS VARCHAR)), (3, CAST(l_quantity AS VARCHAR)), (1, l_returnflag)) x(k, v)""",
)
def attribute_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of two levels to typed leaves, one row each."""
    def leaf(kind, value):
        return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))

    tree = F.array(
        F.struct(F.lit(2).alias("type"), F.lit("").alias("value"), F.array(leaf(0, F.col("l_linenumber")), leaf(3, F.col("l_quantity"))).alias("attributes")),
        F.struct(F.lit(1).alias("type"), F.col("l_returnflag").alias("value"), F.array().cast("array<struct<type: int, value: string>>").alias("attributes")),
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", e.typed_values(e.leaves(tree, "attributes")).alias("attributes"))
    return e.expanded(rows).select("l_orderkey", "l_linenumber", "l_shipdate", "value", F.col("intValue").alias("int_value"), F.col("floatValue").alias("float_value"))


@query(
    "pluck_property",
    "SELECT event_id, '' AS k, event_type AS kind FROM events",
)
def pluck_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: a number is no string, so it is not plucked."""
    body = F.to_json(F.struct(F.col("event_id").alias("k"), F.col("event_type").alias("kind")))
    return table(spark, sf_dir, "events").select("event_id", fx.pluck(body, "k").alias("k"), fx.pluck(body, "kind").alias("kind"))


@query("stamped_rows", "SELECT c_custkey, 1 AS status, 'me' AS owner, substring(sha256(CAST(c_custkey AS VARCHAR)), 1, 32) AS id FROM customer")
def stamped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L7."""
    rows = e.stamped(table(spark, sf_dir, "customer"), "me", F.lit("2024-01-01").cast("timestamp"), ["c_custkey"])
    return rows.select("c_custkey", "status", F.col("entityPermissions.writeUserIds")[0].alias("owner"), "id")


def streamed(spark: SparkSession, *parts: DataFrame, files: int = 8) -> DataFrame:
    """Tables as a file stream: written one after the other, and read as files, at most so many in a micro-batch."""
    path = f"{shared_dir(spark)}/source"
    for df in parts:
        df.write.mode("append").parquet(path)
    reader = spark.readStream.schema(parts[0].schema)
    return (reader.option("maxFilesPerTrigger", files) if len(parts) > 1 else reader).parquet(path)


@query(
    "stream_carbon_records",
    f"""WITH r AS (SELECT event_id, floor({_MS} / 1000) % 60 AS s FROM events)
        SELECT CAST(event_id AS VARCHAR) AS request_id, region, coalesce(region = 'norway', true) AS called, round(2.12 * s / 3600 * 512 / 1792, 10) AS electricity, round(2.12 * s / 3600 * 512 / 1792 * intensity, 8) AS carbon
        FROM r, (VALUES ('eastus', 400, true), ('norway', 30, true), ('westeurope', 250, true), (NULL, 0, false)) g(region, intensity, named) WHERE (event_id % 2 = 0) = named""",
)
def stream_carbon_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as a stream, those of a call folded, to one row for each call and region.

    A call's second line comes up to four minutes after its first, or before it for every third call, and in another
    micro-batch. A call is over when a later line comes: the last one's is an empty line after the watermark's delay.
    """
    place, lines = shared_dir(spark), usage_lines(spark, sf_dir)
    apart = F.when(F.col("batch_id") % 3 == 0, -1).otherwise(1) * (F.col("batch_id") % 5) * 60 * F.col("line_no")
    lines = lines.withColumn("ts", F.timestamp_seconds(F.unix_micros("ts") / 1_000_000 + apart))
    last = lines.agg(F.lit(-1).cast("long").alias("batch_id"), (F.max("ts") + F.expr("interval 32 days")).alias("ts"), F.lit(0).alias("line_no"), F.lit("REPORT").alias("message"))
    parts = lines.where("line_no = 0"), lines.where("line_no > 0"), last
    made = streams.carbon_records(streamed(spark, *parts), "31 days")
    made = made.select("request_id", "region", "called", F.round("electricity", 10).alias("electricity"), F.round("carbon", 8).alias("carbon"))
    return streams.run_available(made, f"{place}/out", f"{place}/state", on_disk=True)


@query(
    "stream_interval_ratings",
    """SELECT w AS start_date, region, round(arg_max(value, ts), 6) AS rating FROM (SELECT time_bucket(INTERVAL '5 minutes', ts) AS w, 'r' || CAST(user_id % 5 AS VARCHAR) AS region, ts, value,
       (SELECT max(ts) FROM events) AS last FROM events) WHERE w + INTERVAL '5 minutes' <= last - INTERVAL '1 day' GROUP BY w, region""",
)
def stream_interval_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: intervals that are over by the watermark of a day."""
    place = shared_dir(spark)
    out = streams.run_available(streams.interval_ratings(streamed(spark, _readings(spark, sf_dir)), "1 day"), f"{place}/out", f"{place}/state")
    return out.select(F.col("start_date").cast("timestamp_ntz").alias("start_date"), "region", F.round("rating", 6).alias("rating"))


@query(
    "stream_with_report",
    """SELECT event_id, CASE WHEN user_id % 5 < 3 THEN CAST(user_id % 5 AS DOUBLE) END AS intensity FROM events""",
)
def stream_with_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream joined with the report's table."""
    report = _readings(spark, sf_dir).select("region").distinct().where("region < 'r3'").withColumn("rating", F.substring("region", 2, 1).cast("double"))
    place = shared_dir(spark)
    return streams.run_available(streams.with_current_report(streamed(spark, _readings(spark, sf_dir)), report), f"{place}/out", f"{place}/state").select("event_id", "intensity")


@query("stream_fanout", _FANOUT)
def stream_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval join of two streams."""
    sent, live = _messages(spark, sf_dir)
    place = shared_dir(spark)
    out = streams.run_available(streams.delivered(streamed(spark, sent), streamed(spark, live), "40 days"), f"{place}/out", f"{place}/state")
    return out.select("id", "user", "conn_id")


@query("stream_index", "SELECT o_orderkey AS id, o_orderstatus || ':' || o_orderpriority AS composite_key FROM orders WHERE o_orderstatus <> 'P'")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change stream into an index that is partitioned by its composite key."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    place = shared_dir(spark)
    streams.index_changes(streamed(spark, rows), f"{place}/index", f"{place}/state", "id", "composite_key", lambda d: e.composite_key(d, ["o_orderstatus", "o_orderpriority"]))
    return e.read_index(spark, f"{place}/index").select("id", F.col("composite_key").cast("string").alias("composite_key"))


@query(
    "stream_versions",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 14 = 0 THEN 'back' WHEN o_orderkey % 3 = 0 THEN 'late' ELSE o_orderstatus END AS composite_key,
         CASE WHEN o_orderkey % 14 = 0 THEN 6 WHEN o_orderkey % 3 = 0 THEN 4 ELSE 3 END AS version FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 14 = 0""",
)
def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a key twice in a batch, late, deleted, too late for that, and brought back."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("composite_key"), F.lit(0).alias("version"), F.lit(False).alias("deleted"))
    put = lambda at, place=None, gone=False: rows.withColumns({"version": F.lit(at), "composite_key": F.lit(place) if place else F.col("composite_key"), "deleted": F.lit(gone)})
    batches = [
        put(3).unionByName(put(1, "old")),
        put(4, "late").where("id % 3 = 0").unionByName(put(2, "older")).unionByName(put(5, gone=True).where("id % 7 = 0")),
        put(4, "too late").where("id % 7 = 0").unionByName(put(6, "back").where("id % 14 = 0")),
    ]
    place = shared_dir(spark)
    index = sn.SnapshotIndex(f"{place}/index", version="version")
    for batch in batches:
        batch.write.mode("append").parquet(f"{place}/in")
        streams.snapshot_changes(spark.readStream.schema(rows.schema).parquet(f"{place}/in"), index, f"{place}/state", deleted="deleted")
    return sn.read(spark, index).select("id", "composite_key", "version")


@query("recent_events", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 11:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND event_type IN ('signup', 'view')")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within the hour before a given time."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cond = p.all_of(p.recent(F.col("ts"), F.lit("2024-01-20 12:00:00").cast("timestamp")), p.within_list(F.col("event_type"), ["signup", "view"]))
    return rows.where(cond.match).select("event_id")


@query(
    "stream_index_moves",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE o_orderstatus END AS composite_key FROM orders WHERE o_totalprice < 200000""",
)
def stream_index_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch empties a partition by moving its rows, and deletes others."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(False).alias("deleted"), "o_totalprice")
    change = rows.where("status = 'F' or o_totalprice >= 200000").withColumns({"status": F.when(F.col("status") == "F", "O").otherwise(F.col("status")), "deleted": F.col("o_totalprice") >= 200000})
    place = shared_dir(spark)
    for batch in (rows, change):
        batch.drop("o_totalprice").write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema("id long, status string, deleted boolean").parquet(f"{place}/in")
        streams.index_changes(stream, f"{place}/index", f"{place}/state", "id", "composite_key", lambda d: e.composite_key(d, ["status"]), "deleted")
    return e.read_index(spark, f"{place}/index").select("id", F.col("composite_key").cast("string").alias("composite_key"))


@query(
    "usage_log_records",
    f"""SELECT CAST(event_id AS VARCHAR) AS request_id, {_MS} AS duration FROM events""",
)
def usage_log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage lines from text files, where other lines are left out."""
    place = shared_dir(spark)
    lines = usage_lines(spark, sf_dir).where("line_no = 0")
    lines.select(F.explode(F.array("message", F.lit("START of a call"))).alias("value")).write.text(place)
    return c.parsed_lines(src.usage_lines(spark, place)).select("request_id", "duration")


@query("region_dimension", "SELECT s_suppkey, s_name AS region, round(s_acctbal / 100, 4) AS lat, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE round(s_acctbal / 50, 4) END AS lon FROM supplier")
def region_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates are text in the landed file; what is no number is null."""
    place = shared_dir(spark)
    text = lambda by: F.round(F.col("s_acctbal") / by, 4).cast("string")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("RegionName"), text(100).alias("Latitude"), F.when(F.col("s_suppkey") % 3 == 0, "unknown").otherwise(text(50)).alias("Longitude"))
    rows.write.json(place)
    found = src.regions(spark, place, lines=True).withColumnRenamed("RegionName", "region")
    return found.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("region")), "region").select("s_suppkey", "region", "lat", "lon")


@query("static_rows", "SELECT r_regionkey AS id, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey")
def static_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at hand, five regions, next to a table."""
    held = src.static(spark, [tuple(x) for x in table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()], "id int, name string")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("id"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(held), "id")
    return rows.groupBy("id").agg(F.count("*").alias("n"))


@query(
    "row_hooks",
    "SELECT o_orderkey, round(o_totalprice * 2, 2) AS price FROM orders WHERE o_orderstatus <> 'P'",
)
def row_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hook before the save drops rows, one after it changes nothing, one after the find changes a value."""
    place = shared_dir(spark)
    hooks = Hooks(before_save=(lambda d: d.where("o_orderstatus <> 'P'"),), after_save=(lambda d: None,), after_find=(lambda d: d.withColumn("price", F.round(F.col("o_totalprice") * 2, 2)),))
    hooks.saved(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), lambda d: d.write.parquet(place))
    return hooks.found(spark.read.parquet(place)).select("o_orderkey", "price")


@query("random_ids", "SELECT count(*) AS n, count(*) AS n_ids, true AS all_are_ids FROM customer")
def random_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random id for each row; all differ."""
    rows = e.stamped(table(spark, sf_dir, "customer"), "me", F.lit("2024-01-01").cast("timestamp"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.every(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("all_are_ids"))


@query(
    "zero_times",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) ELSE TIMESTAMP '0001-01-01' END AS at FROM orders",
)
def zero_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with an offset is a time, a bare date is the zero time."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(day, F.lit("T00:00:00Z"))).otherwise(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", fx.to_time(text).cast("timestamp_ntz").alias("at"))
