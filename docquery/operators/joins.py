"""Subqueries, lookups, grants and interval joins (J1-J12). All are equi-joins, intervals next to an equal key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docquery.functions.fields import spare


def keys_of(sub: DataFrame, condition: Column | None, result: str, name: str = "_key") -> DataFrame:
    """What a subquery returns: the distinct values of a field in the documents that match."""
    found = sub if condition is None else sub.where(condition)
    return found.select(F.col(result).alias(name)).where(F.col(name).isNotNull()).distinct()


def in_subquery(df: DataFrame, field: str, sub: DataFrame, result: str, condition: Column | None = None) -> DataFrame:
    """Rows whose field is among the subquery's values."""
    key = spare("_key", df)
    return df.join(keys_of(sub, condition, result, key), F.col(field) == F.col(key), "left_semi")


def not_in_subquery(df: DataFrame, field: str, sub: DataFrame, result: str, condition: Column | None = None) -> DataFrame:
    """Rows with a field that is not among them; a missing field is dropped, missing values are no values."""
    key = spare("_key", df)
    return df.where(F.col(field).isNotNull()).join(keys_of(sub, condition, result, key), F.col(field) == F.col(key), "left_anti")


def with_flag(df: DataFrame, name: str, field: str, sub: DataFrame, result: str, condition: Column | None = None) -> DataFrame:
    """Whether the field is among the subquery's values, as a column for any boolean condition."""
    key = spare("_key", df)
    keys = keys_of(sub, condition, result, key)
    return df.join(keys, F.col(field) == F.col(key), "left").withColumn(name, F.col(key).isNotNull()).drop(key)


def first_match(df: DataFrame, lookup: DataFrame, on: str, order: str) -> DataFrame:
    """Each row with the first row of the lookup for its key."""
    others = [c for c in lookup.columns if c != on]
    name = spare("_first", df)
    first = lookup.groupBy(on).agg(F.min_by(F.struct(*others), F.col(order)).alias(name))
    return df.join(first, on, "left").select(*df.columns, *[F.col(f"{name}.{c}").alias(c) for c in others])


#: Rows of one key, both sides together, that one task of an as-of join sorts.
AS_OF_ROWS = 5_000_000


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], bucket: str | float = "hour") -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time.

    Where no key has more than AS_OF_ROWS rows, which is counted first, each key is sorted once. Else rows are dealt by key
    and bucket of time (a unit of date_trunc, or a width where times are numbers), so that a key of very many rows is no
    single task: each bucket is sorted once, and what was last before it is carried over from one row a bucket. No pairs are
    made. Of right rows at one time the greatest values count. A null key or time has no values.
    """
    numbers = isinstance(left.schema[left_time].dataType, T.NumericType)
    width = 1.0 if isinstance(bucket, str) else float(bucket)
    slot = lambda t: F.floor(F.col(t) / width) if numbers else F.date_trunc(str(bucket), F.col(t))
    kind = F.struct(*[F.col(v) for v in values])
    a = left.select(F.col(key).alias("_k"), slot(left_time).alias("_b"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(kind.alias("v")).schema["v"].dataType).alias("_v"))
    known = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    b = known.select(F.col(key).alias("_k"), slot(right_time).alias("_b"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), kind.alias("_v"))
    by, rows = ["_k"], a.unionByName(b)
    if (a.select("_k").unionByName(b.select("_k")).groupBy("_k").count().agg(F.max("count")).first()[0] or 0) > AS_OF_ROWS:
        by, rows = ["_k", "_b"], rows.unionByName(_carried(a, b))
    last = F.last("_v", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_last", last).where("_side = 1")
    return rows.select("_row.*", *[F.when(F.col("_t").isNotNull(), F.col(f"_last.{v}")).alias(v) for v in values])


def _carried(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each key and bucket of the rows of both sides a right row that was last before it, at its own time."""
    ends = a.select("_k", "_b", F.lit(None).cast(b.schema["_v"].dataType).alias("_v"), F.lit(None).cast(b.schema["_t"].dataType).alias("_t")).unionByName(b.select("_k", "_b", "_v", "_t"))
    ends = ends.groupBy("_k", "_b").agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("_t", "_v"))).alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("_from", carried).where("_from is not null").select("_k", "_b", F.col("_from._t").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col("_from._v").alias("_v"))


def counterfactuals(records: DataFrame, intensities: str, region: str) -> DataFrame:
    """A row for each other region of a record's own map of intensities."""
    return records.select("*", F.explode(intensities).alias("other_region", "other_intensity")).where(F.col("other_region") != F.coalesce(F.col(region), F.lit("")))


GRANT_KEYS = ("user", "type", "resource", "asset", "op")


def granted(requests: DataFrame, grants: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Requests that a grant, or one carried along, allows on all five keys."""
    keys = grants.select(*GRANT_KEYS)
    keys = keys if extra is None else keys.unionByName(extra.select(*GRANT_KEYS))
    return requests.join(keys, list(GRANT_KEYS), "left_semi")


def grant_flags(requests: DataFrame, grants: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """All requests, and whether each is granted."""
    keys = grants.select(*GRANT_KEYS)
    keys = (keys if extra is None else keys.unionByName(extra.select(*GRANT_KEYS))).distinct().withColumn("granted", F.lit(True))
    return requests.join(keys, list(GRANT_KEYS), "left").withColumn("granted", F.coalesce("granted", F.lit(False)))


def root_ids(df: DataFrame, key: str, parent: str) -> DataFrame:
    """Ids of rows without a parent, and all parents."""
    return df.select(F.coalesce(F.col(parent), F.col(key)).alias("root")).distinct()


def two_hops(df: DataFrame, key: str, parent: str, ids: DataFrame) -> DataFrame:
    """Rows whose own id or whose parent is among ids (J8): one pass, with a flag from each join."""
    own, up = spare("_own", df), spare("_up", df)
    rows = with_flag(with_flag(df, own, key, ids, ids.columns[0]), up, parent, ids, ids.columns[0])
    return rows.where(F.col(own) | F.col(up)).drop(own, up)


def fan_out(messages: DataFrame, connections: DataFrame, within: str = "1 hour") -> DataFrame:
    """Messages with each connection of sender or recipient made within the interval before.

    messages: id, sender, recipient, ts; connections: conn_id, user, created. A message to oneself goes out once.
    """
    ends = messages.select("id", "ts", F.explode(F.array_distinct(F.array("sender", "recipient"))).alias("user"))
    fresh = (ends.user == connections.user) & (connections.created <= ends.ts) & (connections.created > ends.ts - F.expr(f"interval {within}"))
    return ends.join(connections, fresh).select("id", ends.user, "conn_id", "created", "ts")


def attribute_filters(listings: DataFrame, types: DataFrame) -> DataFrame:
    """Listing attributes with the kind that their type gives them.

    listings: id, type_id, attributes; types: id, attributes with name and type. Types are few next to listings.
    """
    kinds = types.select(F.col("id").alias("type_id"), F.explode("attributes").alias("t")).select("type_id", F.col("t.name").alias("name"), F.col("t.type").alias("kind"))
    rows = listings.select("id", "type_id", F.explode("attributes").alias("a")).select("id", "type_id", F.col("a.name").alias("name"), F.col("a.value").alias("value"))
    return rows.join(kinds, ["type_id", "name"])
