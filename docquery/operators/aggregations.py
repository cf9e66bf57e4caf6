"""Groupings, metrics, nested and pipeline aggregations, facets and top hits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docquery.functions.fields import key_text, numeric, spare
from docquery.functions.scripts import script

#: Formats of date-histogram keys.
INTERVALS = {"minute": "yyyy-MM-dd HH:mm", "hour": "yyyy-MM-dd HH", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _part(p: float) -> float:
    return (p if 0 < p <= 100 else 50) / 100


#: Metrics of the numbers in a field. The exact median and percentile hold a group's distinct values in one task, counted;
#: the approx ones a bounded sketch.
NUMERIC: dict[str, Callable[..., Column]] = {
    "sum": lambda x: _zero(F.sum(x)),
    "avg": lambda x: _zero(F.avg(x)),
    "mean": lambda x: _zero(F.avg(x)),
    "median": lambda x: _zero(F.median(x)),
    "min": lambda x: _zero(F.min(x)),
    "max": lambda x: _zero(F.max(x)),
    "std_dev": lambda x: _zero(F.stddev_samp(x)),
    "percentile": lambda x, p=50: _zero(F.percentile(x, _part(p))),
    "approx_percentile": lambda x, p=50: _zero(F.percentile_approx(x, _part(p), 10_000)),
    "count": lambda x: F.count(x),
}
#: Metrics of any values.
OTHERS: dict[str, Callable[..., Column]] = {
    "mode": lambda x: F.mode(x, True),
    "approx_cardinality": lambda x: F.approx_count_distinct(x).cast("double"),
    "cardinality": lambda x, nulls=False: (F.count_distinct(x) + (F.coalesce(F.max(x.isNull().cast("int")), F.lit(0)) if nulls else 0)).cast("double"),
}
METRICS = NUMERIC | OTHERS | {"unique_count": OTHERS["cardinality"]}


def metric(kind: str, field: str | Column, name: str, **options) -> Column | None:
    """A named metric; without values 0, and the least of equally common modes (A6-A15). An unknown kind is none.

    Numeric metrics skip text that is no number. cardinality(nulls=True) counts null as one value, for fields where it is
    not just missing; the elements of arrays are counted by the function cardinality.
    """
    if kind not in METRICS:
        return None
    c = F.col(field) if isinstance(field, str) else field
    return METRICS[kind](numeric(c) if kind in NUMERIC else c, **options).alias(name)


def _known(metrics) -> list[Column]:
    return [m for m in metrics if m is not None]


def _bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with all keys; text keys without white space at their ends."""
    texts = [k for k in keys if isinstance(df.schema[k].dataType, T.StringType)]
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).withColumns({k: key_text(F.col(k)) for k in texts})


def terms(df: DataFrame, keys: list[str], *metrics: Column | None) -> DataFrame:
    """A bucket for each combination of keys, missing ones dropped (A1); text keys are trimmed."""
    return _bucketed(df, keys).groupBy(*keys).agg(F.count("*").alias("count"), *_known(metrics))


def cardinality(df: DataFrame, keys: list[str], array: str, name: str) -> DataFrame:
    """keys and the number of distinct elements of an array field, null as one value.

    A row whose array is missing or empty adds nothing. Elements are counted by group and value before anything is gathered.
    """
    value = spare("_x", df)
    rows = _bucketed(df, keys) if keys else df
    held = rows.select(*keys, F.explode(F.coalesce(array, F.array())).alias(value)).groupBy(*keys, value).agg(F.lit(1).alias("_n"))
    groups = rows.select(*keys).distinct() if keys else None
    counts = held.groupBy(*keys).agg(F.count("*").cast("double").alias(name))
    return counts if groups is None else groups.join(counts, keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def whole(df: DataFrame, *metrics: Column | None) -> DataFrame:
    """One bucket of all rows (A5)."""
    return df.agg(F.count("*").alias("count"), *_known(metrics))


def ranges(df: DataFrame, field: str, buckets: list[tuple[str, float, float]], *metrics: Column) -> DataFrame:
    """(key, from, to) buckets, 0 as an open end; the first that fits counts and empty ones are there with 0 (A2).

    What is no number, nor the text of one, is in no bucket.
    """
    x = numeric(F.col(field))
    which = F.lit(None).cast("int")
    for i, (_, start, end) in reversed(list(enumerate(buckets))):
        which = F.when((x >= start) & (x < end) if end else x >= start, F.lit(i)).otherwise(which)
    at = spare("_i", df)
    held = df.withColumn(at, which).where(F.col(at).isNotNull()).groupBy(at).agg(F.count("*").alias("count"), *_known(metrics))
    declared = df.sparkSession.createDataFrame([(i, k) for i, (k, _, _) in enumerate(buckets)], f"{at} int, key string")
    names = [c for c in held.columns if c not in (at, "count")]
    return declared.join(held, at, "left").orderBy(at).select("key", F.coalesce("count", F.lit(0)).alias("count"), *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def date_histogram(df: DataFrame, ts: str, interval: str, *metrics: Column) -> DataFrame:
    """Buckets by formatted time; no empty ones, none at all for an unknown interval (A3)."""
    if interval not in INTERVALS:
        return df.limit(0).groupBy(F.lit("").alias("key")).agg(F.count("*").alias("count"), *_known(metrics))
    return df.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, INTERVALS[interval]).alias("key")).agg(F.count("*").alias("count"), *_known(metrics))


def nested(df: DataFrame, array: str, keep: list[str] = ()) -> DataFrame:
    """An array's structs as rows, on which the children of a nested aggregation run (A4)."""
    return df.select(*keep, F.explode(array).alias("_x")).select(*keep, "_x.*")


def nested_metric(df: DataFrame, keys: list[str], array: str, field: str, kind: str, name: str) -> DataFrame:
    """Sum or average of an array's field over all rows of a group, without exploding them; what is no number is skipped."""
    values = F.filter(F.transform(F.coalesce(F.col(array), F.array()), lambda x: numeric(x[field])), lambda v: v.isNotNull())
    total, n = F.sum(F.aggregate(values, F.lit(0.0), lambda a, v: a + v)), F.sum(F.size(values))
    out = {"sum": _zero(total), "avg": F.coalesce(F.try_divide(total, n), F.lit(0.0))}[kind]
    return df.groupBy(*keys).agg(out.alias(name))


def scripted(code: str, reducer: str, name: str, initial: float = 0.0) -> Column:
    """User code (functions.scripts) per row, folded; rows where it fails or gives no number are skipped."""
    x, start = numeric(script(code)), F.lit(float(initial))
    made = {
        "sum": start + _zero(F.sum(x)),
        "avg": F.coalesce(F.try_divide(start + F.sum(x), F.count(x)), start),
        "min": F.coalesce(F.min(x), start),
        "max": F.coalesce(F.max(x), start),
        "count": F.when(F.count(x) > 0, F.count(x).cast("double")).otherwise(start),
    }
    return made.get(reducer, F.max(start)).alias(name)


def bucket_scripts(buckets: DataFrame, *scripts: tuple[str, str, dict[str, str]]) -> DataFrame:
    """(name, code, {variable: metric}) of user code (functions.scripts) over finished buckets, in order, later ones seeing earlier ones; failure is 0."""
    for name, code, paths in scripts:
        values = {v: (F.coalesce(numeric(F.col(m)), F.lit(0.0)) if m in buckets.columns else F.lit(0.0)) for v, m in paths.items()}
        buckets = buckets.withColumn(name, F.coalesce(numeric(script(code, values)), F.lit(0.0)))
    return buckets


def stats_of(buckets: DataFrame, field: str, sibling: bool = True) -> DataFrame:
    """Statistics over a metric of sibling buckets, with the population deviation; none at all without buckets.

    At top level (sibling False) five of them, where no buckets give count, avg and sum 0 (A20).
    """
    x = F.col(field).cast("double")
    five = [F.count(x).alias("stat_count"), F.min(x).alias("stat_min"), F.max(x).alias("stat_max"), _zero(F.sum(x)).alias("stat_sum"), _zero(F.avg(x)).alias("stat_avg")]
    if not sibling:
        return buckets.agg(*five)
    return buckets.agg(*five, F.stddev_pop(x).alias("stat_std_dev")).where("stat_count > 0")


def sub_aggregation(df: DataFrame, parents: list[str], child: str, *metrics: Column) -> DataFrame:
    """Child buckets within each parent bucket: one grouping by all keys."""
    return terms(df, [*parents, child], *metrics)


def top_hits(df: DataFrame, keys: list[str], order: list[Column], size: int, source: list[str]) -> DataFrame:
    """The first rows of each bucket, ranked from 1 (A22); the rank limit is applied before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= size).select(*keys, "rank", *[c for c in source if c not in keys])


def facets(df: DataFrame, fields: list[str]) -> DataFrame:
    """(facet, value, count) of several fields in one pass; values are trimmed as keys are."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), key_text(F.col(f).cast("string")).alias("value")) for f in fields])
    return df.select(F.inline(pairs)).where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("count"))


def nested_facet(df: DataFrame, outer: str, inner: str, name: str, search: str | None = None, size: int = 10) -> DataFrame:
    """The most common names in arrays within an array, of those that hold the search text."""
    rows = df.select(F.explode(outer).alias("o")).select(F.explode(f"o.{inner}").alias("i")).select(F.col(f"i.{name}").alias("value")).where("value is not null")
    rows = rows if not search else rows.where(F.lower("value").contains(search.lower()))
    return rows.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(size)


def regrouped(df: DataFrame, keys: list[str], items: list[str], name: str) -> DataFrame:
    """Flat rows as one row per key with a sorted array of structs."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*items))).alias(name))


def bundle(df: DataFrame, named: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Several aggregations of the same rows, lazy; the caller persists df if more than one is to be read."""
    return {name: make(df) for name, make in named.items()}
