"""Scaling, distances and nearest neighbours over array columns (V1-V5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Query vectors that go to all tasks in one pass over the data, and those that a task compares at once.
QUERY_BLOCK, COMPARED = 16_384, 512


def min_max(df: DataFrame, vector: str) -> DataFrame:
    """Each dimension scaled to 0..1 over all rows; a constant one is 0 (V1). Extremes are one row, whatever the input."""
    spread = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ends = {r["i"]: (float(r["lo"]), float(r["hi"])) for r in spread.collect()}
    low = F.array(*[F.lit(ends[i][0]) for i in sorted(ends)])
    width = F.array(*[F.lit(ends[i][1] - ends[i][0]) for i in sorted(ends)])
    scaled = F.transform(F.arrays_zip(F.col(vector).alias("x"), low.alias("lo"), width.alias("w")), lambda z: F.coalesce(F.try_divide(z["x"].cast("double") - z["lo"], z["w"]), F.lit(0.0)))
    return df.withColumn(vector, F.when(F.col(vector).isNotNull(), scaled)) if ends else df


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def on_sphere(v: Column) -> Column:
    """The vector at length 1; a zero vector stays (V2)."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def distance(metric: str, a: Column, b: Column) -> Column:
    """euclidean, manhattan or cosine (1 where a vector is zero) (V3)."""
    if metric == "euclidean":
        return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "manhattan":
        return _sum(a, b, lambda x, y: F.abs(x - y))
    return 1 - F.coalesce(F.try_divide(_sum(a, b, lambda x, y: x * y), norm(a) * norm(b)), F.lit(0.0))


def nearest(df: DataFrame, key: str, vector: str, query: list[float], k: int, metric: str = "euclidean") -> DataFrame:
    """The k rows nearest to one query, ties by key (V4): a top-k, with no sort of all rows.

    Rows whose vector is null, has a null in it or another length than the query's take no part.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    sound = F.col(vector).isNotNull() & (F.size(vector) == len(query)) & ~F.exists(vector, lambda x: x.isNull())
    return df.where(sound).select(key, distance(metric, F.col(vector), q).alias("distance")).orderBy("distance", key).limit(k)


def nearest_of_each(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
    """(query, key, distance, rank) of the k nearest rows of every query, exact, ties by key (V4).

    A block of queries at a time, by a hash of the key, goes to all tasks, whose partitions keep the k best of their own
    rows; only these are shuffled. queries has key and vector columns of the same names; keys are of any type with an
    order. Queries and rows whose key is null, or whose vector is null, has a null in it or another length than the first
    query's, take no part.
    """
    schema = T.StructType([T.StructField("query", df.schema[key].dataType), T.StructField(key, df.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    sound = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())
    asked = queries.where(sound).select(key, vector)
    size = asked.agg(F.count("*").alias("n"), F.min_by(F.size(vector), key).alias("d")).first()
    if not size["n"]:
        return df.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    asked, rows = (d.where(sound & (F.size(vector) == size["d"])).select(key, vector) for d in (queries, df))
    blocks, out = -(-size["n"] // QUERY_BLOCK), None
    for b in range(blocks):
        held = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toPandas()
        if len(held):
            best = rows.mapInArrow(_best_of(held[key].tolist(), np.array([list(v) for v in held[vector]], float), k, metric, arrow), schema)
            out = best if out is None else out.unionByName(best)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _best_of(ids, q, k, metric, arrow):
    def distances(q, x):
        if metric == "cosine":
            size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
            return 1 - np.divide(q @ x.T, size, out=np.zeros((len(q), len(x))), where=size > 0)
        return np.stack([np.abs(q - row).sum(axis=1) if metric == "manhattan" else np.sqrt(((q - row) ** 2).sum(axis=1)) for row in x], axis=1)

    def run(batches):
        known: list = []  # keys that are still among the best of a query, in their order
        at, found = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float)
            if not len(x):
                continue
            here = [*known, *batch.column(0).to_pylist()]
            place = np.empty(len(here), np.int64)
            place[sorted(range(len(here)), key=here.__getitem__)] = np.arange(len(here))
            parts = []
            for i in range(0, len(ids), COMPARED):
                d = np.concatenate([found[i : i + COMPARED], distances(q[i : i + COMPARED], x)], axis=1)
                of = np.concatenate([at[i : i + COMPARED], np.broadcast_to(np.arange(len(known), len(here)), (len(d), len(x)))], axis=1)
                order = np.lexsort((place[of], d), axis=1)[:, :k]
                parts.append((np.take_along_axis(of, order, 1), np.take_along_axis(d, order, 1)))
            at, found = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            kept, at = np.unique(at, return_inverse=True)
            at, known = at.reshape(found.shape), [here[j] for j in kept]
        n = found.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, object), n).tolist(), arrow.field(0).type), pa.array([known[j] for j in at.ravel()], arrow.field(1).type), pa.array(found.ravel())], schema=arrow)

    return run


def scaled_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 by the extremes of all rows, a constant one 0 (V5)."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return df.withColumns({c: F.coalesce(F.try_divide(F.col(c) - F.lit(ends[f"lo_{c}"]), F.lit(ends[f"hi_{c}"]) - F.lit(ends[f"lo_{c}"])), F.lit(0.0)) for c in columns})


def with_inks(df: DataFrame, r: str, g: str, b: str) -> DataFrame:
    """cyan, magenta and yellow as the means of two of red, green and blue."""
    return df.withColumns({"cyan": (F.col(g) + F.col(b)) / 2, "magenta": (F.col(r) + F.col(b)) / 2, "yellow": (F.col(r) + F.col(g)) / 2})
