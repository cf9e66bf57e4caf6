"""An index of immutable files with snapshots: versions merged latest-wins, deletes remembered, one atomic switch a change.

    path/data/commit=<c...>/_part=<k:composite key | d:nn>/*.parquet    rows, and what is known of deleted keys
    path/manifest/version=<n>/*.parquet                                 which commit holds each part, from n on

A change writes the parts that it touches anew, under a commit of its own, and then the next manifest, which is one file: it
is there or not. Readers take the parts of one manifest, so they see a whole state, also one that has been followed by others.
A part that loses its last row is in no later manifest. Parts are rebalanced when written: a large one has several files,
and what earlier changes left in small files comes together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docquery.operators.entities import row_hash

#: Parts over which deleted keys are dealt by hash.
GONE_PARTS = 64
#: Changed keys, or parts that they touch, that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Columns of the index's own.
_VERSION, _DELETED, _PART, _HASH = "_version", "_deleted", "_part", "_hash"
_OWN = (_VERSION, _DELETED, _PART, _HASH, "commit")


@dataclass(frozen=True)
class SnapshotIndex:
    """Where an index is, its key and partition columns, and the column that says which of two rows of a key is later.

    Without a version column changes count in the order in which they are committed.
    """

    path: str
    key: str = "id"
    partition: str = "composite_key"
    version: str | None = None


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _manifest(spark: SparkSession, index: SnapshotIndex) -> DataFrame | None:
    return _read(spark, f"{index.path}/manifest")


def versions(spark: SparkSession, index: SnapshotIndex) -> list[int]:
    """The snapshots that there are, in order."""
    found = _manifest(spark, index)
    return [] if found is None else sorted(r[0] for r in found.where(f"{_PART} is null").select("version").collect())


def _held(spark: SparkSession, index: SnapshotIndex, at: int) -> DataFrame:
    """All rows of a snapshot with the index's own columns, deleted keys too. Only its parts are read: the join prunes by folder."""
    live = _manifest(spark, index).where((F.col("version") == at) & F.col(_PART).isNotNull()).select("commit", _PART)
    return spark.read.parquet(f"{index.path}/data").join(F.broadcast(live) if live.count() <= BROADCAST_KEYS else live, ["commit", _PART], "left_semi")


def read(spark: SparkSession, index: SnapshotIndex, at: int | None = None, composite: str | None = None) -> DataFrame:
    """The rows of the latest snapshot, or of one before; of one composite key if it is given.

    An index without a snapshot, or of that number, is an error.
    """
    known = versions(spark, index)
    at = known[-1] if at is None and known else at
    if at not in known:
        raise ValueError(f"no snapshot {at} of {index.path}")
    rows = _held(spark, index, at).where(~F.col(_DELETED))
    if composite is not None:
        rows = rows.where(F.col(_PART) == "k:" + composite)
    return rows.drop(*_OWN)




def _staged(index: SnapshotIndex, changes: DataFrame, deleted: str | None, number: int) -> DataFrame:
    """One row for each key of a change, the latest; rows without a key, or with no place and not deleted, are left out."""
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    columns = [c for c in changes.columns if c != deleted]
    if clash := set(columns) & set(_OWN):
        raise ValueError(f"columns of the index's own: {sorted(clash)}")
    place = F.when(gone, F.format_string("d:%02d", F.pmod(F.xxhash64(index.key), F.lit(GONE_PARTS)))).when(F.col(index.partition) != "", F.concat(F.lit("k:"), F.col(index.partition).cast("string")))
    version = F.col(index.version) if index.version else F.lit(number).cast("long")
    rows = changes.select(*columns, version.alias(_VERSION), gone.alias(_DELETED), place.alias(_PART), row_hash(changes.drop(deleted) if deleted else changes).alias(_HASH))
    rows = rows.where(F.col(index.key).isNotNull() & F.col(_PART).isNotNull() & F.col(_VERSION).isNotNull())
    one = rows.groupBy(F.col(index.key).alias("_k")).agg(F.max_by(F.struct(*rows.drop(_HASH).columns), _later()).alias("_r")).select("_r.*")
    return one.withColumn(_HASH, row_hash(one.select(*columns)))  # again, as what is shuffled has it once, as 32 bytes


def _later() -> Column:
    """What says which of two rows of a key is later."""
    return F.struct(_VERSION, _DELETED, F.unhex(_HASH).alias(_HASH))


def commit(spark: SparkSession, index: SnapshotIndex, changes: DataFrame, deleted: str | None = None, source: str = "", batch: int | None = None) -> int:
    """The snapshot after a change: its number, or that of the latest one if nothing changed.

    changes has the index's columns, and deleted, if named, where true a key goes. Of the rows of a key, in the change and
    in the index, the one of the largest version counts; of equal versions a delete, then the larger hash, so that the order
    in which changes come does not matter. A deleted key is remembered with its version: an older row does not bring it back.
    A batch of a source is committed once: that it or a later one is in a manifest makes it no change. Rows without a key, a
    version or, unless deleted, a partition are not indexed.

    The change is read once. Only its keys meet the index, and only touched parts are read whole and written. Two writers
    at once are not served: the second one's manifest is there already, which fails.
    """
    known = versions(spark, index)
    at = known[-1] if known else 0
    manifest = _manifest(spark, index)
    if batch is not None and manifest is not None and not manifest.where((F.col("source") == source) & (F.col("batch") >= batch)).isEmpty():
        return at
    name = "c" + uuid.uuid4().hex
    stage = f"{index.path}/staged/{name}"
    _staged(index, changes, deleted, at + 1).write.parquet(f"{stage}/rows")
    rows = spark.read.parquet(f"{stage}/rows")
    near = F.broadcast if rows.count() <= BROADCAST_KEYS else lambda d: d
    old = _held(spark, index, at) if known else None
    now = rows.select(index.key, F.col(_PART).alias("_now"), _later().alias("_new"))
    if old is None:
        moves = now.select(index.key, F.lit(None).cast("string").alias("_was"), "_now")
    else:
        was = old.join(near(rows.select(index.key)), index.key, "left_semi").select(index.key, F.col(_PART).alias("_was"), _later().alias("_old"))
        moves = now.join(was, index.key, "left").where(F.col("_old").isNull() | (F.col("_new") > F.col("_old"))).select(index.key, "_was", "_now")
    moves.write.parquet(f"{stage}/moves")
    moves = spark.read.parquet(f"{stage}/moves")
    if moves.isEmpty():
        return at
    parts = moves.select(F.explode(F.array_compact(F.array("_was", "_now"))).alias(_PART)).distinct()
    keys = near(moves.select(index.key))
    out = rows.join(keys, index.key, "left_semi")
    if old is not None:
        # Parts can be few though keys are many: by a shuffle all rows of a part would be one task's.
        few = F.broadcast(parts) if parts.count() <= BROADCAST_KEYS else parts
        out = old.join(few, _PART, "left_semi").join(keys, index.key, "left_anti").drop("commit").unionByName(out)
    place = f"{index.path}/data/commit={name}"
    out.hint("rebalance", F.col(_PART)).write.partitionBy(_PART).parquet(place)
    fresh = spark.read.parquet(place).groupBy(_PART).agg(F.count("*").alias("rows")).select(_PART, F.lit(name).alias("commit"), "rows")
    if manifest is not None and known:
        held = manifest.where((F.col("version") == at) & F.col(_PART).isNotNull()).select(_PART, "commit", "rows")
        fresh = fresh.unionByName(held.join(parts, _PART, "left_anti"))
    head = spark.range(1).select(F.lit(None).cast("string").alias(_PART), F.lit(None).cast("string").alias("commit"), F.lit(None).cast("long").alias("rows"))
    entries = fresh.unionByName(head).withColumns({"source": F.lit(source), "batch": F.lit(batch).cast("long")})
    entries.coalesce(1).write.parquet(f"{index.path}/manifest/version={at + 1}")
    return at + 1


def unreferenced(spark: SparkSession, index: SnapshotIndex, keep: int) -> DataFrame:
    """(commit): folders below data that none of the last keep snapshots reads, for whoever deletes files."""
    manifest = _manifest(spark, index)
    live = manifest.where(F.col("version").isin(versions(spark, index)[-keep:])).select("commit")
    return manifest.select("commit").where("commit is not null").distinct().join(live, "commit", "left_anti")
