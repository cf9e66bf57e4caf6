"""The event-driven jobs as Structured Streaming (R1-R5); state is bounded by watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquery.operators.carbon import actual_and_others, folded, parsed_lines
from docquery.operators.entities import latest_of, read_index, write_changed
from docquery.sources import snapshots


#: State on executors' disks, for many open keys; no count of them is kept, as that takes a read for each write.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", on_late: Callable[[int], None] | None = None, on_disk: bool = False) -> DataFrame:
    """Everything that is there now, to Parquet, and the sink read back; a later call goes on where this one ended.

    on_late is told how many rows came after the watermark and were dropped (R2). on_disk keeps the state of open keys on
    disk and not in the executors' heaps; a checkpoint stays with the kind of state that it began with.
    """
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in ON_DISK if on_disk}
    try:
        for key in before:
            conf.set(key, ON_DISK[key])
        query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)
    query.awaitTermination()
    if on_late is not None:
        on_late(sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def carbon_records(lines: DataFrame, late: str = "10 minutes", apart: str = "10 minutes") -> DataFrame:
    """Usage lines (ts, batch_id, line_no, message) as one carbon record for each batch and region.

    The lines of one batch are folded as records() folds them, in whatever order and micro-batches they come, as long as
    none is further than apart from the next one in time: a session window of the batch is the state, one row for each,
    which ends apart after its last line and is given out once the watermark has passed that. A line that comes again
    changes nothing before, and is dropped after. ts is the first line's time.
    """
    parsed = parsed_lines(lines.withWatermark("ts", late), ("ts", "batch_id", "line_no"))
    # The batch comes first, as rows are sorted by these: a number is compared faster than a window.
    made = folded(parsed, ["batch_id", F.session_window("ts", apart).alias("session")])
    return actual_and_others(made.withColumn("ts", F.col("session.start")).drop("session"))


def interval_ratings(readings: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The last rating (ts, region, rating) of each region and five minutes, once the interval is over (R2)."""
    window = F.window("ts", "5 minutes")
    last = readings.withWatermark("ts", late).groupBy(window.alias("w"), "region").agg(F.max_by("rating", "ts").alias("rating"))
    return last.select(F.col("w.start").alias("start_date"), F.col("w.end").alias("end_date"), "region", "rating")


def with_current_report(records: DataFrame, report: DataFrame) -> DataFrame:
    """Streamed records with the report's intensity of their region, read anew in each micro-batch."""
    return records.join(report.select("region", F.col("rating").alias("intensity")), "region", "left")


def delivered(messages: DataFrame, connections: DataFrame, late: str = "5 minutes", within: str = "1 hour") -> DataFrame:
    """Messages (id, sender, recipient, ts) to live connections (conn_id, user, created) of both parties."""
    ends = messages.withWatermark("ts", late).select("id", "ts", F.explode(F.array_distinct(F.array("sender", "recipient"))).alias("party"))
    live = connections.withWatermark("created", late)
    near = (F.col("party") == F.col("user")) & (F.col("created") <= F.col("ts")) & (F.col("created") > F.col("ts") - F.expr(f"interval {within}"))
    return ends.join(live, near).select("id", "user", "conn_id", "created", "ts")


def index_changes(changed: DataFrame, path: str, checkpoint: str, key: str, partition: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x, deleted: str | None = None, version: str | None = None) -> None:
    """A change stream into an index, one upsert for each micro-batch.

    Of one batch's rows of a key the one of the largest version counts; without a version column that of the largest hash.
    Rows in which the column deleted is true take their key out of the index; the column itself is not indexed. Versions of
    different batches are not compared, and readers may see half a write: snapshot_changes does better.
    """

    def apply(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch = latest_of(batch, key, version)
        gone = batch.where(F.col(deleted)).select(key) if deleted else None
        new = prepare(batch.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else batch)
        old = read_index(spark, path, key, new.schema).select(*new.columns)
        write_changed(old, new, key, partition, path, gone)

    changed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def snapshot_changes(changed: DataFrame, index: snapshots.SnapshotIndex, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x, deleted: str | None = None) -> None:
    """A change stream into an index with snapshots, one for each micro-batch that changes anything.

    Versions are merged over all batches, so that a late one changes nothing, and a batch that comes again is known.
    """

    def apply(batch: DataFrame, number: int) -> None:
        snapshots.commit(batch.sparkSession, index, prepare(batch), deleted, checkpoint, number)

    changed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
