"""What the operators share: row annotation through Arrow, tables in the shared folder, labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docquery.session import shared_dir

#: Bytes of text that one call of an annotating function works on (a longer text is a call of its own).
CHUNK_BYTES = 1 << 20


def quoted(name: str):
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts come to about limit bytes; never less than a row."""
    total, start = 0, 0
    for row, size in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if total and total + (size or 0) > limit:
            yield batch.slice(start, row - start)
            total, start = 0, row
        total += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def annotate(df: DataFrame, text: str, keep: list[str], factory: Callable, outputs: str) -> DataFrame:
    """Columns computed from the whole text of each row, beside the kept ones.

    factory() runs once a task and returns a function from a list of UTF-8 byte strings (None for null) to one list per
    output column. A kept column that an output column's name equals is replaced, as withColumn does.
    """
    out = T.StructType.fromDDL(outputs)
    taken = {f.name.lower() for f in out}
    kept = [c for c in keep if c.lower() not in taken]
    schema = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(kept)] + [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(out)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = factory()
        for batch in batches:
            for part in chunks(batch, len(kept)):
                found = work(part.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(i).cast(arrow.field(i).type) for i in range(len(kept))] + [pa.array(v, type=arrow.field(len(kept) + i).type) for i, v in enumerate(found)], schema=arrow)

    rows = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)], quoted(text).cast("binary").alias("t")).mapInArrow(run, schema)
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"o{i}").alias(f.name) for i, f in enumerate(out)])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: what reads them needs nothing of what made them."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def crc_class(doc_id, classes: int):
    """crc32 of the id as text, modulo classes; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(classes))


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, split: tuple[int, int], rows: int) -> DataFrame:
    """(doc_id, text, label) of at most rows labelled documents outside the held-out class, in an order by hash of the id.

    split is (classes, held-out remainder). A document that is labelled both ways counts by its mean, 1 from one half on.
    The ids are bounded by rows, so that they are broadcast and no text is shuffled to find them; a repeated id keeps the
    smallest text.
    """
    classes, out = split
    known = labels.select(quoted("doc_id").alias("id"), quoted(target).cast("double").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("label")).where(crc_class(F.col("id"), classes) != out)
    few = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = documents.select(quoted("doc_id").alias("doc_id"), quoted("text").alias("text"))
    found = texts.join(F.broadcast(few), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
