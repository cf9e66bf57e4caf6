"""A positional inverted index: each term's documents and places, dealt by term, and searches that read only a query's terms.

    path/postings/segment=<n>/part=<p>/*.parquet    term, and of some of one change's documents with it arrays of keys, of positions
    path/docs                                       an index with snapshots: key, segment, tokens, grams of each live document

A change adds a segment and then moves its documents to it in one switch of snapshots, so a document's old postings no longer
count, nor do a deleted one's. Searches give the scores that the operators of relevance give on analysed texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from docquery.functions import text as tx
from docquery.operators.relevance import length_factor
from docquery.session import kept
from docquery.sources import snapshots as sn

#: Parts that terms are dealt to by hash, those of the documents, and rows of a file.
PARTS, DOC_PARTS, FILE_ROWS = 64, 64, 5_000_000
#: Tokens that a task puts in order at once, so that a row's arrays are bounded (a longer text is put in order alone).
CHUNK_TOKENS = 1 << 20


@dataclass(frozen=True)
class PostingIndex:
    """Where an index is, the key and text columns of its documents, their version column if any, and whether terms are stems."""

    path: str
    key: str = "doc_id"
    text: str = "text"
    version: str | None = None
    stem: bool = True

    @property
    def docs(self) -> sn.SnapshotIndex:
        return sn.SnapshotIndex(f"{self.path}/docs", "doc", "bucket", "version" if self.version else None)


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have at most limit tokens together; never less than a row."""
    total, start = 0, 0
    for row, size in enumerate(pa.compute.list_value_length(batch.column("t")).to_pylist()):
        if total and total + size > limit:
            yield batch.slice(start, row - start)
            total, start = 0, row
        total += size
    yield batch.slice(start)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, .., t) to rows of a term and the documents of a piece that have it: term, doc, .., positions, each an array by document."""
    for piece in (p for batch in batches for p in _pieces(batch, CHUNK_TOKENS)):
        t = piece.column("t")
        words = t.flatten().dictionary_encode()
        if not len(words):
            continue
        row = t.value_parent_indices().to_numpy()
        at = np.arange(len(row)) - np.searchsorted(row, row)
        term = words.indices.to_numpy().astype("int64")
        order = np.argsort(term * piece.num_rows + row, kind="stable")
        term, row = term[order], row[order]
        lists = lambda starts, values: pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype("int32")), values)
        fresh = np.diff(term, prepend=-1) != 0
        starts = np.flatnonzero(fresh | (np.diff(row, prepend=-1) != 0))
        firsts = np.flatnonzero(fresh[starts])
        of = pa.array(row[starts])
        own = [n for n in piece.schema.names if n != "t"]
        columns = [*[piece.column(n).take(of) for n in own], lists(starts, pa.array(at[order].astype("int32")))]
        yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term[starts[firsts]])), *[lists(firsts, c) for c in columns]], names=["term", *own, "positions"])


def update(spark: SparkSession, index: PostingIndex, changes: DataFrame, deleted: str | None = None) -> int:
    """The snapshot after new, changed and deleted documents; of the rows of a key the latest counts, as sn.commit has it.

    A null text has no terms. Texts are analysed once, those that go not at all; a document's places are put in order beside
    its text, so that only postings are shuffled, once; a term that very many documents have is written by several tasks.
    """
    segment = len(sn.versions(spark, index.docs)) + 1
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    version = [c for c in ("version",) if index.version]
    own = [F.col(index.key).alias("doc"), gone.alias("deleted"), *([F.col(index.version).alias("version")] if index.version else [])]
    t = F.when(gone, F.array().cast("array<string>")).otherwise(tx.analysed_phrase(F.coalesce(index.text, F.lit("")), index.stem))
    rows = changes.where(F.col(index.key).isNotNull()).select(*own, t.alias("t"))
    stage = f"{index.path}/staged/{segment}-{len(sn.versions(spark, index.docs))}"
    rows.select("*", F.size("t").alias("tokens"), F.size(tx.gram_hashes(F.col("t"))).alias("grams")).write.mode("overwrite").parquet(stage)
    rows = _latest(spark.read.parquet(stage), version)
    texts = rows.where("not deleted").select("doc", *version, "t")
    lists = [T.StructField(f.name, T.ArrayType(f.dataType)) for f in texts.drop("t").schema] + [T.StructField("positions", T.ArrayType(T.ArrayType(T.IntegerType())))]
    found = texts.mapInArrow(_postings, T.StructType([T.StructField("term", T.StringType()), *lists])).withColumn("part", part_of(F.col("term")))
    found = found.hint("rebalance", F.col("part")).sortWithinPartitions("part", "term")
    found.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("part").parquet(f"{index.path}/postings/segment={segment}")
    bucket = F.pmod(F.xxhash64("doc"), F.lit(DOC_PARTS)).cast("string")
    live = rows.select("doc", *version, "deleted", bucket.alias("bucket"), F.lit(segment).alias("segment"), "tokens", "grams")
    return sn.commit(spark, index.docs, live, "deleted")


def _latest(rows: DataFrame, version: list[str]) -> DataFrame:
    """One row for each document: of rows that repeat a key the latest, as sn.commit has it. Only these are shuffled whole."""
    twice = kept(rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "twice")
    if twice.isEmpty():
        return rows
    last = F.max_by(F.struct(*rows.columns), F.struct(*version, "deleted", F.xxhash64("t")))
    one = rows.join(twice, "doc", "left_semi").groupBy(F.col("doc").alias("_k")).agg(last.alias("_r")).select("_r.*")
    return kept(rows.join(twice, "doc", "left_anti").unionByName(one), "latest")


def read(spark: SparkSession, index: PostingIndex, terms: list[str]) -> DataFrame:
    """(doc, term, positions, tokens, grams) of the live documents with any of the terms: only these terms' parts are read."""
    if not terms:
        terms = [""]
    places = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(part_of(F.col("term"))).distinct().collect()]
    found = spark.read.parquet(f"{index.path}/postings").where(F.col("part").isin(places) & F.col("term").isin(terms))
    live = sn.read(spark, index.docs)
    lists = [c for c in ("doc", "version", "positions") if c in found.columns]
    found = found.select("term", "segment", F.explode(F.arrays_zip(*lists)).alias("p")).select("term", "segment", "p.*")
    return found.join(live, [c for c in ("doc", "segment", "version") if c in live.columns]).select("doc", "term", "positions", "tokens", "grams")


def _by_document(spark: SparkSession, index: PostingIndex, terms: list[str]) -> DataFrame:
    """A row for each document with its positions of each term, in the terms' order: as many columns as the query has terms."""
    rows = read(spark, index, terms)
    columns = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(terms)]
    return rows.groupBy("doc").agg(F.first("tokens").alias("tokens"), F.first("grams").alias("grams"), *columns)


def _run(columns: list[Column]) -> Column:
    """Whether there are places that follow each other, one of each column."""
    last = columns[0]
    for c in columns[1:]:
        last = F.array_intersect(F.transform(last, lambda p: p + 1), c)
    return F.coalesce(F.size(last) > 0, F.lit(False))


def match(spark: SparkSession, index: PostingIndex, query: list[str], boost: float = 1.0) -> DataFrame:
    """(key, score) of the documents that share an n-gram with the query's, as relevance.match() scores them."""
    terms = sorted({w for q in query for w in q.split(" ")})
    at = {t: F.col(f"p{i}") for i, t in enumerate(terms)}
    shared = sum((_run([at[w] for w in q.split(" ")]).cast("int") for q in dict.fromkeys(query)), F.lit(0))
    rows = _by_document(spark, index, terms).withColumn("shared", shared).where("shared > 0")
    return rows.select(F.col("doc").alias(index.key), (F.col("shared") * length_factor(F.col("grams")) * boost).alias("score"))


def phrase(spark: SparkSession, index: PostingIndex, query: list[str], boost: float = 1.0) -> DataFrame:
    """(key, score) of the documents with the query's words next to each other, as relevance.phrase() without slop."""
    terms = sorted(set(query))
    rows = _by_document(spark, index, terms)
    held = rows.where(_run([F.col(f"p{terms.index(w)}") for w in query])) if query else rows.limit(0)
    return held.select(F.col("doc").alias(index.key), (float(len(query)) * length_factor(F.col("tokens")) * 2.5 * boost).alias("score"))


def document_frequency(spark: SparkSession, index: PostingIndex, terms: list[str]) -> DataFrame:
    """(term, df, idf) of the terms; one that no document has counts as if one had it, as unknown tokens do."""
    total = sn.read(spark, index.docs).count()
    asked = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "term string")
    found = read(spark, index, list(dict.fromkeys(terms))).groupBy("term").agg(F.count("*").alias("df"))
    rows = asked.join(found, "term", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    return rows.withColumn("idf", F.ln(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)))
