"""Hard negatives by Fagin's threshold algorithm: sorted lists by dimension, random access to whole vectors, exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docquery.llm.common import quoted, shared_dir, written

#: Rows of vectors that one set of sorted lists holds, and components that it holds at most (for long vectors).
BLOCK_ROWS, BLOCK_CELLS = 8192, 1 << 20
#: Anchors that are looked up in one pass over all vectors: the driver and each task hold no more of them at a time.
ANCHORS, ANCHOR_CELLS = 16384, 1 << 20
#: Scaled components are held between these, so that an inner product of up to 128 of them fits 64 bits.
LARGEST = 1 << 28
#: Rows of each list that the first round of sorted access takes; every further round takes twice as many.
FIRST_ROUND = 32


def scaled(embeddings: DataFrame, scale: float = 256.0, shift: int = 7, classes: int = 10) -> DataFrame:
    """(id, label, q): vectors of whole numbers, floor(scale * x), with the label that counts.

    Rows without id, label or vector, or with a null or non-finite component, take no part. Of rows that repeat an id the
    first by (label, vector) counts. A component beyond 2**28 after scaling counts as that.
    """
    x = quoted("embedding").cast("array<double>")
    rows = embeddings.select(quoted("vec_id").cast("long").alias("id"), quoted("label").cast("long").alias("label"), x.alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where("id is not null and label is not null and x is not null").where(~odd)
    label = F.when(F.col("id") % shift == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    q = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))
    one = rows.select("id", F.struct(label.alias("label"), q.alias("q")).alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    return one.select("id", "row.label", "row.q")


def matrix(lists: list[list[int]], width: int | None = None) -> np.ndarray:
    """Vectors as rows of one matrix; a shorter one ends in zeros, and what is beyond width is left out."""
    width = max(map(len, lists), default=0) if width is None else width
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : min(len(v), width)] = v[:width]
    return out


class SortedLists:
    """A block of vectors and, for each dimension, its rows from the least component to the greatest."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        by_id = np.argsort(ids, kind="stable")  # rows in order of id: a stable sort by score alone then breaks ties as it must
        self.ids, self.labels, self.q = ids[by_id], labels[by_id], q[by_id]
        self.order = np.argsort(self.q, axis=0, kind="stable").T.copy()
        self.value = np.take_along_axis(self.q.T, self.order, 1)

    def rounds(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows not seen before with their scores, and what no unseen row's score exceeds (None when all are seen).

        Sorted access goes down each list from the end that the sign of the anchor's component makes the better one.
        """
        n = len(self.ids)
        dims = np.flatnonzero(anchor)
        if not len(dims):
            yield np.arange(n), np.zeros(n, np.int64), None
            return
        weight, seen, depth, step = anchor[dims], np.zeros(n, bool), 0, FIRST_ROUND
        down, up = dims[weight > 0], dims[weight < 0]
        while depth < n:
            stop = min(n, depth + step)
            reached = np.zeros(n, bool)
            reached[self.order[down, n - stop : n - depth]] = True
            reached[self.order[up, depth:stop]] = True
            rows = np.flatnonzero(reached & ~seen)
            seen |= reached
            bound = int(anchor[down] @ self.value[down, n - stop] + anchor[up] @ self.value[up, stop - 1])
            yield rows, self.q[rows] @ anchor, None if stop == n else bound
            depth, step = stop, 2 * step

    def top(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int | None, int | None]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each window (least, greatest score; None is open) the first k allowed rows and their scores.

        A window is settled once no unseen row can reach its kth score or its least one; equal scores are not below, as an
        unseen row can have the smaller id.
        """
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        best: list[tuple[np.ndarray, np.ndarray]] = [(rows, scores)] * len(windows)
        for new, found, bound in self.rounds(anchor):
            mine = allowed[new]
            new, found = new[mine], found[mine]
            settled = True
            for i, (least, greatest) in enumerate(windows):
                inside = np.ones(len(new), bool)
                if least is not None:
                    inside &= found >= least
                if greatest is not None:
                    inside &= found <= greatest
                rows, scores = np.concatenate([best[i][0], new[inside]]), np.concatenate([best[i][1], found[inside]])
                first = np.lexsort((rows, -scores))[:k]
                best[i] = rows[first], scores[first]
                full = len(first) == k and bound is not None and bound < int(best[i][1][-1])
                settled &= bound is None or full or (least is not None and bound < least)
            if settled:
                break
        return best


def blocks(batches) -> Iterator[SortedLists]:
    """The rows of a task as blocks of bounded size."""
    ids: list[int] = []
    labels: list[int] = []
    vectors: list[list[int]] = []
    width = 0
    for batch in batches:
        for i, label, q in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (len(ids) >= BLOCK_ROWS or (len(ids) + 1) * max(width, len(q)) > BLOCK_CELLS):
                yield SortedLists(np.array(ids), np.array(labels), matrix(vectors))
                ids, labels, vectors, width = [], [], [], 0
            ids.append(i)
            labels.append(label)
            vectors.append(q)
            width = max(width, len(q))
    if ids:
        yield SortedLists(np.array(ids), np.array(labels), matrix(vectors))


def _lookup(vectors: DataFrame, anchors: list[tuple[int, int, list[int]]], windows: dict[int, list[tuple[int, int]]] | None, k: int) -> DataFrame:
    """(anchor, w, id, score): of each block of vectors the first k rows of each window of each anchor.

    Without windows: the first k other rows of the anchor's label, under w = 0. With them, rows of other labels; w is the
    window's place in the anchor's list.
    """
    shared = vectors.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches):
        known, bounds = shared.value
        for block in blocks(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for anchor, label, vector in known:
                same = block.labels == label
                if bounds is None:
                    allowed, wanted = same & (block.ids != anchor), [(None, None)]
                else:
                    allowed, wanted = ~same, bounds.get(anchor, [])
                if not wanted:
                    continue
                a = matrix([vector], block.q.shape[1])[0]
                for w, (rows, scores) in enumerate(block.top(a, allowed, wanted, k)):
                    for column, values in zip(out, (np.full(len(rows), anchor), np.full(len(rows), w), block.ids[rows], scores), strict=True):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["anchor", "w", "id", "score"])

    return vectors.select("id", "label", "q").mapInArrow(run, "anchor long, w long, id long, score long")


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    """Of each group the first k by score and id, with their rank; blocks have left few of them."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, scale: float = 256.0, shift: int = 7, classes: int = 10) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by every.

    For each anchor and each of its first positives (rows of its label by score, ties by id) the first rows of other labels
    whose score is between low percent of the positive's and the positive's: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. Positives of a score below 0 have none, as the window is empty. scaled() says which rows
    take part; vectors of unequal length are compared as if the shorter one ended in zeros, an empty one scores 0 with all.
    An empty table gives no row; other columns are not read.

    The anchors go over all vectors in blocks of at most ANCHORS, each two passes: one for the positives, one for the
    windows that these open. Blocks of vectors are tasks' work, so a label or a value that many rows share is dealt with them.
    """
    spark = embeddings.sparkSession
    rows = scaled(embeddings, scale, shift, classes)
    parts = max(spark.sparkContext.defaultParallelism, -(-embeddings.count() // BLOCK_ROWS))
    vectors = written(rows.repartition(parts), "vectors")
    asked = vectors.where(F.col("id") % every == 0)
    widest = asked.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    passes = max(1, -(-widest["n"] // min(ANCHORS, max(1, ANCHOR_CELLS // max(1, widest["width"] or 1)))))
    kept = shared_dir(spark) + "/negatives"
    for turn in range(passes):
        mine_now = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == turn)
        anchors = [(r["id"], r["label"], r["q"]) for r in mine_now.toLocalIterator()]
        near = [(r["anchor"], r["id"], r["score"]) for r in _first(_lookup(vectors, anchors, None, positives), positives, "anchor").collect()]
        windows: dict[int, list[tuple[int, int]]] = {}
        pairs = []
        for anchor, positive, score in near:
            if score >= 0:
                window = (-(-low * score // 100), score)
                known = windows.setdefault(anchor, [])
                if window not in known:
                    known.append(window)
                pairs.append((anchor, known.index(window), positive, score))
        opened = spark.createDataFrame(pairs, "anchor long, w long, positive_id long, positive_score long")
        found = _first(_lookup(vectors, anchors, windows, negatives), negatives, "anchor", "w")
        result = opened.join(found, ["anchor", "w"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        result.write.mode("append").parquet(kept)
    return spark.read.parquet(kept)
