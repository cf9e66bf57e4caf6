"""Benchmark decontamination: Wu-Manber search of all windows of all benchmark items at once, over words."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, functions as F

from docquery.llm.common import annotate, quoted, written

#: Bytes to a space where the contract has no word byte, A-Z to a-z: what is left between spaces are words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Benchmark text of one automaton; a larger benchmark is searched in blocks of this size.
BLOCK_BYTES = 8 << 20


def text_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class Automaton:
    """Windows of one length, found by shifts.

    A block is a pair of words (one word where windows have one). shift[block] is how far the search may move when it
    sees that block at its end: 0 for the last block of a window, the distance to the end for others, and for a block
    that no window has the whole length less one.
    """

    def __init__(self, windows: dict[tuple, list], length: int):
        self.length, self.width = length, min(2, length)
        self.far = length - self.width + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for window in windows:
            for end in range(self.width, length + 1):
                block = window[end - self.width : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.bucket.setdefault(hash(window[-self.width :]), []).append(window)
        self.windows = windows

    def search(self, words: list[bytes]):
        """(start, items) of every occurrence."""
        length, width, far, shift, n = self.length, self.width, self.far, self.shift, len(words)
        end, get = length, shift.get
        while end <= n:
            block = (words[end - 2], words[end - 1]) if width == 2 else (words[end - 1],)
            step = get(block, far)
            if step:
                end += step
                continue
            here = tuple(words[end - length : end])
            for window in self.bucket.get(hash(block), ()):
                if window == here:
                    yield end - length, self.windows[window]
                    break
            end += 1


def windows_of(items: list[tuple], size: int) -> dict[int, dict[tuple, list]]:
    """Windows by length, each with the ids of the items that have it."""
    found: dict[int, dict[tuple, list]] = {}
    for item, text in items:
        w = text_words(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            ids = found.setdefault(k, {}).setdefault(tuple(w[i : i + k]), [])
            if not ids or ids[-1] != item:
                ids.append(item)
    return found


def _searcher(items: list[tuple], size: int):
    def factory():
        parts = [Automaton(windows, length) for length, windows in windows_of(items, size).items()]

        def work(texts):
            counts, hits, spans, names = [], [], [], []
            for text in texts:
                w = text_words(text)
                found = sorted((start, start + a.length, ids) for a in parts for start, ids in a.search(w))
                runs: list[list[int]] = []
                for start, end, _ in found:
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([start, end])
                counts.append(len(w))
                hits.append(sum(b - a for a, b in runs))
                spans.append([{"start": a, "end": b} for a, b in runs])
                names.append(sorted({x for _, _, ids in found for x in ids}))
            return counts, hits, spans, names

        return work

    return factory


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", window: int = 10, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents (the columns in keep, all by default) with n_words, n_hit, hits and item_ids.

    A window is `window` consecutive words of an item, or the whole of a shorter one; hits are the ranges of document
    words (end exclusive, merged) that lie in an occurrence of one, n_hit their number and item_ids the items, as text
    and sorted as such. Texts are whole. Null or empty texts have no words, and a document without words no hits; items
    without words or id are never found; equal items count once each id; repeated documents each have their row. A kept
    column named like one of the four is replaced. The benchmark is read in blocks of at most about block_bytes of
    text (a single larger item is a block), each a broadcast of that size and one pass over the documents. The driver has
    one block at a time: the texts that a block is found in are written by their SHA-256 before the next one is read.
    """
    known = benchmark.select(quoted(item).cast("string").alias("item"), quoted(text).cast("binary").alias("t")).where("item is not null and t is not null")
    size = known.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    keep = documents.columns if keep is None else keep
    out = documents.select(*[quoted(c).alias(c) for c in dict.fromkeys([*keep, text])])
    types = "n_words long, n_hit long, hits array<struct<start: long, end: long>>, item_ids array<string>"

    def searched(rows: DataFrame, kept: list[str], block: int) -> DataFrame:
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        return annotate(rows, text, kept, _searcher([(r.item, bytes(r.t)) for r in part.collect()], window), types)

    if blocks == 1:
        return searched(out, keep, 0)
    taken = {c.lower() for c in out.columns}
    key, hits, ids = (next(n for n in (f"{stem}{i}" for i in count()) if n not in taken) for stem in ("_key", "_hits", "_ids"))
    keyed = out.withColumn(key, F.sha2(quoted(text).cast("binary"), 256))
    earlier = []
    for b in range(blocks - 1):
        found = searched(keyed, [key], b).where("n_hit > 0")
        earlier.append(written(found.groupBy(key).agg(F.first("hits").alias(hits), F.first("item_ids").alias(ids)), f"block{b}"))
    more = reduce(DataFrame.unionByName, earlier).groupBy(key).agg(F.flatten(F.collect_list(hits)).alias(hits), F.flatten(F.collect_list(ids)).alias(ids))
    found = searched(keyed, [*keep, key], blocks - 1).join(more, key, "left")
    runs = F.array_sort(F.when(F.col(hits).isNull(), F.col("hits")).otherwise(F.concat("hits", hits)))
    none = F.array().cast("array<struct<start: long, end: long>>")
    merged = F.aggregate(runs, none, _joined)
    named = F.array_sort(F.array_distinct(F.when(F.col(ids).isNull(), F.col("item_ids")).otherwise(F.concat("item_ids", ids))))
    found = found.withColumn("hits", merged).withColumn("item_ids", named)
    found = found.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]))
    names = ("n_words", "n_hit", "hits", "item_ids")
    return found.select(*[quoted(c) for c in keep if c.lower() not in names], *names)


def _joined(acc, x):
    """The merged ranges with one more, which starts no earlier than the last of them."""
    last = F.try_element_at(acc, F.lit(-1))
    longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
    return F.when((F.size(acc) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the operator's."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
