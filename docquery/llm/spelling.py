"""Spelling variants: words of one edit's distance by dynamic programming down a sorted list, and the forms they lead to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docquery.llm.common import quoted, written
from docquery.llm.textkernels import LOWER

#: Maximal runs of letters: ASCII ones and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]"
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Words of a group beyond which it is split by where the edit lies, and cells of code points of one scan.
GROUP, CELLS = 2048, 1 << 21
#: Queries whose rows of the edit matrix are carried down the list at once.
QUERIES = 16384
FAR = 9  # stands for any distance of two or more


def counted(documents: DataFrame, least_length: int, prime: int = 199) -> DataFrame:
    """(word, n): lower-cased runs of all texts, some of them with a letter taken out, and how often they occur.

    A run loses the code point at h % length where prime divides h, the crc32 of `<doc_id>:<run>`. A null id is empty text.
    """
    run_of = re.compile(RUN + "{%d,}" % max(1, least_length))

    def run(batches):
        words: Counter[str] = Counter()

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = Counter(run_of.findall(text.as_py().translate(LOWER).decode("utf-8", "replace")))
                start = zlib.crc32(f"{doc.as_py()}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if not h % prime:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    words[word] += n
                if len(words) > HELD:
                    yield emit()
                    words.clear()
        if words:
            yield emit()

    texts = documents.select(F.coalesce(quoted("doc_id").cast("string"), F.lit("")).alias("d"), quoted("text").cast("binary").alias("t")).where("t is not null")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# Pairs of words at distance 1 are looked for in groups. Let i be the place of the first difference and k the shorter word's
# length: both words begin with the same i code points, and what follows the edit is the same too. A group (k, lo, hi, key)
# has the words of length k or k + 1 that agree in what lies before lo and after hi, and finds the pairs with lo <= i < hi.
# So each pair is found once; a group that is too large is cut at the middle of lo to hi, down to one place, where what is
# left to vary is one code point.


def _keyed(rows: DataFrame, lo, hi) -> DataFrame:
    """Rows (word, n, size, k) under the key of lo and hi: what is before lo and what the shorter word has from hi on."""
    tail = F.greatest(F.col("k") - hi, F.lit(0))
    ends = F.when(tail == 0, "").otherwise(F.expr("right(word, tail)"))
    rows = rows.withColumn("lo", lo).withColumn("hi", hi).withColumn("tail", tail)
    return rows.withColumn("key", F.struct(F.col("k"), F.col("lo"), F.col("hi"), F.expr("left(word, lo)").alias("head"), ends.alias("end"))).select("word", "n", "size", "k", "lo", "hi", "key")


def _halves(rows: DataFrame) -> DataFrame:
    """Each row under both halves of its group."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    both = rows.withColumn("part", F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("hi").alias("b")))))
    both = both.where("part.b > part.a")
    return _keyed(both.select("word", "n", "size", "k", F.col("part.a").alias("x"), F.col("part.b").alias("y")), F.col("x"), F.col("y"))


def grouped(vocabulary: DataFrame) -> DataFrame:
    """(word, n, size, k, lo, hi, key): every word in the groups in which its near words are found."""
    sized = vocabulary.select("word", "n", F.length("word").alias("size"))
    both = sized.withColumn("k", F.explode(F.array(F.col("size"), F.col("size") - 1))).where("k > 0")
    rows = written(_halves(both.withColumn("lo", F.lit(0)).withColumn("hi", F.col("k") + 1)), "halves")
    done = None
    while True:
        large = rows.groupBy("key").count().where((F.col("count") > GROUP) & (F.col("key.hi") - F.col("key.lo") > 1)).select("key")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti").select(rows.columns)
        done = small if done is None else done.unionByName(small)
        rows = written(_halves(rows.join(large, "key", "left_semi").select(rows.columns)), "halves")


def code_points(words: list[str], width: int) -> np.ndarray:
    """Words as rows of code points, ended by zeros."""
    joined = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(words), width)


def near_pairs(words: list[str], group: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (query, other) of words of one group at distance 1, the shorter of length k, that first differ from lo up to hi.

    words are sorted within their groups, and a group's rows stand together; k, lo and hi are by row. The queries go down the
    list together: a stretch of words with a common beginning is one node, whose band of the edit matrix (a row for its
    beginning, three cells about the diagonal) is made from its parent's, so words reuse the rows of what they share with
    the word before. A node of which no cell is under 2 is dropped with all of its words.
    """
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    width = int(size.max(initial=0)) + 3
    at = code_points(words, width)
    same = np.cumprod(at[1:] == at[:-1], axis=1, dtype=np.uint8).sum(1, dtype=np.int64) if n > 1 else np.zeros(0, np.int64)
    lcp = np.concatenate([[-1], np.where(group[1:] == group[:-1], np.minimum(same, np.minimum(size[1:], size[:-1])), -1)])  # with the word before; -1 where a group begins
    found_q, found_w = [], []
    for begin in range(0, n, QUERIES):
        query = np.arange(begin, min(n, begin + QUERIES))
        heads = np.flatnonzero(lcp < 0)
        node = np.searchsorted(heads, query, "right") - 1  # of the nodes at depth 0, which are the groups
        left, mid, right = np.full(len(query), FAR, np.int8), np.zeros(len(query), np.int8), np.ones(len(query), np.int8)
        depth = 0
        while len(query):
            first = heads[node]  # a node's first word is its shortest: one that ends here
            ended = size[first] == depth
            cell = size[query] - depth
            distance = np.select([cell == -1, cell == 0, cell == 1], [left, mid, right], FAR)
            hit = ended & (distance == 1)
            found_q.append(query[hit])
            found_w.append(first[hit])
            child_heads = np.flatnonzero(lcp <= depth)  # the nodes one code point deeper; those of words that end here hold no more
            low = np.searchsorted(child_heads, first)
            upto = np.append(heads, n)[node + 1]
            count = np.searchsorted(child_heads, upto) - low
            query, left, mid, right = (np.repeat(v, count) for v in (query, left, mid, right))
            node = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            c = at[child_heads[node], depth]
            live = size[child_heads[node]] > depth
            query, left, mid, right, node, c = query[live], left[live], mid[live], right[live], node[live], c[live]
            at_query = lambda j: at[query, np.clip(j, 0, width - 1)]
            length = size[query]
            new_left = np.minimum(left + (at_query(depth - 1) != c) if depth else np.full(len(query), FAR, np.int8), mid + 1)
            new_mid = np.minimum(np.minimum(mid + (at_query(depth) != c), right + 1), new_left + 1)
            new_mid = np.where(depth + 1 <= length, new_mid, FAR)
            new_left = np.where(depth <= length, new_left, FAR)
            new_right = np.where(depth + 2 <= length, np.minimum(right + (at_query(depth + 1) != c), new_mid + 1), FAR)
            keep = np.minimum(np.minimum(new_left, new_mid), new_right) < 2
            query, node = query[keep], node[keep]
            left, mid, right = (np.minimum(v[keep], FAR).astype(np.int8) for v in (new_left, new_mid, new_right))
            heads, depth = child_heads, depth + 1
    q, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_q, found_w))
    if not len(q):
        return q, w
    differ = np.argmax(at[q] != at[w], axis=1)  # words of a pair are not equal, so there is a first difference
    inside = (differ >= lo[q]) & (differ < hi[q]) & (np.minimum(size[q], size[w]) == k[q])
    return q[inside], w[inside]


def _scans(batches) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole groups of two words or more, as many at a time as CELLS allows: words, counts, group numbers, k, lo and hi.

    Rows come sorted by key, so that a group stands together, and by k first, so that words of one scan are about as long.
    """
    words: list[str] = []
    n: list[int] = []
    group: list[int] = []
    bounds: list[list[int]] = []
    key, held, number = None, [], 0

    def close():
        nonlocal number
        if len(held) > 1:
            number += 1
            for word, count in sorted(held):
                words.append(word)
                n.append(count)
                group.append(number)
                bounds.append(key[:3])

    def scan():
        return list(words), np.array(n, np.int64), np.array(group), *np.array(bounds, np.int64).reshape(-1, 3).T

    for batch in batches:
        for word, count, *found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if found != key:
                close()
                held = []
                key = found
                if words and len(words) * (len(word) + 4) > CELLS:
                    yield scan()
                    for x in (words, n, group, bounds):
                        x.clear()
            held.append((word, count))
    close()
    if words:
        yield scan()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): the number of words at distance 1, and the most frequent of them, the first if several are.

    Words without a near one have no row.
    """

    def run(batches):
        for words, n, group, *bounds in _scans(batches):
            q, w = near_pairs(words, group, *bounds)
            if len(q):
                order = np.lexsort((w, -n[w], q))  # within a group the words' order is theirs
                q, w = q[order], w[order]
                first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
                many = np.diff(np.append(first, len(q)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[i] for i in q[first]]), pa.array(many.astype(np.int64)), pa.array(n[w[first]]), pa.array([words[i] for i in w[first]])], ["word", "n_near", "near_n", "near"]
                )

    rows = grouped(vocabulary).select("word", "n", F.col("k"), F.col("lo"), F.col("hi"), F.col("key.head").alias("head"), F.col("key.end").alias("end"))
    keys = ["k", "lo", "hi", "head", "end"]
    placed = rows.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys)
    found = placed.mapInArrow(run, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.rank")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): of rows (word, form) each word's form at the end of the chain; each round doubles how far it reaches.

    Counts grow along a chain by a factor, so chains are short and have no cycle.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def variants(documents: DataFrame, least_length: int = 6, least_count: int = 5, factor: int = 5, prime: int = 199) -> DataFrame:
    """Every word of the texts with the one that it is a spelling variant of.

    Words are lower-cased runs of letters of least_length code points and least_count occurrences (counted() says which
    lose a letter). word, n, n_near (words at distance 1: one code point inserted, deleted or replaced), form (the near word of
    the largest n, the first by code points if several have it, if that is at least factor times the word's own n) and its
    form_n, root (from the word by forms to the last). Null and empty texts have no words; rows that repeat count each; an
    empty table gives no row; other columns are not read. A word may be as long as a text.
    """
    vocabulary = written(counted(documents, least_length, prime).where(F.col("n") >= least_count), "vocabulary")
    found = vocabulary.join(near_words(vocabulary), "word", "left")
    good = F.col("near_n") >= factor * F.col("n")
    rows = written(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")), "forms"
    )
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
