"""Packing into sequences by linear grouping: the plan is made from the histogram of lengths, the rows follow it.

Lengths are whole numbers up to the limit, so the histogram, the plan and what tasks get of it are bounded by the limit
and do not grow with the corpus.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from docquery.llm.common import annotate, written

#: Words, and pieces of words, whose ids a task remembers at once.
CACHE_WORDS = 500_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


def _encoder(path: str):
    """A function from a text to its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and splits at it, so a text's ids are its words' ids in turn; most words are seen
    again and again. A word of letters whose case and composition are plain goes to the model piece by piece; any other
    word goes to the whole tokenizer.
    """
    import regex
    from tokenizers import Tokenizer

    if sys.byteorder != "little" or array("I").itemsize != 4:
        raise NotImplementedError("ids are packed in the machine's own byte order")
    whole = Tokenizer.from_file(path)
    model, letters = whole.model, _byte_letters()
    plain = re.compile(r"[!-~¡-įı-ſ]+").fullmatch
    pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    @lru_cache(CACHE_WORDS)
    def of_piece(piece: str) -> bytes:
        return array("I", [t.id for t in model.tokenize("".join([letters[b] for b in piece.encode()]))]).tobytes()

    class Ids(dict):
        """Ids by word. When it is full, what it holds is kept aside, and of that what is seen again comes back."""

        aside: dict = {}

        def __missing__(self, word: bytes) -> bytes:
            if len(self) >= CACHE_WORDS:
                self.aside = self.copy()
                self.clear()
            found = self.aside.get(word)
            if found is None:
                text = word.decode("utf-8", "replace")
                if b"<|" in word or not plain(text):
                    found = array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
                elif text.isalpha():
                    found = of_piece(text.lower())
                elif text[:-1].isalpha() and text[-1] in ".,!?;:":
                    found = of_piece(text[:-1].lower()) + of_piece(text[-1])
                else:
                    found = b"".join([of_piece(p) for p in pieces.findall(text.lower())])
            self[word] = found
            return found

    ids = Ids()
    return lambda text: b"".join(map(ids.__getitem__, text.split()))


def pieces(documents: DataFrame, text: str = "text", keep: list[str] | None = None, limit: int = 4096, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece of at most limit ids of each document: keep, piece, start, length, ids_crc32.

    A document is its text's ids and then end_id; only longer ones are cut, and only the last piece may be shorter. A
    null text is the empty one. A kept column named like one of the four is replaced.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    keep = documents.columns if keep is None else keep
    last = np.array([end_id], "<u4").tobytes()

    def factory():
        encode = _encoder(tokenizer)

        def work(texts):
            out = []
            for t in texts:
                ids = encode(t or b"") + last
                out.append([{"piece": i, "start": i * limit, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} for i, p in enumerate(ids[a : a + 4 * limit] for a in range(0, len(ids), 4 * limit))])
            return (out,)

        return work

    found = annotate(documents, text, keep, factory, "_pieces array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    names = ("piece", "start", "length", "ids_crc32")
    kept = [c for c in found.columns if c != "_pieces" and c.lower() not in names]
    return found.select(*[F.col("`" + c + "`") for c in kept], F.explode("_pieces").alias("_p")).select(*[F.col("`" + c + "`") for c in kept], *[F.col(f"_p.{n}").alias(n) for n in names])


class _Plan:
    """Placements (length, first rank, count, first sequence, offset): the ranks of a length go to consecutive sequences."""

    def __init__(self, limit: int):
        self.limit, self.rows, self.sequences = limit, [], 0
        self.rank: dict[int, int] = {}
        self.room: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        first = self.rank.get(length, 0)
        self.rank[length] = first + count
        self.rows.append((length, first, count, sequence, offset))

    def leave(self, sequence: int, count: int, room: int) -> None:
        if room > 0:
            if room not in self.room:
                insort(self.rooms, room)
                self.room[room] = []
            self.room[room].append((sequence, count))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                new = -(-count // (self.limit // length))
                self.leave(self.open(new), new, self.limit)
                continue
            room = self.rooms[at]
            sequence, n = self.room[room].pop()
            used = min(n, count)
            if used < n:
                self.room[room].append((sequence + used, n - used))
            elif not self.room[room]:
                del self.room[room], self.rooms[at]
            self.put(length, used, sequence, self.limit - room)
            self.leave(sequence, used, room - length)
            count -= used


def _fill(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """How many of each size fill the room best, of what is left."""
    reach = np.full(room + 1, -1, np.int64)  # the last size by which a total is reached
    reach[0] = len(sizes)
    taken: list[np.ndarray] = []
    for i, size in enumerate(sizes):
        step = np.zeros(room + 1, np.int64)
        for _ in range(min(left[i], room // size)):
            new = np.flatnonzero((reach[:-size] >= 0) & (reach[size:] < 0)) + size
            new = new[(step[new - size] + 1 <= left[i])]
            if not len(new):
                break
            step[new] = step[new - size] + 1
            reach[new] = i
        taken.append(step)
    use, total = [0] * len(sizes), int(np.flatnonzero(reach >= 0)[-1])
    while total:
        i = int(reach[total])
        use[i] += 1
        total -= sizes[i]
        if use[i] > left[i]:
            return [0] * len(sizes)
    return use


def _dearest(limit: int, sizes: list[int], worth: np.ndarray) -> np.ndarray:
    """The configuration of the greatest worth: how many of each size, any number of times, fit into the limit."""
    value, pick = np.zeros(limit + 1), np.full(limit + 1, -1)
    for i, size in enumerate(sizes):
        for _ in range(limit // size if worth[i] > 0 else 0):
            more = value[:-size] + worth[i]
            better = np.flatnonzero(more > value[size:] + 1e-12)
            if not len(better):
                break
            value[better + size] = more[better]
            pick[better + size] = i
    use, at = np.zeros(len(sizes)), int(np.argmax(value))
    while pick[at] >= 0:
        use[pick[at]] += 1
        at -= sizes[pick[at]]
    return use


def configurations(limit: int, sizes: list[int], demand: list[int], rounds: int = 2000) -> list[tuple[list[int], int]]:
    """(how many of each size, how often): whole parts of the fewest sequences that hold the demand, by the linear programme.

    Its columns are configurations, one basis column a size. The basis begins with sequences of one size; the duals price
    the sizes, and the configuration that they price highest comes in for the first that it drives out, until none is
    worth more than the sequence it takes. Every basis on the way holds the demand, so rounds only bounds the time.
    """
    m = len(sizes)
    basis = np.diag([float(limit // s) for s in sizes])
    wanted, ones = np.array(demand, float), np.ones(m)
    for _ in range(rounds if m else 0):
        worth = np.linalg.solve(basis.T, ones)
        use = _dearest(limit, sizes, worth)
        if use @ worth <= 1 + 1e-6:
            break
        often, change = np.linalg.solve(basis, wanted), np.linalg.solve(basis, use)
        out = np.flatnonzero(change > 1e-9)
        basis[:, out[np.argmin(np.maximum(often[out], 0) / change[out])]] = use
    often, left, found = np.linalg.solve(basis, wanted) if m else [], list(demand), []
    for column, x in zip(basis.T, often, strict=True):
        use = [int(u) for u in column]
        times = min([int(x + 1e-9), *[left[i] // u for i, u in enumerate(use) if u]])
        if times > 0:
            found.append((use, times))
            left = [n - u * times for n, u in zip(left, use, strict=True)]
    return found


def plan(histogram: dict[int, int], limit: int, groups: int = 40, small: int | None = None, optimised: bool = True) -> _Plan:
    """Linear grouping over a histogram of lengths.

    Lengths over small, from the largest down, are dealt into groups of equal cardinality and rounded up to each
    group's largest. The configurations of these few sizes are those of the linear programme, in whole numbers; what is
    left over, at most a sequence for each size, and all of it if not optimised, goes the largest size first with what
    fills the rest of its sequence best, as often as the groups allow. Actual lengths then stand in for the sizes, and the
    small ones go, from the largest down, where they fit best.
    """
    out, small = _Plan(limit), limit // 10 if small is None else small
    for length in sorted((x for x in histogram if x >= limit), reverse=True):
        out.put(length, histogram[length], out.open(histogram[length]), 0)
    large = [(x, histogram[x]) for x in sorted(histogram, reverse=True) if small < x < limit]
    each = max(1, -(-sum(n for _, n in large) // groups))
    queues: list[list[list[int]]] = []
    space = 0
    for length, n in large:
        while n:
            if not space:
                queues.append([])
                space = each
            used = min(n, space)
            queues[-1].append([length, used])
            n, space = n - used, space - used
    sizes, left = [q[0][0] for q in queues], [sum(n for _, n in q) for q in queues]

    def lay(use: list[int], times: int) -> None:
        """A configuration, times over, with the next actual lengths of each group in it."""
        slots = []
        for i, u in enumerate(use):
            for _ in range(u):
                need, runs = times, []
                while need:
                    head = queues[i][0]
                    used = min(need, head[1])
                    runs.append([head[0], used])
                    head[1] -= used
                    need -= used
                    if not head[1]:
                        queues[i].pop(0)
                slots.append(runs)
            left[i] -= u * times
        first, done = out.open(times), 0
        while done < times:
            n, offset = min(r[0][1] for r in slots), 0
            for r in slots:
                out.put(r[0][0], n, first + done, offset)
                offset += r[0][0]
                r[0][1] -= n
                if not r[0][1]:
                    r.pop(0)
            out.leave(first + done, n, limit - offset)
            done += n

    for use, times in configurations(limit, sizes, left) if optimised else ():
        lay(use, times)
    for g in range(len(queues)):
        while left[g]:
            rest = list(left)
            rest[g] -= 1
            use = _fill(limit - sizes[g], sizes, rest)
            use[g] += 1
            lay(use, min(left[i] // u for i, u in enumerate(use) if u))
    for length in sorted((x for x in histogram if x <= small and x < limit), reverse=True):
        out.best_fit(length, histogram[length])
    return out


def best_plan(histogram: dict[int, int], limit: int) -> _Plan:
    """Of a few choices of where small begins, with and without the linear programme, the plan of the fewest sequences."""
    tried = ((40, limit // 10), (60, limit // 6), (30, limit // 20))
    return min((plan(histogram, limit, groups, small, optimised) for optimised in (True, False) for groups, small in tried), key=lambda p: p.sequences)


def pack(documents: DataFrame, text: str = "text", key: str = "doc_id", limit: int = 4096, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece (see pieces) with sequence_id and offset; in a sequence, offsets follow without gaps from 0.

    The pieces are written once. The ranks of a length are counted in buckets of rows, so that a length that a third of
    the rows have is no group of one task; equal rows may change places. An empty table gives no rows, a repeated row
    is packed as often as it is there.
    """
    rows = written(pieces(documents, text, [key], limit, end_id, tokenizer), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = best_plan(counts, limit)
    buckets = max(32, sum(counts.values()) >> 20)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "_b").agg(F.count("*").alias("n")).select("length", "_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy(key, "piece", "ids_crc32")) - 1)
    ranked = ranked.join(base, ["length", "_b"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_r")).alias("_rank"))
    table = np.array(sorted(made.rows), np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]

    def place(frames):
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        for f in frames:
            at = np.searchsorted(keys, f["length"].to_numpy() * (1 << 44) + f["_rank"].to_numpy(), "right") - 1
            f["sequence_id"] = table[at, 3] + f.pop("_rank").to_numpy() - table[at, 1]
            f["offset"] = table[at, 4]
            yield f

    kind = documents.schema[key].dataType.simpleString()
    return ranked.mapInPandas(place, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
