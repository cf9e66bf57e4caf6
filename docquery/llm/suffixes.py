"""Removal of repeated byte strings: suffix arrays by shard, common prefixes, and runs of shards merged by binary search.

Two equal strings of `window` bytes have the same least hash among the `gram`-byte strings in them, their anchor. So only
stretches of text whose anchor occurs twice can repeat anything, and equal strings meet if the stretches of one anchor do.
A stretch is what an anchor's consecutive windows cover. Equal stretches are one row with a number, and these rows are dealt
to shards by anchor. A shard has a suffix array of its stretches; a window repeats if the windows that share its first
`window` bytes, which stand next to it, stand for two occurrences. An anchor with very many different stretches is dealt to
several shards. Their windows go on as runs sorted by digest, cut at fixed values and merged in the tasks of these ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from docquery.llm.common import quoted, written
from docquery.llm.textkernels import mix

#: Bytes of the strings whose hashes choose anchors, for windows of at least twice as much; smaller windows take half of theirs.
GRAM = 48
#: Bytes of text that one call works on, and of stretches that make a shard.
PIECE, SHARD = 1 << 19, 1 << 20
#: Different stretches of one anchor that go to one shard.
CROWD = 256

#: Low bits of a hash that give way to its place, so that the least value tells where it is.
PLACES = np.uint64((1 << 21) - 1)

_random = np.random.default_rng(20250711)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))]), dtype=np.uint64)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def gram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on."""
    if not _tables:
        _tables[0] = _powers(_BASE, PIECE + (1 << 16)), _powers(pow(_BASE, -1, 1 << 64), PIECE + (1 << 16))
    up, down = _tables[0]
    if len(up) < len(a):
        up, down = _powers(_BASE, len(a)), _powers(pow(_BASE, -1, 1 << 64), len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    n = len(a) - k + 1
    return mix((total[k:] - total[:n]) * down[:n])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width, np.uint64((1 << 64) - 1))]).reshape(-1, width)
    so_far = np.minimum.accumulate(blocks, 1).ravel()
    from_here = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(from_here[: n - width + 1], so_far[width - 1 : n])


def stretches(a: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, windows, several) of the stretches of texts that stand in a, one after the other up to their ends.

    The first of the least hashes of a window counts. A stretch has at most as many windows as one anchor covers; a longer run
    of one value, as in periodic text, is cut. several: its anchor occurs more than once in it, so it can repeat itself.
    """
    gram = min(GRAM, max(1, window // 2))
    width = window - gram + 1
    if len(a) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    value = gram_hashes(a, gram)
    place = least_of((value & ~PLACES) | np.arange(len(value), dtype=np.uint64), width) & PLACES
    least = value[place.astype(np.int64)]
    start = np.concatenate([[0], end[:-1]])
    edge = np.zeros(len(a) + 1, np.int32)
    long = end - start >= window
    np.add.at(edge, start[long], 1)
    np.add.at(edge, end[long] - window + 1, -1)
    valid = np.cumsum(edge[: len(least)]) > 0
    new = np.concatenate([[True], least[1:] != least[:-1]])
    new[1:] |= valid[1:] != valid[:-1]
    new[start[(start > 0) & (start < len(new))]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(least)))
    count, first = count[valid[first]], first[valid[first]]
    pieces = -(-count // width)
    at = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, count = np.repeat(first, pieces) + at * width, np.minimum(np.repeat(count, pieces) - at * width, width)
    return least[first], first, count, place[first] != place[first + count - 1]


def digest(piece: bytes) -> bytes:
    return blake2b(piece, digest_size=16).digest()


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _pieces(batches, window: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, list[bytes]]]:
    """Texts joined to about PIECE bytes, with their ends, where each began in its text, and its text's digest.

    A longer text comes in pieces that overlap by a window less one byte, so that each window is in one.
    """
    held: list[bytes] = []
    begin: list[int] = []
    whole: list[bytes] = []
    size = 0
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py()
            name = digest(text)
            for at in range(0, max(1, len(text) - window + 1), PIECE):
                piece = text[at : at + PIECE + window - 1]
                if held and size + len(piece) > PIECE:
                    yield b"".join(held), np.cumsum([len(x) for x in held]), np.array(begin), whole
                    held, begin, whole, size = [], [], [], 0
                held.append(piece)
                begin.append(at)
                whole.append(name)
                size += len(piece)
    if held:
        yield b"".join(held), np.cumsum([len(x) for x in held]), np.array(begin), whole


def anchors(texts: DataFrame, window: int) -> DataFrame:
    """(a): the anchor of each stretch of the texts, a row for each, and another if it occurs again in its stretch."""

    def run(batches):
        for joined, end, _, _ in _pieces(batches, window):
            anchor, _, _, several = stretches(np.frombuffer(joined, np.uint8), end, window)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([anchor, anchor[several]]).view(np.int64))], ["a"])

    return texts.mapInArrow(run, "a long")


def marks(texts: DataFrame, window: int) -> DataFrame:
    """(a, s1, s2, t1, t2, at, n): anchor, digest, text's digest, place in the text and number of windows of each stretch."""

    def run(batches):
        for joined, end, begin, whole in _pieces(batches, window):
            anchor, start, count, _ = stretches(np.frombuffer(joined, np.uint8), end, window)
            if not len(anchor):
                continue
            owner = np.searchsorted(end, start, "right")
            at = start - np.concatenate([[0], end])[owner] + begin[owner]
            s1, s2 = _halves([digest(joined[i : i + n + window - 1]) for i, n in zip(start.tolist(), count.tolist(), strict=True)])
            t1, t2 = (x[owner] for x in _halves(whole))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor.view(np.int64), s1, s2, t1, t2, at, count.astype(np.int32))], ["a", "s1", "s2", "t1", "t2", "at", "n"])

    return texts.mapInArrow(run, "a long, s1 long, s2 long, t1 long, t2 long, at long, n int")


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers; zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    two = padded[:-1].astype(np.uint16) | padded[1:].astype(np.uint16) << np.uint16(8)
    four = two[:-2].astype(np.uint32) | two[2:].astype(np.uint32) << np.uint32(16)
    return (four[:-4].astype(np.uint64) | four[4:].astype(np.uint64) << np.uint64(32))[: len(text)]


def suffix_array(text: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Places in the order of what follows them up to the end of their own string; rest is how much that is.

    What ends sooner comes first, and equal ones stand as in the text. Larsson and Sadakane's refinement: places are sorted
    by seven bytes; then groups of places that are still equal, and only these, are sorted by the group of the place h
    further on, which doubles the h bytes by which they are in order.
    """
    n = len(text)
    have = np.minimum(rest, 7).astype(np.uint64)
    mask = ~((np.uint64(1) << (np.uint64(64) - np.uint64(8) * have)) - np.uint64(1))
    key = (words_at(text).byteswap() & mask) | have
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    slot = np.arange(n)
    group = np.empty(n, np.int64)
    group[sa] = np.maximum.accumulate(np.where(new, slot, 0))
    still = slot[~(new & np.append(new[1:], True))]
    h, longest = 7, int(rest.max(initial=0))
    while len(still) and h < longest:
        p = sa[still]
        further = np.where(rest[p] > h, group[np.minimum(p + h, n - 1)] + 1, 0)
        key = group[p] * (n + 1) + further
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        sa[still] = p
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group[p] = np.maximum.accumulate(np.where(new, still, 0))
        still = still[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, rest: np.ndarray, start: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each place of sa, the bytes, cap at most, that it shares with the one before it there.

    Kasai's walk: the next place in a string shares at least one byte less than this one does. All strings, which begin at
    start, are walked side by side, eight bytes compared at a time.
    """
    n = len(text)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    word, out = words_at(text), np.zeros(n, np.int64)
    size = rest[start]
    by_size = np.argsort(-size, kind="stable")
    start, size = start[by_size], size[by_size]
    shared = np.zeros(len(start), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, "left"))  # strings longer than step, which come first
        p = start[:live] + step
        q = sa[rank[p] - 1]
        limit = np.where(rank[p] > 0, np.minimum(np.minimum(rest[p], rest[q]), cap), 0)
        h = np.minimum(np.maximum(shared[:live] - 1, 0), limit)
        more = np.flatnonzero(h < limit)
        while len(more):
            differ = word[p[more] + h[more]] ^ word[q[more] + h[more]]
            equal = differ == 0
            low = np.where(equal, np.uint64(1), differ & (~differ + np.uint64(1)))
            h[more] = np.minimum(h[more] + np.where(equal, 8, np.log2(low.astype(np.float64)).astype(np.int64) >> 3), limit[more])
            more = more[equal & (h[more] < limit[more])]
        shared[:live] = h
        out[rank[p]] = h
    return out


SHARD_ROWS = "a long, s1 long, s2 long, parts int, froms array<int>, tos array<int>, cell int, keys binary, refs binary"
#: What a run holds beside each digest: how many occurrences it stands for, and, where that is one, which window it is.
REF = np.dtype([("weight", "<i8"), ("s1", "<i8"), ("s2", "<i8"), ("offset", "<i4")])


def cell_of(high: np.ndarray, parts: int) -> np.ndarray:
    """Which of parts equal ranges of digests each one is in, by its first eight bytes, big-endian."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.searchsorted(bounds, high, "right")


def shard_findings(window: int):
    """What a shard finds: rows with spans of windows that repeat in it, and cells of runs of anchors that other shards have too."""

    def run(table: pa.Table) -> pa.Table:
        first: dict[tuple[int, int, int], int] = {}
        for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in ("a", "s1", "s2")), strict=True)):
            first.setdefault(key, i)  # tasks that had the same text have each sent it
        keys, picked = list(first), list(first.values())
        piece = [table.column("piece")[i].as_py() for i in picked]
        weight = table.column("w").to_numpy()[picked]
        parts = table.column("parts").to_numpy()[picked]
        text = np.frombuffer(b"".join(piece), np.uint8)
        size = np.array([len(x) for x in piece])
        end = np.cumsum(size)
        start = end - size
        owner = np.repeat(np.arange(len(piece)), size)
        rest = end[owner] - np.arange(len(text))
        sa = suffix_array(text, rest)
        lcp = common_prefixes(text, rest, start, sa, window)
        full = rest[sa] >= window
        run_of = np.cumsum(lcp < window) - 1
        total = np.bincount(run_of[full], weights=weight[owner[sa[full]]], minlength=int(run_of[-1]) + 1).astype(np.int64)
        times = np.zeros(len(text), np.int64)
        times[sa[full]] = total[run_of[full]]
        out: list[dict] = []
        hit = times >= 2
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        # a run of hits ends with its stretch's windows at the latest, as the last bytes of a stretch are no window
        begin, stop = edge[::2], edge[1::2]
        of = owner[begin]
        cut = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int), len(of))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            o = int(of[i])
            a, s1, s2 = keys[o]
            out.append({"a": a, "s1": s1, "s2": s2, "froms": (begin[i:j] - start[o]).tolist(), "tos": (stop[i:j] - 1 - start[o]).tolist()})
        # one window for each string of an anchor that is dealt to several shards
        lead = full & (parts[owner[sa]] > 1)
        chosen = sa[lead]
        if len(chosen):
            chosen = chosen[np.unique(run_of[lead], return_index=True)[1]]
            joined = text.tobytes()
            by_anchor: dict[int, list[int]] = {}
            for p in chosen.tolist():
                by_anchor.setdefault(keys[owner[p]][0], []).append(p)
            for a, places in by_anchor.items():
                names = np.array([digest(joined[p : p + window]) for p in places], "S16")
                order = np.argsort(names, kind="stable")
                names, at = names[order], np.array(places)[order]
                many = int(parts[owner[at[0]]])
                refs = np.zeros(len(at), REF)
                refs["weight"] = times[at]
                for field in (1, 2):
                    refs[f"s{field}"] = [keys[o][field] for o in owner[at]]
                refs["offset"] = at - start[owner[at]]
                raw = names.tobytes()
                cells = cell_of(np.frombuffer(raw, ">u8")[::2].astype(np.uint64), many)
                bound = np.searchsorted(cells, np.arange(many + 1))
                for cell in np.unique(cells).tolist():
                    i, j = int(bound[cell]), int(bound[cell + 1])
                    out.append({"a": a, "parts": many, "cell": cell, "keys": raw[16 * i : 16 * j], "refs": refs[i:j].tobytes()})
        return pa.Table.from_pylist(out, SHARD_SCHEMA)

    return run


SHARD_SCHEMA = pa.schema(
    [("a", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("parts", pa.int32()), ("froms", pa.list_(pa.int32())), ("tos", pa.list_(pa.int32())), ("cell", pa.int32()), ("keys", pa.binary()), ("refs", pa.binary())]
)


def merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of distinct keys with weights as one: the second's keys are found in the first by binary search."""
    (k1, w1), (k2, w2) = one, two
    at = np.searchsorted(k1, k2)
    known = at < len(k1)
    known[known] = k1[at[known]] == k2[known]
    w1 = w1.copy()
    w1[at[known]] += w2[known]
    return np.insert(k1, at[~known], k2[~known]), np.insert(w1, at[~known], w2[~known])


def cell_findings(table: pa.Table) -> pa.Table:
    """Windows that stand alone in their shard but not in all shards of their anchor: (a, s1, s2, offset)."""
    runs = [(np.frombuffer(k.as_py(), "S16"), np.frombuffer(r.as_py(), REF)) for k, r in zip(table.column("keys"), table.column("refs"), strict=True)]
    level = [(k, r["weight"].copy()) for k, r in runs]
    while len(level) > 1:
        level = [merged(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    keys, weight = level[0]
    found = np.concatenate([r[(r["weight"] == 1) & (weight[np.searchsorted(keys, k)] > 1)] for k, r in runs])
    a = np.full(len(found), table.column("a")[0].as_py())
    return pa.table([pa.array(a), *(pa.array(np.ascontiguousarray(found[c])) for c in ("s1", "s2", "offset"))], ["a", "s1", "s2", "offset"])


def repeated(texts: DataFrame, window: int) -> DataFrame:
    """(t1, t2, spans): of texts with repeated windows, by digest, a set of (at, froms, tos): windows from at + from to at + to."""
    # Written, so that the join is one of two plain shuffles, of which Spark can split an anchor's rows that are very many.
    shared = written(anchors(texts, window).groupBy("a").count().where("count > 1").select("a"), "shared")
    all_marks = written(marks(texts, window).join(shared, "a", "left_semi"), "marks")
    kinds = written(all_marks.groupBy("a", "s1", "s2").agg(F.count("*").alias("w"), F.min(F.struct("t1", "t2", "at", "n")).alias("one")), "stretches")
    size = kinds.agg(F.sum(F.col("one.n") + window - 1).alias("size")).first()["size"]
    shards = max(1, -(-(size or 0) // SHARD))
    crowds = kinds.groupBy("a").count().where(F.col("count") > CROWD).select("a", F.ceil(F.col("count") / CROWD).cast("int").alias("parts"))
    placed = kinds.join(crowds, "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("a", F.pmod("s1", "parts")), F.lit(shards)).cast("int"))
    wanted = placed.groupBy(F.col("one.t1").alias("t1"), F.col("one.t2").alias("t2")).agg(F.collect_list(F.struct("shard", "a", "s1", "s2", "w", "parts", "one.at", "one.n")).alias("wanted"))

    def cut(batches):
        before = None
        for batch in batches:
            for *name, text, rows in zip(*batch.columns, strict=True):
                if (name := [x.as_py() for x in name]) == before:
                    continue  # a copy that another task has handed on: the join brings copies together
                before, text, rows = name, text.as_py(), rows.as_py()
                columns = [pa.array([r[c] for r in rows], kind) for c, kind in (("shard", pa.int32()), ("a", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("w", pa.int64()), ("parts", pa.int32()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([text[r["at"] : r["at"] + r["n"] + window - 1] for r in rows], pa.binary())], ["shard", "a", "s1", "s2", "w", "parts", "piece"])

    pieces = named_once(texts).join(wanted, ["t1", "t2"]).select("t1", "t2", "t", "wanted").mapInArrow(cut, "shard int, a long, s1 long, s2 long, w long, parts int, piece binary")
    findings = written(pieces.groupBy("shard").applyInArrow(shard_findings(window), SHARD_ROWS), "findings")
    cells = findings.where("keys is not null").groupBy("a", "cell").applyInArrow(cell_findings, "a long, s1 long, s2 long, offset int")
    across = cells.groupBy("a", "s1", "s2").agg(F.collect_set("offset").alias("froms")).withColumn("tos", F.col("froms"))
    hits = findings.where("froms is not null").select("a", "s1", "s2", "froms", "tos").unionByName(across)
    found = all_marks.join(hits, ["a", "s1", "s2"]).select("t1", "t2", F.struct("at", "froms", "tos").alias("span"))
    return found.groupBy("t1", "t2").agg(F.collect_set("span").alias("found"))


def named(rows: DataFrame) -> DataFrame:
    """The rows with the digest (t1, t2) of their text t."""

    def run(batches):
        for batch in batches:
            t1, t2 = _halves([digest(t.as_py()) for t in batch.column("t")])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t1), pa.array(t2)], schema=batch.schema.append(pa.field("t1", pa.int64())).append(pa.field("t2", pa.int64())))

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType())]))


def named_once(texts: DataFrame) -> DataFrame:
    """(t, t1, t2): the texts with their digests; a task hands on a text that it has had among the last ones once."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            names = [digest(t.as_py()) for t in batch.column("t")]
            fresh = []
            for i, name in enumerate(names):
                if name not in seen:
                    fresh.append(i)
                    seen.add(name)
            if len(seen) > 1 << 16:
                seen.clear()
            if fresh:
                t1, t2 = _halves([names[i] for i in fresh])
                yield pa.RecordBatch.from_arrays([batch.column("t").take(pa.array(fresh)), pa.array(t1), pa.array(t2)], ["t", "t1", "t2"])

    return texts.mapInArrow(run, "t binary, t1 long, t2 long")


def without_repeats(documents: DataFrame, keep: list[str], window: int = 200) -> DataFrame:
    """Each document without the bytes that any string of window bytes covers which also starts elsewhere in the table.

    The kept columns, spans array<struct<start: long, stop: long>> (maximal removed runs of bytes, in order) and kept binary
    (the bytes left, not always whole characters). Texts count as UTF-8, nulls as empty; matches lie within documents, overlaps
    within one count, and strings are judged on the input. Rows that repeat a text, whatever their id, lose it where it is
    long enough; shorter texts stay. An empty table gives no row; no column name clashes, as columns are renamed within.
    """
    if not 2 <= window <= PIECE:
        raise ValueError(f"a window has from 2 to {PIECE} bytes")
    names = [f"k{i}" for i in range(len(keep))]
    rows = documents.select(*[quoted(c).alias(n) for c, n in zip(keep, names, strict=True)], F.coalesce(quoted("text").cast("binary"), F.lit(b"")).alias("t"))
    long, short = rows.where(F.octet_length("t") >= window), rows.where(F.octet_length("t") < window)
    found = repeated(long.select("t"), window)
    spans_type = T._parse_datatype_string("array<struct<start:bigint,stop:bigint>>")

    def cut(batches):
        for batch in batches:
            spans, kept = [], []
            for text, rows in zip(batch.column("t"), batch.column("found"), strict=True):
                text, rows = text.as_py(), rows.as_py()
                merged_spans: list[list[int]] = []
                for i, j in sorted((r["at"] + a, r["at"] + b + window) for r in rows or () for a, b in zip(r["froms"], r["tos"], strict=True)):
                    if merged_spans and i <= merged_spans[-1][1]:
                        merged_spans[-1][1] = max(j, merged_spans[-1][1])
                    else:
                        merged_spans.append([i, j])
                spans.append([{"start": i, "stop": j} for i, j in merged_spans])
                edges = [0, *(x for s in merged_spans for x in s), len(text)]
                kept.append(b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
            fixed = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], [*names, "spans", "kept"])

    schema = T.StructType([*rows.select(*names).schema, T.StructField("spans", spans_type), T.StructField("kept", T.BinaryType())])
    cut_rows = named(long).join(found, ["t1", "t2"], "left").select(*names, "t", "found").mapInArrow(cut, schema)
    whole = short.select(*names, F.array().cast(spans_type).alias("spans"), F.col("t").alias("kept"))
    return cut_rows.unionByName(whole).select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "spans", "kept")


def digested(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what without_repeats leaves."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
