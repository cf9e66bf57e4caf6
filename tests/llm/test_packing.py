import zlib
from functools import lru_cache
from itertools import product

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docquery.llm import packing
from tests.llm.helpers import AWKWARD, documents

whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute(text, limit=4096):
    ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
    return [(i // limit, i, len(p), zlib.crc32(p.tobytes())) for i in range(0, len(ids), limit) for p in [ids[i : i + limit]]]


def check(docs, rows, limit=4096):
    want = sorted((r.doc_id, *p) for r in docs.collect() for p in brute(r.text, limit))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by), -(-sum(r.length for r in rows) // limit)


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    used, least = check(docs, packing.pack(docs).collect())
    assert used <= least * 1.03 + 1


def test_awkward_rows(spark):
    odd = ["It's İstanbul ΑΣ, don't!! 12³ á", "<|endoftext|> x<|startoftext|>y", "a\x1cb\x85c d e ­f ſs ŉ ĲǄ", "'s 'S I'LL", "ﬁ ½ Å Å 漢字 и"]
    docs = documents(spark, [*AWKWARD, *odd])
    check(docs, packing.pack(docs).collect())
    check(docs, packing.pack(docs, limit=7).collect(), 7)
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_places_everything_once():
    rng = np.random.default_rng(1)
    for limit, n in ((100, 3000), (4096, 5000), (10, 50)):
        lengths = np.minimum(rng.lognormal(np.log(limit / 6), 1, n).astype(int) + 1, limit)
        histogram = {int(x): int(c) for x, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        made = packing.best_plan(histogram, limit)
        got, used = {}, {}
        for length, first, count, sequence, offset in made.rows:
            assert got.get(length, 0) == first
            got[length] = first + count
            for s in range(sequence, sequence + count):
                used.setdefault(s, []).append((offset, length))
        assert got == histogram
        for parts in used.values():
            ends = np.cumsum([x for _, x in sorted(parts)])
            assert ends[-1] <= limit and [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
        assert len(used) == made.sequences <= 1.05 * -(-int(lengths.sum()) // limit) + 1


def fewest(limit, sizes, demand):
    """The fewest sequences for a demand, by trying every first configuration that holds the largest size left."""

    @lru_cache(None)
    def best(left):
        if not any(left):
            return 0
        first = next(i for i, n in enumerate(left) if n)
        fits = (u for u in product(*[range(n + 1) for n in left]) if u[first] and sum(k * s for k, s in zip(u, sizes, strict=True)) <= limit)
        return 1 + min(best(tuple(n - k for n, k in zip(left, u, strict=True))) for u in fits)

    return best(tuple(demand))


def test_configurations_against_the_fewest():
    for limit, sizes in ((10, [5, 4, 3]), (100, [44, 34, 22]), (17, [8, 6, 5]), (12, [7, 7, 5])):
        demand = [5, 5, 5]
        found = packing.configurations(limit, sizes, [1000 * n for n in demand])
        held = [sum(use[i] * times for use, times in found) for i in range(3)]
        assert all(sum(k * s for k, s in zip(use, sizes, strict=True)) <= limit for use, _ in found)
        assert all(1000 * n - limit <= h <= 1000 * n for h, n in zip(held, demand, strict=True))
        assert sum(times for _, times in found) <= 1000 * fewest(limit, sizes, demand)
        whole = packing.plan({s: 5 * sizes.count(s) for s in sizes}, limit, 3, 0)
        assert whole.sequences <= fewest(limit, sizes, demand) + 3
    assert packing.configurations(10, [], []) == []


def test_configurations_pack_closer_than_filling_in_turn():
    lengths = np.random.default_rng(5).integers(1000, 2100, 30000)
    histogram = {int(x): int(c) for x, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    assert packing.plan(histogram, 4096).sequences < 0.95 * packing.plan(histogram, 4096, optimised=False).sequences
