"""Removal of repeated strings against a plain version; suffix arrays, prefixes and merging against plain sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docquery.llm import suffixes
from tests.llm.helpers import AWKWARD, documents


def plain(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + (len(b) > 0 and gone[0])), hashlib.sha256(kept).hexdigest()))
    return out


def found(spark, texts, window):
    rows = suffixes.digested(suffixes.without_repeats(documents(spark, texts), ["doc_id"], window)).orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in rows]


def shared_texts(seed, n):
    """Texts of few words with passages that several share, cut at any place and sometimes changed."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "gämma", "delta", "né", "\n", "zeta9", "\0", "omega"]
    passages = [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(40)) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts.append(p[a : a + rng.randrange(len(p))])
            parts.append(" ".join(str(rng.random()) for _ in range(rng.randint(0, 6))))
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("window,crowd", [(40, 256), (40, 1), (97, 2)])
def test_equal_to_all_windows(spark, monkeypatch, window, crowd):
    """With a crowd of one, every anchor of two stretches is dealt to several shards and merged."""
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "SHARD", 3000)
    texts = shared_texts(window + crowd, 60)
    expected = plain(texts, window)
    assert sum(r[1] for r in expected) > 1000 and found(spark, texts, window) == expected


def test_awkward_texts(spark):
    period = "abcdefg" * 60
    texts = [*AWKWARD, "x" * 199, "x" * 200, "y" * 200, "y" * 201, period, "q" + period[3:] + "r", "same " * 50, "same " * 50, "\0" * 450]
    assert found(spark, texts, 200) == plain(texts, 200)
    assert found(spark, [], 200) == [] and found(spark, [None, ""], 200) == plain([None, ""], 200)


def test_long_text_in_pieces(spark, monkeypatch):
    """A text longer than what one call works on is cut with overlaps, so that nothing is lost at the cuts."""
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij") for _ in range(40_000))
    pieces = list(suffixes._pieces([FakeBatch([text.encode()])], 200))
    assert len(pieces) == 1
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    pieces = list(suffixes._pieces([FakeBatch([text.encode()])], 200))
    windows = {text[b + i : b + i + 200] for joined, _, begin, _ in pieces for b in begin for i in range(len(joined) - 199)}
    assert len(pieces) == 40 and windows == {text[i : i + 200] for i in range(len(text) - 199)}


class FakeBatch:
    def __init__(self, texts):
        self.texts = texts

    def column(self, _):
        import pyarrow as pa

        return pa.array(self.texts, pa.binary())


@pytest.mark.parametrize("alphabet", [2, 250])
def test_suffix_array_and_prefixes(alphabet):
    rng = random.Random(alphabet)
    strings = [bytes(rng.randrange(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    strings += [strings[0], strings[1] + strings[2], b"\0" * 30, b"\0" * 29]
    text = np.frombuffer(b"".join(strings), np.uint8)
    size = np.array([len(s) for s in strings])
    end = np.cumsum(size)
    rest = np.repeat(end, size) - np.arange(len(text))
    suffix = [text[i : i + rest[i]].tobytes() for i in range(len(text))]
    sa = suffixes.suffix_array(text, rest)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: (suffix[i], i))
    lcp = suffixes.common_prefixes(text, rest, end - size, sa, 25)
    share = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert lcp.tolist() == [0] + [min(25, share(suffix[a], suffix[b])) for a, b in zip(sa, sa[1:], strict=False)]


def test_runs_merge_by_weight():
    rng = np.random.default_rng(2)
    runs = [np.unique(rng.integers(0, 50, 20).astype("S16")) for _ in range(5)]
    total = Counter(k for r in runs for k in r.tolist())
    one = (runs[0], np.ones(len(runs[0]), np.int64))
    for r in runs[1:]:
        one = suffixes.merged(one, (r, np.ones(len(r), np.int64)))
    assert dict(zip(one[0].tolist(), one[1].tolist(), strict=True)) == total and one[0].tolist() == sorted(total)


def test_kept_bytes_and_clashing_names(spark):
    passage = "this passage stands in two texts and is long enough"
    rows = spark.createDataFrame([(1, "a: " + passage + " end", "p", "q"), (2, passage, "p", "q")], "id long, text string, spans string, kept string")
    out = {r["id"]: r for r in suffixes.without_repeats(rows, ["id"], 40).collect()}
    assert bytes(out[1]["kept"]) == b"a:  end" and [tuple(s) for s in out[1]["spans"]] == [(3, 3 + len(passage))] and bytes(out[2]["kept"]) == b""
