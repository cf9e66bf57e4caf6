"""Spelling variants against plain versions, and the texts that need care."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docquery.llm import spelling
from tests.llm.helpers import AWKWARD, documents


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i + 1 :] == b[i + 1 :]


def plain(rows, least_length=6, least_count=5):
    counts = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            counts[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[w] = [form, n, len(near), counts[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(row) for w, row in out.items()}


def found(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "x", 1, "x") for d, t in rows], "doc_id long, text string, word string, n int, form string")
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df, **how).collect()}


@pytest.mark.parametrize("letters,longest", [("ab", 8), ("abcé", 6)])
def test_scan_finds_each_pair_once(letters, longest):
    rng = random.Random(longest)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(250)})
    for k in range(1, longest + 1):
        mine = [w for w in words if len(w) in (k, k + 1)]
        q, w = spelling.near_pairs(mine, *(np.full(len(mine), x) for x in (0, k, 0, k + 1)))
        pairs = [(mine[i], mine[j]) for i, j in zip(q, w, strict=True)]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(a, b) for a in mine for b in mine if one_edit(a, b) and min(len(a), len(b)) == k}


def texts(seed, n):
    """Words in families of misspellings, the rarer the further from the first."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        word = "".join(rng.choice("abcdeéü") for _ in range(rng.randint(6, 9)))
        for times in (rng.choice([125, 130]), 26, 5):
            out += [word] * times
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + "x" + word[at:], word[:at] + "y" + word[at + 1 :]])
    rng.shuffle(out)
    return [(i, " ".join(out[i::20])) for i in range(20)]


@pytest.mark.parametrize("group", [2048, 2])
def test_equal_to_all_pairs(spark, monkeypatch, group):
    """Also where every group of three words is split by the place of the edit."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rows = texts(3, 25)
    expected = plain(rows)
    assert any(r[0] and r[0] != r[1] for r in expected.values())  # a chain of two forms
    assert found(spark, rows) == expected


def test_hot_group(spark, monkeypatch):
    """Words that share all but one place come from one group that can be cut no further."""
    monkeypatch.setattr(spelling, "GROUP", 4)
    rows = [(i, " ".join("prefix" + c + "suffix" for c in "abcdefghij") + " prefixsuffix") for i in range(6)]
    got = found(spark, rows)
    assert got == plain(rows) and got["prefixsuffix"][3] == 10


def test_awkward_texts(spark):
    rows = list(enumerate(AWKWARD)) + [(None, "Wörter wörter WÖRTER Wörtern " * 6), (3, "aaaaaa aaaaaaa " * 9), (3, "aaaaaa aaaaaaa " * 9), (5, "a1b2c3 abcćdef " + "q" * 3000 + " " + "q" * 2999)]
    assert found(spark, rows, least_count=1) == plain(rows, least_count=1)
    assert found(spark, []) == {}
    assert spelling.variants(documents(spark, [None, ""])).collect() == []


def test_ties_take_the_first_word(spark):
    rows = [(1, "abcdexx " * 5 + "abcdeax " * 30 + "abcdebx " * 30 + "abcdezx " * 25)]
    got = found(spark, rows)
    assert got == plain(rows) and got["abcdexx"][0] == "abcdeax"
