import random
import re

from hypothesis import given, settings, strategies as st

from docquery.llm import jaccard as j, textkernels as kernels
from tests.llm.helpers import AWKWARD, documents


def shingles(text, size):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def brute(rows, size, num, den):
    sets = [(k, shingles(t, size)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


def check(docs, size=4, num=85, den=100):
    got = sorted(tuple(r) for r in j.components(docs, size=size, num=num, den=den).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], size, num, den)
    return got


def test_tables(spark, sf):
    got = check(spark.read.parquet(f"{sf}/documents.parquet"))
    assert len({r[2] for r in got}) < len(got)


def test_awkward_rows(spark):
    check(documents(spark, AWKWARD))
    check(documents(spark, AWKWARD), 1, 1, 1)
    assert j.components(documents(spark, AWKWARD).limit(0)).count() == 0


def near(seed, families, size):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    out = []
    for f in range(families):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(5, 60))]
        for _ in range(r.randrange(1, size)):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"x{r.randrange(20)}"
            out.append(" ".join(w + passage * (r.random() < 0.3)))
    r.shuffle(out)
    return out


def test_families_and_passages(spark, monkeypatch):
    docs = documents(spark, near(1, 30, 25))
    check(docs)
    check(docs, 5, 80, 100)
    check(docs, 3, 50, 100)
    monkeypatch.setattr(j, "COMMON_FROM", 3)
    monkeypatch.setattr(j, "REPORT_FROM", 2)
    monkeypatch.setattr(j, "GROUP_TOKENS", 300)
    check(docs)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_group_connects_what_links_connect(seed):
    import numpy as np

    r = random.Random(seed)
    sets = [np.array(sorted(r.sample(range(14), r.randrange(1, 12))), np.uint64) for _ in range(r.randrange(2, 14))]
    g = j.Group(list(range(len(sets))), sets, 60, 100)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in g.inner():
        x, y = set(sets[a]), set(sets[b])
        assert 100 * len(x & y) >= 60 * len(x | y)
        root[find(a)] = find(b)
    for a in range(len(sets)):
        for b in range(a):
            x, y = set(sets[a]), set(sets[b])
            if 100 * len(x & y) >= 60 * len(x | y):
                assert find(a) == find(b)


def test_connected_long_path(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (200, 200)], "u long, v long")
    got = {tuple(r) for r in j.connected(edges).collect()}
    assert got == {(i, 0) for i in range(1, n + 1)} | {(101, 100)}


def test_long_words_do_not_collide(spark):
    """The Thue-Morse word and its complement have equal polynomials modulo 2**64, whatever the base."""
    for size in (1024, 2048, 4096, 8192):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
        other = one.translate(str.maketrans("ab", "ba"))
        assert len(set(kernels.words([f"{one} {other}".encode()]).hash.tolist())) == 2
    rows = [f"{w} and some words that both texts share here" for w in (one, other)]
    assert [r.component_id for r in j.components(documents(spark, rows), num=80, den=100).orderBy("doc_id").collect()] == [0, 1]
