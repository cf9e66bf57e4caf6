"""Held-out accuracy of what is learned, brute force for what is counted, and the awkward rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquery.llm import language, quality, rules, toxicity
from docquery.llm.common import labelled_sample
from tests.llm.helpers import AWKWARD, documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def base(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_rules(spark, tables):
    docs, labels = tables
    learned = rules.fit(docs, labels)
    got = rules.apply(docs, learned, keep=["doc_id"]).toPandas().set_index("doc_id")
    for r in docs.collect():
        want = base(r.text)
        assert tuple(got.loc[r.doc_id, list(rules.BASE)]) == want
        assert got.loc[r.doc_id, "base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    both = got.join(labels.toPandas().set_index("doc_id"), how="inner")
    both = both[~both.base_failed]
    assert learned and (both.kept == (both.quality == 1)).mean() > 0.95
    assert not got[got.base_failed].kept.any()


def test_rules_awkward_rows(spark, tables):
    docs = documents(spark, [*AWKWARD, "a b c d e a b c d e f\n\n x\n x\n", "a a a a a a"])
    got = {r.doc_id: tuple(r[k] for k in rules.BASE) for r in rules.apply(docs, []).collect()}
    assert got == {r.doc_id: base(r.text) for r in docs.collect()}
    assert rules.fit(docs, tables[1].limit(0)) == []
    assert rules.apply(docs.limit(0), []).count() == 0


def test_cover_finds_a_conjunction():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.7) & (x["b"] <= 0.4)
    found = rules.cover(x, bad)
    hit = np.zeros(3000, bool)
    for r in found:
        hit |= rules._covers(r, x, np.arange(3000))
    assert (hit == bad).mean() > 0.97


def held_out(frame, labels, name):
    both = frame.toPandas().merge(labels.toPandas(), on="doc_id")
    both = both[both.held_out]
    return (both.predicted == both[name]).mean(), both


def test_quality(tables):
    accuracy, both = held_out(quality.judged(*tables), tables[1], "quality")
    assert accuracy > 0.95 and both.score.between(0, 1).all()


def test_toxicity(tables):
    accuracy, both = held_out(toxicity.judged(*tables), tables[1], "toxic")
    assert accuracy > 0.93
    assert (both[both.toxic == 0].predicted == 0).mean() > 0.99


def test_language(tables):
    docs = tables[0]
    both = language.predicted(docs).toPandas().merge(docs.toPandas()[["doc_id", "lang"]], on="doc_id")
    both = both[both.held_out]
    assert (both.lang == both.lang_pred).mean() > 0.97


def test_awkward_rows(spark, tables):
    docs, labels = documents(spark, AWKWARD), tables[1]
    none = labels.limit(0)
    assert {r.score for r in quality.judged(docs, none).collect()} == {0.5}
    assert all(0 <= r.score <= 1 for r in toxicity.judged(docs, none).collect())
    got = language.identify(docs, language.fit(tables[0]), keep=["doc_id"]).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got)
    assert [r.lang_pred for r in language.predicted(docs).collect()] == ["und"] * len(AWKWARD)
    for f in (quality.judged(docs.limit(0), labels), toxicity.judged(docs.limit(0), labels), language.predicted(docs.limit(0))):
        assert f.count() == 0


def test_folding_and_exceptions():
    lexicon = {" idiot ": 5.0, " vequ": 3.0, " trash ": 4.0}
    m = toxicity.Matcher(lexicon, ("trash can",))
    for text in ("IDIOT", "1d10t!", "іdіоt", "i​diot,", "ïdìot", "ｉｄｉｏｔ", "𝐢𝐝𝐢𝐨𝐭"):
        assert [h[1] for h in m.hits(toxicity.folded(text.encode()))] == [" idiot "], text
    for text in ("idiotic", "an idiom", "1010", "", "trash can", "the trash can."):
        assert not m.hits(toxicity.folded(text.encode())), text
    assert [h[1] for h in m.hits(toxicity.folded("trash, Vequée trash can".encode()))] == [" trash ", " vequ"]
    assert toxicity.folded(None) == "  "


def test_exceptions_are_learned(spark):
    words = ["river", "stone", "cloud", "paper", "green", "table", "music", "winter"]
    plain = [" ".join(words[(i * k + k) % 8] for k in range(3, 20)) for i in range(800)]
    texts = [f"{t} trash {t}" if i % 2 else f"{t} the trash can of {i}" if i % 20 == 0 else t for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(800)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.judged(documents(spark, texts), labels).collect()}
    assert all(got[i] == (i % 2) for i in range(800))


def test_letters_of_any_script():
    assert len(language.grams("漢字".encode())) == 2 and len(language.grams("😀 12 、".encode())) == 0 and len(language.grams("\u2fff\u3000".encode())) == 0


def test_profiles_are_sums_of_bound_letters():
    code = language.grams(b"Abc, abc")
    assert len(code) == 2 * 3 + 1 and len(set(code.tolist())) == 4  # " ab" "abc" "bc " "c a", two of three kinds twice
    v = language.vectors(code[1:2])[0]
    a, b, c = (language._SIGNS[language._CLASS[ord(x)]] for x in "abc")
    assert (v == a * np.roll(b, 1) * np.roll(c, 2)).all()


def test_letters_have_vectors_of_their_own(spark):
    shared = [abs(int(language._SIGNS[ord(a)].astype(int) @ language._SIGNS[ord(b)])) for a, b in ("ék", "ßa", "àb", "äf", "ñs", "öx", "漢字", "ab")]
    assert max(shared) < language.WIDTH // 4
    letters = {"el": "αβγδεζηθικλμνξοπρστυφχψω", "ru": "абвгдежзиклмнопрстуфхцчшщ", "zh": "漢字文化学校電話天気明日先生", "en": "abcdefghijklmnopqrstuvwxyz"}
    rng = np.random.default_rng(1)
    words = {k: ["".join(rng.choice(list(x), 4)) for _ in range(12)] for k, x in letters.items()}
    rows = [(i, " ".join(rng.choice(words[k], 10)), k) for i in range(240) for k in [sorted(letters)[i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.lang_pred == dict((a, c) for a, _, c in rows)[r.doc_id] for r in language.predicted(docs).collect())


def test_cosines_are_brute_force(spark, tables):
    docs = tables[0].limit(120).cache()
    names, profiles = language.fit(docs)
    for r in language.identify(docs, (names, profiles)).collect():
        text = " " + re.sub(r"[\W\d_]+", " ", (r.text or "").lower()).strip() + " "
        total = np.zeros(language.WIDTH)
        for i in range(len(text) - 2):
            if text.strip():
                parts = [language._SIGNS[0 if x == " " else ord(x)].astype(int) for x in text[i : i + 3]]
                total += parts[0] * np.roll(parts[1], 1) * np.roll(parts[2], 2)
        cosine = profiles @ total / max(np.linalg.norm(total), 1e-9)
        assert not text.strip() or abs(r.score - max(0, cosine.max())) < 1e-4 and r.lang_pred == names[int(cosine.argmax())]


def test_toxicity_finds_nine_of_ten(spark, sf):
    """Held-out recall at 0.7 on the largest table; no clean text of it is called toxic."""
    sf = sf.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    _, both = held_out(toxicity.judged(spark.read.parquet(f"{sf}/documents.parquet"), labels), labels, "toxic")
    assert (both[both.toxic == 1].predicted == 1).mean() >= 0.9
    assert (both[both.toxic == 0].predicted == 0).mean() > 0.99


def test_scores_are_brute_force(spark):
    lexicon, exceptions = {" idiot ": 5.0, " idi": 2.0, " trash ": 4.0}, ("trash can",)
    texts = ["IDIOT of a trash can", "idiom and tr4sh", "", None, "trash " * 50, "an 1d10t, an 1d10t", "a trash can trash"]
    want = [5.0, 6.0, 0, 0, 200.0, 10.0, 4.0]
    got = toxicity.score(documents(spark, texts), (lexicon, exceptions, 100, 0.5, -2.0)).orderBy("doc_id").collect()
    for r, w in zip(got, want, strict=True):
        n = len((r.text or "").split()) + 1
        assert r.score == pytest.approx(1 / (1 + np.exp(-(0.5 * w / (1 + np.log1p(n / 100)) - 2))), abs=1e-9)


def test_equally_heavy_entries_are_stable(spark):
    model = ({" ab": 1.0, " abc ": 1.0, " abcd": 1.0}, (), 100, 1.0, 0.0)
    got = toxicity.score(documents(spark, ["abc abcd ab"] * 20), model).collect()
    assert {tuple(r.hits) for r in got} == {("ab", "ab", "ab")}


def test_many_short_texts_of_a_large_script(spark):
    """10,000 texts of 34 of 20,000 letters: their table of texts and n-grams would take about 27 GB."""
    import random
    import resource

    rng = random.Random(5)
    texts = ["".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(34)) for _ in range(10_000)]
    names, profiles = ["x", "y"], np.array([language.vectors(language.grams(t.encode())).sum(0) for t in texts[:2]], np.float32)
    model = names, profiles / np.linalg.norm(profiles, axis=1, keepdims=True)
    held = {}

    def stub(df, text, keep, factory, outputs):
        held["work"] = factory()

    real, language.annotate = language.annotate, stub
    try:
        language.identify(documents(spark, []), model)
    finally:
        language.annotate = real
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found, score = held["work"]([t.encode() for t in texts])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    assert found[:2] == ["x", "y"] and min(score[:2]) > 0.999 and len(found) == 10_000


def plain_follow(rows, alpha=0.3, beta=1.0, l1=0.02, l2=0.5):
    """Follow-the-regularised-leader an n-gram at a time, in dictionaries."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(quality.PASSES):
        for dims, values, label in rows:
            x = {**dict(zip(dims, values, strict=True)), "bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[i] * x[i] for i in x)))))
            for i, v in x.items():
                g = (p - label) * v
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_quality_scores_are_brute_force(spark, tables):
    """What is learned and scored, against dictionaries over the same sparse vectors."""
    docs, labels = tables
    sample = [(r.label, r.text) for r in labelled_sample(docs, labels, "quality", (3, 1), 150).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    dims, values = quality.sparse([(t or "").encode() for _, t in sample])
    weights = plain_follow([(d.tolist(), np.float32(v).tolist(), y) for (y, _), d, v in zip(sample, dims, values, strict=True)])
    assert 100 < len(sample) <= 150 and len(weights) > 1000
    got = {r.doc_id: r for r in quality.judged(docs, labels, rows=150).collect()}
    rows = docs.collect()
    dims, values = quality.sparse([(r.text or "").encode() for r in rows])
    for r, d, v in zip(rows, dims, values, strict=True):
        p = 1 / (1 + math.exp(-sum(weights.get(i, 0.0) * x for i, x in zip(d.tolist(), v.tolist(), strict=True)) - weights["bias"]))
        assert got[r.doc_id].score == pytest.approx(p, abs=1e-4)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def test_quality_vectors_know_their_n_grams():
    """Words and pairs of words as they are, in the text's share of its words; no n-gram over two texts; repeats add up."""
    dims, values = quality.sparse([b"one two one two", b"two one", b"", b"one"])
    of = lambda i: dict(zip(dims[i].tolist(), values[i].tolist(), strict=True))
    assert len(dims[2]) == 0 and sum(values[0]) == pytest.approx(quality.SCALE / 4 * (4 + 3 + 4 + 3 + 2 + 4)) and sum(values[3]) == pytest.approx(quality.SCALE * 3)
    words_of = set(of(1)) & set(of(0))
    assert set(of(3)) - words_of <= set(of(3)) and len(words_of) >= 3


def plain_verdict(text, learned):
    """The decision list on one text: 0 for the base rules, else the first rule whose conditions all hold, None if none does."""
    t = text or ""
    n, chars, symbols, dup, repeat = base(t)
    if n < 10 or 100 * repeat > 20 * n:
        return 0
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    x = {
        "symbol_share": symbols / max(chars, 1), "mark_share": marks / max(chars, 1), "upper_share": sum("A" <= c <= "Z" for c in t) / max(chars, 1), "digit_share": sum("0" <= c <= "9" for c in t) / max(chars, 1),
        "word_length": chars / max(n, 1), "repeat_share": repeat / max(n, 1), "same_share": sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(n, 1), "distinct_share": len(set(w)) / max(n, 1),
        "long_share": sum(len(v.encode()) > 20 for v in w) / max(n, 1), "dup_line_share": dup / max(len(lines), 1), "words": n,
    }
    return next((i for i, rule in enumerate(learned, 1) if all((x[c.name] > c.threshold) == c.above for c in rule)), None)


def test_verdicts_are_brute_force(spark, tables):
    """Learned lists and one that uses every share, over all texts of the table."""
    docs, labels = tables
    condition = rules.Condition
    every = [[condition(name, above, t), condition("words", True, 20.0)] for name, above, t in (("symbol_share", True, 0.02), ("mark_share", True, 0.2), ("upper_share", True, 0.3), ("digit_share", True, 0.2), ("same_share", True, 0.05), ("long_share", True, 0.3), ("dup_line_share", True, 0.4), ("distinct_share", False, 0.2), ("repeat_share", True, 0.1), ("word_length", False, 3.5))]
    for learned in (rules.fit(docs, labels), every):
        for r in rules.apply(docs, learned).collect():
            want = plain_verdict(r.text, learned)
            assert r.rule == want and r.kept == (want is None), (r.doc_id, r.rule, want)
    assert {plain_verdict(r.text, every) for r in docs.collect()} > {0, 1, None}


def test_covering_is_plain_sequential_covering():
    """The list against loops over single rows: thresholds, gains, pruning rows and the end of the list."""
    rng = np.random.default_rng(8)
    x = {k: rng.integers(0, 12, 400) / 10 for k in ("a", "b", "c")}
    bad = ((x["a"] > 0.8) | ((x["b"] > 0.5) & (x["c"] <= 0.3))) ^ (rng.random(400) < 0.03)

    def holds(rule, i):
        return all((x[c.name][i] > c.threshold) == c.above for c in rule)

    def grow(rows):
        rule = []
        while len(rule) < rules.CONDITIONS and rows and not all(bad[i] for i in rows):
            p0, n0, best, gain = sum(bad[i] for i in rows), len(rows), None, 1e-9
            for name in sorted(x):
                values = sorted(x[name][i] for i in rows)
                for t in sorted({values[int(math.floor(q / 32 * (len(values) - 1)))] for q in range(33)}):
                    for above in (True, False):
                        inside = [i for i in rows if (x[name][i] > t) == above]
                        p, n = sum(bad[i] for i in inside), len(inside)
                        if p >= rules.LEAST_ROWS and n < n0 and p * (np.log2(p / n) - np.log2(p0 / n0)) > gain:
                            best, gain = rules.Condition(name, above, float(t)), p * (np.log2(p / n) - np.log2(p0 / n0))
            if best is None:
                break
            rule.append(best)
            rows = [i for i in rows if holds([best], i)]
        return rule

    def worth(rule, rows):
        inside = [bool(bad[i]) for i in rows if holds(rule, i)]
        return (2 * sum(inside) - len(inside)) / len(inside) if inside else -1.0

    left, want = list(range(400)), []
    while len(want) < rules.RULES and sum(bad[i] for i in left) >= rules.LEAST_ROWS:
        prune = [i for i in left if i % 3 == 2]
        grown = grow([i for i in left if i % 3 != 2])
        rule = max((grown[:k] for k in range(len(grown), 0, -1)), key=lambda r: (worth(r, prune), -len(r)), default=[])
        inside = [bool(bad[i]) for i in prune if holds(rule, i)]
        if not rule or (sum(inside) + 1) / (len(inside) + 2) < rules.LEAST_SHARE - 0.5 / math.sqrt(len(inside) + 1):
            break
        want.append(rule)
        left = [i for i in left if not holds(rule, i)]
    assert len(want) >= 2 and rules.cover(x, bad) == want
