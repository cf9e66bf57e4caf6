"""Toxicity by a weighted lexicon, matched at once by Aho-Corasick in folded text, normalised by length, with exceptions."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docquery.llm.common import annotate, crc_class, labelled_sample, quoted, written

#: Labelled documents that the lexicon is learned from at most, and what an entry must reach: texts and share of toxic ones.
SAMPLE_ROWS, LEAST_TOXIC, LEAST_SHARE = 20_000, 4, 0.9
#: Clean texts that must have an exception phrase.
LEAST_CLEAN = 4
#: Length of the word beginnings that can be entries, beside whole words.
BEGINNINGS = range(4, 8)
#: Words of a text from which its length begins to tell: the one that suits the sample best is taken.
LENGTHS = (25, 50, 100, 200, 400, 800, 1600, 3200, 6400)

# Letters that look like a Latin one, digits and marks written for a letter.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
_DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"})
_HIDDEN = dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF])
_TOKEN = re.compile(r"[a-z0-9@$!|]*[0-9@$!|][a-z0-9@$!|]*[a-z0-9]")
_REST = re.compile(r"[^a-zß-öø-ɏ]+")


class _Fold(dict):
    """Each character's folded form, made when first seen: lower case, look-alikes as Latin, a Latin letter's own marks kept."""

    def __missing__(self, point: int) -> str:
        low = chr(point).lower()
        if not (0xDF <= ord(low[0]) < 0x250 and low.isalpha()):
            low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c)).lower()
        self[point] = out = "".join(_LOOKALIKES.get(c, c) for c in low)
        return out


_FOLD = _Fold(_HIDDEN)


def _bare(point: int) -> str:
    first = unicodedata.normalize("NFKD", chr(point))[0]
    return {"ł": "l", "ø": "o", "đ": "d", "ı": "i"}.get(first, first)


#: Marked Latin letters without their marks, one for one.
_BARE = {point: _bare(point) for point in range(0xDF, 0x250)}


def folded(text: bytes | None) -> str:
    """Latin letters and single spaces, one at each end. Digits and marks are letters where a token has a letter too."""
    t = unicodedata.normalize("NFC", (text or b"").decode("utf-8", "replace")).translate(_FOLD)
    t = _TOKEN.sub(lambda m: m[0].translate(_DIGITS) if any("a" <= c <= "z" for c in m[0]) else m[0], t)
    return " " + _REST.sub(" ", t).strip() + " "


def candidates(text: str) -> set[str]:
    """What a folded text has that could be an entry: its words and their beginnings, each after a space."""
    words = set(text.split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


def _counted(sample: DataFrame, only: frozenset | None, factory: Callable = lambda: candidates) -> DataFrame:
    """(entry, n): the texts that have each candidate, or each of the given ones; factory() makes a task's way to find them."""
    schema = T.StructType.fromDDL("entry string, n long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        find = factory()
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = find(folded(t))
                counts.update(found if only is None else found & only)
            if len(counts) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()))], schema=arrow)
                counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=arrow)

    return sample.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, schema).groupBy("entry").agg(F.sum("n").alias("n"))


def entries(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, tried: int) -> dict[str, float]:
    """Entries and weights: the log odds of those that clean texts of the same number rarely have.

    tried is how many candidates there were: an entry's likelihood ratio against chance must be more than the best of so
    many would have by chance.
    """
    base, out = n_toxic / (n_toxic + n_clean), {}
    for e, a in toxic.items():
        b = clean.get(e, 0)
        scaled = b * n_toxic / n_clean
        ratio = a * math.log(a / (a + b) / base) + (b * math.log(b / (a + b) / (1 - base)) if b else 0)
        if a / (a + scaled) >= LEAST_SHARE and ratio >= math.log(max(tried, 2)) + 2:
            out[e] = math.log((a + 0.5) / (scaled + 0.5))
    return {e: round(out[e], 6) for e in sorted(out)}


class Matcher:
    """All entries and exception phrases in one automaton."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for e, weight in lexicon.items():
            self.automaton.add_word(e, (e, weight))
        for phrase in exceptions:
            if (p := folded(phrase.encode())).strip():
                self.automaton.add_word(p, (p, None))
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, str, float]]:
        """(place, entry, weight), the heaviest entry at each place, but for those inside an exception phrase."""
        best: dict[int, tuple[str, float]] = {}
        spared: list[tuple[int, int]] = []
        found = list(self.automaton.iter(text)) if self.some else []
        if self.some and not text.isascii():  # a marked letter may stand for the bare one, but in whole words only
            found += [(end, x) for end, x in self.automaton.iter(text.translate(_BARE)) if x[0][-1] == " " and x[0].isascii()]
        for end, (e, weight) in found:
            start = end - len(e) + 1
            if weight is None:
                spared.append((start, end))
            elif start not in best or best[start][1] < weight:
                best[start] = (e, weight)
        return [(s, e, w) for s, (e, w) in sorted(best.items()) if not any(a <= s and s + len(e.rstrip()) - 1 <= b for a, b in spared)]


def strength(hits: list[tuple[int, str, float]], text: str, length_from: float) -> float:
    """The weights of what was found in a folded text, divided by what grows with its length."""
    return sum(w for _, _, w in hits) / (1 + math.log1p(text.count(" ") / length_from)) if hits else 0.0


def surroundings(text: str, matcher: Matcher) -> set[str]:
    """The two and three words in a row of a folded text that have an entry's word, with a space at each end."""
    out = set()
    for start, _, _ in matcher.hits(text):
        before, after = text[:start].rsplit(" ", 2)[1:], text[start + 1 :].split(" ", 3)[:3]
        words, at = [*before, *filter(None, after)], len(before)
        spans = ((i, i + k) for k in (2, 3) for i in range(max(at - k + 1, 0), at + 1) if i + k <= len(words))
        out |= {" " + " ".join(words[i:j]) + " " for i, j in spans}
    return out


def phrases(sample: DataFrame, lexicon: dict[str, float], toxic: dict[str, int], clean: dict[str, int]) -> tuple[str, ...]:
    """Exception phrases: words around an entry that clean texts of the sample have and toxic ones never.

    As for entries, chance must not give the best of so many phrases as often: each of its clean texts, copies counted
    once, is as likely as the share of clean ones among the texts that have the entry. What has a shorter phrase in it is
    left out.
    """

    def factory():
        matcher = Matcher(lexicon)
        return lambda text: surroundings(text, matcher)

    seen = {r["entry"]: r["n"] for r in _counted(sample.where("label = 0").select("text").distinct(), None, factory).collect()} if lexicon else {}
    bad = {r["entry"] for r in _counted(sample.where("label = 1"), frozenset(seen), factory).collect()} if seen else set()
    out: list[str] = []
    for phrase, n in sorted(seen.items(), key=lambda x: (x[0].count(" "), x[0])):
        chance = max(((clean.get(e, 0) + 0.5) / (toxic[e] + clean.get(e, 0) + 1) for e in candidates(phrase) if e in lexicon), default=1.0)
        if n >= LEAST_CLEAN and phrase not in bad and -n * math.log(chance) >= math.log(max(len(seen), 2)) + 2 and not any(p in phrase for p in out):
            out.append(phrase)
    return tuple(p.strip() for p in out)


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (strength, label), a little held back so that it is finite."""
    a, b = 1.0, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * x).sum() - 1e-2 * a, (y - p).sum() - 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return max(a, 0.0), b


def fit(documents: DataFrame, labels: DataFrame, target: str = "toxic", split: tuple[int, int] = (3, 1), rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = ()):
    """(lexicon, exceptions, length, slope, intercept) learned from at most rows labelled documents outside the held-out class.

    Candidates are counted in toxic texts, those frequent there in clean ones; both counts are of the bounded sample, from
    which phrases come too, beside the given exceptions.
    Without labelled rows of both kinds the lexicon is empty and every score 0.
    """
    sample = written(labelled_sample(documents, labels, target, split, rows), "sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}, exceptions, LENGTHS[0], 0.0, -30.0
    counted = written(_counted(sample.where("label = 1"), None), "counted")
    toxic = {r["entry"]: r["n"] for r in counted.where(F.col("n") >= LEAST_TOXIC).collect()}
    clean = {r["entry"]: r["n"] for r in _counted(sample.where("label = 0"), frozenset(toxic)).collect()}
    lexicon = entries(toxic, clean, sizes[1], sizes[0], counted.count())
    exceptions = tuple(dict.fromkeys([*exceptions, *phrases(sample, lexicon, toxic, clean)]))

    def factory():
        matcher = Matcher(lexicon, exceptions)

        def work(texts):
            found = [(matcher.hits(f), f) for f in map(folded, texts)]
            return ([[strength(h, f, n) for n in LENGTHS] for h, f in found],)

        return work

    got = annotate(sample, "text", ["doc_id", "label"], factory, "x array<double>").orderBy("doc_id", "label").toPandas()
    x, y = np.array(got["x"].tolist(), float).reshape(-1, len(LENGTHS)), got["label"].to_numpy(float)
    tried = [(likelihood(x[:, i], y, *(curve := calibrated(x[:, i], y))), -n, curve) for i, n in enumerate(LENGTHS)]
    _, length, curve = max(tried)
    return lexicon, exceptions, -length, *curve


def likelihood(x: np.ndarray, y: np.ndarray, slope: float, intercept: float) -> float:
    """The logarithm of how likely the labels are on a logistic curve; rounded, so that machines agree on the best."""
    z = np.clip(slope * x + intercept, -30, 30)
    return round(float((y * z - np.log1p(np.exp(z))).sum()), 6)


def score(documents: DataFrame, model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default), score of each whole text (0 to 1) and hits, the entries found in it.

    A null or empty text has no hits and the score that no hits have. Of entries at one place the heaviest counts, of equally
    heavy ones the first that ends. A kept column of either name is replaced.
    """
    lexicon, exceptions, length, slope, intercept = model

    def factory():
        matcher = Matcher(lexicon, exceptions)

        def work(texts):
            out, found = [], []
            for f in map(folded, texts):
                hits = matcher.hits(f)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, slope * strength(hits, f, length) + intercept)))))
                found.append([e.strip() for _, e, _ in hits])
            return out, found

        return work

    return annotate(documents, text, documents.columns if keep is None else keep, factory, "score double, hits array<string>")


def judged(documents: DataFrame, labels: DataFrame, split: tuple[int, int] = (3, 1), rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.7 on). A null id is never held out; rows come back as given."""
    found = score(documents, fit(documents, labels, "toxic", split, rows), keep=["doc_id"])
    held = F.coalesce(crc_class(quoted("doc_id"), split[0]) == split[1], F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
