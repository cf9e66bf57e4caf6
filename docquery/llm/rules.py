"""Quality rules: counts of each text, and a decision list learned from labelled counts, as ordered Spark conditions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from docquery.llm.common import annotate, labelled_sample, quoted
from docquery.llm.textkernels import SPACE, mix, sequences, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_lower", "n_digits", "n_marks", "n_same", "n_lines", "n_distinct", "n_long")
SYMBOLS = b"#*$%&|<>"
#: Labelled documents that a list is learned from at most, its rules, a rule's conditions, and what a rule must reach.
SAMPLE_ROWS, RULES, CONDITIONS, LEAST_SHARE, LEAST_ROWS = 20_000, 12, 3, 0.9, 5


def _table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_CLASSES = {
    "n_symbols": _table(SYMBOLS),
    "n_upper": _table(range(65, 91)),
    "n_lower": _table(range(97, 123)),
    "n_digits": _table(range(48, 58)),
    "n_marks": _table(c for c in range(33, 127) if not chr(c).isalnum()),
}


def counts(texts: list[bytes | None]) -> list:
    """BASE and MORE for each text."""
    w = words(texts)
    n = len(texts)
    size = np.diff(w.first)
    owner = w.owner

    def per_text(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[w.text_at[1:]] - total[w.text_at[:-1]]

    out = {"n_words": size, "word_chars": per_text(((w.bytes & 0xC0) != 0x80) & ~SPACE[w.bytes])}
    out |= {k: per_text(t[w.bytes]) for k, t in _CLASSES.items()}
    runs = sequences(w.hash, 5)
    inside = owner[: len(runs)] == owner[4:] if len(runs) else np.zeros(0, bool)
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if inside.any():
        at = np.flatnonzero(inside)
        _, back, times = np.unique(mix(runs[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        at = at[times[back] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 5, -1)
    out["n_repeat_words"] = np.bincount(owner, np.cumsum(covered)[:-1] > 0, n)
    same = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])])[: len(owner)]
    out["n_same"] = np.bincount(owner, same, n)
    out["n_long"] = np.bincount(owner, w.end - w.start > 20, n)
    out["n_distinct"] = [len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    lines = [[x for x in (t or b"").split(b"\n") if x.strip(b" \t\r\x0b\x0c")] for t in texts]
    out["n_lines"] = [len(x) for x in lines]
    out["n_dup_lines"] = [len(x) - len(set(x)) for x in lines]
    return [np.asarray(out[k]).astype(np.int64).tolist() for k in (*BASE, *MORE)]


#: What conditions are about: shares that do not depend on a text's length, by the counts that they are made of.
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "same_share": ("n_same", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "long_share": ("n_long", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "words": ("n_words", None),
}


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.threshold if self.above else x[self.name] <= self.threshold

    def column(self) -> Column:
        a, b = RATIOS[self.name]
        value = F.col(a) / F.greatest(F.col(b), F.lit(1)) if b else F.col(a).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


def ratios(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {name: x[a] / np.maximum(x[b], 1) if b else x[a].astype(float) for name, (a, b) in RATIOS.items()}


def _covers(rule, x, rows):
    out = np.ones(len(rows), bool)
    for c in rule:
        out &= c.holds(x)[rows]
    return out


def _grow(x, bad, rows):
    """Conditions that gain most, one after the other, until only bad rows are covered."""
    rule: list[Condition] = []
    while len(rule) < CONDITIONS and len(rows) and not bad[rows].all():
        p0, n0 = bad[rows].sum(), len(rows)
        best, gain = None, 1e-9
        for name in sorted(x):
            values = x[name][rows]
            for t in np.unique(np.quantile(values, np.linspace(0, 1, 33), method="lower")):
                for above in (True, False):
                    cover = values > t if above else values <= t
                    p, n = bad[rows][cover].sum(), cover.sum()
                    if p >= LEAST_ROWS and n < n0:
                        now = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if now > gain:
                            best, gain = Condition(name, above, float(t)), now
        if best is None:
            break
        rule.append(best)
        rows = rows[best.holds(x)[rows]]
    return rule


def _prune(rule, x, bad, rows):
    """The shortest beginning of the rule that is worth most on rows it was not grown on."""

    def worth(r):
        cover = _covers(r, x, rows)
        p, n = bad[rows][cover].sum(), cover.sum()
        return (2 * p - n) / n if n else -1.0

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (worth(r), -len(r)), default=[])


def cover(x: dict[str, np.ndarray], bad: np.ndarray) -> list[list[Condition]]:
    """Rules for bad rows, in order, each for what the ones before it leave.

    Every third row prunes, the others grow; a rule that is not reliable on the pruning rows ends the list.
    """
    left, rules = np.arange(len(bad)), []
    while len(rules) < RULES and bad[left].sum() >= LEAST_ROWS:
        prune = left % 3 == 2
        rule = _prune(_grow(x, bad, left[~prune]), x, bad, left[prune])
        if not rule:
            break
        held = _covers(rule, x, left[prune])
        p, n = bad[left[prune]][held].sum(), held.sum()
        if (p + 1) / (n + 2) < LEAST_SHARE - 0.5 / np.sqrt(n + 1):
            break
        rules.append(rule)
        left = left[~_covers(rule, x, left)]
    return rules


def stats(documents: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and the counts of each whole text; a null or empty text has zeros.

    A kept column named like a count is replaced.
    """
    return annotate(documents, text, documents.columns if keep is None else keep, lambda: counts, ", ".join(f"{k} long" for k in (*BASE, *MORE)))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit(documents: DataFrame, labels: DataFrame, target: str = "quality", split: tuple[int, int] = (3, 1), rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Rules learned from the counts of at most rows labelled documents outside the held-out class, by hash of the id.

    Only documents that pass the base rules teach. Without such rows of both labels the list is empty and keeps all.
    """
    sample = stats(labelled_sample(documents, labels, target, split, rows), keep=["doc_id", "label"]).where(~base_failed())
    got = sample.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    bad = got["label"].to_numpy() == 0
    return cover(ratios({k: got[k].to_numpy(float) for k in (*BASE, *MORE)}), bad) if len(got) else []


def verdict(rules: list[list[Condition]]) -> tuple[Column, Column]:
    """Whether the list keeps a row, and the number of the first rule that rejects it (null if none does)."""
    which = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        held = F.lit(True)
        for c in rule:
            held &= c.column()
        which = F.when(held, F.lit(i)).otherwise(which)
    return which.isNull(), which


def apply(documents: DataFrame, rules: list[list[Condition]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, BASE, base_failed, kept, and rule: the first rule that rejects the row, 0 for the base rules."""
    found = stats(documents, text, keep)
    good, which = verdict(rules)
    rest = [c for c in found.columns if c not in MORE and c not in ("base_failed", "kept", "rule")]
    return found.select(*[quoted(c) for c in rest], base_failed().alias("base_failed"), (~base_failed() & good).alias("kept"), F.when(base_failed(), F.lit(0)).otherwise(which).alias("rule"))
