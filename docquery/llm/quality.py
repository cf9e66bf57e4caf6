"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docquery.llm.common import annotate, crc_class, labelled_sample, quoted
from docquery.llm.textkernels import Words, mix, sequences, words

#: Dimensions of the hashed space.
DIMENSIONS = 1 << 18
#: Labelled documents that a model is fitted on at most, and passes over them.
SAMPLE_ROWS, PASSES = 4000, 3
#: Share that an n-gram kind's occurrences in a text come to.
SCALE = 8.0

_UPPER, _LOWER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_MARK[[c for c in range(33, 127) if not (_UPPER | _LOWER | _DIGIT)[c]]] = True


def _inside(mask: np.ndarray, w: Words) -> np.ndarray:
    """How many bytes of each word are in a class of bytes."""
    total = np.concatenate([[0], np.cumsum(mask[w.bytes])])
    return total[w.end] - total[w.start]


def shapes(w: Words) -> np.ndarray:
    """What each word looks like, whatever it says: length, case, digits, marks, its last mark, and whether it repeats."""
    size = w.end - w.start
    upper, marks = _inside(_UPPER, w), _inside(_MARK, w)
    case = np.where(upper == 0, 0, np.where(_inside(_LOWER, w) > 0, 1, 2))
    length = np.searchsorted([2, 4, 7, 11, 17], size)
    last = w.bytes[w.end - 1] if len(size) else np.zeros(0, np.uint8)
    final = np.where(_MARK[last], last, 0)
    first = np.isin(np.arange(len(size)), w.first)
    again = np.concatenate([[False], w.hash[1:] == w.hash[:-1]])[: len(size)] & ~first
    code = (((length * 3 + case) * 4 + np.minimum(marks, 3)) * 2 + (_inside(_DIGIT, w) > 0)) * 2 + again
    return mix(code.astype(np.uint64) * np.uint64(256) + final.astype(np.uint64))


def repeated(w: Words, owner: np.ndarray) -> np.ndarray:
    """Whether the three words from each one on are found more than once in its text."""
    runs = sequences(w.hash, 3)
    out = np.zeros(len(w.hash), bool)
    inside = np.flatnonzero(owner[: len(runs)] == owner[2:]) if len(runs) else np.zeros(0, np.int64)
    key = mix(runs[inside] + owner[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    out[inside] = n[at] > 1  # runs over the end of a text are none of its own, whatever text comes after it
    return out


def features(w: Words):
    """For each kind of n-gram: the text and the dimension of each occurrence."""
    owner = w.owner
    shape = shapes(w)
    seen = mix(shape + repeated(w, owner).astype(np.uint64))
    kinds = [(w.hash, 1), (w.hash, 2), (shape, 1), (shape, 2), (shape, 3), (seen, 1)]
    for kind, (values, k) in enumerate(kinds):
        grams = sequences(values, k)
        inside = owner[: len(grams)] == owner[k - 1 :] if len(grams) else np.zeros(0, bool)
        yield owner[: len(grams)][inside], (mix(grams[inside] + np.uint64(kind)) % np.uint64(DIMENSIONS)).astype(np.int64)


def _norms(w: Words) -> np.ndarray:
    return SCALE / np.maximum(np.diff(w.first), 1)


def sparse(texts: list[bytes | None]) -> tuple[list, list]:
    """Sorted dimensions and values of each text."""
    w = words(texts)
    parts = list(features(w))
    owner, dim = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    key, n = np.unique(owner * DIMENSIONS + dim, return_counts=True)
    at = np.searchsorted(key // DIMENSIONS, np.arange(len(texts) + 1))
    value = n * _norms(w)[key // DIMENSIONS]
    return [key[a:b] % DIMENSIONS for a, b in zip(at[:-1], at[1:], strict=True)], [value[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def follow(rows, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias after passes over (dimensions, values, label), which rows() gives anew each time."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(PASSES):
        for dims, values, label in rows():
            i, x = np.append(dims, DIMENSIONS), np.append(values, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    found = weights(np.arange(DIMENSIONS + 1))
    return found[:-1].astype(np.float32), float(found[-1])


def fit(documents: DataFrame, labels: DataFrame, target: str = "quality", split: tuple[int, int] = (3, 1), rows: int = SAMPLE_ROWS):
    """(weights, bias) from at most rows labelled documents outside the held-out class, in an order by hash of the id.

    What comes to the driver is these rows' sparse vectors. Without labelled rows all weights are 0, so every score 0.5.
    """
    sample = labelled_sample(documents, labels, target, split, rows)
    found = annotate(sample, "text", ["doc_id", "label"], lambda: sparse, "dims array<int>, vals array<float>")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id").select("label", "dims", "vals").toArrow()

    def vectors():
        for batch in got.to_batches():
            ends = batch.column("dims").offsets.to_numpy()
            dims, vals = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in ("dims", "vals"))
            for label, a, b in zip(batch.column("label").to_numpy(), ends[:-1], ends[1:], strict=True):
                yield dims[a:b], vals[a:b].astype(float), label

    return follow(vectors)


def score(documents: DataFrame, model, text: str = "text", keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """The kept columns (all by default) and the score of each whole text, 0 to 1; a null or empty text has the bias alone.

    A kept column of the score's name is replaced.
    """
    weights, bias = model

    def factory():
        def work(texts):
            w = words(texts)
            total = np.zeros(len(texts))
            for owner, dim in features(w):
                total += np.bincount(owner, weights[dim], len(texts))
            return ((1 / (1 + np.exp(-np.clip(total * _norms(w) + bias, -30, 30)))).tolist(),)

        return work

    return annotate(documents, text, documents.columns if keep is None else keep, factory, f"`{column}` double")


def judged(documents: DataFrame, labels: DataFrame, split: tuple[int, int] = (3, 1), rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on). A null id is never held out; rows come back as given."""
    found = score(documents, fit(documents, labels, "quality", split, rows), keep=["doc_id"])
    held = F.coalesce(crc_class(quoted("doc_id"), split[0]) == split[1], F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
