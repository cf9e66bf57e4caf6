"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs; an n-gram's vector is the product of its letters' vectors, each turned by its
place; a text's profile is the sum of its n-grams' vectors, a language's the sum of its texts' profiles of equal length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docquery.llm.common import annotate, crc_class, quoted

#: Length of the vectors, and letters of an n-gram.
WIDTH, GRAM = 512, 3
#: Bits of a code point in the code of an n-gram.
BITS = 21
#: Documents that the profiles are learned from at most.
SAMPLE_ROWS = 6000
#: N-grams of texts whose vectors are made at once.
AT_ONCE = 4096

#: Code points below this limit that are letters, as themselves, others 0.
_CLASS = np.array([c if chr(c).isalpha() else 0 for c in range(0x3000)], np.int64)


class _Signs(dict):
    """The vector of each letter, drawn when first seen with its code point as the seed; 0 stands for a break."""

    def __missing__(self, point: int) -> np.ndarray:
        bits = np.random.Generator(np.random.PCG64([7, int(point)])).integers(0, 256, WIDTH // 8, dtype=np.uint8)
        self[int(point)] = out = np.unpackbits(bits).astype(np.int8) * 2 - 1
        return out


_SIGNS = _Signs()


def vectors(codes: np.ndarray) -> np.ndarray:
    """The vectors of n-grams given by their codes."""
    points = np.stack([codes >> BITS * (GRAM - 1 - place) & (1 << BITS) - 1 for place in range(GRAM)])
    letters, at = np.unique(points, return_inverse=True)
    table, at = np.array([_SIGNS[p] for p in letters.tolist()], np.int8).reshape(-1, WIDTH), at.reshape(points.shape)
    out = np.ones((len(codes), WIDTH), np.int8)
    for place in range(GRAM):
        out *= np.roll(table, place, axis=1)[at[place]]
    return out


def grams(text: bytes | None) -> np.ndarray:
    """Codes of a text's n-grams: letters as lower case, every run of other characters as one break; none without letters."""
    points = np.frombuffer((text or b"").decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), "<u4")
    letters = _CLASS[np.minimum(points, len(_CLASS) - 1)]
    for point in np.unique(points[points >= len(_CLASS) - 1]).tolist():
        letters[points == point] = point if chr(point).isalpha() else 0
    if not letters.any():
        return np.zeros(0, np.int64)
    letters = np.concatenate([[0], letters, [0]])
    letters = letters[np.concatenate([[True], (letters[1:] > 0) | (letters[:-1] > 0)])]
    code = np.zeros(len(letters) - GRAM + 1, np.int64)
    for place in range(GRAM):
        code = (code << BITS) + letters[place : len(code) + place]
    return code


def fit(documents: DataFrame, text: str = "text", language: str = "lang", split: tuple[int, int] = (4, 2), rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their profiles of length 1, from at most rows documents outside the held-out class by hash of the id."""
    known = documents.select(quoted("doc_id").alias("doc_id"), quoted(language).cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & (crc_class(F.col("doc_id"), split[0]) != split[1]))
    few = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(rows)
    texts = documents.select(quoted("doc_id").alias("doc_id"), quoted(language).cast("string").alias("lang"), quoted(text).alias("text"))
    sample = texts.join(F.broadcast(few), ["doc_id", "lang"])

    def factory():
        def work(texts):
            out = []
            for t in texts:
                code, n = np.unique(grams(t), return_counts=True)
                out.append([{"c": int(c), "v": float(v)} for c, v in zip(code, n / np.linalg.norm(n) if len(n) else n, strict=True)])
            return (out,)

        return work

    counts = annotate(sample, "text", ["lang"], factory, "g array<struct<c: long, v: double>>").select("lang", F.explode("g").alias("g"))
    sums = counts.groupBy("lang", "g.c").agg(F.round(F.sum("g.v"), 6).alias("v")).toPandas().sort_values(["lang", "c"])
    names, profiles = [], []
    for name, part in sums.groupby("lang"):
        total = sum(part["v"].to_numpy()[i : i + AT_ONCE] @ vectors(part["c"].to_numpy()[i : i + AT_ONCE].astype(np.int64)) for i in range(0, len(part), AT_ONCE))
        names.append(name)
        profiles.append(total / (np.linalg.norm(total) or 1))
    return names, np.array(profiles, np.float32).reshape(-1, WIDTH)


def identify(documents: DataFrame, model, text: str = "text", keep: list[str] | None = None, unknown: str = "und") -> DataFrame:
    """The kept columns (all by default), lang_pred and score: the language of the largest cosine, and that cosine from 0 on.

    Whole texts count. A null text or one without letters, and any text where no language was learned, is unknown with 0.
    Of equal cosines the first language by name wins. A kept column of either name is replaced.
    """
    names, profiles = model

    def factory():
        def work(texts):
            codes = [np.unique(grams(t), return_counts=True) for t in texts]
            total = np.zeros((len(texts), WIDTH), np.float32)
            code, times = (np.concatenate([c[i] for c in codes]) if codes else np.zeros(0, np.int64) for i in (0, 1))
            owner = np.repeat(np.arange(len(texts)), [len(c) for c, _ in codes])
            # Slices of (text, n-gram) counts, so that memory does not grow with the texts times the n-grams that differ.
            for i in range(0, len(code), AT_ONCE):
                distinct, at = np.unique(code[i : i + AT_ONCE], return_inverse=True)
                of, row = np.unique(owner[i : i + AT_ONCE], return_inverse=True)
                weights = np.zeros((len(of), len(distinct)), np.float32)
                weights[row, at] = times[i : i + AT_ONCE]
                total[of] += weights @ vectors(distinct).astype(np.float32)
            size = np.linalg.norm(total, axis=1)
            if not names:
                return [unknown] * len(texts), [0.0] * len(texts)
            cosine = total @ profiles.T / np.maximum(size, 1e-9)[:, None]
            best = cosine.argmax(axis=1)
            some = [len(c) > 0 for c, _ in codes]
            return [names[b] if s else unknown for b, s in zip(best, some, strict=True)], [min(1.0, max(0.0, float(cosine[i, b]))) if some[i] else 0.0 for i, b in enumerate(best)]

        return work

    return annotate(documents, text, documents.columns if keep is None else keep, factory, "lang_pred string, score double")


def predicted(documents: DataFrame, split: tuple[int, int] = (4, 2), rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score. A null id is neither learned from nor held out; rows come back as given."""
    held = F.coalesce(crc_class(quoted("doc_id"), split[0]) == split[1], F.lit(False))
    return identify(documents, fit(documents, split=split, rows=rows), keep=["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")
