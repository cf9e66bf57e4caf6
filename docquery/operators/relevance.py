"""Relevance: analysed, fuzzy and phrase matches with scores, and score modifiers."""

from __future__ import annotations

from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docquery.functions import text as tx
from docquery.functions.fields import numeric
from docquery.functions.scripts import script
from docquery.operators.predicates import Cond


def query_tokens(spark: SparkSession, value: str, phrase: bool = False, stem: bool = True) -> list[str]:
    """A query's tokens by the same Columns that analyse documents; one row, once a query."""
    made = tx.analysed_phrase if phrase else tx.analysed
    return spark.range(1).select(made(F.lit(value), stem).alias("t")).first()["t"]


def length_factor(n: Column) -> Column:
    """1 up to ten tokens, then one over the logarithm of their number."""
    return F.when(n > 10, 1 / F.ln(n + 1.0)).otherwise(F.lit(1.0))


def match(analysed: Column, query: list[str], boost: float = 1.0) -> Cond:
    """At least one n-gram in common; analysed is a column of distinct n-grams, written once for many queries."""
    return _shared(analysed, F.array(*[F.lit(q) for q in query]) if query else F.array().cast("array<string>"), boost)


def _shared(analysed: Column, wanted: Column, boost: float) -> Cond:
    score = tx.bound(analysed, lambda g: tx.bound(F.size(F.array_intersect(g, wanted)), lambda n: F.when(n > 0, n * length_factor(F.size(g)) * boost)))
    return Cond.of(score.isNotNull(), score)


def match_hashed(hashes: Column, query: list[str], boost: float = 1.0, tokens: Column | None = None) -> Cond:
    """match() over the hashes of a document's n-grams (text.gram_hashes); a query's n-grams are hashed alike.

    With tokens, the document's own, rows without a word of the query are filtered before any n-gram is made: where each
    word is also an n-gram of the query, as analysis gives them, that is all the filter there is.
    """
    wanted = F.array(*[tx.gram_hash(*[F.lit(w) for w in q.split(" ")]) for q in query]) if query else F.array().cast("array<bigint>")
    cond = _shared(hashes, wanted, boost)
    if tokens is None or not query:
        return cond
    singles = sorted({w for q in query for w in q.split(" ")})
    some = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in singles]))
    return Cond(cond.match, cond.score, some if set(singles) <= set(query) else some & cond.filter)


def could_hold(text: Column, wanted: list[str], every: bool = True) -> Column:
    """Whether raw text can have all, or any, of the words among its tokens without stemming: a filter before analysis.

    Text without such a run of characters, once normalised as analysis does, has no such token.
    """
    holds = lambda t: reduce(lambda a, b: a & b if every else a | b, [t.contains(w) for w in wanted])
    return tx.bound(F.lower(tx.normalised(text)), holds) if wanted else F.lit(True)


def words(c: Column) -> Column:
    """Runs of letters and digits of any script, lower case."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def fuzzy_frame(df: DataFrame, key: str, c: Column, value: str, fuzziness: int, boost: float = 1.0) -> DataFrame:
    """(key, fuzzy_score) of rows with a word within fuzziness edits of the whole value.

    Words that the built-in distance puts beyond twice as many edits cannot be: only the others go to the exact one, each
    distinct word once. At fuzziness 0 an equal word scores 0.
    """
    wanted = F.lit(value.lower())
    near = df.select(F.col(key), F.explode(F.array_distinct(words(c))).alias("w")).where(F.levenshtein("w", wanted, 2 * fuzziness) >= 0)
    vocabulary = near.select("w").distinct().withColumn("d", tx.osa("w", wanted)).where(F.col("d") <= fuzziness)
    score = (1 + (fuzziness - F.col("d")) / fuzziness) * boost if fuzziness else F.lit(0.0)
    return near.join(vocabulary, "w").groupBy(key).agg(F.max(score).alias("fuzzy_score"))


#: Distances of words that come again in other documents, a bounded number of them.
_distance = lru_cache(1 << 17)(tx.osa_distance)


def best_phrase(doc: list[str], query: list[str], slop: int, fuzz: int) -> tuple[int, int] | None:
    """(slop used, fuzziness used) of the first start that uses the least slop, each next word taken where it first fits."""
    best = None
    distance = _distance if fuzz else lambda a, b: 0 if a == b else 1
    near = [{w: d for w in set(doc) if abs(len(w) - len(q)) <= fuzz and (d := distance(w, q)) <= fuzz} for q in query]
    if not all(near):
        return None
    for start in (i for i, w in enumerate(doc) if w in near[0]):
        used, edits, at = 0, near[0][doc[start]], start
        for held in near[1:]:
            found = next((i for i in range(at + 1, min(len(doc), at + 2 + slop - used)) if doc[i] in held), None)
            if found is None:
                break
            used, at, edits = used + found - at - 1, found, edits + held[doc[found]]
        else:
            if best is None or used < best[0]:
                best = (used, edits)
    return best


def phrase(tokens: Column, query: list[str], slop: int = 0, fuzz: int = 0, boost: float = 1.0) -> Cond:
    """The query's words in order with at most slop words between (T11). Without slop and fuzziness it is all built in."""
    n, m = F.size(tokens), len(query)
    if not m:
        return Cond.of(F.lit(False))
    wanted = F.array(*[F.lit(q) for q in query])
    if not slop and not fuzz:
        def held(t):
            starts = F.sequence(F.lit(1), F.greatest(F.size(t) - m + 1, F.lit(1)))
            found = (F.size(t) >= m) & F.array_contains(t, query[0]) & F.exists(starts, lambda i: F.slice(t, i, m) == wanted)
            return F.when(found, float(m) * length_factor(F.size(t)) * 2.5 * boost)

        score = tx.bound(tokens, held)
        return Cond.of(score.isNotNull(), score)

    @F.pandas_udf("struct<slop: int, fuzz: int>")
    def place(docs: pd.Series) -> pd.DataFrame:
        found = [best_phrase(list(d), query, slop, fuzz) if d is not None and len(d) >= m else None for d in docs]
        return pd.DataFrame({"slop": pd.array([f and f[0] for f in found], "Int32"), "fuzz": pd.array([f and f[1] for f in found], "Int32")})

    possible = (n >= m) & (F.lit(True) if fuzz else F.arrays_overlap(tokens, F.array(F.lit(query[0]))))
    used = place(F.when(possible, tokens))
    near = 1 - used["slop"] / (slop + 1) if slop else F.lit(1.0)
    return Cond.of(used["slop"].isNotNull(), F.greatest(F.lit(1), m - used["slop"] - used["fuzz"]) * length_factor(n) * 2.5 * boost * near)


def modified(score: Column, functions: list[tuple[Column | str, float]], combine: str = "multiply") -> Column:
    """A score after (value, weight) functions; those that fail or give no number are skipped.

    A text is user code (functions.scripts), which fails without failing the job; a Column is taken as it is.

    multiply: times the product, of which a running 0 gives way to the next value. sum: plus 1 and the values. replace:
    the last value, 1 if all failed. Anything else is like multiply.
    """
    numbers = [(numeric(script(v) if isinstance(v, str) else v), w) for v, w in functions]
    values = [F.when(v.isNotNull() & ~F.isnan(v), v * w) for v, w in numbers]
    if combine == "sum":
        return score + 1 + reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values], F.lit(0.0))
    if combine == "replace":
        return F.coalesce(*reversed(values), F.lit(1.0))
    return score * reduce(lambda a, v: F.when(v.isNull(), a).when(a == 0, v).otherwise(a * v), values, F.lit(1.0))
