"""Text analysis as Column expressions, and edit distance."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The words that analysis drops.
STOP_WORDS = (
    "the a an and or but is are was were of to in for on with as at by it its he she they we you your my me him her them this that those "
    "then not do will can could would should have has had be"
).split()
# Endings of the last two stemming steps and what takes their place, the first that fits.
_LONG = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("fulness", ""))
_SHORT = ("al", "ance", "ence", "er", "ic", "able", "ant", "ize")

_VOWEL = "[aeiou]|.y"


def bound(value: Column, made) -> Column:
    """made(value), where value is worked out once however often made uses it, as in the lambdas of array functions."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def normalised(c: Column) -> Column:
    """No 's at a word's end, no apostrophe before a letter, hyphens as spaces."""
    c = F.regexp_replace(c, r"'s(?![0-9A-Za-z_])", "")
    return F.replace(F.regexp_replace(c, r"'(?=[0-9A-Za-z_])", ""), F.lit("-"), F.lit(" "))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit("[0-9A-Za-z_]+"), F.lit(0))


def without_stop_words(t: Column) -> Column:
    return F.filter(t, lambda x: ~x.isin(*STOP_WORDS))


def without_short_and_numbers(t: Column) -> Column:
    """Tokens of two characters or more that are no number, also not inf, nan or infinity."""
    number = r"^(?:[+-]?(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9_]+)(?:e[+-]?[0-9]+)?|[+-]?(?:inf|infinity|nan)|0x[0-9a-f_]+p[0-9]+)$"
    could_be = lambda x: (x < ":") | x.isin("inf", "infinity", "nan")  # noqa: E731  (digits and signs sort before a colon)
    return F.filter(t, lambda x: (F.length(x) > 1) & ~(could_be(x) & x.rlike(number)))


def _cut(x: Column, n: int) -> Column:
    return F.substring(x, F.lit(1), F.length(x) - n)


def _plural(x: Column) -> Column:
    s = x.endswith("s") & ~x.endswith("ss") & (F.length(x) > 3)
    return F.when(F.length(x) < 3, x).when(x.endswith("sses") | x.endswith("ies"), _cut(x, 2)).when(s, _cut(x, 1)).otherwise(x)


def _past(x: Column) -> Column:
    """Marked with a leading space if an ending went, so that the next step doubles back on those alone."""
    hit = F.when(x.endswith("eed"), F.when(_cut(x, 3).rlike(_VOWEL), _cut(x, 1)))
    hit = F.when(x.endswith("eed"), hit).when(x.endswith("ed") & _cut(x, 2).rlike(_VOWEL), _cut(x, 2)).when(x.endswith("ing") & _cut(x, 3).rlike(_VOWEL), _cut(x, 3))
    return F.when(F.length(x) < 3, x).otherwise(F.coalesce(F.concat(F.lit(" "), hit), x))


def _single(x: Column) -> Column:
    bare = F.ltrim(x)
    return F.when(x.startswith(" "), F.when(bare.rlike(r"([^lsz])\1$"), _cut(bare, 1)).otherwise(bare)).otherwise(x)


def _ending(x: Column, longer_than: int, stem: int, rules) -> Column:
    out = x
    for end, new in reversed(rules):
        out = F.when(x.endswith(end), F.concat(_cut(x, len(end)), F.lit(new))).otherwise(out)
    return F.when((F.length(x) > longer_than) & _cut(x, stem).rlike(_VOWEL), out).otherwise(x)


def stemmed(t: Column) -> Column:
    """Stems of lower-case tokens (T5): each step is a pass of its own, so that no step's expression is repeated in the next."""
    return bound(t, _stemmed)


def _stemmed(original: Column) -> Column:
    t = original
    for step in (_plural, _past, _single, lambda x: _ending(x, 5, 5, _LONG), lambda x: _ending(x, 4, 3, [(e, "") for e in _SHORT])):
        t = F.transform(t, step)
    return F.zip_with(original, t, lambda a, b: F.when(F.length(a) < 3, a).otherwise(b))


def ngrams(t: Column, upto: int = 3) -> Column:
    """Runs of one to upto tokens joined by a space, first occurrences in order."""
    return bound(t, lambda x: F.array_distinct(F.concat(x, *[_runs(x, k) for k in range(2, upto + 1)])))


def _runs(t: Column, k: int) -> Column:
    return F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))).otherwise(F.array().cast("array<string>"))


def gram_hash(*words: Column) -> Column:
    """What stands for an n-gram where only equality counts: a hash of its words, one after the other."""
    return reduce(lambda h, w: F.xxhash64(h, w), words[1:], F.xxhash64(words[0]))


def gram_hashes(t: Column, upto: int = 3) -> Column:
    """The n-grams of ngrams() as hashes: no text is made for them, so that long documents stay cheap."""

    def longer(x, runs, k):
        if k > upto:
            return runs[0] if len(runs) == 1 else F.concat(*runs)
        n = F.greatest(F.size(x) - (k - 1), F.lit(0))
        more = F.zip_with(F.slice(runs[-1], F.lit(1), n), F.slice(x, F.lit(k), n), lambda h, w: F.xxhash64(h, w))
        return bound(more, lambda found: longer(x, [*runs, found], k + 1))

    return F.array_distinct(bound(t, lambda x: bound(F.transform(x, lambda w: F.xxhash64(w)), lambda ones: longer(x, [ones], 2))))


def analysed_phrase(c: Column, stem: bool = True) -> Column:
    """Tokens in order, repeats kept (T8); null text has none."""
    t = without_stop_words(F.transform(tokens(normalised(F.coalesce(c, F.lit("")))), F.lower))
    return without_short_and_numbers(stemmed(t) if stem else t)


def analysed(c: Column, stem: bool = True) -> Column:
    """Distinct n-grams of the tokens."""
    return ngrams(analysed_phrase(c, stem))


def osa_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours, no part edited twice."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, last = last, now
    return last[-1]


def osa_column(a: Column, b: Column) -> Column:
    """osa_distance of two short texts as a Column, without Python: rows of the matrix folded over the first text's places."""
    n, m = F.length(a), F.length(b)
    at = lambda c, i: F.substr(c, i, F.lit(1))

    def row(held: Column, i: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            one, two = held["one"], held["two"]
            swap = F.when((i > 1) & (j > 1) & (at(a, i) == at(b, j - 1)) & (at(a, i - 1) == at(b, j)), F.try_element_at(two, j - 1) + 1)
            best = F.least(F.element_at(one, j + 1) + 1, F.element_at(now, j) + 1, F.element_at(one, j) + (at(a, i) != at(b, j)).cast("int"), swap)
            return F.concat(now, F.array(best))

        return F.struct(held["one"].alias("two"), F.aggregate(F.sequence(F.lit(1), m), F.array(i), cell).alias("one"))

    start = F.struct(F.array().cast("array<int>").alias("two"), F.sequence(F.lit(0), m).alias("one"))
    full = F.aggregate(F.sequence(F.lit(1), n), start, row, lambda held: F.element_at(held["one"], -1))
    return F.when(n == 0, m).when(m == 0, n).otherwise(full)


@F.pandas_udf(T.IntegerType())
def osa(a: pd.Series, b: pd.Series) -> pd.Series:
    """osa_distance of two text columns; null if either is."""
    return pd.Series([None if x is None or y is None else osa_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def inverse_document_frequency(df: DataFrame, token_lists: Column) -> DataFrame:
    """token, df and idf over all documents (T16): one count of rows, one count per token."""
    total = df.count()
    counts = df.select(F.explode(F.array_distinct(token_lists)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return counts.select("token", "df", F.ln(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
