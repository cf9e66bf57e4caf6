"""Words near many values at once by keys of deletions: an equi-join, then the exact distance on what it leaves.

If two words are at most k edits apart (swaps of neighbours count as one), their first PREFIX characters have a text in common
that is left when at most k of them are deleted from each: what is inserted, deleted, replaced or swapped before that place
can be deleted on both sides, and what an insertion pushes over it, at its end. So words and values meet by these texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docquery.functions.fields import spare
from docquery.functions.text import osa_column
from docquery.operators.relevance import words

#: Characters that deletions are made of: a word has at most 1 + 7 + 21 + 35 keys for three edits, however long it is.
PREFIX = 7


def deletions(word: Column, edits: int, prefix: int = PREFIX) -> Column:
    """The distinct texts that are left of a word's first characters when up to so many are deleted."""
    def shorter(x: Column) -> Column:
        return F.when(F.length(x) == 0, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1))))

    start = F.array(F.left(word, F.lit(prefix)))
    step = lambda held: F.array_distinct(F.concat(held, F.flatten(F.transform(held, shorter))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(edits)), start, lambda held, _: step(held)) if edits else start


def near_values(vocabulary: DataFrame, word: str, values: DataFrame, value: str, edits: int, prefix: int = PREFIX) -> DataFrame:
    """(word, value, distance) of all pairs of distinct words and values at most so many edits apart; nulls have none.

    Pairs that meet under several keys count once, and the distance is taken only of pairs whose lengths allow it.
    """
    keyed = lambda df, c, name: df.where(F.col(c).isNotNull()).select(F.col(c).alias(name)).distinct().select(name, F.explode(deletions(F.col(name), edits, prefix)).alias("_key"))
    met = keyed(vocabulary, word, "word").join(keyed(values, value, "value"), "_key").where(F.abs(F.length("word") - F.length("value")) <= edits)
    pairs = met.select("word", "value").distinct()
    return pairs.withColumn("distance", osa_column(F.col("word"), F.col("value"))).where(F.col("distance") <= edits)


def fuzzy_matches(df: DataFrame, key: str, text: Column, values: DataFrame, value: str, fuzziness: int, boost: float = 1.0) -> DataFrame:
    """(key, value, fuzzy_score) of rows with a word within fuzziness edits of a value, for all values at once.

    Each distinct word of the table meets the values once. At fuzziness 0 an equal word scores 0, as with one value.
    """
    own = spare("_w", df)
    held = df.select(F.col(key), F.explode(F.array_distinct(words(text))).alias(own))
    asked = values.select(F.lower(value).alias("_low"), F.col(value).alias("value")).distinct()
    near = near_values(held, own, asked, "_low", fuzziness)
    score = (1 + (fuzziness - F.col("distance")) / fuzziness) * boost if fuzziness else F.lit(0.0)
    found = near.select(F.col("word").alias(own), F.col("value").alias("_low"), score.alias("score")).join(asked, "_low")
    return held.join(found, own).groupBy(key, "value").agg(F.max("score").alias("fuzzy_score"))
