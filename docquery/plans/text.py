"""Text analysis and relevance queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquery.functions import text as tx
from docquery.operators import fuzzy, postings as ix, relevance as r, search as s
from docquery.plans.registry import ORACLES, query, spread_table
from docquery.session import shared_dir

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
#: Analysis without stemming, as SQL over documents.
_TOKENS = rf"""toks AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '''s([^0-9A-Za-z_]|$)', '\1', 'g'), '''([0-9A-Za-z_])', '\1', 'g'), '[^0-9A-Za-z_]+', ' ', 'g'), ' '), lambda x: lower(x)),
    lambda x: length(x) > 1 AND x NOT IN ({_STOP}) AND NOT regexp_matches(x, '^([0-9][0-9_]*e?[0-9]*|inf|infinity|nan)$')) AS t FROM documents)"""


@query(
    "analyze_tokens",
    rf"""WITH {_TOKENS}, grams AS (
       SELECT doc_id, len(t) AS n, list_distinct(t || list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' ')) || list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS g FROM toks)
       SELECT doc_id, CAST(n AS INT) AS n_tokens, CAST(len(g) AS INT) AS n_grams FROM grams""",
)
def analyze_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T4 T6-T8 without stems, which SQL cannot express."""
    t = tx.analysed_phrase(F.col("text"), stem=False)
    return spread_table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(tx.gram_hashes(F.col("t"))).alias("n_grams"))


def _kept(x: str, n: int) -> str:
    """SQL for a text without its last n characters."""
    return f"left({x}, greatest(length({x}) - {n}, 0))"


def _ending_sql(x: str, longer_than: int, stem: int, rules) -> str:
    cases = " ".join(f"WHEN ends_with({x}, '{end}') THEN {_kept(x, len(end))} || '{new}'" for end, new in rules)
    return f"CASE WHEN length({x}) > {longer_than} AND regexp_matches({_kept(x, stem)}, '[aeiou]|.y') THEN CASE {cases} ELSE {x} END ELSE {x} END"


#: Stems by one step a table: an ending that went marks the word, and only such words lose a doubled last letter.
_STEMS = rf"""words AS (
  SELECT word, count(*) AS documents FROM (SELECT unnest(list_distinct(list_filter(list_transform(
    regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '''s([^0-9A-Za-z_]|$)', '\1', 'g'), '''([0-9A-Za-z_])', '\1', 'g'), '[^0-9A-Za-z_]+', ' ', 'g'), ' '),
    lambda x: lower(x)), lambda x: x <> ''))) AS word FROM documents) GROUP BY word),
  one AS (SELECT *, CASE WHEN ends_with(word, 'sses') OR ends_with(word, 'ies') THEN {_kept("word", 2)}
    WHEN length(word) > 3 AND ends_with(word, 's') AND NOT ends_with(word, 'ss') THEN {_kept("word", 1)} ELSE word END AS a FROM words),
  two AS (SELECT *, CASE WHEN length(a) < 3 THEN NULL
    WHEN ends_with(a, 'eed') THEN CASE WHEN regexp_matches({_kept("a", 3)}, '[aeiou]|.y') THEN {_kept("a", 1)} END
    WHEN ends_with(a, 'ed') AND regexp_matches({_kept("a", 2)}, '[aeiou]|.y') THEN {_kept("a", 2)}
    WHEN ends_with(a, 'ing') AND regexp_matches({_kept("a", 3)}, '[aeiou]|.y') THEN {_kept("a", 3)} END AS cut FROM one),
  three AS (SELECT *, CASE WHEN cut IS NULL THEN a WHEN length(cut) > 1 AND right(cut, 1) = right({_kept("cut", 1)}, 1) AND right(cut, 1) NOT IN ('l', 's', 'z') THEN {_kept("cut", 1)} ELSE cut END AS b FROM two),
  four AS (SELECT *, {_ending_sql("b", 5, 5, tx._LONG)} AS c FROM three),
  five AS (SELECT *, {_ending_sql("c", 4, 3, [(e, "") for e in tx._SHORT])} AS d FROM four)"""


@query("stemmed_vocabulary", f"WITH {_STEMS} SELECT word, documents, CASE WHEN length(word) < 3 THEN word ELSE d END AS stem FROM five")
def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the stem of every distinct word, and the documents that have it."""
    words = spread_table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(tx.tokens(tx.normalised(F.col("text"))), F.lower))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("documents")).withColumn("stem", F.get(tx.stemmed(F.array("word")), F.lit(0)))


@query(
    "match_score",
    rf"""WITH {_TOKENS}, grams AS (
       SELECT doc_id, list_distinct(t || list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' ')) || list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS g FROM toks),
       hit AS (SELECT doc_id, len(list_intersect(g, ['reer', 'ereaes', 'reer ereaes', 'onor', 'ereaes onor', 'reer ereaes onor'])) AS shared, len(g) AS n FROM grams)
       SELECT doc_id, round(shared * CASE WHEN n > 10 THEN 1 / ln(n + 1.0) ELSE 1 END * 1.5, 8) AS score FROM hit WHERE shared > 0""",
)
def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared n-grams of a three-word query."""
    wanted = r.query_tokens(spark, "Reer, ereaes the onor", stem=False)
    docs = spread_table(spark, sf_dir, "documents").where(r.could_hold(F.col("text"), [w for w in wanted if " " not in w], every=False))
    docs = docs.select("doc_id", tx.analysed_phrase(F.col("text"), stem=False).alias("t"))
    docs = docs.select("doc_id", "t", tx.gram_hashes(F.col("t")).alias("g"))
    return s.matched(docs, r.match_hashed(F.col("g"), wanted, 1.5, F.col("t"))).select("doc_id", F.round("_score", 8).alias("score"))


@query(
    "doc_frequency_idf",
    rf"""WITH {_TOKENS}, d AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM toks) GROUP BY token)
       SELECT token, df, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 8) AS idf FROM d""",
)
def doc_frequency_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16."""
    out = tx.inverse_document_frequency(spread_table(spark, sf_dir, "documents"), tx.analysed_phrase(F.col("text"), stem=False))
    return out.withColumn("idf", F.round("idf", 8))


@query(
    "phrase_exact",
    rf"""WITH {_TOKENS}
       SELECT doc_id, round(2.0 * CASE WHEN len(t) > 10 THEN 1 / ln(len(t) + 1.0) ELSE 1 END * 2.5, 8) AS score FROM toks
       WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'attion' AND t[i + 1] = 'thanedble')) > 0""",
)
def phrase_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11 without slop: two words next to each other, stop words between them dropped."""
    wanted = r.query_tokens(spark, "attion to thanedble", phrase=True, stem=False)
    docs = spread_table(spark, sf_dir, "documents").where(r.could_hold(F.col("text"), wanted)).select("doc_id", tx.analysed_phrase(F.col("text"), stem=False).alias("t"))
    return s.matched(docs, r.phrase(F.col("t"), wanted)).select("doc_id", F.round("_score", 8).alias("score"))


@query(
    "phrase_slop",
    rf"""WITH {_TOKENS}, near AS (
         SELECT doc_id, n, i, q, damerau_levenshtein(w, word) AS d
         FROM (SELECT doc_id, len(t) AS n, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM toks), (VALUES (1, 'attion'), (2, 'anea'), (3, 'eriner')) AS v(q, word)
         WHERE damerau_levenshtein(w, word) <= 1),
       second AS (SELECT a.doc_id, a.n, a.i AS start, a.d AS d1, min(b.i) AS i2, arg_min(b.d, b.i) AS d2
         FROM near a JOIN near b ON a.doc_id = b.doc_id AND a.q = 1 AND b.q = 2 AND b.i > a.i GROUP BY ALL),
       third AS (SELECT a.doc_id, a.n, a.start, a.d1 + a.d2 + arg_min(b.d, b.i) AS fuzz, min(b.i) - a.start - 2 AS slop
         FROM second a JOIN near b ON a.doc_id = b.doc_id AND b.q = 3 AND b.i > a.i2 GROUP BY a.doc_id, a.n, a.start, a.d1, a.d2, a.i2),
       best AS (SELECT doc_id, n, slop, fuzz FROM third WHERE slop <= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY slop, start) = 1)
       SELECT doc_id, round(greatest(1, 3 - slop - fuzz) * CASE WHEN n > 10 THEN 1 / ln(n + 1.0) ELSE 1 END * 2.5 * (1 - slop / 4.0), 8) AS score FROM best""",
)
def phrase_slop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11 T13 with slop and fuzziness."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", tx.analysed_phrase(F.col("text"), stem=False).alias("t"))
    return s.matched(docs, r.phrase(F.col("t"), ["attion", "anea", "eriner"], slop=3, fuzz=1)).select("doc_id", F.round("_score", 8).alias("score"))


@query(
    "fuzzy_match",
    r"""WITH RECURSIVE words AS (
         SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS w FROM documents),
       rows_of AS (
         SELECT DISTINCT w, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT[]) AS above, range(0, 10) AS row FROM words WHERE length(w) BETWEEN 7 AND 11
         UNION ALL
         SELECT w, i + 1, row, list_transform(range(1, 11), lambda j: list_min(list_transform(range(1, j + 1), lambda k: down[k] + j - k)))
         FROM (SELECT w, i, row, list_transform(range(1, 11), lambda j: least(row[j] + 1,
             CASE WHEN j > 1 THEN row[j - 1] + CASE WHEN substr(w, i + 1, 1) = substr('thanedble', j - 1, 1) THEN 0 ELSE 1 END ELSE 99 END,
             CASE WHEN j > 2 AND i > 0 AND substr(w, i + 1, 1) = substr('thanedble', j - 2, 1) AND substr(w, i, 1) = substr('thanedble', j - 1, 1) THEN above[j - 2] + 1 ELSE 99 END)) AS down
           FROM rows_of WHERE i < length(w))),
       edits AS (SELECT w, row[10] AS d FROM rows_of WHERE i = length(w) AND row[10] <= 2)
       SELECT doc_id, max(1 + (2 - d) / 2.0) AS fuzzy_score FROM words JOIN edits USING (w) GROUP BY doc_id""",
)
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word within two edits of the whole value; the SQL fills the table of edits a row at a time."""
    return r.fuzzy_frame(spread_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "Thanedble", 2)


def _indexed(spark: SparkSession, sf_dir: str) -> ix.PostingIndex:
    """An index of all documents, a tenth of which came with other texts at first, beside some that have gone since."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(2).alias("version"), F.lit(False).alias("gone"))
    some = docs.where("doc_id % 10 = 0")
    stale = some.withColumns({"text": F.concat(F.reverse("text"), F.lit(" reer attion thanedble")), "version": F.lit(1)})
    lost = some.withColumns({"doc_id": -1 - F.col("doc_id")})
    index = ix.PostingIndex(shared_dir(spark), version="version", stem=False)
    ix.update(spark, index, docs.where("doc_id % 10 <> 0").unionByName(stale).unionByName(lost), "gone")
    ix.update(spark, index, some.unionByName(lost.withColumns({"version": F.lit(3), "gone": F.lit(True)})), "gone")
    return index


@query("indexed_match", ORACLES["match_score"])
def indexed_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_score from the postings of the query's terms."""
    wanted = r.query_tokens(spark, "Reer, ereaes the onor", stem=False)
    return ix.match(spark, _indexed(spark, sf_dir), wanted, 1.5).withColumn("score", F.round("score", 8))


@query("indexed_phrase", ORACLES["phrase_exact"])
def indexed_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phrase_exact from the positions of the query's terms."""
    wanted = r.query_tokens(spark, "attion to thanedble", phrase=True, stem=False)
    return ix.phrase(spark, _indexed(spark, sf_dir), wanted).withColumn("score", F.round("score", 8))


@query(
    "indexed_frequency",
    rf"""WITH {_TOKENS}, d AS (SELECT v.term, greatest(1, (SELECT count(*) FROM toks WHERE list_contains(t, v.term))) AS df FROM (VALUES ('attion'), ('reer'), ('nosuchword')) v(term))
       SELECT term, df, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 8) AS idf FROM d""",
)
def indexed_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies of a few terms, an unknown one among them."""
    return ix.document_frequency(spark, _indexed(spark, sf_dir), ["attion", "reer", "nosuchword"]).withColumn("idf", F.round("idf", 8))


_FUZZY = ORACLES["fuzzy_match"]
_VALUES = ("thanedble", "eauxereai", "ciondelos")


@query(
    "fuzzy_values",
    " UNION ALL ".join(f"SELECT doc_id, '{v}' AS value, fuzzy_score FROM ({_FUZZY.replace('thanedble', v)}) q{i}" for i, v in enumerate(_VALUES)),
)
def fuzzy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words within two edits of any of several values, met by what deletions leave of both."""
    values = spark.createDataFrame([(v,) for v in _VALUES], "v string")
    return fuzzy.fuzzy_matches(spread_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), values, "v", 2)


@query(
    "full_search",
    rf"""WITH {_TOKENS},
       hit AS (SELECT d.doc_id, d.source, CASE WHEN len(list_filter(range(1, len(t)), lambda i: t[i] = 'attion' AND t[i + 1] = 'thanedble')) > 0 THEN 1 ELSE 0 END AS p,
         CASE WHEN len(t) > 10 THEN 1 / ln(len(t) + 1.0) ELSE 1 END AS f FROM toks JOIN documents d USING (doc_id) WHERE d.lang = 'en')
       SELECT doc_id, source, round(2.0 * f * 2.5 * 3.0, 8) AS score FROM hit WHERE p = 1 AND source <> 'src1' ORDER BY 2.0 * f * 2.5 * 3.0 DESC, doc_id LIMIT 40""",
)
def full_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and phrase, a weight, a post-filter, order by score, a page."""
    from docquery.operators import predicates as p

    docs = spread_table(spark, sf_dir, "documents").withColumn("t", tx.analysed_phrase(F.col("text"), stem=False))
    cond = p.boolean(All=[p.equal(F.col("lang"), "en"), r.phrase(F.col("t"), ["attion", "thanedble"])])
    controls = s.Controls(tiebreak=["doc_id"], limit=40, post_filter=p.not_equal(F.col("source"), "src1"), modifiers=[(F.lit(1.0), 3.0)], source=["doc_id", "source"])
    return s.search([(docs, cond)], controls).hits.select("doc_id", "source", F.round("_score", 8).alias("score"))
