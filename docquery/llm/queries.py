"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docquery.llm import decontamination, html, jaccard, language, negatives, packing, quality, rules, secrets, spelling, suffixes, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


@query(
    "op1_decontamination",
    r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
pats AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM pats),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, ks WHERE len(w) >= k)),
found AS (SELECT g.doc_id, g.k, g.i, p.item_id FROM grams g JOIN pats p ON g.k = p.k AND g.p = p.p),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(len(w.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in any ten-word window of a benchmark item."""
    return decontamination.digest(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 4096 tokens, packed into sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op8_secrets")
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each distinct text scanned once."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(
    "op2_jaccard_join",
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM words WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(r.m, w.doc_id)) AS component_id
FROM words w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = w.doc_id""",
)
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose four-word shingle sets have a Jaccard similarity of 0.85 or more, as connected classes."""
    return jaccard.components(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules, and the learned decision list."""
    documents = table(spark, sf_dir, "documents")
    return rules.apply(documents, rules.fit(documents, table(spark, sf_dir, "labels")), keep=["doc_id"])


@query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by hashed word n-grams."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by hyperdimensional profiles."""
    return language.predicted(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a weighted lexicon."""
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")


@query(
    "op7_url_filter",
    r"""
WITH RECURSIVE parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block' END AS ruled FROM (
    SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS p, CASE
      WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed) x),
segs AS (SELECT page_id, host, path, rule, ruled, coalesce(regexp_replace(p[1], '[0-9]+', '*', 'g'), '') AS s0, coalesce(regexp_replace(p[2], '[0-9]+', '*', 'g'), '') AS s1, coalesce(regexp_replace(p[3], '[0-9]+', '*', 'g'), '') AS s2, coalesce(regexp_replace(p[4], '[0-9]+', '*', 'g'), '') AS s3, CASE WHEN len(p) > 4 THEN '**' ELSE '' END AS s4 FROM ruled),
counted AS (SELECT host, s0, s1, s2, s3, s4, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS b FROM segs GROUP BY ALL),
c0 AS (SELECT host, count(DISTINCT s0) AS children FROM counted GROUP BY host),
l0 AS (SELECT counted.*, CASE WHEN children > 8 AND s0 <> '' THEN '*' ELSE s0 END AS t0 FROM counted JOIN c0 USING (host)),
c1 AS (SELECT host, t0, count(DISTINCT s1) AS children FROM l0 GROUP BY host, t0),
l1 AS (SELECT l0.*, CASE WHEN children > 8 AND s1 <> '' THEN '*' ELSE s1 END AS t1 FROM l0 JOIN c1 USING (host, t0)),
c2 AS (SELECT host, t0, t1, count(DISTINCT s2) AS children FROM l1 GROUP BY host, t0, t1),
l2 AS (SELECT l1.*, CASE WHEN children > 8 AND s2 <> '' THEN '*' ELSE s2 END AS t2 FROM l1 JOIN c2 USING (host, t0, t1)),
c3 AS (SELECT host, t0, t1, t2, count(DISTINCT s3) AS children FROM l2 GROUP BY host, t0, t1, t2),
l3 AS (SELECT l2.*, CASE WHEN children > 8 AND s3 <> '' THEN '*' ELSE s3 END AS t3 FROM l2 JOIN c3 USING (host, t0, t1, t2)),
c4 AS (SELECT host, t0, t1, t2, t3, count(DISTINCT s4) AS children FROM l3 GROUP BY host, t0, t1, t2, t3),
l4 AS (SELECT l3.*, CASE WHEN children > 8 AND s4 <> '' THEN '*' ELSE s4 END AS t4 FROM l3 JOIN c4 USING (host, t0, t1, t2, t3)),
tree AS (SELECT *, concat_ws('/', nullif(t0, ''), nullif(t1, ''), nullif(t2, ''), nullif(t3, ''), nullif(t4, '')) AS template FROM l4),
leaves AS (SELECT host, template, sum(n) AS n, sum(b) AS b FROM tree GROUP BY ALL),
hosts AS (SELECT host, sum(n) AS hn, sum(b) / nullif(sum(n), 0) AS share FROM leaves GROUP BY host),
close AS (SELECT leaves.*, n > 0 AND abs(b - n * share) <= 1.96 * sqrt(n * share * (1 - share)) + 0.5 AS alike FROM leaves JOIN hosts USING (host)),
merged AS (SELECT host, sum(n) AS mn, sum(b) AS mb FROM close WHERE alike GROUP BY host),
prior AS (SELECT coalesce(sum(b) / nullif(sum(n), 0), 0) AS p FROM counted),
judged AS (
  SELECT host, template, (CASE WHEN alike THEN mb ELSE b END + 4.0::DOUBLE * p) / (CASE WHEN alike THEN mn ELSE n END + 4.0::DOUBLE) AS purity,
    CASE WHEN alike THEN mn ELSE n END > 0 AND CASE WHEN alike THEN mb ELSE b END >= 0.6 * CASE WHEN alike THEN mn ELSE n END AS shown
  FROM close LEFT JOIN merged USING (host), prior),
ways AS (
  SELECT host, template, n, b, depth, i, array_to_string(step[1:i], '/') AS node, array_to_string(step[1:i - 1], '/') AS above
  FROM (SELECT *, len(step) AS depth, unnest(range(0, len(step) + 1)) AS i FROM (SELECT *, list_filter(string_split(template, '/'), lambda x: x <> '') AS step FROM leaves) x) y),
nodes AS (SELECT host, node, any_value(above) AS above, i, sum(n) AS n, sum(b) AS b FROM ways GROUP BY host, node, i),
branches AS (SELECT host, above AS node, sum(b / n) AS shares, count(*) AS branches FROM nodes WHERE i > 0 AND n > 0 GROUP BY host, above),
fair AS (SELECT least(coalesce(avg(share), 0), PRIOR_MOST) AS p FROM hosts WHERE hn > 0),
walk(host, template, depth, i, m) AS (
  SELECT host, template, depth, 0::BIGINT, CAST(p AS DOUBLE) FROM ways, fair WHERE i = 0
  UNION ALL
  SELECT w.host, w.template, w.depth, w.i + 1, (coalesce(shares, 0) + PRIOR_BRANCHES * m) / (coalesce(branches, 0) + PRIOR_BRANCHES)
  FROM walk w JOIN ways y ON y.host = w.host AND y.template = w.template AND y.i = w.i LEFT JOIN branches r ON r.host = w.host AND r.node = y.node WHERE w.i < w.depth),
near AS (SELECT host, template, arg_max(o.b / o.n, o.i) FILTER (o.n > 0) AS near FROM ways JOIN nodes o USING (host, node, i) GROUP BY host, template),
above AS (
  SELECT host, template, (b + 4.0::DOUBLE * m) / (n + 4.0::DOUBLE) >= 0.6 AND coalesce(near >= 0.6, false) AS above
  FROM walk JOIN leaves USING (host, template) JOIN near USING (host, template) WHERE i = depth)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= 0.6 AND shown OR above THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
FROM segs JOIN tree USING (host, s0, s1, s2, s3, s4) JOIN judged USING (host, template) JOIN above USING (host, template)""".replace("PRIOR_MOST", str(urls.PRIOR_MOST)).replace("PRIOR_BRANCHES", f"{float(urls.PRIOR_BRANCHES)}::DOUBLE"),
)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url by rules and by path templates."""
    return urls.judge(table(spark, sf_dir, "pages")).drop("expected")


@query(
    "op11_suffix_dedup",
    """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT r, i, md5(b[i:i + 199]) AS w FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d)),
hit AS (SELECT r, i FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
marked AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit),
spans AS (SELECT r, min(i) AS a, max(i) + 199 AS z FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM marked) x GROUP BY r, g),
before AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS y FROM spans),
cut AS (
  SELECT r, sum(z - a + 1) AS n_removed, count(*) AS n_spans, max(z) AS z, string_agg(CASE WHEN a > y + 1 THEN hex(b[y + 1:a - 1]) ELSE '' END, '' ORDER BY a) AS h
  FROM before JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN cut.r IS NULL THEN sha256(b) ELSE sha256(unhex(concat(h, CASE WHEN z < octet_length(b) THEN hex(b[z + 1:octet_length(b)]) ELSE '' END))) END AS kept_sha256
FROM d LEFT JOIN cut USING (r)""",
)
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that also stand elsewhere."""
    return suffixes.digested(suffixes.without_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"]))


@query(
    "op12_hard_negatives",
    """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5""",
)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score nearly as much as the first ones of an anchor's label."""
    return negatives.mine(table(spark, sf_dir, "embeddings"))


@query(
    "op13_spelling_variants",
    """
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)),
per AS (SELECT doc_id, r, count(*) AS c, hex(encode(concat(doc_id, ':', r))) AS b FROM runs WHERE length(r) >= 6 GROUP BY doc_id, r),
crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, (c & 1) * 3988292384), b)) AS t),
hashed AS (
  SELECT r, c, xor(4294967295, list_reduce(range(len(b) // 2), lambda h, i: xor(h >> 8, t[xor(h & 255, strpos('0123456789ABCDEF', b[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', b[2 * i + 2]) - 17) + 1]), 4294967295)) AS h
  FROM per, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN concat(r[1:h % length(r)], r[h % length(r) + 2:]) ELSE r END AS word, c FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
gaps AS (SELECT word, n, length(word) AS k, i, concat(word[1:i - 1], word[i + 1:]) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.k = b.k AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= 5 * v.n THEN best.m END AS form_n,
    CASE WHEN best.m >= 5 * v.n THEN (SELECT min(other) FROM near x WHERE x.word = v.word AND x.m = best.m) END AS form
  FROM v LEFT JOIN best USING (word)),
walk(word, last) AS (SELECT word, word FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.last AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN walk w ON w.word = f.word JOIN formed e ON e.word = w.last AND e.form IS NULL""",
)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent ones that they are one edit away from."""
    return spelling.variants(table(spark, sf_dir, "documents"))
