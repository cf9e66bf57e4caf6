"""The pipeline's stages against plain versions, each on what the one before it kept."""

import corpus_pipeline as cp
from docquery.llm import quality
from docquery.llm.common import written
from tests.llm import test_decontamination, test_jaccard, test_packing, test_secrets
from tests.llm.helpers import AWKWARD, documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(cp.STAGES)
    assert list(steps) == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]

    good = written(steps["quality_classifier"](spark, docs, sf), "good")
    judged = quality.judged(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(good) == ids(judged.where("predicted = 1")) and good.columns == COLUMNS

    one = written(steps["ngram_jaccard_join"](spark, good, sf), "one")
    want = test_jaccard.brute([(r.doc_id, r.text) for r in good.collect()], 5, 80, 100)
    assert ids(one) == sorted({c for _, _, c in want}) and one.columns == COLUMNS

    clean = written(steps["benchmark_decontamination"](spark, one, sf), "clean")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids(clean) == sorted(r.doc_id for r in one.collect() if not test_decontamination.brute(r.text, items)[4])

    safe = written(steps["secret_scans"](spark, clean, sf), "safe")
    assert ids(safe) == ids(clean) and safe.columns == COLUMNS
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in safe.collect():
        had = sum(test_secrets.brute(before[r.doc_id])[:3])
        assert ("[SECRET]" in r.text) == bool(had) and not sum(test_secrets.brute(r.text)[:3]) and r.n_chars == len(r.text)

    test_packing.check(safe, steps["best_fit_packing"](spark, safe, sf).collect())
    assert cp.run(spark, sf).count() == steps["best_fit_packing"](spark, safe, sf).count()


def test_awkward_rows(spark, sf):
    docs = documents(spark, AWKWARD).select(*COLUMNS)
    docs = docs.unionByName(docs.limit(6)).unionByName(spark.createDataFrame([(None, "no id at all, yet a text"), (None, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS lang", "'s' AS source", "0L AS n_chars"))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == COLUMNS and stage(spark, docs.limit(0), sf).count() == 0, name
        if name == "ngram_jaccard_join":
            assert sorted(ids(out.where("doc_id is not null"))) == [0, 1, 2, 3, 4, 5, 7, 8] and out.where("doc_id is null").count() == 2
        out.count()


def test_rows_of_one_id_with_other_texts_stay(spark, sf):
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(7, "alpha beta gamma delta epsilon zeta"), (7, near), (7, near), (8, near + " more"), (7, near + " more"), (9, "quite another text with words of its own")]
    docs = spark.createDataFrame([(i, t, "x", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = sorted((r.doc_id, r.text) for r in dict(cp.STAGES)["ngram_jaccard_join"](spark, docs, sf).collect())
    assert len(out) == 3 and out[0] == rows[0] and out[2] == rows[5] and out[1][0] == 7 and out[1][1] in (near, near + " more")
