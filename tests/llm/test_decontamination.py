import hashlib
import re

from docquery.llm import decontamination as d
from tests.llm.helpers import AWKWARD, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, size=10):
    w, hit, found = WORD.findall(lowered(text)), set(), set()
    for item, t in items:
        x = WORD.findall(lowered(t))
        k = min(size, len(x))
        if not k or item is None:
            continue
        windows = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def check(spark, docs, bench, **options):
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {tuple(r)[:6] for r in d.digest(d.decontaminate(docs, bench, keep=["doc_id"], **options)).collect()}
    assert got == {(r.doc_id, *brute(r.text, items)) for r in docs.collect()}
    return got


def test_tables(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert any(r[5] for r in check(spark, docs, bench))


def test_awkward_rows_and_blocks(spark):
    item = "One two, three four five six seven eight nine ten eleven É twelve"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "short Item"), (10, item), (None, "same"), (4, None), (5, ""), (6, "xyz")], "item_id long, text string")
    docs = documents(spark, [*AWKWARD, "x " + item.upper().replace("É", "É") + " y", "a SHORT item, short item item", "short", "xyz xyz", item[:30]])
    check(spark, docs, bench)
    check(spark, docs, bench, block_bytes=40)
    check(spark, docs, bench.limit(0))
    assert d.decontaminate(docs.limit(0), bench).count() == 0
    assert d.decontaminate(docs, bench).columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "n_words", "n_hit", "hits", "item_ids"]


def test_blocks_of_a_large_benchmark(spark):
    """Runs that touch across blocks merge, copies of one text each have their row, and kept names may clash."""
    text = " ".join(f"w{i}" for i in range(60))
    bench = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 11))) for i in range(16)], "item_id long, text string")
    docs = documents(spark, [text, text, text[40:], None, "", "w1 w2", "x " + text])
    check(spark, docs, bench, block_bytes=120)
    clash = docs.selectExpr("doc_id", "text", "1 as _key0", "2 as _hits0", "'a' as hits", "'b' as N_WORDS")
    one, many = (d.decontaminate(clash, bench, block_bytes=b) for b in (1 << 20, 120))
    assert one.columns == many.columns == ["doc_id", "text", "_key0", "_hits0", "n_words", "n_hit", "hits", "item_ids"]
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert many.count() == docs.count()
