"""Secret scans over a ledger of blobs: a text is scanned once for each version of the rules, whatever paths hold it."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import AtomicType, StructType

from docquery.llm.common import chunks, quoted, shared_dir

#: Kinds in the order in which spans of equal start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "private_key", "web_token", "forge_token", "chat_token", "cloud_key")
BASE = KINDS[:3]

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
#: Characters of the value, or of the match, from which the base kinds count.
_LEAST = {"assign": 12, "access": 18, "hex": 16}
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_CLASS = bytes(104 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
#: What the ledger's rules find beside the base: a literal that every match has, and the pattern.
_MORE = {
    "private_key": (b"PRIVATE KEY", re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")),
    "web_token": (b"eyJ", re.compile(rb"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "forge_token": (b"gh", re.compile(rb"gh[opsu]_[A-Za-z0-9]{36,}")),
    "chat_token": (b"xox", re.compile(rb"xox[abprs]-[A-Za-z0-9-]{10,}")),
    "cloud_key": (b"AIza", re.compile(rb"AIza[A-Za-z0-9_-]{35}")),
}
#: Parts that the rows of one blob are joined with its findings in.
PARTS = 8


def rules_version() -> str:
    """A name for what is scanned for: it changes whenever a pattern or a least length does."""
    patterns = [*zip(BASE, (_ASSIGN, _ACCESS, _HEX), strict=True), *((k, p) for k, (_, p) in _MORE.items())]
    told = repr([(k, p.pattern, p.flags, _LEAST.get(k)) for k, p in patterns])
    return hashlib.sha256(told.encode()).hexdigest()[:16]


RULES_VERSION = rules_version()


def find(text: bytes) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of every secret in bytes, sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _LEAST["assign"]]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST["access"]]
    if b"h" * _LEAST["hex"] in text.translate(_HEX_CLASS):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= _LEAST["hex"]]
    for kind, (literal, pattern) in _MORE.items():
        if literal in text:
            found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def spans_of(text: bytes) -> list[dict]:
    """find() in code points."""
    found, out = find(text), []
    points = {0: 0}
    at = total = 0
    for place in sorted({p for a, _, b in found for p in (a, b)}):
        total += len(text[at:place].decode("utf-8", "replace"))
        at, points[place] = place, total
    for a, kind, b in found:
        out.append({"kind": KINDS[kind], "start": points[a], "end": points[b]})
    return out


def scan(documents: DataFrame, text: str = "text", ledger: str | None = None, version: str = RULES_VERSION) -> DataFrame:
    """documents with blob (SHA-256 of the text) and spans (kind, start, end in code points, end exclusive).

    The ledger is a Parquet folder of (blob, spans), one folder a version of the rules, which by default follows from the
    rules themselves. Only blobs that it does not hold for this version are scanned, each once, and appended; a later call
    with the same ledger scans only what is new. Without a ledger the call has one of its own in the shared folder. A null
    text is the empty one. Rows come back as often as they were given; a column named blob or spans is replaced. A killed
    append leaves nothing behind that readers see; an append that is run twice, or by two calls at once, leaves equal rows,
    which count once.
    """
    spark = documents.sparkSession
    path = ledger or f"{shared_dir(spark)}/ledger"
    blob = F.unhex(F.sha2(F.coalesce(quoted(text), F.lit("")).cast("binary"), 256))
    rest = [c for c in documents.columns if c.lower() not in ("blob", "spans")]
    held = documents.select(blob.alias("blob"), F.coalesce(quoted(text), F.lit("")).cast("binary").alias("t"))
    if ledger is not None and (known := _ledger(spark, path, version)) is not None:
        held = held.join(known.select("blob").distinct(), "blob", "left_anti")
    schema = StructType.fromDDL("blob binary, spans array<struct<kind: string, start: long, end: long>>")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0).cast(arrow.field(0).type), pa.array([spans_of(t) for t in part.column(1).to_pylist()], arrow.field(1).type)], schema=arrow)

    new = held.groupBy("blob").agg(F.first("t").alias("t")).mapInArrow(run, schema)
    new.select("blob", F.lit(version).alias("version"), "spans").write.mode("append").partitionBy("version").parquet(path)
    found = _ledger(spark, path, version)
    found = spark.createDataFrame([], schema) if found is None else found
    # The rows of one blob, which can be a third of all, are joined in PARTS parts.
    findings = found.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    told = [quoted(f.name) for f in documents.schema if isinstance(f.dataType, AtomicType) and f.name in rest and f.name != text]
    part = F.pmod(F.xxhash64(*told), F.lit(PARTS)) if told else F.lit(0)
    rows = documents.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(rest)], blob.alias("blob"), part.cast("int").alias("part"))
    back = rows.join(findings, ["blob", "part"], "left")
    return back.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(rest)], "blob", F.coalesce("spans", F.array().cast(schema["spans"].dataType)).alias("spans"))


def history(versions: DataFrame, ledger: str | None = None, path: str = "path", revision: str = "revision", text: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """path, revision, blob, kind, start and end of every secret in every historical version of every path.

    versions has a row for each path and revision with its text; blobs that many paths or revisions share are scanned once,
    and their findings come back to all of them. A path or revision may be null; rows come back as often as they were given.
    """
    rows = versions.select(quoted(path).alias("path"), quoted(revision).alias("revision"), quoted(text).alias("text"))
    return scan(rows, ledger=ledger, version=version).select("path", "revision", "blob", F.inline("spans"))


def _ledger(spark, path: str, version: str) -> DataFrame | None:
    """What the ledger holds for a version, None if there is no such folder yet."""
    try:
        return spark.read.schema("blob binary, spans array<struct<kind: string, start: long, end: long>>").parquet(f"{path}/version={version}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def listed(spans):
    """kind:start:end of each, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the operator's."""

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE)).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redacted(text, spans):
    """The text with every span, overlapping ones as one, replaced by [SECRET]: both are columns."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))))
    start = F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(
        ordered,
        start,
        lambda acc, x: F.struct(
            F.when(x["a"] >= acc["at"], F.concat(acc["s"], F.substring(text, acc["at"] + 1, x["a"] - acc["at"]), F.lit("[SECRET]"))).otherwise(acc["s"]).alias("s"),
            F.greatest(acc["at"], x["b"]).alias("at"),
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(done["s"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
