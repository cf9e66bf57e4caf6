"""Indexes with snapshots, versions merged in and over changes, and stream state by batch."""

import datetime as dt
import itertools
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docquery.operators import entities as e
from docquery.sources import snapshots as sn
from docquery.streaming import jobs as streams

SCHEMA = "id int, k string, v int, gone boolean"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def put(spark, index, rows, **how):
    return sn.commit(spark, index, spark.createDataFrame(rows, SCHEMA), "gone", **how)


def test_versions_win_in_any_order(spark, tmp_path):
    """Twice in one change, an older one late, deleted and brought back: each order of the changes ends alike."""
    changes = [[(1, "a", 1, False), (1, "b", 3, False), (2, "a", 1, False), (4, "a", 1, False)], [(1, "a", 2, False), (2, None, 5, True), (3, "a", 1, False)], [(2, "a", 4, False), (3, None, 2, True), (3, "c", 3, False), (None, "a", 9, False), (5, None, 1, False)]]
    ends = []
    for n, order in enumerate(list(itertools.permutations(changes))[::3]):
        index = sn.SnapshotIndex(str(tmp_path / str(n)), partition="k", version="v")
        for rows in order:
            put(spark, index, rows)
        ends.append(rows_of(sn.read(spark, index), "id", "k", "v"))
    assert ends == [[(1, "b", 3), (3, "c", 3), (4, "a", 1)]] * 2


def test_readers_keep_their_snapshot_and_emptied_parts_have_no_file(spark, tmp_path):
    index = sn.SnapshotIndex(str(tmp_path / "i"), partition="k", version="v")
    with pytest.raises(ValueError):
        sn.read(spark, index)
    assert put(spark, index, [(1, "a:x", 1, False), (2, "b", 1, False), (3, "b", 1, False)]) == 1
    reader = sn.read(spark, index)
    assert put(spark, index, [(1, "b", 2, False), (2, None, 2, True)]) == 2
    assert rows_of(reader, "id", "k") == [(1, "a:x"), (2, "b"), (3, "b")]  # opened before the change
    assert rows_of(sn.read(spark, index), "id", "k") == [(1, "b"), (3, "b")]
    assert rows_of(sn.read(spark, index, at=1, composite="a:x"), "id") == [(1,)] and rows_of(sn.read(spark, index, composite="a:x")) == []
    live = spark.read.parquet(f"{index.path}/manifest").where("version = 2 and _part is not null")
    assert rows_of(live.where("_part not like 'd:%'"), "_part", "rows") == [("k:b", 2)]
    assert sn.unreferenced(spark, index, 2).count() == 0 and sn.unreferenced(spark, index, 1).count() == 1
    folder = next(Path(index.path, "data").glob(f"commit={rows_of(live, 'commit')[0][0]}/*b"))
    assert len(list(folder.glob("*.parquet"))) == 1  # what two changes wrote to b is one file


def test_replays_change_nothing(spark, tmp_path):
    index = sn.SnapshotIndex(str(tmp_path / "i"), partition="k", version="v")
    rows = [(1, "a", 1, False), (2, "a", 1, True)]
    assert put(spark, index, rows, source="s", batch=7) == 1
    assert put(spark, index, rows) == 1  # the same rows
    assert put(spark, index, [(1, "z", 9, False)], source="s", batch=7) == 1  # a batch that was committed
    assert put(spark, index, [(1, "z", 9, False)], source="other", batch=7) == 2
    assert sn.versions(spark, index) == [1, 2]
    with pytest.raises(ValueError):
        sn.commit(spark, index, spark.createDataFrame([(1, "a", 1, 0)], "id int, k string, v int, commit int"))


def test_without_versions_later_changes_count(spark, tmp_path):
    index = sn.SnapshotIndex(str(tmp_path / "i"), partition="k")
    put(spark, index, [(1, "a", 5, False), (2, "a", 5, False)])
    put(spark, index, [(1, "a", 4, False), (2, None, 0, True)])
    assert rows_of(sn.read(spark, index), "id", "v") == [(1, 4)]
    put(spark, index, [(2, "a", 3, False)])
    assert rows_of(sn.read(spark, index), "id", "v") == [(1, 4), (2, 3)]


def test_few_parts_of_many_keys_are_broadcast(spark, tmp_path, monkeypatch):
    """By a shuffle on the part all rows of a part would be one task's; the hash that is kept is the row's own."""
    monkeypatch.setattr(sn, "BROADCAST_KEYS", 4)
    sent = []
    monkeypatch.setattr(sn.F, "broadcast", lambda df, keep=F.broadcast: sent.append(df.columns) or keep(df))
    index = sn.SnapshotIndex(str(tmp_path / "i"), partition="k", version="v")
    put(spark, index, [(i, "ab"[i % 2], 1, False) for i in range(20)])
    put(spark, index, [(i, "a", 2, False) for i in range(10)])
    assert ["_part"] in sent and ["id"] not in sent
    assert rows_of(sn.read(spark, index), "id", "k", "v") == sorted([(i, "a", 2) if i < 10 else (i, "ab"[i % 2], 1) for i in range(20)], key=str)
    kept = spark.read.parquet(f"{index.path}/data").select("id", "k", "v", "_hash")
    assert kept.where(F.col("_hash") != e.row_hash(kept.drop("_hash"))).count() == 0 and kept.where("_hash is null").count() == 0


def test_stream_of_versions(spark, tmp_path):
    index = sn.SnapshotIndex(str(tmp_path / "i"), partition="k", version="v")
    for rows in ([(1, "a", 1, False), (1, "b", 2, False)], [(1, None, 5, True)], [(1, "a", 4, False), (2, "a", 1, False)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streams.snapshot_changes(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), index, str(tmp_path / "state"), deleted="gone")
    assert rows_of(sn.read(spark, index), "id", "k") == [(2, "a")]


def test_plain_index_takes_one_row_a_key(spark, tmp_path):
    place = {n: str(tmp_path / n) for n in ("in", "out", "state")}
    spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (2, "a", 1, False), (2, None, 3, True)], SCHEMA).write.parquet(place["in"])
    streams.index_changes(spark.readStream.schema(SCHEMA).parquet(place["in"]), place["out"], place["state"], "id", "k", deleted="gone", version="v")
    assert rows_of(e.read_index(spark, place["out"]), "id", F.col("k").cast("string"), "v") == [(1, "b", 2)]
    twice = spark.createDataFrame([(7, "x", 1), (7, "y", 1)], "id int, k string, v int")
    e.write_changed(spark.createDataFrame([], twice.schema), twice, "id", "k", str(tmp_path / "w"))
    assert e.read_index(spark, str(tmp_path / "w")).count() == 1


def test_maps_hash_by_their_entries(spark):
    df = spark.sql("select map('a', map(1, 'x', 2, 'y'), 'b', map()) as m, array(named_struct('q', map('k', 1, 'l', 2))) as s union all select map('b', map(), 'a', map(2, 'y', 1, 'x')), array(named_struct('q', map('l', 2, 'k', 1)))")
    assert df.select(e.row_hash(df)).distinct().count() == 1
    other = spark.sql("select map('a', map(1, 'x'), 'b', map()) as m, array(named_struct('q', map('k', 1, 'l', 2))) as s")
    assert df.union(other).select(e.row_hash(other)).distinct().count() == 2


def test_lines_of_a_batch_make_one_record(spark, tmp_path):
    """Whatever their order, the micro-batch they come in and the minutes between them."""
    at = lambda minute, second=0: dt.datetime(2024, 1, 1, 12, minute, second)
    first, second = "REPORT RequestId: {} Duration: 3000 ms Memory Size: 512 MB", "REPORT RequestId: {} X-A-REGIONS: r,q X-A-INTENSITIES: 10,20 X-A-REGION: r"
    days = dt.datetime(2024, 1, 3)
    batches = [
        [(at(0), 1, 0, first.format("one")), (at(9, 30), 2, 1, second.format("two")), (at(5), 3, 0, first.format("three")), (at(5), 3, 1, second.format("three"))],
        [(at(8), 1, 1, second.format("one")), (at(2), 2, 0, first.format("two")), (at(5), 3, 1, second.format("three"))],
        [(days, 9, 0, "REPORT")],
    ]
    schema = "ts timestamp, batch_id int, line_no int, message string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        lines = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = streams.run_available(streams.carbon_records(lines, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows_of(out, "request_id", "region", "called", "duration", "intensity") == sorted([(n, r, r == "r", 3000, i) for n in ("one", "two", "three") for r, i in (("r", 10), ("q", 20))], key=str)
    assert rows_of(out.select("request_id", "ts").distinct()) == [("one", at(0)), ("three", at(5)), ("two", at(2))]


def test_open_calls_are_kept_on_disk_and_only_what_is_returned_is_looked_for(spark, sf, tmp_path, monkeypatch):
    """A stream of many open calls has its state in RocksDB; the session's settings stay, and columns that no one uses are not made."""
    from docquery.operators import carbon as c
    from docquery.plans.catalogue import QUERIES

    lines = spark.createDataFrame([("REPORT",)], "message string").selectExpr("1 as batch_id", "0 as line_no", "message")
    plan = c.parsed_lines(lines).select("region")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 1 and "regexp_extract_all(" not in plan
    key, ran, run = "spark.sql.streaming.stateStore.providerClass", [], streams.run_available
    before = spark.conf.get(key, None)
    monkeypatch.setattr(streams, "run_available", lambda df, path, state, **kw: (ran.append((df.columns, state)), run(df, path, state, **kw))[1])
    out = QUERIES["stream_carbon_records"](spark, sf)
    (columns, state), = ran
    assert columns == out.columns == ["request_id", "region", "called", "electricity", "carbon"]
    kept = [x.name for x in Path(state).glob("state/0/*/*")]
    assert any(x.endswith(".zip") for x in kept) and not any(x.endswith(".delta") for x in kept)
    assert spark.conf.get(key, None) == before
