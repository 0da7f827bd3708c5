"""Cell checks, duplicates, insert-only load, registry, ledger, sink."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskpanel.functions.frames import GuardError
from riskpanel.operators import ingest
from riskpanel.sources import tables

CELLS = [
    ("7", None), (" 7 ", None), ("1e3", None), ("-2147483648", None), ("2147483647", None), ("3.0", None),
    ("", ingest.MISSING), (None, ingest.MISSING), ("n/a", ingest.NON_NUMERIC), (" ", ingest.NON_NUMERIC),
    ("NaN", ingest.NON_NUMERIC), ("Infinity", ingest.NON_NUMERIC), ("7d", ingest.NON_NUMERIC), ("0x1F", ingest.NON_NUMERIC),
    ("1.5", ingest.NON_INTEGRAL), ("1e-3", ingest.NON_INTEGRAL), ("2147483648", ingest.OUT_OF_RANGE),
    ("-2147483649", ingest.OUT_OF_RANGE), ("1e300", ingest.OUT_OF_RANGE), ("1e400", ingest.OUT_OF_RANGE),
]


def test_reject_reasons(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CELLS)], "row_no bigint, a string")
    found = {r.row_no: r.reason for r in ingest.reject_cells(df, ["a"]).collect()}
    assert found == {i: reason for i, (_, reason) in enumerate(CELLS) if reason}
    parsed = {r.row_no: r.a for r in ingest.parsed(df, ["a"]).collect()}
    assert parsed == {0: 7, 1: 7, 2: 1000, 3: -2147483648, 4: 2147483647, 5: 3}


@pytest.fixture()
def cells(spark):
    rows = [(1, "10", "1"), (2, "10", "2"), (3, "x", "3"), (4, "11", "1.5"), (5, "10", "5"), (6, "12", "6"), (7, "", "")]
    return spark.createDataFrame(rows, "row_no bigint, id string, a string")


def test_duplicates_only_among_parsed_rows(cells):
    parsed = ingest.parsed(cells, ["id", "a"])
    for share in (None, 1e-9):  # plain, and every repeated key treated as hot
        got = ingest.reject_duplicates(parsed, "id", share=share).collect()
        assert sorted((r.row_no, r.raw_value) for r in got) == [(2, "10"), (5, "10")]


def test_accepted_rows_and_summary_agree(cells):
    kept = {r.id: r.row_no for r in ingest.accepted_rows(cells, ["id", "a"], "id").collect()}
    assert kept == {10: 1, 12: 6}
    s = ingest.reject_summary(cells, ["id", "a"], "id").first()
    assert (s.source_rows, s.parsed_rows, s.rejected_rows, s.rejected_cells) == (7, 2, 5, 6)
    assert ingest.all_rejects(cells, ["id", "a"], "id").count() == 6
    with pytest.raises(GuardError):
        ingest.require_no_rejects(cells, ["id", "a"], "id")
    clean = cells.where("row_no IN (1, 6)")
    assert ingest.require_no_rejects(clean, ["id", "a"], "id").count() == 2


def test_row_count_guard(cells):
    ingest.check_row_count(cells, 7)
    with pytest.raises(GuardError):
        ingest.check_row_count(cells, 8)


@pytest.fixture()
def batch(spark):
    return spark.createDataFrame([(1, 5, None), (2, 6, "b"), (3, 7, "c")], "id bigint, v bigint, w string")


def test_load_twice_inserts_nothing(batch):
    first = ingest.load_insert_only(batch, batch.limit(0), "id", ["v", "w"])
    assert first.count() == 3
    s = ingest.load_summary(batch, batch, "id", ["v", "w"]).first()
    assert (s.staged_rows, s.inserted_rows, s.existing_matching_rows, s.conflicting_rows) == (3, 0, 3, 0)
    assert ingest.load_insert_only(batch, batch, "id", ["v", "w"]).count() == 0


def test_conflict_blocks_the_load(batch):
    target = batch.withColumn("w", F.when(F.col("id") == 1, "was null").otherwise(F.col("w")))
    assert [r.id for r in ingest.find_conflicts(batch, target, "id", ["v", "w"]).collect()] == [1]
    with pytest.raises(GuardError, match="conflict"):
        ingest.load_insert_only(batch, target, "id", ["v", "w"])


def test_registration_collapses_replays_and_finds_conflicts(spark):
    schema = "source_id string, file_sha256 string, data_row_count bigint, column_count bigint"
    batch = spark.createDataFrame(
        [("a", "1", 5, 2), ("a", "1", 5, 2), ("b", "1", 5, 2), ("b", "1", 6, 2), ("c", "1", 1, 1), ("d", "1", 1, 1)], schema
    )
    held = spark.createDataFrame([("c", "1", 1, 1), ("d", "1", 2, 1)], schema)
    got = {r.source_id: r.action for r in ingest.register_source(batch, held).collect()}
    assert got == {"a": "insert", "b": "conflict", "c": "noop", "d": "conflict"}
    key, fields = ["source_id", "file_sha256"], ["data_row_count", "column_count"]
    with pytest.raises(GuardError):
        ingest.register(batch, held, key, fields)
    assert ingest.register(batch.where("source_id IN ('a', 'c')"), held, key, fields).count() == 1


def test_one_source_identity(spark):
    schema = "source_id string, source_file_sha256 string"
    one = spark.createDataFrame([("s", "h")] * 3, schema)
    assert ingest.require_one_source(one).first().source_id == "s"
    for extra in (("s", "other"), ("s", None)):
        with pytest.raises(GuardError):
            ingest.require_one_source(one.union(spark.createDataFrame([extra], schema)))
    with pytest.raises(GuardError):
        ingest.require_one_source(one.limit(0))


def test_run_state_takes_the_last_event(spark):
    rows = [("r1", "building", 1, 1), ("r1", "succeeded", 5, 2), ("r2", "building", 2, 3), ("r2", "failed", 2, 4)]
    ledger = spark.createDataFrame(rows, "run_id string, status string, event_time bigint, sequence bigint")
    got = {r.run_id: (r.status, r.started_at, r.completed_at) for r in ingest.run_state(ledger).collect()}
    assert got == {"r1": ("succeeded", 1, 5), "r2": ("failed", 2, 2)}


def test_row_numbers_are_gap_free(spark):
    df = spark.createDataFrame([(v,) for v in (50, 3, 99, 7, 1000)], "k bigint")
    got = {r.k: r.source_row_number for r in ingest.with_row_number(df, "k", start=3).collect()}
    assert got == {3: 3, 7: 4, 50: 5, 99: 6, 1000: 7}


def test_run_sink_never_overwrites(spark, tmp_path):
    table = str(tmp_path / "core")
    df = spark.range(3).withColumn("pipeline_run_id", F.lit("ignored"))
    tables.append_run(df, table, "RUN-001")
    tables.append_run(df.limit(1), table, "RUN-002")
    with pytest.raises(GuardError, match="exists"):
        tables.append_run(df, table, "RUN-001")
    for bad in ("x", "a/b/c", "../up", "-lead"):
        with pytest.raises(GuardError):
            tables.append_run(df, table, bad)
    back = spark.read.parquet(table)
    assert {r.pipeline_run_id: r["count"] for r in back.groupBy("pipeline_run_id").count().collect()} == {
        "RUN-001": 3, "RUN-002": 1,
    }


def test_two_writers_of_one_run(spark, tmp_path, monkeypatch):
    """Both have passed the first check; the one that ends later raises and changes nothing."""
    table = str(tmp_path / "core")
    monkeypatch.setattr(tables, "_exists", lambda *_: False)
    tables.append_run(spark.range(3), table, "RUN-001")
    with pytest.raises(GuardError, match="another writer"):
        tables.append_run(spark.range(7), table, "RUN-001")
    assert spark.read.parquet(table).count() == 3
    assert [p.name for p in (tmp_path / "core").iterdir()] == ["pipeline_run_id=RUN-001"]


def test_read_table_refuses_other_columns(spark, tmp_path):
    from pyspark.sql import types as T

    path = str(tmp_path / "t")
    spark.range(2).write.parquet(path)
    good = T.StructType([T.StructField("id", T.LongType())])
    assert tables.read_table(spark, path, good).count() == 2
    with pytest.raises(GuardError, match="other"):
        tables.read_table(spark, path, T.StructType([*good.fields, T.StructField("other", T.IntegerType())]))
    with pytest.raises(GuardError):
        tables.require_header(spark.range(1), ["ID"])


def test_fingerprints_notice_a_changed_file(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"one")
    (folder / "b.bin").write_bytes(b"two")
    before = tables.fingerprint_files(spark, str(folder)).select("file_path", "file_sha256").collect()
    registered = spark.createDataFrame([tuple(r) for r in before] + [("gone.bin", "0")], "file_path string, file_sha256 string")
    (folder / "b.bin").write_bytes(b"three")
    (folder / "c.bin").write_bytes(b"new")
    found = tables.fingerprint_files(spark, str(folder))
    got = {r.file_path: r.status for r in tables.compare_fingerprints(found, registered).collect()}
    assert got == {"a.bin": "match", "b.bin": "changed", "c.bin": "unregistered", "gone.bin": "absent"}


@pytest.mark.parametrize(
    "text, reason",
    [("1.00000000000000001", "non-integral"), ("2147483647.0000000001", "non-integral"), ("1e-400", "non-integral"), ("10e-2", "non-integral"),
     ("100e-2", None), ("0e-5", None), ("1.5e1", None), ("2147483648", "outside int32"), ("1e99999999999", "outside int32"), ("12.", None)],
)
def test_cells_are_judged_by_their_text(spark, text, reason):
    assert spark.createDataFrame([(text,)], "c string").select(ingest.reject_reason(F.col("c"))).first()[0] == reason


def test_fingerprints_reach_into_table_folders(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(10).repartition(1).write.parquet(str(tmp_path / name))
    found = tables.fingerprint_files(spark, str(tmp_path), "*.parquet")
    rows = found.collect()
    assert sorted(r.file_path.split("/")[0] for r in rows) == ["a", "b"]
    for r in rows:
        assert r.file_sha256 == hashlib.sha256((tmp_path / r.file_path).read_bytes()).hexdigest()
    assert tables.compare_fingerprints(found, found).where("status <> 'match'").count() == 0


def test_fingerprints_of_files_beyond_two_gib(spark, tmp_path):
    (tmp_path / "small.bin").write_bytes(b"one")
    with open(tmp_path / "a large.bin", "wb") as file:
        file.truncate((1 << 31) + 5)  # a hole, which takes no disk
    want = hashlib.sha256()
    for _ in range(1 << 9):
        want.update(bytes(1 << 22))
    want.update(bytes(5))
    found = {r.file_path: (r.file_bytes, r.file_sha256) for r in tables.fingerprint_files(spark, str(tmp_path)).collect()}
    assert found == {"small.bin": (3, hashlib.sha256(b"one").hexdigest()), "a large.bin": ((1 << 31) + 5, want.hexdigest())}


def test_long_files_of_a_store_without_local_paths(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 5000)
    (tmp_path / "b.bin").write_bytes(b"y")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.prints.link./in", f"file://{tmp_path}")
    found = {r.file_path: r.file_sha256 for r in tables.fingerprint_files(spark, "viewfs://prints/in", whole_bytes=1000).collect()}
    assert found == {f"{n}.bin": hashlib.sha256((tmp_path / f"{n}.bin").read_bytes()).hexdigest() for n in "ab"}


def test_a_half_written_run_can_be_repeated(spark, tmp_path):
    table = str(tmp_path / "t")
    folder = tables.append_run(spark.range(3), table, "RUN-001")
    with pytest.raises(GuardError, match="exists already"):
        tables.append_run(spark.range(3), table, "RUN-001")
    (Path(folder) / "_SUCCESS").unlink()
    tables.append_run(spark.range(5), table, "RUN-001")
    assert spark.read.parquet(table).count() == 5
