"""Streaming: a rerun ingests nothing new; the streamed activity index equals the batch one."""

from pricelens.plans import q_stream
from pricelens.streaming import incremental as inc


def test_ingest_rerun_adds_nothing(spark, sf_dir):
    rows = {r["run"]: r["rows_in_sink"] for r in q_stream.r1_ingest(spark, sf_dir).collect()}
    assert rows[3] > rows[1] == rows[2] > 0


def test_dedup_stream_keeps_one_per_id(spark, sf_dir):
    r = q_stream.r2_dedup(spark, sf_dir).first()
    assert r["rows_kept"] == r["distinct_ids"] == r["from_first_file"] > 0


def test_activity_stream_equals_batch(spark, sf_dir):
    s = q_stream.r3_activity(spark, sf_dir)
    b = q_stream.r3_activity_batch(spark, sf_dir)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_csv_scan_restores_latin1_files(spark, sf_dir):
    import __spark_entry__ as E
    r = E.queries()["s1_s5_csv_scan"](spark, sf_dir).first()
    assert r["replacement_chars"] == 0 and r["rows"] == r["distinct_ids"] > 0 and r["accented_names"] > 0


def test_resumable_ingest_loses_no_row(spark, sf_dir):
    first, again, rest = [tuple(r) for r in q_stream.s19_resumable_ingest(spark, sf_dir).orderBy("run").collect()]
    assert first[1] == first[2] == first[3] == again[1] == again[2] > 0
    assert rest[1] == rest[2] == rest[3] > first[1]


def test_hash_unit_takes_large_ids(spark):
    from pricelens.functions.exprs import hash_unit
    ids = [0, 1, 3_474_701_533, 4_000_000_000, 2 ** 62 - 1, 2 ** 62]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    got = {r[0]: r[1] for r in df.select("id", hash_unit("id", 42)).collect()}
    assert got == {i: (i + 42) % 2 ** 31 * 2654435761 % 2 ** 32 for i in ids}


def _arrive(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_dedup_drops_a_copy_however_late_and_survives_a_repeated_batch(spark, tmp_path):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("id long, at long, v string")
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    (tmp_path / "src").mkdir()

    def run():
        return sorted(inc.dedup_stream(spark, src, schema, "id", "at", sink, ck, None).collect(), key=str)

    assert run() == []
    _arrive(spark, [(1, 5, "b"), (1, 4, "a"), (None, 1, "n"), (2, 1, "c")], schema, src)
    first = run()
    assert sorted(r["v"] for r in first) == ["a", "c", "n"]
    _arrive(spark, [(1, 0, "old"), (3, 10 ** 9, "d"), (None, 0, "m")], schema, src)
    second = run()
    assert sorted(r["v"] for r in second) == ["a", "c", "d", "n"]
    assert run() == second
    # the last commit is lost, as when the driver dies after the batch has been written
    for f in sorted((tmp_path / "ck" / "commits").iterdir()):
        if f.name.lstrip(".").startswith("1"):
            f.rename(tmp_path / f.name.replace(".", "_"))
    assert run() == second


def test_activity_takes_late_events_inside_the_watermark_only(spark, tmp_path):
    import datetime as dt
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("ts timestamp, event_type string")
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    (tmp_path / "src").mkdir()

    def run(*rows):
        if rows:
            _arrive(spark, [(dt.datetime(2024, 1, d, h, tzinfo=dt.timezone.utc), "view") for d, h in rows], schema, src)
        out = inc.activity_stream(spark, src, schema, sink, ck)
        return {r["window_start"].day: (r["n"], r["activity_index"]) for r in out.collect()}

    assert run() == {}
    assert run((1, 1), (1, 2), (10, 1)) == {1: (2, 100), 10: (1, 50)}
    assert run((9, 12), (2, 1)) == {1: (2, 100), 9: (1, 50), 10: (1, 50)}  # the 9th is open, the 2nd has been closed
    assert run((10, 3)) == {1: (2, 100), 9: (1, 50), 10: (2, 100)}
    assert run() == {1: (2, 100), 9: (1, 50), 10: (2, 100)}
