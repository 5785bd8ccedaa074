import uuid

import pytest
from pyspark.sql import functions as F

from conftest import dicts
from sedgework.operators.incremental import Manifest, next_batch, pending_paths
from sedgework.streaming.incremental import refresh_stream

FILES = "path string, hash string, chunks int, indexed string, size long, embedded boolean, metadata string"
SCANS = "scan_id long, path string, hash string, size long, seen_at timestamp"
RUNS = "run_id long, started_at timestamp, finished_at timestamp, status string"


def ts(spark, rows, schema, *columns):
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame(rows, schema.replace("timestamp", "string"))
    return df.select(*(F.to_timestamp(n).alias(n) if n in columns else F.col(n) for n in names))


def found(spark, files, scans, runs):
    """Reasons by path; the batch that the manifest gives out has the same paths, each once, and again when asked again."""
    tables = spark.createDataFrame(files, FILES), ts(spark, scans, SCANS, "seen_at"), ts(spark, runs, RUNS, "started_at", "finished_at")
    reasons = {r["path"]: r["reason"] for r in dicts(pending_paths(*tables))}
    root = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    for _ in range(2):
        assert sorted(r["path"] for r in dicts(next_batch(*tables, root))) == sorted(reasons)
    assert Manifest(spark, root).batches() == ["history", "next"]
    return reasons


RUN = [(1, "2025-03-01 01:00:00", "2025-03-01 02:00:00", "ok"), (2, "2025-03-02 01:00:00", None, "crashed"), (3, "2025-03-03 01:00:00", "2025-03-03 02:00:00", "ok")]


def state(path, digest, at, embedded=True):
    return (path, digest, 1, at, 1, embedded, None)


def test_states_ignore_failed_runs_and_offsets_count(spark):
    h = "a" * 12
    files = [
        state("/same", h, "2025-03-01T01:30:00Z"),
        state("/upper", "A" * 64, "2025-03-01T03:30:00.000+02:00"),
        state("/changed", "b" * 12, "2025-03-01T01:30:00Z"),
        state("/crashed", h, "2025-03-02T05:00:00Z"),
        state("/older", h, "2025-03-01T01:30:00Z", False),
        state("/older", h, "2025-03-03T01:30:00Z"),
        state("/unembedded", h, "2025-03-03T01:30:00Z", None),
        state("/gone", h, "2025-03-03T01:30:00Z"),
    ]
    paths = ["/same", "/upper", "/changed", "/crashed", "/older", "/unembedded", "/new"]
    scans = [(i, p, h, 1, "2025-03-04 00:00:00") for i, p in enumerate(paths)]
    scans += [(90, "/same", None, 1, "2025-03-05 00:00:00"), (91, "/same", "c" * 12, 1, "2025-03-01 00:00:00"), (92, "/unread", None, 1, "2025-03-05 00:00:00")]
    assert found(spark, files, scans, RUN) == {"/changed": "changed", "/crashed": "new", "/unembedded": "not embedded", "/new": "new"}


def test_nulls_ties_and_empty_tables(spark):
    h = "a" * 12
    assert found(spark, [], [], []) == {}
    files = [state(None, h, "2025-03-01T01:30:00Z"), state("/p", h, "nonsense"), state("/q", None, "2025-03-01T01:30:00Z")]
    scans = [(1, "/p", h, 1, "2025-03-04 00:00:00"), (2, "/q", h, 1, "2025-03-04 00:00:00"), (3, "/q", h, 1, "2025-03-04 00:00:00"), (4, None, h, 1, "2025-03-04 00:00:00")]
    assert found(spark, files, scans, RUN) == {"/p": "new", "/q": "changed"}
    tie = [state("/t", h, "2025-03-01T01:30:00Z", False), state("/t", h, "2025-03-01T01:30:00Z", True)]
    assert found(spark, tie, [(1, "/t", h, 1, "2025-03-04 00:00:00")], RUN) == {}


LISTING = "path string, size long, checksum string, extra string"


def listing(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], LISTING)


def test_manifest_processes_new_and_changed_once(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"))
    assert m.run("1", listing(spark, ("/a", 1, "x"), ("/a", 1, "x"), ("/n", None, None)), lambda d: d)
    assert not m.run("1", listing(spark, ("/b", 1, "x")), lambda d: d), "a committed batch is not repeated"
    assert m.run("2", listing(spark, ("/a", 2, "y"), ("/n", None, None)), lambda d: d)
    assert sorted((r["path"], r["size"]) for r in dicts(m.output().select("path", "size")) if r["size"]) == [("/a", 2)], "superseded"
    assert m.output().count() == 2
    assert m.run("3", listing(spark, ("/a", 1, "x")), lambda d: d), "an input may change back"
    assert [r["size"] for r in dicts(m.output().where("path = '/a'"))] == [1]


def test_an_input_that_gives_nothing_any_more_leaves_no_rows(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"))
    m.run("1", listing(spark, ("/a", 1, "x"), ("/b", 1, "x")), lambda d: d)
    m.run("2", listing(spark, ("/a", 2, "y")), lambda d: d.where("false"))
    assert [r["path"] for r in dicts(m.output())] == ["/b"]


def test_compaction_keeps_what_counts(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"))
    m.adopt("before", listing(spark, ("/z", 9, "z")))
    m.run("odd id+1", listing(spark, ("/a", 1, "x"), ("/b", 1, "x"), ("/z", 9, "z")), lambda d: d)
    m.run("2", listing(spark, ("/a", 2, "y")), lambda d: d)
    want = sorted(map(tuple, m.output().collect()))
    m.compact()
    assert sorted(map(tuple, m.output().collect())) == want == [("/a", 2, "y"), ("/b", 1, "x")]
    assert not m.run("2", listing(spark, ("/c", 1, "x")), lambda d: d), "compacted batches stay committed"
    assert m.pending(listing(spark, ("/a", 2, "y"), ("/z", 9, "z"))).isEmpty() and len(m._markers()) == 1
    assert m.run("3", listing(spark, ("/b", 2, "x")), lambda d: d)
    assert sorted(map(tuple, m.output().collect())) == [("/a", 2, "y"), ("/b", 2, "x")]


def test_manifest_survives_a_failure_between_any_two_steps(spark, tmp_path):
    m = Manifest(spark, str(tmp_path / "m"))

    def fails(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        m.run("1", listing(spark, ("/a", 1, "x")), fails)
    assert m.output() is None and m.pending(listing(spark, ("/a", 1, "x"))).count() == 1
    commit, m._commit = m._commit, fails
    with pytest.raises(RuntimeError):
        m.run("1", listing(spark, ("/a", 1, "x"), ("/b", 1, "x")), lambda d: d)
    assert m.output() is None, "written output without a commit does not count"
    m._commit = commit
    assert m.run("1", listing(spark, ("/a", 1, "x"), ("/b", 1, "x")), lambda d: d)
    assert m.output().count() == 2


def test_stream_refreshes_incrementally(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(r, "path string, size long, checksum string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: refresh_stream(spark, source, root, lambda d: d, str(tmp_path / "cp"), 1).awaitTermination()
    rows(("/a", 1, "x"))
    run()
    rows(("/a", 1, "x"), ("/b", 1, "y"))
    run()
    assert sorted(r["path"] for r in dicts(Manifest(spark, root).output().select("path"))) == ["/a", "/b"]


def test_a_lost_checkpoint_neither_skips_nor_repeats(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame(r, "path string, size long, checksum string").coalesce(1).write.mode("append").parquet(source)
    run = lambda cp: refresh_stream(spark, source, root, lambda d: d, str(tmp_path / cp), 1).awaitTermination()
    rows(("/a", 1, "x"))
    run("first")
    rows(("/b", 1, "y"))
    run("second")
    assert sorted(r["path"] for r in dicts(Manifest(spark, root).output().select("path"))) == ["/a", "/b"]
