"""Publication by racing writers, banks fed by replayed batches, and job states with a timer across a restart."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from qforge import storage
from qforge.streaming import jobs


def test_racing_writers_lose_no_version(spark, tmp_path):
    barrier, folders = threading.Barrier(4), []

    def write(i):
        df = spark.createDataFrame([(i,)], "n int").coalesce(1)
        barrier.wait()
        folders.append(storage.published(df, str(tmp_path), "t"))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    versions = storage.Versions(spark, str(tmp_path), "t")
    assert versions.numbers() == [1, 2, 3, 4]
    assert sorted(versions.read(n).folder for n in versions.numbers()) == sorted(folders)
    assert sorted(versions.table(versions.read(n)).first()["n"] for n in versions.numbers()) == [0, 1, 2, 3]
    assert storage.current(spark, str(tmp_path), "t").first()["n"] == versions.table(versions.read(4)).first()["n"]


def test_a_number_is_taken_once(spark, tmp_path):
    """Two writers with one listing: the second is refused and finds the first's marker as it was; a marker left half-made is passed over."""
    versions = storage.Versions(spark, str(tmp_path), "t")
    assert versions.latest().number == 0 and versions.table(versions.latest()) is None
    assert versions.claim(storage.Version(1, "a")) and not versions.claim(storage.Version(1, "b"))
    assert versions.latest() == storage.Version(1, "a")
    (tmp_path / "t" / "current" / "2").write_text("")
    assert versions.latest().folder == "a"
    folder = storage.published(spark.createDataFrame([(1,)], "n int"), str(tmp_path), "t")
    assert versions.latest() == storage.Version(3, folder)
    assert not [p for p in (tmp_path / "t" / "current").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_racing_commits_build_on_each_other(spark, tmp_path):
    def write(i):
        df = spark.createDataFrame([(i,), (100,)], "k int").coalesce(1)
        storage.committed(spark, str(tmp_path), "bank", jobs.inserted(df, "k"), f"s{i}", 0)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r.k for r in storage.current(spark, str(tmp_path), "bank").collect()) == [0, 1, 2, 100]
    versions = storage.Versions(spark, str(tmp_path), "bank")
    assert versions.latest().batches == {"s0": 0, "s1": 0, "s2": 0} and versions.latest().number == 3
    assert sorted(versions.read(n).counts["skipped"] for n in (1, 2, 3)) == [0, 1, 1]


def test_a_killed_batch_is_replayed_once(spark, tmp_path, monkeypatch):
    """The first try dies between writing and publishing, the second after publishing but before the stream's own commit; counts come out as in one good run."""
    spark.createDataFrame([(i % 40, i) for i in range(100)], "k int, n int").coalesce(1).write.parquet(f"{tmp_path}/in")
    go = lambda: jobs.into_bank(spark.readStream.schema("k int, n int").parquet(f"{tmp_path}/in"), str(tmp_path), "bank", f"{tmp_path}/state", lambda b: jobs.inserted(b, "k", "n"), "s")
    claim, committed = storage.Versions.claim, jobs.committed

    def dies(*a):
        raise RuntimeError("killed")

    def dies_late(*a):
        committed(*a)
        raise RuntimeError("killed")

    monkeypatch.setattr(storage.Versions, "claim", dies)
    with pytest.raises(Exception, match="killed"):
        go()
    monkeypatch.setattr(storage.Versions, "claim", claim)
    assert storage.Versions(spark, str(tmp_path), "bank").latest().number == 0
    monkeypatch.setattr(jobs, "committed", dies_late)
    with pytest.raises(Exception, match="killed"):
        go()
    monkeypatch.setattr(jobs, "committed", committed)
    go()
    spark.createDataFrame([(50, 1), (3, 3)], "k int, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    versions = storage.Versions(spark, str(tmp_path), "bank")
    assert [versions.read(n).counts for n in versions.numbers()] == [{"inserted": 40, "skipped": 60}, {"inserted": 1, "skipped": 1}]
    assert sorted((r.k, r.n) for r in storage.current(spark, str(tmp_path), "bank").collect()) == [*((i, i) for i in range(40)), (50, 1)]


def test_a_job_left_queued_falls_back_once_across_a_restart(spark, tmp_path):
    jobs.with_states(spark)
    schema = "job int, kind string, error string"
    src = f"{tmp_path}/in"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    updates = lambda: jobs.job_updates(spark.readStream.schema(schema).parquet(src), "job", F.col("kind"), F.col("error"), wait_ms=8000)
    seen = lambda: [(r.job, r.status, r.fallback, r.error) for r in spark.read.schema(jobs.UPDATE).parquet(f"{tmp_path}/out/*").collect()]

    def go():
        return updates().writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()

    def until(done, query, seconds=90):
        end = time.time() + seconds
        while not done() and time.time() < end:
            assert query.exception() is None
            time.sleep(0.5)
        assert done()

    put((1, "queued", None), (2, "queued", None), (2, "started", None), (3, "queued", None))
    query = go()
    until(lambda: any((tmp_path / "out").glob("*/_SUCCESS")) and len(seen()) == 3, query)
    query.stop()
    put((3, "done", None), (2, "failed", "no text"), (None, "done", None))
    query = go()  # the timers of 1 and 3 come from the state
    until(lambda: ("1", "processing", True, None) in seen(), query)
    time.sleep(4)
    query.stop()
    assert [x for x in seen() if x[2]] == [("1", "processing", True, None)]
    got = {r.job: (r.status, r.progress, r.events, r.error, r.fallback) for r in jobs.latest_updates(spark.read.schema(jobs.UPDATE).parquet(f"{tmp_path}/out/*")).collect()}
    assert got == {"1": ("processing", 40, 1, None, True), "2": ("failed", 65, 3, "no text", False), "3": ("completed", 100, 2, None, False)}
