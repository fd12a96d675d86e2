"""Jobs by name: progress, cancellation, errors; files that change under a read."""

import os
import time

import pytest

from lodestrata import jobs
from lodestrata.sources import pointcloud


def slow(spark, tasks=40, seconds=0.5):
    def run(batches):
        time.sleep(seconds)
        yield from batches

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "id long").count()


def test_a_job_goes_on_to_its_result(spark):
    all_jobs = jobs.Jobs(spark)
    all_jobs.start("good", lambda s: slow(s, 8, 0.3))
    seen = []
    while not all_jobs.jobs["good"].ended.wait(0.1):
        seen.append(all_jobs.progress("good").share)
    assert all_jobs.wait("good") == 8 and seen == sorted(seen) and max(seen) < 1
    last = all_jobs.progress("good")
    assert (last.state, last.share) == (jobs.DONE, 1.0) and last.tasks_done == last.tasks > 0


def test_cancel_ends_a_running_job_and_no_other(spark):
    all_jobs = jobs.Jobs(spark)
    all_jobs.start("other", lambda s: slow(s, 4, 0.5))
    all_jobs.start("long", lambda s: slow(s, 400, 0.5))
    with pytest.raises(jobs.JobExists):
        all_jobs.start("long", lambda s: 1)
    while not all_jobs.progress("long").tasks:
        time.sleep(0.1)
    begun = time.time()
    assert all_jobs.cancel("long") and time.time() - begun < 20
    assert all_jobs.progress("long").state == jobs.CANCELLED and not all_jobs.cancel("long")
    with pytest.raises(Exception):
        all_jobs.wait("long")
    assert all_jobs.wait("other", 60) == 4
    all_jobs.start("long", lambda s: 5)
    assert all_jobs.wait("long", 60) == 5


def test_errors_and_names(spark):
    all_jobs = jobs.Jobs(spark)
    all_jobs.start("bad", lambda s: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        all_jobs.wait("bad", 60)
    assert all_jobs.progress("bad").state == jobs.FAILED
    for name in ("", "a b", "x" * 129):
        with pytest.raises(ValueError):
            all_jobs.start(name, lambda s: 1)
    with pytest.raises(KeyError):
        all_jobs.progress("none")


def test_a_file_that_changes_is_an_error(tmp_path):
    path = tmp_path / "a.xyz"
    path.write_text("1 2 3\n4 5 6\n")
    reader = pointcloud.CloudReader({"path": str(path)})
    (part,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 2
    path.write_text("1 2 3\n4 5 6\n7 8 9\n")
    with pytest.raises(pointcloud.SourceChanged):
        list(reader.read(part))
    (part,) = reader.partitions()
    rest = reader.read(part)
    next(rest)
    os.utime(path, ns=(1, 1))
    with pytest.raises(pointcloud.SourceChanged):
        list(rest)
