"""ChangeCapture across runs: ties of position, and what a crash leaves in the sink."""

import os
import shutil

from siltstone.operators.incremental import ChangeCapture

IMAGE = "volume_id bigint, frn bigint, usn bigint, content_hash_lo bigint, content_hash_hi bigint, extractor_ver int"


def capture(spark, root, scans):
    base = spark.createDataFrame([(1, 1, 10, 5, 5, 1), (1, 2, 10, 5, 5, 1)], IMAGE)
    return ChangeCapture(spark, str(root), base, spark.createDataFrame(scans, f"scan_id bigint, run_id int, {IMAGE}"))


def keys(df):
    return sorted((r.volume_id, r.frn) for r in df.collect())


def test_equal_position_takes_greater_fingerprint(spark, tmp_path):
    cap = capture(spark, tmp_path / "c", [(1, 1, 1, 1, 10, 6, 5, 1), (2, 1, 1, 2, 10, 4, 5, 1), (3, 2, 1, 1, 10, 7, 5, 1), (4, 2, 1, 2, 10, 5, 5, 1)])
    assert keys(cap.commit(1)) == [(1, 1)]
    assert keys(cap.commit(2)) == [(1, 1)]
    assert sorted((r.frn, r.content_hash_lo) for r in cap.state().collect()) == [(1, 7), (2, 5)]


def test_part_file_without_success_is_not_applied(spark, tmp_path):
    cap = capture(spark, tmp_path / "c", [(1, 1, 1, 1, 20, 6, 5, 1), (2, 2, 1, 2, 20, 6, 5, 1), (3, 3, 1, 1, 15, 9, 9, 1)])
    assert keys(cap.commit(1)) == [(1, 1)]
    cap.plan(2)
    left = capture(spark, tmp_path / "other", [(2, 2, 1, 2, 20, 6, 5, 1)])
    left.commit(2)
    shutil.copytree(tmp_path / "other/sink/batch=2", tmp_path / "c/sink/batch=2", ignore=lambda d, names: [n for n in names if "_SUCCESS" in n])
    assert not os.path.exists(tmp_path / "c/sink/batch=2/_SUCCESS")
    assert keys(cap.changes()) == [(1, 1)]
    assert keys(cap.commit(3)) == [(1, 2)]
    assert keys(cap.changes()) == [(1, 1), (1, 2)]


SCANS = [(1, 1, 1, 1, 20, 6, 5, 1), (2, 1, 1, 2, 20, 6, 5, 1), (3, 2, 1, 3, 5, 1, 1, 1), (4, 2, 1, 1, 30, 7, 5, 1), (5, 3, 2, 9, 1, 1, 1, 1), (6, 3, 1, 3, 6, 2, 1, 1), (7, 3, 1, 1, 30, 7, 5, 1)]


def whole(spark, root):
    cap = capture(spark, root, SCANS)
    return {run: keys(cap.commit(run)) for run in (1, 2, 3)}


def test_failures_at_any_point_change_nothing(spark, tmp_path):
    want = whole(spark, tmp_path / "a")
    assert want == {1: [(1, 1), (1, 2)], 2: [(1, 1), (1, 3)], 3: [(1, 3), (2, 9)]}
    # before the plan of run 2 nothing is there to replay; after it run 3 takes both
    cap = capture(spark, tmp_path / "b", SCANS)
    assert keys(cap.commit(1)) == want[1]
    assert keys(cap.commit(3)) == sorted({*want[2], *want[3]})
    cap = capture(spark, tmp_path / "c", SCANS)
    cap.commit(1)
    cap.plan(2)
    again = capture(spark, tmp_path / "c", SCANS)  # a new process
    assert again.pending() == [2] and keys(again.commit(3)) == sorted({*want[2], *want[3]})
    # a run that is played again gives what it gave
    assert keys(again.commit(3)) == sorted({*want[2], *want[3]}) and again.pending() == []


def test_redelivered_and_late_rows(spark, tmp_path):
    cap = capture(spark, tmp_path / "c", SCANS[:4])
    cap.commit(1)
    cap.commit(2)
    # rows 1 and 4 come again; a row of run 1 comes after plan 2, as its place in the log says; another is older than what is known
    late = [(8, 1, 1, 8, 3, 3, 3, 1), (9, 1, 1, 1, 20, 6, 5, 1), (10, 2, 1, 1, 30, 7, 5, 1), (11, 2, 1, 3, 4, 9, 9, 1)]
    cap = capture(spark, tmp_path / "c", SCANS[:4] + late)
    assert keys(cap.commit(3)) == [(1, 8)]


def test_nulls_and_empty_logs(spark, tmp_path):
    rows = [(1, 1, 1, 5, 9, None, 1, 1), (2, 1, 1, 5, None, 1, 1, 1), (3, 1, None, 5, 9, 1, 1, 1), (None, 1, 1, 6, 9, 1, 1, 1), (4, None, 1, 6, 9, 1, 1, 1), (5, 1, 1, 7, 9, 1, 1, None)]
    assert keys(capture(spark, tmp_path / "n", rows).commit(1)) == [(1, 7)]
    assert keys(capture(spark, tmp_path / "e", []).commit(1)) == []
    runs = spark.createDataFrame([(1, "failed"), (2, None)], "run_id int, status string")
    from siltstone.operators.incremental import replay_runs

    assert replay_runs(capture(spark, tmp_path / "r", rows), runs).collect() == []


def test_offsets_not_in_order_of_runs(spark, tmp_path):
    # two scanners of one volume number their rows by themselves: those of runs 2 and 3 lie below the greatest of run 1
    rows = [(1, 1, 1, 1, 20, 6, 5, 1), (2, 2, 1, 2, 20, 6, 5, 1), (3, 3, 1, 1, 30, 7, 5, 1), (101, 1, 1, 11, 20, 6, 5, 1), (102, 2, 1, 12, 20, 6, 5, 1), (103, 3, 1, 11, 20, 6, 5, 1)]
    cap = capture(spark, tmp_path / "c", rows)
    assert {run: keys(cap.commit(run)) for run in (1, 2, 3)} == {1: [(1, 1), (1, 11)], 2: [(1, 2), (1, 12)], 3: [(1, 1)]}
    # a failed run in between, and a row of run 1 that comes after its plan
    cap = capture(spark, tmp_path / "d", rows)
    cap.commit(1)
    cap.plan(2)
    cap = capture(spark, tmp_path / "d", [*rows, (104, 1, 1, 13, 20, 6, 5, 1)])
    assert keys(cap.commit(3)) == [(1, 1), (1, 2), (1, 12), (1, 13)]
    assert keys(cap.commit(4)) == []
