"""A rescan's joins by segments: as many tasks as the rows ask for, and rows that no task sorts."""

import contextlib
import io

import pytest

from lectern.operators import reconcile


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("task_rows", [1 << 18, 40])
def test_rows_of_segments(spark, monkeypatch, task_rows):
    monkeypatch.setattr(reconcile, "TASK_ROWS", task_rows, raising=False)
    old = spark.createDataFrame([(k, f"f{k % 5}") for k in range(200) if k % 10] + [(None, "f")], "segment_id long, fingerprint string")
    new = spark.createDataFrame([(k, f"f{k % 5}" if k % 7 else None if k % 2 else "x") for k in range(200) if k % 10 != 1], "segment_id long, fingerprint string")
    rows = spark.createDataFrame([(k, n) for k in range(210) for n in range(k % 4)] + [(7, 1), (None, 1)], "segment_id long, n int")
    changes = reconcile.segment_changes(old, new, "segment_id", "fingerprint")
    found = {r.segment_id: r.change for r in changes.collect()}
    expected = {k: "added" if not k % 10 else "removed" if k % 10 == 1 else "unchanged" if k % 7 else "changed" for k in range(200)}
    # a new segment without a fingerprint counts as removed, as before
    expected |= {k: "removed" for k in range(200) if k % 7 == 0 and k % 2 and k % 10}
    assert {k: v for k, v in found.items() if k is not None} == expected
    done = reconcile.reconcile(rows, rows, changes)
    plan = _plan(done)
    origin = {"unchanged": "reused", "added": "parsed", "changed": "parsed"}
    theirs = sorted((r.segment_id, r.n, origin[expected[r.segment_id]]) for r in rows.collect() if expected.get(r.segment_id) in origin)
    assert done.columns == ["segment_id", "n", "origin"] and sorted(map(tuple, done.collect())) == theirs
    assert plan.count("ShuffledHashJoin") == 2  # the rows of both sides pass unsorted
    assert ("REPARTITION_BY_NUM" in plan) == (task_rows == 40)
