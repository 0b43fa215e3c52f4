"""Archives read in ranges, and state that expires."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumisonde.sources import archives
from lumisonde.streaming import status


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_rows_of_archives(spark, tmp_path, save):
    rng = np.random.default_rng(1)
    x, hot = rng.normal(size=(1000, 3, 2)).astype("f4"), np.eye(3)[rng.integers(0, 3, 1000)]
    save(tmp_path / "a.npz", X_train=x, y_train=hot, X_test=x[:7].astype("<i2"), y_test=np.arange(7))
    save(tmp_path / "b.npz", X=np.ones((5, 4)), other=np.array([1]))
    got = archives.read_rows(spark, str(tmp_path), split="val", rows=300)
    assert got.rdd.getNumPartitions() == 4 + 1 + 1
    rows = {(r.path[-5:], r.split, r.row): (r.x, r.y) for r in got.collect()}
    assert len(rows) == 1012
    assert all(np.allclose(rows["a.npz", "train", i][0], x[i].ravel()) and rows["a.npz", "train", i][1] == hot[i].argmax() for i in range(1000))
    assert rows["a.npz", "test", 6][1] == 6 and rows["b.npz", "val", 0] == ([1.0] * 4, -1)
    few = archives.read_rows(spark, str(tmp_path), columns="split,y")
    assert few.columns == ["split", "y"] and few.groupBy("split").count().count() == 2
    assert archives.read_rows(spark, str(tmp_path / "nothing"), columns="row").count() == 0 if (tmp_path / "nothing").mkdir() is None else True


def test_only_a_range_of_a_stored_archive_is_read(tmp_path):
    import zipfile

    np.savez(tmp_path / "a.npz", X=np.arange(3_000_000, dtype="f8").reshape(-1, 3))

    class Counted:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n=-1):
            out = self.f.read(n)
            self.n += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.f, name)

    with open(tmp_path / "a.npz", "rb") as f, zipfile.ZipFile(c := Counted(f)) as z:
        assert archives.rows_of(z, "X", 900_000, 900_010)[0].tolist() == [2_700_000.0, 2_700_001.0, 2_700_002.0]
        assert c.n < 100_000
    with pytest.raises(ValueError, match="ends early"), zipfile.ZipFile(tmp_path / "a.npz") as z:
        archives.rows_of(z, "X", 999_999, 1_000_001)


def test_arrays_of_objects_are_refused(tmp_path):
    import zipfile

    np.savez(tmp_path / "o.npz", X=np.array([{}, 1], object))
    with zipfile.ZipFile(tmp_path / "o.npz") as z, pytest.raises(ValueError, match="objects"):
        archives.rows_of(z, "X", 0, 1)


def test_steps_bound_the_history_and_reset():
    s = None
    for i in range(250):
        s = status.step(s, i, "running", float(i))
    assert len(s[1]) == status.HISTORY and s[1][-1] == 249.0 and s[2] == 249 + status.ACTIVE
    assert status.step(s, 300, "reset", None) == ("reset", [], 300 + status.ACTIVE) and status.step(s, 300, "done", None)[2] == 300 + status.ENDED


def test_states_expire_in_a_stream(spark, tmp_path):
    zero = datetime.datetime(2026, 1, 1)
    at = lambda s: zero + datetime.timedelta(seconds=s)
    batches = [
        [("a", at(0), "running", 0.2), ("a", at(10), "running", 0.4), ("b", at(5), "done", 0.9)],
        [("c", at(120), "running", 0.1)],  # the watermark passes a's expiry at 40, not b's at 305
        [("a", at(200), "running", 0.8), ("c", at(160), "failed", None)],  # a begins anew, and c's state has expired in between
        [("d", at(2000), "running", 0.5)],
        [("d", at(2001), "running", 0.7)],
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", status.STORE)
    try:
        source = tmp_path / "in"
        schema = "job string, at timestamp, status string, score double"
        q = None
        got = []
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            out = status.tracked(spark.readStream.schema(schema).parquet(str(source)), "job", "10 seconds")
            q = out.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, n: got.extend(tuple(r) for r in df.collect())).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    seconds = [(k, int((t - zero).total_seconds()), s, n, event) for k, t, s, n, m, event in got]
    assert [x for x in seconds if x[0] == "a"] == [("a", 0, "running", 1, "update"), ("a", 10, "running", 2, "update"), ("a", 40, "running", 2, "expired"), ("a", 200, "running", 1, "update"), ("a", 230, "running", 1, "expired")]
    assert [x for x in seconds if x[0] == "b"] == [("b", 5, "done", 1, "update"), ("b", 305, "done", 1, "expired")]
    assert [x for x in seconds if x[0] == "c"][-1][1:] == (460, "failed", 0, "expired") or ("c", 460, "failed", 1, "expired") in seconds
    assert not [x for x in seconds if x[0] == "d" and x[4] == "expired"]
