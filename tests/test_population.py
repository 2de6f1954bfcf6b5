"""Compaction of batches and the two population estimators against NumPy."""

import os

import numpy as np
import pytest

from shardloom.operators.moments import packed_moments
from shardloom.streaming import incremental as I, population as P

DECAY = 0.8


def arrive(spark, tmp_path, batches, start):
    """Batches of features arrive one after the other; the stream is started again for each."""
    source, at = str(tmp_path / "source"), 0
    for x in batches:
        rows = [(at + i, [float(v) for v in r]) for i, r in enumerate(x)]
        at += len(x)
        spark.createDataFrame(rows, "global_index bigint, features array<double>").write.mode("append").parquet(source)
        start(spark.readStream.schema("global_index bigint, features array<double>").parquet(source)).awaitTermination()


def folders(path):
    return sorted(os.listdir(path)) if os.path.exists(path) else []


def test_decayed_moments_and_compaction(spark, tmp_path):
    rnd = np.random.default_rng(0)
    batches = [rnd.normal(size=(n, 3)) + n for n in (5, 1, 8, 3, 6, 2, 4)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    arrive(spark, tmp_path, batches, lambda s: P.stream_decayed(s, 3, out, state, DECAY, pilot=[4.0] * 3, every=2))
    assert folders(out) == ["batch_id=4", "batch_id=5", "batch_id=6", "upto=3", "upto=5"]
    x = np.concatenate(batches)
    w = np.concatenate([np.full(len(b), DECAY ** (len(batches) - 1 - k)) for k, b in enumerate(batches)])
    mom = P.read_decayed(spark, out, 3, DECAY, pilot=[4.0] * 3)
    got = packed_moments(mom).first()
    assert mom.first()["weight"] == pytest.approx(w.sum()) and got["count"] == round(w.sum())
    assert np.allclose(got["mu"], np.average(x, axis=0, weights=w)) and np.allclose(got["sigma"], np.cov(x.T, aweights=w, ddof=0))
    # what a crashed compaction leaves is not looked at
    os.makedirs(f"{out}/upto=6/_temporary/0")
    assert packed_moments(P.read_decayed(spark, out, 3, DECAY, pilot=[4.0] * 3)).first() == got
    # an unrelated checkpoint starts at batch 0, which was merged long ago
    with pytest.raises(Exception, match="another checkpoint"):
        P.stream_decayed(spark.readStream.schema("global_index bigint, features array<double>").parquet(str(tmp_path / "source")), 3, out, str(tmp_path / "other"), DECAY).awaitTermination()


def test_statistics_do_not_change_by_compaction(spark, tmp_path):
    rnd = np.random.default_rng(1)
    batches = [rnd.normal(size=(4, 2)) for _ in range(6)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    arrive(spark, tmp_path, batches, lambda s: I.stream_moments(s, 2, out, state, every=1))
    assert len(folders(out)) < 6
    got = packed_moments(I.read_moments(spark, out, 2)).first()
    assert got["count"] == 24 and np.allclose(got["sigma"], np.cov(np.concatenate(batches).T))


@pytest.mark.parametrize("last", [1000, 9, 4, 2])
def test_newest_rows(spark, tmp_path, last):
    rnd = np.random.default_rng(2)
    batches = [rnd.normal(size=(n, 2)) for n in (5, 4, 7, 3, 4)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    arrive(spark, tmp_path, batches, lambda s: P.stream_newest(s, 2, out, state, last))
    x = np.concatenate(batches)[-last:]
    got = packed_moments(P.read_newest(spark, out, 2, last)).first()
    assert got["count"] == len(x) and np.allclose(got["mu"], x.mean(axis=0)) and np.allclose(got["sigma"], np.cov(x.T))
    assert last == 1000 or len(folders(f"{out}/rows")) <= 4
    if last == 1000:
        late = packed_moments(P.read_newest(spark, out, 2, last, since=3)).first()
        assert late["count"] == 7 and np.allclose(late["mu"], np.concatenate(batches[3:]).mean(axis=0))
