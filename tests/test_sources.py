import json
import struct

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual
from pyspark.sql.types import StructType
from pyspark.sql import functions as F

from shardloom.operators import registry as R, validation as V
from shardloom.sources import files, infer, logs, sinks, tables, tensor_shards as TS
from shardloom.spec import DatasetSpec

SPEC = DatasetSpec(2, 3, 4)


def write_raw(path, tensors, meta=None):
    """A shard file from ``name -> (dtype, shape, bytes)``."""
    header, at, body = ({"__metadata__": meta} if meta else {}), 0, b""
    for name, (dtype, shape, blob) in tensors.items():
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(blob)]}
        at, body = at + len(blob), body + blob
    head = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(head)) + head + body)


def labels(n):
    return ("I64", [n], np.arange(n, dtype="<i8").tobytes())


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(4).normal(size=(11, SPEC.size)).astype(np.float32)


@pytest.fixture(scope="module")
def samples(spark, data):
    rows = [(i, i * 2, i + 100, [float(v) for v in r], [float(v) for v in r[::-1]]) for i, r in enumerate(data)]
    return spark.createDataFrame(
        rows, "global_index bigint, label bigint, source_index bigint, latents array<float>, latents_flip array<float>"
    )


def test_shard_round_trip(spark, samples, data, tmp_path):
    facts = TS.write_tensor_shards(samples, str(tmp_path), SPEC, ["latents", "latents_flip"], shard_size=4, metadata={"a": 1})
    assert sorted(r["rows"] for r in facts.collect()) == [3, 4, 4]
    sums = {r["path"]: r["sha256"] for r in files.checksum(files.file_table(spark, str(tmp_path))).collect()}
    assert sums == {r["path"]: r["sha256"] for r in facts.collect()}
    for size in (None, 200):  # 200 bytes per partition cuts every file into several row ranges
        back = TS.read_tensor_shards(spark, str(tmp_path), SPEC, ["latents", "latents_flip"], partition_bytes=size)
        rows = back.orderBy("view", "shard", "local_index").collect()
        assert len(rows) == 22
        assert np.array_equal(np.array([r["tensor"] for r in rows[:11]], dtype=np.float32), data)
        assert np.array_equal(np.array([r["tensor"] for r in rows[11:]], dtype=np.float32), data[:, ::-1])
        assert [r["source_index"] for r in rows[:11]] == list(range(100, 111))
    headers = TS.read_shard_headers(spark, str(tmp_path)).orderBy("shard_index").collect()
    assert [h["num_samples"] for h in headers] == [4, 4, 3] and headers[2]["label_max"] == 20
    assert headers[0]["metadata"] == {"a": "1"} and headers[0]["latent_shape"] == [4, 2, 3, 4]


def test_bf16_widens_exactly(spark, samples, data, tmp_path):
    TS.write_tensor_shards(samples, str(tmp_path), SPEC, ["latents"], "BF16", shard_size=100)
    got = np.array([r["tensor"] for r in TS.read_tensor_shards(spark, str(tmp_path), SPEC).orderBy("local_index").collect()], dtype=np.float32)
    assert np.abs(got - data).max() <= np.abs(data).max() / 256
    assert not (got.view(np.uint32) & 0xFFFF).any()
    one = np.array([1.0, -2.5, 0.15625], dtype="<f4").view("<u4") >> 16
    write_raw(tmp_path / "x_shard000009.safetensors", {"labels": labels(1), "latents": ("BF16", [1, 3, 1, 1], one.astype("<u2").tobytes())})
    back = TS.read_tensor_shards(spark, str(tmp_path), DatasetSpec(3, 1, 1), glob="x_*").first()
    assert back["tensor"] == [1.0, -2.5, 0.15625] and back["shard"] == 9


def test_views_are_checked_before_reading(spark, samples, tmp_path):
    TS.write_tensor_shards(samples, str(tmp_path), SPEC, ["latents"], shard_size=100)
    with pytest.raises(Exception, match="has no tensors"):
        TS.read_tensor_shards(spark, str(tmp_path), SPEC, ["latents", "latents_flip"]).collect()
    assert TS.read_tensor_shards(spark, str(tmp_path), SPEC, ["auto"]).select("view").first()[0] == "latents"
    with pytest.raises(Exception, match="has shape"):
        TS.read_tensor_shards(spark, str(tmp_path), DatasetSpec(4, 3, 2)).collect()


class Counting:
    """A file handle that adds up the bytes read from it."""

    def __init__(self, handle, log):
        self.handle, self.log = handle, log

    def read(self, n=-1):
        got = self.handle.read(n)
        self.log.append(len(got))
        return got

    def __getattr__(self, name):
        return getattr(self.handle, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.handle.close()


def test_pushed_filters_skip_files_views_and_rows(spark, tmp_path, monkeypatch):
    spec = DatasetSpec(4, 8, 8)
    data = np.random.default_rng(1).normal(size=(1000, 256)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), (-r).tolist(), i % 7) for i, r in enumerate(data)], "global_index bigint, latents array<float>, latents_flip array<float>, label bigint")
    TS.write_tensor_shards(df, str(tmp_path), spec, ["latents", "latents_flip"], shard_size=250)
    opened, read = [], []

    def open_counted(path, real=TS.open_fs):
        fs, inner = real(path)

        class FS:
            def open_input_file(self, p):
                opened.append(p)
                return Counting(fs.open_input_file(p), read)

        return FS(), inner

    def rows(filters, **options):
        opened.clear(), read.clear()
        source = TS.TensorShardSource({"path": str(tmp_path), "views": "latents,latents_flip", "channels": "4", "height": "8", "width": "8", "push": "true", **options})
        schema = source.schema() if not isinstance(source.schema(), str) else StructType.fromDDL(source.schema())
        reader = source.reader(schema)
        assert list(reader.pushFilters(filters)) == filters
        with monkeypatch.context() as m:
            m.setattr(TS, "open_fs", open_counted)
            return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    whole = rows([])
    assert len(whole) == 2000 and len(opened) == 4 and sum(read) > 2 * data.nbytes
    some = rows([EqualTo(("shard",), 2), GreaterThan(("local_index",), 99), LessThanOrEqual(("local_index",), 120), In(("view",), ("latents_flip", "x"))])
    assert len(opened) == 1 and sum(read) < 25 * 1024 + 4000  # 22 rows of one view
    assert [r["local_index"] for r in some] == list(range(99, 121)) and np.allclose(some[1]["tensor"], -data[600])
    assert rows([In(("shard",), (9,))]) == [] and not opened and rows([EqualTo(("local_index",), 7), EqualTo(("local_index",), 8)]) == []
    few = rows([], columns="shard,label")
    assert len(few) == 2000 and set(few[0]) == {"shard", "label"} and sum(read) < 40_000  # no tensor is read
    before = spark.conf.get(TS.PUSHDOWN, "false")
    for on in ("true", "false"):
        spark.conf.set(TS.PUSHDOWN, on)
        back = TS.read_tensor_shards(spark, str(tmp_path), spec, ["latents", "latents_flip"]).where("shard >= 1 AND shard < 3 AND local_index = 5 AND label IS NOT NULL")
        assert sorted((r["shard"], r["view"]) for r in back.collect()) == [(s, v) for s in (1, 2) for v in ("latents", "latents_flip")]
    spark.conf.set(TS.PUSHDOWN, before)
    assert TS.read_tensor_shards(spark, str(tmp_path), spec, columns=["label", "path"]).groupBy("label").count().count() == 7
    with pytest.raises(Exception, match="no columns"):
        TS.read_tensor_shards(spark, str(tmp_path), spec, columns=["nothing"]).count()


def test_bad_files_are_quarantined(spark, tmp_path):
    good = ("F32", [2, 1, 1, 2], np.zeros(4, "<f4").tobytes())
    write_raw(tmp_path / "d_shard000000.safetensors", {"labels": labels(2), "latents": good})
    write_raw(tmp_path / "d_shard000001.safetensors", {"latents": good})
    write_raw(tmp_path / "d_shard000002.safetensors", {"labels": labels(3), "latents": good})
    write_raw(tmp_path / "d_shard000003.safetensors", {"labels": labels(2), "latents": ("F32", [2, 2], np.zeros(4, "<f4").tobytes())})
    write_raw(tmp_path / "d_shard000004.safetensors", {"labels": labels(2), "latents": ("F32", [2, 2, 1, 1], np.zeros(4, "<f4").tobytes())})
    write_raw(tmp_path / "d_shard000005.safetensors", {"labels": labels(0), "latents": ("F32", [0, 1, 1, 2], b"")})
    whole = (tmp_path / "d_shard000000.safetensors").read_bytes()
    (tmp_path / "d_shard000006.safetensors").write_bytes(whole[:-4])
    (tmp_path / "d_shard000007.safetensors").write_bytes(b"abc")
    (tmp_path / "plain.safetensors").write_bytes(whole)
    headers = TS.read_shard_headers(spark, str(tmp_path))
    checked = V.validate_shards(headers)
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in checked.collect()}
    assert got["d_shard000000.safetensors"] is None and got["d_shard000005.safetensors"] is None
    assert got["d_shard000001.safetensors"] == "missing keys [labels]"
    assert got["d_shard000002.safetensors"] == "labels/latents N mismatch"
    assert got["d_shard000003.safetensors"] == "latents must be [N,C,H,W]"
    assert got["d_shard000004.safetensors"] == "latent shape changed"
    assert "truncated" in got["d_shard000006.safetensors"] and "truncated" in got["d_shard000007.safetensors"]
    assert headers.where("path like '%plain%'").first()["shard_index"] == -1
    reg = R.shard_registry(TS.registry_rows(checked.where("status = 'ok'")))
    assert reg.count() == 2 and reg.agg(F.max("end")).first()[0] == 4


def test_publish_needs_a_passing_check(spark, samples, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_sharded(samples, path, 4)
    first = sinks.current_version(path)
    back = sinks.read_published(spark, path)
    assert back.count() == 11 and [r[0] for r in back.groupBy("shard").count().orderBy("shard").select("count").collect()] == [4, 4, 3]

    def refuse(_):
        raise ValueError("bad")

    with pytest.raises(ValueError):
        sinks.publish_table(samples, path, refuse)
    assert sinks.current_version(path) == first
    with pytest.raises(ValueError, match="distinct"):
        sinks.write_sharded(samples.unionByName(samples.limit(1)), path, 4)
    assert sinks.current_version(path) == first
    totals = sinks.manifest_totals(sinks.build_manifest(back, payload="latents")).first()
    assert totals["rows"] == 11 and totals["bytes"] == 11 * SPEC.size * 4 and totals["label_max"] == 20


def test_slices_skip_whole_shards(spark, samples, tmp_path):
    sinks.write_sharded(samples, str(tmp_path / "t"), 4)
    plan = sinks.read_published(spark, str(tmp_path / "t")).where("shard = 1 AND global_index >= 5")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "PushedFilters: [IsNotNull(global_index)" in plan


def test_source_position_over_several_files(spark, tmp_path):
    for name, lo, n in (("b", 5, 7), ("a", 0, 5), ("c", 12, 3)):
        spark.range(lo, lo + n, 1, 1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = tables.read_source_parquet(spark, str(tmp_path / "*.parquet"))
    assert all(r["id"] == r["source_index"] for r in got.collect()) and got.count() == 15


def test_feature_bank_records_truncation(spark):
    df = spark.range(10).withColumnRenamed("id", "global_index")
    assert tables.feature_bank(df, 4).count() == 4 and tables.feature_bank(df, 4).first()["truncated_to_max_ref"] == 4
    assert tables.feature_bank(df, 10).first()["truncated_to_max_ref"] is None and tables.feature_bank(df).count() == 10


def test_batches_are_full_and_models_load_once(spark, samples):
    def make():
        state = {"calls": 0}

        def fn(x):
            state["calls"] += 1
            return np.full((len(x), 2), [state["calls"], len(x)], dtype=np.float32)

        return fn

    df = samples.coalesce(1).withColumnRenamed("latents", "tensor").withColumn("view", F.lit("latents")).drop("latents_flip")
    rows = infer.batch_infer(df, make, SPEC, 4, ["latents"]).orderBy("global_index").collect()
    assert [r["features"] for r in rows] == [[1, 4]] * 4 + [[2, 4]] * 4 + [[3, 3]] * 3
    assert infer.batch_infer(df, make, SPEC, 4, ["samples"]).count() == 0
    with pytest.raises(Exception, match="returned 1 rows"):
        infer.batch_infer(df, lambda: lambda x: x[:1], SPEC, 4).collect()


def test_flip_of_bytes_and_arrays(spark):
    spec = DatasetSpec(1, 2, 3)
    df = spark.createDataFrame([(bytes([1, 2, 3, 4, 5, 6]), [1, 2, 3, 4, 5, 6])], "image binary, a array<int>")
    assert bytes(infer.hflip(df, spec).first()["image"]) == bytes([3, 2, 1, 6, 5, 4])
    assert infer.hflip(df, spec, "a").first()["a"] == [3, 2, 1, 6, 5, 4]


def test_log_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(
        '{"type": "train_step", "step": 1, "loss": NaN, "created_at_utc": "2026-05-28T01:02:03Z", "other": 5}\n'
        '{"type": "train_step", "step": 2, "loss": 0.5, "created_at_utc": "2026-05-28T01:02:04+00:00"}\n'
        '{"type": "train_st\n'
        "\n"
        '{"step": 3}\n'
        '{"type": "eval", "step": 2, "fid": null, "sample_status": "ok"}\n'
    )
    rows = logs.read_run_log(spark, str(tmp_path)).orderBy("type", "step").collect()
    assert [(r["type"], r["step"]) for r in rows] == [("eval", 2), ("train_step", 1), ("train_step", 2)]
    assert rows[1]["loss"] != rows[1]["loss"] and '"other": 5' in rows[1]["value"]
    assert (rows[2]["created_at"] - rows[1]["created_at"]).total_seconds() == 1
    assert logs.read_malformed(spark, str(tmp_path)).count() == 2


def test_metric_documents(spark, tmp_path):
    docs = {
        "step_0000010/inception_eval/m.json": {"metrics": {"fid": 3.5, "num_generated": 64}, "fid": 9.0, "generated_image_summary": {"std": 0.2}},
        "step_0000020/m.json": {"fid": 2.5, "num_generated_total": 5},
        "other/m.json": {"fid": 1.0},
    }
    for name, doc in docs.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
    (tmp_path / "step_0000030").mkdir()
    (tmp_path / "step_0000030" / "m.json").write_text("{broken")
    rows = {r["step"]: r for r in logs.read_metric_docs(spark, str(tmp_path)).collect()}
    assert set(rows) == {10, 20}
    assert rows[10]["fid"] == 3.5 and rows[10]["generated_image_std"] == 0.2 and rows[20]["num_generated"] == 5


@pytest.mark.parametrize(
    "text, parsed, record",
    [
        ('x\n{"FID": 3, "fid": null}\n{"fid": 4, "mmd2_poly3": 0.5}', 3.0, (4.0, 0.5)),
        ('{"fid50k": 7}\nFID: 2', 7.0, (None, None)),
        ("final FID = 1.5e1 done\nfid 2", 15.0, (None, None)),
        ("FID50K: .5", 0.5, (None, None)),
        ("FID score: 12", None, (None, None)),
        ('{"kid": 0.1}\n{broken\nfid: -3', -3.0, (None, None)),
        ("nothing", None, (None, None)),
    ],
)
def test_metric_text(spark, text, parsed, record):
    df = spark.createDataFrame([("k", i, line) for i, line in enumerate(text.split("\n"))], "job string, line_no int, line string")
    row = logs.parse_metric_text(df, ["job"]).first()
    assert row["parsed_fid"] == parsed and (row["fid"], row["mmd2"]) == record


def test_selection_denies_before_it_allows(spark):
    df = spark.createDataFrame([("a/x.bin", 5), ("a/x.tmp", 6), ("b/y.bin", 7)], "path string, bytes bigint")
    out = files.publish_selection(df, ["^a/"], [r"\.tmp$"])
    assert [r["path"] for r in out.where("published").collect()] == ["a/x.bin"]
    assert {r["published"]: r["bytes"] for r in files.selection_summary(out).collect()} == {True: 5, False: 13}


def test_listed_paths_keep_their_scheme(tmp_path):
    (tmp_path / "a.bin").write_bytes(b"123")
    for lead in ("", "file:", "file://"):
        assert files.list_files(f"{lead}{tmp_path}/") == [(f"{lead}{tmp_path}/a.bin", 3)]
    assert files.list_files(str(tmp_path / "missing")) == []
