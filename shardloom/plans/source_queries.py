"""Sources and sinks: data derived from the tables is written, read back and summarised."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shardloom.operators.registry import shard_registry, with_global_index
from shardloom.operators.validation import verify_dataset
from shardloom.plans.catalog import query, rounded
from shardloom.plans.views import SHARD, SPEC, Tables
from shardloom.session import materialize, scratch_dir
from shardloom.sources import files, infer, logs, sinks, tables, tensor_shards

ROW_SUMS = """round(list_sum(CAST(tensor AS DOUBLE[])), 6) AS total, round(tensor[1], 6) AS first, round(tensor[64], 6) AS last"""


def _write_latents(t: Tables, dtype: str = "F32") -> str:
    """The latent table as shard files of 64 samples with both views."""
    path = scratch_dir(t.spark, "shards")
    flip = F.transform(F.reverse("tensor"), lambda v: (v / 2).cast("float"))
    rows = t.latents.withColumn("latents", F.col("tensor")).withColumn("latents_flip", flip)
    rows = rows.withColumn("source_index", F.col("global_index") * 3)
    tensor_shards.write_tensor_shards(rows, path, SPEC, ["latents", "latents_flip"], dtype, SHARD, metadata={"kind": "latents"})
    return path


@query(
    "read_tensor_shards",
    """SELECT CAST(shard AS INTEGER) AS shard, local_index, view, label, global_index * 3 AS source_index,
      round(list_sum(CAST(tensor AS DOUBLE[])) / div, 6) AS total,
      round(CAST(CASE WHEN div = 1 THEN tensor[1] ELSE tensor[64] / 2 END AS DOUBLE), 6) AS first
    FROM latents, (VALUES ('latents', 1), ('latents_flip', 2)) v(view, div)""",
    ("latents",),
)
def _(t: Tables):
    back = tensor_shards.read_tensor_shards(t.spark, _write_latents(t), SPEC, ["latents", "latents_flip"], partition_bytes=24_576)
    total = F.aggregate("tensor", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return rounded(
        back.select("shard", "local_index", "view", "label", "source_index", total.alias("total"), F.get("tensor", F.lit(0)).alias("first"))
    )


@query(
    "read_tensor_slice",
    """SELECT CAST(shard AS INTEGER) AS shard, local_index, label, round(CAST(tensor[64] / 2 AS DOUBLE), 6) AS first
    FROM latents WHERE shard IN (1, 3, 4) AND local_index > 9 AND local_index <= 40""",
    ("latents",),
)
def _(t: Tables):
    """A slice of some shards: the other files are not opened, of these only the rows and the view asked for are read."""
    path, before = _write_latents(t), t.spark.conf.get(tensor_shards.PUSHDOWN, "false")
    t.spark.conf.set(tensor_shards.PUSHDOWN, "true")
    try:
        back = tensor_shards.read_tensor_shards(t.spark, path, SPEC, ["latents", "latents_flip"], columns=["shard", "local_index", "view", "tensor", "label"])
        wanted = back.where("shard IN (1, 3, 4) AND local_index > 9 AND local_index <= 40 AND view = 'latents_flip'")
        return materialize(rounded(wanted.select("shard", "local_index", "label", F.get("tensor", F.lit(0)).alias("first"))), "slice")
    finally:
        t.spark.conf.set(tensor_shards.PUSHDOWN, before)


@query(
    "read_shard_headers",
    """SELECT CAST(shard AS INTEGER) AS shard_index, count(*) AS num_samples, count(*) || ',4,4,4' AS latent_shape,
      true AS has_latents_flip, 'I64' AS label_dtype, min(label) AS label_min, max(label) AS label_max,
      'latents' AS kind, CAST(NULL AS VARCHAR) AS read_error FROM latents GROUP BY shard""",
    ("latents",),
)
def _(t: Tables):
    headers = tensor_shards.read_shard_headers(t.spark, _write_latents(t))
    return headers.select(
        "shard_index", "num_samples", F.array_join("latent_shape", ",").alias("latent_shape"), "has_latents_flip",
        "label_dtype", "label_min", "label_max", F.try_element_at("metadata", F.lit("kind")).alias("kind"), "read_error",
    )


@query(
    "verify_written_shards",
    """SELECT count(DISTINCT shard) AS num_files, count(*) AS total_samples, true AS contiguous_shards, true AS shape_ok,
      true AS dtype_ok, true AS total_ok, true AS ok FROM latents""",
    ("latents",),
)
def _(t: Tables):
    """Shard files written, then verified from their headers alone."""
    headers = tensor_shards.read_shard_headers(t.spark, _write_latents(t, "BF16"))
    return verify_dataset(headers, t.latents.count(), SPEC.shape).drop("total_bytes")


@query(
    "index_written_shards",
    "SELECT global_index, CAST(shard AS INTEGER) AS shard, local_index, label FROM latents", ("latents",),
)
def _(t: Tables):
    """Headers to registry to global index, from files."""
    path = _write_latents(t)
    headers = tensor_shards.registry_rows(tensor_shards.read_shard_headers(t.spark, path))
    samples = tensor_shards.read_tensor_shards(t.spark, path, SPEC)
    return with_global_index(samples, shard_registry(headers)).select("global_index", "shard", "local_index", "label")


def _write_images(t: Tables) -> str:
    """The images as shard files of 64."""
    path = scratch_dir(t.spark, "images")
    rows = t.images.withColumnRenamed("image", "images").withColumn("source_index", F.col("global_index"))
    tensor_shards.write_tensor_shards(rows, path, SPEC, ["images"], "U8", SHARD, prefix="images_shard")
    return path


@query(
    "read_image_shards",
    """SELECT global_index // 64 * 64 + global_index % 64 AS source_index, label, CAST(sum(p) AS BIGINT) AS total,
      CAST(max(p) FILTER (pos = 0) AS INTEGER) AS first FROM pixels GROUP BY global_index, label""",
    ("pixels",),
)
def _(t: Tables):
    back = tensor_shards.read_image_shards(t.spark, _write_images(t), SPEC)

    @F.pandas_udf("bigint")
    def total(images):
        return images.map(sum)

    return back.select("source_index", "label", total("image").alias("total"), F.conv(F.hex(F.substring("image", 1, 1)), 16, 10).cast("int").alias("first"))


def _write_log(t: Tables) -> str:
    """The run log as JSONL files, with a broken line after every error event."""
    path = scratch_dir(t.spark, "log")
    utc = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zone = F.when(F.col("k") % 2 == 0, "Z").otherwise("+00:00")
    loss = F.when(F.col("k") == 98, F.lit(float("nan"))).otherwise(F.col("loss"))
    fields = t.log.select(
        "type", "step", F.col("run").cast("string").alias("run"), "batch_size", loss.alias("loss"), "loss_finite",
        "peak_memory_mb", F.concat(utc, zone).alias("created_at_utc"), F.col("k").alias("extra_field"),
    )
    text = F.regexp_replace(F.to_json(F.struct("*")), '"NaN"', "NaN")
    lines = F.when(F.col("type") == "fd_audit", F.array(text, F.lit('{"type": "train_st'))).otherwise(F.array(text))
    fields.select(F.explode(lines).alias("value")).write.text(path)
    return path


@query(
    "read_run_log",
    """SELECT CAST(run AS VARCHAR) AS run, type, count(*) AS n, CAST(sum(step) AS BIGINT) AS steps,
      count(*) FILTER (k = 98) AS nan_losses, round(coalesce(sum(loss) FILTER (k <> 98), 0), 4) AS loss,
      strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') AS last_at FROM runlog GROUP BY run, type""",
    ("runlog",),
)
def _(t: Tables):
    log = logs.read_run_log(t.spark, _write_log(t))
    out = log.groupBy("run", "type").agg(
        F.count("*").alias("n"), F.sum("step").alias("steps"), F.count_if(F.isnan("loss")).alias("nan_losses"),
        F.coalesce(F.sum(F.when(~F.isnan("loss"), F.col("loss"))), F.lit(0.0)).alias("loss"),
        F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_at"),
    )
    return rounded(out, 4)


@query("read_malformed", "SELECT count(*) AS broken FROM runlog WHERE type = 'fd_audit'", ("runlog",))
def _(t: Tables):
    return logs.read_malformed(t.spark, _write_log(t)).agg(F.count("*").alias("broken"))


@query(
    "read_metric_docs",
    """SELECT (date_diff('day', DATE '2024-01-01', ts::DATE))::BIGINT AS step, round(avg(value), 6) AS fid, count(*) AS num_generated
    FROM events GROUP BY step""",
)
def _(t: Tables):
    """One JSON document per day, every other one with its metrics nested."""
    path = scratch_dir(t.spark, "docs")
    daily = t.read("events").groupBy(F.datediff("ts", F.lit("2024-01-01")).alias("d")).agg(
        F.avg("value").alias("fid"), F.count("*").alias("n")
    )
    nested = F.col("d") % 2 == 0
    docs = daily.select(
        F.format_string("step_%07d", "d").alias("doc"),
        F.when(nested, F.struct("fid", F.col("n").alias("num_generated"))).alias("metrics"),
        F.when(~nested, F.col("fid")).alias("fid"), F.when(~nested, F.col("n")).alias("num_generated_total"),
    )
    docs.repartition("doc").write.partitionBy("doc").json(path)
    return rounded(logs.read_metric_docs(t.spark, path).select("step", "fid", "num_generated"))


@query(
    "parse_metric_text",
    r"""WITH s AS (SELECT doc_id, n_chars, n_chars % 4 AS kind FROM documents)
    SELECT doc_id, CASE kind WHEN 0 THEN n_chars / 100.0::DOUBLE WHEN 1 THEN n_chars / 10.0::DOUBLE WHEN 2 THEN NULL ELSE 7.5 END AS parsed_fid,
      CASE kind WHEN 0 THEN 2.0 WHEN 3 THEN 7.5 END::DOUBLE AS fid, CASE WHEN kind = 0 THEN 0.25 WHEN kind = 3 THEN 0.5 END::DOUBLE AS mmd2 FROM s""",
)
def _(t: Tables):
    """Output of four kinds of jobs, with each document's length as the value and its text as noise."""
    kind, n = F.col("n_chars") % 4, F.col("n_chars")
    noise = F.regexp_replace("text", r"(?i)fid|[{}\n\r]", " ")
    lines = (
        F.when(kind == 0, F.array(noise, F.concat(F.lit('{"fid": '), (n / 100.0).cast("string"), F.lit("}")), F.lit('{"FID": 2.0, "mmd2_poly3": 0.25}')))
        .when(kind == 1, F.array(noise, F.concat(F.lit("final FID: "), (n / 10.0).cast("string")), F.lit("fid: 1.0")))
        .when(kind == 2, F.array(noise, F.lit("FID score: 12"), F.lit("{broken")))
        .otherwise(F.array(noise, F.lit('{"fid": null, "fid50k": 7.5, "mmd2": 0.5}')))
    )
    rows = t.read("documents").select("doc_id", F.posexplode(lines).alias("line_no", "line"))
    return logs.parse_metric_text(rows, ["doc_id"]).select("doc_id", "parsed_fid", "fid", "mmd2")


@query("read_source_parquet", "SELECT event_id AS source_index, event_id, user_id FROM events")
def _(t: Tables):
    """``events`` rows carry their own position, which the reader must recover."""
    return tables.read_source_parquet(t.spark, f"{t.sf_dir}/events.parquet").select("source_index", "event_id", "user_id")


@query(
    "write_sharded",
    """SELECT global_index // 100 AS shard, count(*) AS "rows", count(*) * 256 AS bytes, min(global_index) AS first_index,
      max(global_index) AS last_index, min(label) AS label_min, max(label) AS label_max FROM latents GROUP BY 1""",
    ("latents",),
)
def _(t: Tables):
    path = scratch_dir(t.spark, "sharded")
    sinks.write_sharded(t.latents.drop("shard", "local_index"), path, 100)
    manifest = sinks.build_manifest(sinks.read_published(t.spark, path))
    return manifest.withColumn("shard", F.col("shard").cast("bigint")).drop("digest_xor", "digest_sum")


@query(
    "build_manifest",
    """SELECT source, count(*) AS "rows", CAST(sum(length(text)) AS BIGINT) AS bytes, min(doc_id) AS first_index, max(doc_id) AS last_index,
      min(n_chars % 10) AS label_min, max(n_chars % 10) AS label_max FROM documents GROUP BY source""",
)
def _(t: Tables):
    docs = t.read("documents").select(
        F.col("source").alias("shard"), "doc_id", (F.col("n_chars") % 10).alias("label"), F.split("text", "").alias("chars")
    )
    manifest = sinks.build_manifest(docs, "doc_id", "chars", 1)
    return manifest.withColumnRenamed("shard", "source").drop("digest_xor", "digest_sum")


@query(
    "manifest_totals",
    """SELECT count(DISTINCT shard) AS shards, count(*) AS "rows", count(*) * 256 AS bytes, min(global_index) AS first_index,
      max(global_index) AS last_index, min(label) AS label_min, max(label) AS label_max FROM latents""",
    ("latents",),
)
def _(t: Tables):
    return sinks.manifest_totals(sinks.build_manifest(t.latents))


@query(
    "publish_selection",
    """WITH f AS (SELECT source || '/' || lang || '/' || doc_id || CASE WHEN n_chars % 5 = 0 THEN '.tmp' ELSE '.bin' END AS path, n_chars AS bytes FROM documents)
    SELECT path, bytes, (regexp_matches(path, '^src[0-4]/') OR regexp_matches(path, '/en/')) AND NOT regexp_matches(path, '[.]tmp$')
      AND NOT regexp_matches(path, '/de/') AS published FROM f""",
)
def _(t: Tables):
    return files.publish_selection(_file_rows(t), ["^src[0-4]/", "/en/"], ["[.]tmp$", "/de/"])


def _file_rows(t: Tables) -> DataFrame:
    ending = F.when(F.col("n_chars") % 5 == 0, ".tmp").otherwise(".bin")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ending))
    return t.read("documents").select(path.alias("path"), F.col("n_chars").alias("bytes"))


@query(
    "selection_summary",
    """WITH f AS (SELECT source || '/' || lang || '/' || doc_id || CASE WHEN n_chars % 5 = 0 THEN '.tmp' ELSE '.bin' END AS path, n_chars AS bytes FROM documents)
    SELECT regexp_matches(path, '^src') AND NOT regexp_matches(path, '[.]tmp$') AS published, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes
    FROM f GROUP BY 1""",
)
def _(t: Tables):
    return files.selection_summary(files.publish_selection(_file_rows(t), ["^src"], ["[.]tmp$"]))


@query("checksum")
def _(t: Tables):
    """SHA-256 of the shard files written from the latent table."""
    path = _write_latents(t)
    return files.checksum(files.file_table(t.spark, path)).select("name", "bytes", "sha256")


def _little_endian(value: str) -> str:
    """Hex digits of the eight bytes of a whole number."""
    return " || ".join(f"printf('%02x', ({value} >> {8 * k}) & 255)" for k in range(8))


@query(
    "checksum_images",
    f"""WITH i AS (SELECT global_index, any_value(label) AS label, string_agg(printf('%02x', p), '' ORDER BY pos) AS x FROM pixels GROUP BY global_index),
    s AS (SELECT global_index // {SHARD} AS shard, count(*) AS n, string_agg(x, '' ORDER BY global_index) AS images,
      string_agg({_little_endian("label")}, '' ORDER BY global_index) AS labels, string_agg({_little_endian("global_index")}, '' ORDER BY global_index) AS ids
      FROM i GROUP BY shard),
    h AS (SELECT *, '{{"images":{{"dtype":"U8","shape":[' || n || ',4,4,4],"data_offsets":[0,' || n * 64 || ']}},"labels":{{"dtype":"I64","shape":[' || n
      || '],"data_offsets":[' || n * 64 || ',' || n * 72 || ']}},"source_indices":{{"dtype":"I64","shape":[' || n || '],"data_offsets":[' || n * 72 || ','
      || n * 80 || ']}}}}' AS head FROM s),
    b AS (SELECT shard, unhex({_little_endian("(length(head) + (8 - length(head) % 8) % 8)")} || hex(encode(head || repeat(' ', (8 - length(head) % 8) % 8)))
      || images || labels || ids) AS bytes FROM h)
    SELECT printf('images_shard%06d.safetensors', shard) AS name, octet_length(bytes) AS bytes, sha256(bytes) AS sha256 FROM b""",
    ("pixels",),
)
def _(t: Tables):
    """SHA-256 of image shard files, whose bytes SQL can build: header, pixels, labels and indices."""
    return files.checksum(files.file_table(t.spark, _write_images(t), "*.safetensors")).select("name", "bytes", "sha256")


@query(
    "batch_infer",
    "SELECT global_index, label, CAST(channel AS BIGINT) AS channel, round(avg(v), 5) AS value FROM elements GROUP BY ALL",
    ("elements",),
)
def _(t: Tables):
    pooled = infer.batch_infer(t.views, infer.pooled_mean, SPEC, 48, ["latents"], out_type="double")
    long = pooled.select("global_index", "label", F.posexplode("features").alias("channel", "value"))
    return rounded(long.withColumn("channel", F.col("channel").cast("bigint")), 5)


@query(
    "hflip", "SELECT global_index, pos // 4 * 4 + 3 - pos % 4 AS pos, p FROM pixels", ("pixels",),
)
def _(t: Tables):
    return infer.hflip(t.images, SPEC).select("global_index", F.posexplode("image").alias("pos", "p")).select(
        "global_index", F.col("pos").cast("bigint").alias("pos"), F.col("p").cast("bigint").alias("p")
    )
