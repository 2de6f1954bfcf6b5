"""Role views over the given tables: latent table, paired reconstruction, run log, shard headers.

Each view exists as a DataFrame here and as a SQL common table expression, so both sides of a check agree.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from shardloom.functions.ordering import range_bucket, running_before
from shardloom.operators.registry import shard_registry
from shardloom.operators.transforms import quantize_u8
from shardloom.spec import DatasetSpec

SPEC = DatasetSpec(4, 4, 4)
SHARD = 64


class Tables:
    """The given tables in ``sf_dir`` and the views on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # the tables hold UTC wall-clock times
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def latents(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("global_index"), F.floor(F.col("vec_id") / SHARD).alias("shard"),
            (F.col("vec_id") % SHARD).alias("local_index"), F.col("embedding").alias("tensor"),
            F.col("label").cast("bigint").alias("label"),
        )

    @cached_property
    def views(self) -> DataFrame:
        """Long form: every sample as ``latents`` and, mirrored, as ``latents_flip`` at half strength."""
        flip = self.latents.withColumn("tensor", F.transform(F.reverse("tensor"), lambda v: (v / 2).cast("float")))
        return self.latents.withColumn("view", F.lit("latents")).unionByName(
            flip.withColumn("view", F.lit("latents_flip"))
        )

    @cached_property
    def features(self) -> DataFrame:
        return self.latents.select("global_index", "label", F.col("tensor").alias("features"))

    def recon(self, digits: int) -> DataFrame:
        """Every sample rounded to a few decimals: the stand-in for a reconstruction."""
        rounded = F.transform("tensor", lambda v: F.round(v.cast("double"), digits))
        return self.latents.withColumn("tensor", rounded)

    def recon_features(self, digits: int) -> DataFrame:
        return self.recon(digits).select("global_index", "label", F.col("tensor").alias("features"))

    @cached_property
    def images(self) -> DataFrame:
        return quantize_u8(self.latents, "minus1_1").drop("tensor")

    def recon_images(self, digits: int) -> DataFrame:
        return quantize_u8(self.recon(digits), "minus1_1").drop("tensor")

    @cached_property
    def log(self) -> DataFrame:
        """``events`` as a run log: run = user, step = position of the event in the run."""
        e = self.read("events").withColumn("created_at", F.col("ts").cast("timestamp"))
        numbered = running_before(
            e, ["created_at", "event_id"], range_bucket(e, "created_at"), group=["user_id"], name="ahead"
        )
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
        kind = (
            F.when(F.col("event_type") == "error", "fd_audit").when(F.col("event_type") == "signup", "eval")
            .when(F.col("event_type") == "purchase", "checkpoint").otherwise("train_step")
        )
        return numbered.select(
            F.col("user_id").alias("run"), (F.col("ahead") + 1).alias("step"), kind.alias("type"), "event_id",
            "event_type", k.alias("k"), F.col("value").alias("loss"), "created_at", F.lit(96).alias("batch_size"),
            ((k + 10) / 200.0).alias("step_sec"), (k * 10 + 1000.0).alias("peak_memory_mb"),
            (F.col("value") < 400).alias("loss_finite"), (k < 99).alias("grad_is_finite"),
            (k / 100.0).alias("realized_r_eq_t_fraction"), (k / 5000.0).alias("fd_rel_err_full_jvp"),
            (k / 4e8).alias("all_r_eq_t_degenerate_target_minus_v_max_abs"),
            F.when(k % 2 == 0, "ok").otherwise("timeout").alias("sample_status"),
        )

    @cached_property
    def headers(self) -> DataFrame:
        """One shard header per order of ``lineitem``, some of them broken on purpose."""
        rows = self.read("lineitem").groupBy("l_orderkey").agg(
            F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.min("l_returnflag").alias("flag")
        )
        n = F.col("n")
        good = F.array(n, F.lit(4).cast("bigint"), F.lit(4).cast("bigint"), F.lit(4).cast("bigint"))
        wide = F.array(n, F.lit(4).cast("bigint"), F.lit(4).cast("bigint"), F.lit(8).cast("bigint"))
        latent = F.when(n >= 9, wide).otherwise(good)
        return rows.select(
            F.lpad(F.col("l_orderkey").cast("string"), 10, "0").alias("path"), F.col("l_orderkey").alias("shard_index"),
            n.alias("num_samples"), (n * 256).alias("bytes"), latent.alias("latent_shape"),
            F.when(n % 2 == 0, latent).alias("flip_shape"),
            F.when((F.col("flag") == "R") & (n == 1), F.array(n, n)).otherwise(F.array(n)).alias("label_shape"),
            F.lit("I64").alias("label_dtype"),
            F.when(F.col("q") > 300, "truncated file").alias("read_error"),
        )

    @cached_property
    def registry(self) -> DataFrame:
        return shard_registry(self.headers)


# SQL twins of the views.
CTES = {
    "latents": """latents AS (SELECT vec_id AS global_index, vec_id // 64 AS shard, vec_id % 64 AS local_index,
        embedding AS tensor, CAST(label AS BIGINT) AS label FROM embeddings)""",
    "elements": """elements AS (SELECT vec_id AS global_index, vec_id // 64 AS shard, CAST(label AS BIGINT) AS label,
        generate_subscripts(embedding, 1) - 1 AS pos, (generate_subscripts(embedding, 1) - 1) // 16 AS channel,
        CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)""",
    "flips": """flips AS (SELECT global_index, shard, label, 63 - pos AS pos, (63 - pos) // 16 AS channel, v / 2 AS v
        FROM elements)""",
    "pixels": """pixels AS (SELECT global_index, label, pos, channel,
        CAST(round_even((greatest(-1.0, least(1.0, v)) + 1.0) * 127.5, 0) AS BIGINT) AS p FROM elements)""",
    "runlog": """runlog AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
        CASE event_type WHEN 'error' THEN 'fd_audit' WHEN 'signup' THEN 'eval' WHEN 'purchase' THEN 'checkpoint'
        ELSE 'train_step' END AS type, event_id, event_type, k, value AS loss, ts AS created_at, 96 AS batch_size,
        (k + 10) / 200.0::DOUBLE AS step_sec, k * 10 + 1000.0::DOUBLE AS peak_memory_mb, value < 400 AS loss_finite,
        k < 99 AS grad_is_finite, k / 100.0::DOUBLE AS realized, k / 5000.0::DOUBLE AS fd_rel_err,
        k / 4e8::DOUBLE AS degenerate, CASE WHEN k % 2 = 0 THEN 'ok' ELSE 'timeout' END AS sample_status
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))""",
    "headers": """headers AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS path, l_orderkey AS shard_index,
        count(*) AS num_samples, sum(l_quantity) AS q, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey)""",
    "registry": """registry AS (SELECT path, num_samples,
        CAST(sum(num_samples) OVER (ORDER BY path) AS BIGINT) - num_samples AS "start",
        CAST(sum(num_samples) OVER (ORDER BY path) AS BIGINT) AS "end",
        row_number() OVER (ORDER BY path) - 1 AS shard_pos FROM headers)""",
    "valid": """valid AS (SELECT path, num_samples, CASE WHEN q > 300 THEN 'truncated file'
        WHEN flag = 'R' AND num_samples = 1 THEN 'labels must be [N]'
        WHEN num_samples >= 9 THEN 'latent shape changed' END AS error FROM headers)""",
}
_NEEDS = {"flips": ["elements"], "pixels": ["elements"], "registry": ["headers"], "valid": ["headers"]}


def with_ctes(body: str, *names: str) -> str:
    """``WITH`` the named views (and what they need), then any CTEs and the query in ``body``."""
    order: list[str] = []
    for name in names:
        for part in (*_NEEDS.get(name, []), name):
            if part not in order:
                order.append(part)
    body = body.strip()
    if not order:
        return body
    head = "WITH " + ",\n".join(CTES[n] for n in order)
    return f"{head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"{head}\n{body}"
