"""Run logs, metric documents and metric text. Broken lines are set aside, never fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from shardloom.functions.parsing import iso_timestamp, path_step

# Field names of the log events, all nullable; other fields stay in ``value``.
RUN_LOG_FIELDS = """
run string, type string, step bigint, created_at_utc string, elapsed_sec double, batch_size int,
optimizer_lr double, loss double, loss_finite boolean, grad_is_finite boolean, u_finite boolean,
du_finite boolean, target_finite boolean, target_requires_grad boolean, jvp_param_source string,
ema_used_for_target_jvp boolean, class_cond_injected boolean, r_t_sampling_granularity string,
backbone_forward_mode string, jvp_target_mode string, fd_audit_mode string,
grad_norm_before_clip double, realized_r_eq_t_fraction double, label_min int, label_max int,
label_unique_count int, peak_memory_mb double, optimizer_step_applied boolean, fd_eps double,
fd_rel_err_full_jvp double, du_norm double, fd_norm double, r_eq_t_count int, r_eq_t_total int,
no_nan_or_inf boolean, all_r_eq_t_degenerate_target_minus_v_max_abs double,
actual_rt_samples_target_minus_v_max_abs double, path string, num_samples int, sample_steps int,
use_ema boolean, sample_status string, sample_finite boolean, sample_mean double, sample_std double,
fid_status string, fid double
"""
_JSON = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "allowNonNumericNumbers": "true"}

METRIC_FIELDS = "fid double, mmd2 double, kid double, kid_x1000 double, num_images bigint, num_generated bigint, " \
    "num_real bigint, ref_features_used bigint, inception_mmd_rbf double, inception_kid_poly3 double"
METRIC_DOC_SCHEMA = (
    f"status string, elapsed_sec double, num_generated_total bigint, num_real_total bigint, {METRIC_FIELDS}, "
    f"metrics struct<{', '.join(f.strip().replace(' ', ':', 1) for f in METRIC_FIELDS.split(','))}>, "
    "generated_image_std double, real_image_std double, generated_image_summary struct<std:double>, "
    "real_image_summary struct<std:double>, _corrupt_record string"
)


def parse_run_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per line with the typed fields, the raw ``value`` and ``malformed``; works on streams too."""
    schema = f"{RUN_LOG_FIELDS.strip()}, _corrupt_record string"
    parsed = lines.withColumn("__j", F.from_json(F.col(column), schema, _JSON))
    out = parsed.select(*[c for c in lines.columns if c != column], F.col(column).alias("value"), "__j.*")
    # an object without a type is not an event either
    broken = F.col("_corrupt_record").isNotNull() | F.col("type").isNull()
    return out.withColumn("malformed", broken).withColumn(
        "created_at", iso_timestamp(F.col("created_at_utc"))
    ).drop("_corrupt_record")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed events of an append-only JSONL log (one file, a folder or a glob)."""
    return parse_run_log(spark.read.text(path).where(F.trim("value") != "")).where(~F.col("malformed"))


def read_malformed(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_log(spark.read.text(path).where(F.trim("value") != "")).where("malformed").select("value")


def read_metric_docs(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """One row per metric document; the step comes from the path. Unreadable documents are skipped."""
    docs = (
        spark.read.schema(METRIC_DOC_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob).options(**_JSON).json(path)
        .select("*", F.col("_metadata.file_path").alias("metrics_path"))
    )

    def pick(name: str, *fallback: str) -> Column:
        # a nested metrics object replaces the top level as a whole
        inner = F.when(F.col("metrics").isNotNull(), F.col(f"metrics.{name}")).otherwise(F.col(name))
        return F.coalesce(inner, *[F.col(f) for f in fallback]).alias(name)

    docs = docs.where(F.col("_corrupt_record").isNull())
    return docs.select(
        path_step(F.col("metrics_path")).alias("step"), pick("fid"), pick("mmd2"), pick("kid"), pick("kid_x1000"),
        pick("inception_mmd_rbf"), pick("inception_kid_poly3"), pick("num_images"),
        pick("num_generated", "num_generated_total"), pick("num_real", "num_real_total"),
        F.coalesce("generated_image_std", "generated_image_summary.std").alias("generated_image_std"),
        F.coalesce("real_image_std", "real_image_summary.std").alias("real_image_std"), "metrics_path",
    ).where(F.col("step").isNotNull())


# Accepted spellings of each metric, in order, and the free-text pattern.
FID_KEYS = ["fid", "FID", "fid50k", "FID50K"]
RECORD_KEYS = {
    "fid": FID_KEYS, "mmd2": ["mmd2", "mmd2_poly3"], "kid": ["kid"], "kid_x1000": ["kid_x1000"],
    "ref_features_used": ["ref_features_used"], "num_images": ["num_images"], "metrics_elapsed_sec": ["elapsed_sec"],
}
RECORD_MARKERS = ["fid", "FID", "mmd2", "kid"]
FID_TEXT = r"(?i)\bfid(?:50k)?\b[^0-9+\-.eE]*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"
# The same pattern over a line break: the name at the end of one line, the number at the head of another.
FID_OPEN = r"(?i)\bfid(?:50k)?\b[^0-9+\-.eE]*$"
FID_REST = r"^[^0-9+\-.eE]*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)"


def parse_metric_text(lines: DataFrame, by: list[str], line: str = "line", order: str = "line_no") -> DataFrame:
    """Metrics printed among free text, one row per ``by``.

    ``fid`` is the first JSON line with a non-null spelling of it, else the first match of the text pattern;
    the full record is the last JSON line that names fid, mmd2 or kid. Keys are matched exactly. The text pattern may
    reach over line breaks. The lines of one ``by`` are one step's output and are sorted in one task.
    """
    text = F.trim(line)
    fields = F.from_json(
        F.when(F.startswith(text, F.lit("{")), text), "map<string,string>", {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"}
    )
    rows = lines.select(*by, F.col(order).alias("__at"), text.alias("__text"), fields.alias("__map"))

    def first_key(names: list[str]) -> Column:
        return F.coalesce(*[F.try_element_at("__map", F.lit(n)).try_cast("double") for n in names])

    named = F.lit(False)
    for n in RECORD_MARKERS:
        named = named | F.coalesce(F.map_contains_key("__map", F.lit(n)), F.lit(False))
    found = F.regexp_extract("__text", FID_TEXT, 1)
    # A name at the end of a line takes its number from the first later line that has a character to stop at.
    later = Window.partitionBy(*by).orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last(F.when(F.col("__text").rlike(r"[0-9+\-.eE]"), F.col("__text")), ignorenulls=True).over(later)
    rows = rows.withColumn("__next", ahead)
    continued = F.when(F.col("__text").rlike(FID_OPEN), F.regexp_extract("__next", FID_REST, 1))
    found = F.when(found != "", found).otherwise(F.coalesce(continued, F.lit("")))
    rows = rows.withColumn("__fid", first_key(FID_KEYS)).withColumn("__named", named).withColumn(
        "__free", F.when(found != "", found.cast("double"))
    )
    record = F.struct(*[first_key(names).alias(out) for out, names in RECORD_KEYS.items()])
    # min_by and max_by skip rows whose ordering is null
    best = rows.groupBy(*by).agg(
        F.min_by("__fid", F.when(F.col("__fid").isNotNull(), F.col("__at"))).alias("json_fid"),
        F.min_by("__free", F.when(F.col("__free").isNotNull(), F.col("__at"))).alias("text_fid"),
        F.max_by(record, F.when(F.col("__named"), F.col("__at"))).alias("record"),
    )
    return best.select(
        *by, F.coalesce("json_fid", "text_fid").alias("parsed_fid"),
        *[F.col(f"record.{k}").alias(k) for k in RECORD_KEYS],
    )
