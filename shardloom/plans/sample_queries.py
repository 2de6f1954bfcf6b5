"""Registry, selection, sampling and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.functions.ordering import bucket_in_groups, ordered_bucket, running_before
from shardloom.operators import registry, sampling, validation
from shardloom.plans.catalog import query, rounded
from shardloom.plans.views import Tables

REG = ["path", "num_samples", "start", "end", "source_total_seen"]


@query("shard_registry", 'SELECT path, num_samples, "start", "end", "end" AS source_total_seen FROM registry', ("registry",))
def _(t: Tables):
    return t.registry.select(*REG)


@query(
    "shard_registry_cut",
    """SELECT path, least(num_samples, 5000 - "start") AS num_samples, "start", least("end", 5000) AS "end",
      "end" AS source_total_seen FROM registry WHERE "start" < 5000 AND shard_pos < 3000""",
    ("registry",),
)
def _(t: Tables):
    return registry.shard_registry(t.headers, max_shards=3000, max_samples=5000).select(*REG)


@query("validate_shards", "SELECT path, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error FROM valid", ("valid",))
def _(t: Tables):
    return validation.validate_shards(t.headers).select("path", "status", "error")


@query(
    "select_shards",
    """WITH spaced AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 31.0::DOUBLE, 0) AS BIGINT) AS shard_pos
      FROM (SELECT count(*) AS n FROM registry), (SELECT unnest(range(32)) AS i))
    SELECT path, shard_pos FROM registry WHERE shard_pos IN (SELECT shard_pos FROM spaced ORDER BY shard_pos LIMIT 20)""",
    ("registry",),
)
def _(t: Tables):
    return registry.select_shards(t.registry, linspace=32, max_shards=20).select("path", "shard_pos")


@query(
    "locate",
    """WITH asked AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_custkey - 1 ELSE o_orderkey * 2 END AS global_index
      FROM orders), total AS (SELECT max("end") AS n FROM registry),
    placed AS (SELECT *, CASE WHEN global_index < 0 THEN global_index + n ELSE global_index END AS g FROM asked, total)
    SELECT o_orderkey, global_index, path, g - "start" AS local_index FROM placed ASOF JOIN registry ON g >= "start" """,
    ("registry",),
)
def _(t: Tables):
    asked = t.read("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", -F.col("o_custkey") - 1).otherwise(F.col("o_orderkey") * 2).alias("global_index"),
    )
    return registry.locate(asked, t.registry)


def _items(t: Tables):
    """``lineitem`` as samples: shard path and position inside the shard."""
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    lines = t.read("lineitem").select("l_orderkey", *order)
    bucket = bucket_in_groups(lines, ["l_orderkey"], F.col("l_linenumber"))
    numbered = running_before(lines, order, bucket, group=["l_orderkey"], name="local_index")
    return numbered.withColumn("path", F.lpad(F.col("l_orderkey").cast("string"), 10, "0"))


ITEMS = """items AS (SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS path, l_partkey, l_suppkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS local_index,
    l_orderkey FROM lineitem)"""


@query(
    "with_global_index",
    f"""WITH {ITEMS} SELECT path, local_index, "start" + local_index AS global_index, l_partkey
    FROM items JOIN registry USING (path)""",
    ("registry",),
)
def _(t: Tables):
    return registry.with_global_index(_items(t), t.registry).select("path", "local_index", "global_index", "l_partkey")


@query(
    "dataset_summary",
    """WITH t AS (SELECT count(*) AS num_shards, CAST(sum(num_samples) AS BIGINT) AS total_samples FROM registry)
    SELECT num_shards, total_samples, total_samples AS source_total_seen, total_samples = 60000 AS ready,
      (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM registry ORDER BY path LIMIT 8)) AS first_shards,
      (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM registry ORDER BY path DESC LIMIT 8)) AS last_shards,
      (SELECT count(*) FROM valid WHERE error IS NOT NULL) AS skipped_count,
      (SELECT coalesce(string_agg(path, ',' ORDER BY path), '') FROM (SELECT path FROM valid WHERE error IS NOT NULL ORDER BY path LIMIT 8)) AS skipped_first
    FROM t""",
    ("registry", "valid"),
)
def _(t: Tables):
    bad = validation.quarantine(validation.validate_shards(t.headers))
    return registry.dataset_summary(t.registry, bad, expected=60_000)


@query(
    "source_total_seen",
    """SELECT CAST(max("end") AS BIGINT) AS source_total_seen, CAST(least(max("end"), 5000) AS BIGINT) AS total_samples
    FROM registry WHERE "start" < 5000""",
    ("registry",),
)
def _(t: Tables):
    return registry.source_total_seen(registry.shard_registry(t.headers, max_samples=5000))


@query(
    "cache_inventory",
    """WITH f AS (SELECT source AS cache, n_chars AS bytes, lang = 'de' AS tmp, n_chars < 200 AS bad FROM documents)
    SELECT cache, count(*) FILTER (NOT tmp AND NOT bad) AS files,
      CAST(coalesce(sum(bytes % 97) FILTER (NOT tmp AND NOT bad), 0) AS BIGINT) AS samples,
      CAST(coalesce(sum(bytes) FILTER (NOT tmp AND NOT bad), 0) AS BIGINT) AS bytes,
      count(*) FILTER (tmp) AS tmp_files, count(*) FILTER (bad) AS bad_files,
      round(coalesce(sum(bytes) FILTER (NOT tmp AND NOT bad), 0) / 1e9, 9) AS gb,
      round(coalesce(sum(bytes % 97) FILTER (NOT tmp AND NOT bad), 0) / 5000, 9) AS completeness,
      CAST(greatest(5000 - coalesce(sum(bytes % 97) FILTER (NOT tmp AND NOT bad), 0), 0) AS BIGINT) AS remaining,
      coalesce(sum(bytes % 97) FILTER (NOT tmp AND NOT bad), 0) = 5000 AND count(*) FILTER (tmp) = 0
        AND count(*) FILTER (bad) = 0 AS complete
    FROM f GROUP BY cache""",
)
def _(t: Tables):
    files = t.read("documents").select(
        F.col("source").alias("cache"), F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("bytes"),
        (F.col("lang") == "de").alias("is_tmp"), (F.col("n_chars") < 200).alias("is_bad"),
        (F.col("n_chars") % 97).alias("num_samples"),
    )
    return rounded(registry.cache_inventory(files, expected=5000), 9)


@query("slice_samples", "SELECT global_index, shard, local_index, label FROM latents WHERE global_index >= 100 AND global_index < 350", ("latents",))
def _(t: Tables):
    return sampling.slice_samples(t.latents, 100, 250).select("global_index", "shard", "local_index", "label")


@query(
    "slice_provenance",
    """WITH s AS (SELECT * FROM latents WHERE global_index >= 100 AND global_index < 350)
    SELECT count(*) AS loaded, min(global_index) AS first_global_index, max(global_index) AS last_global_index,
      min(label) AS label_min, max(label) AS label_max, min_by(shard, global_index) AS first_shard,
      min_by(local_index, global_index) AS first_local_index, min_by(label, global_index) AS first_label,
      max_by(shard, global_index) AS last_shard, max_by(local_index, global_index) AS last_local_index,
      max_by(label, global_index) AS last_label FROM s""",
    ("latents",),
)
def _(t: Tables):
    return sampling.slice_provenance(sampling.slice_samples(t.latents, 100, 250))


@query(
    "take_per_view",
    """SELECT view, global_index, label FROM latents, (VALUES ('latents'), ('latents_flip')) v(view) WHERE global_index < 150""",
    ("latents",),
)
def _(t: Tables):
    return sampling.take_per_view(t.views, 150).select("view", "global_index", "label")


@query(
    "take_per_view_after_selection",
    """WITH s AS (SELECT * FROM latents WHERE shard IN (1, 3, 4)), r AS (SELECT global_index, label, row_number() OVER (ORDER BY global_index) AS r FROM s)
    SELECT view, global_index, label FROM r, (VALUES ('latents'), ('latents_flip')) v(view) WHERE r <= 100""",
    ("latents",),
)
def _(t: Tables):
    """The first samples of what a shard selection has left, whose indexes have gaps."""
    return sampling.take_per_view(t.views.where(F.col("shard").isin(1, 3, 4)), 100).select("view", "global_index", "label")


def _ordered(column: str, kind: str):
    def run(t: Tables):
        orders = t.read("orders").select("o_orderkey", F.col(column).cast(kind).alias("at"))
        bucket = ordered_bucket(orders, "at", single_task_rows=0)
        return running_before(orders, ["at", "o_orderkey"], bucket).select("o_orderkey", "before")

    return run


# The form for tables of any size, on every kind of order column.
for _name, _column, _kind in (
    ("date", "o_orderdate", "date"), ("timestamp", "o_orderdate", "timestamp_ntz"), ("number", "o_totalprice", "double"),
    ("text", "o_orderpriority", "string"),
):
    query(
        f"ordered_large_{_name}",
        f"SELECT o_orderkey, row_number() OVER (ORDER BY {_column}{'::DATE' if _kind == 'date' else ''}, o_orderkey) - 1 AS before FROM orders",
    )(_ordered(_column, _kind))


@query("first_n", "SELECT global_index, label FROM latents WHERE global_index < 300", ("latents",))
def _(t: Tables):
    return sampling.first_n(t.latents, 300).select("global_index", "label")


@query(
    "sample_exact",
    "SELECT global_index, label FROM latents ORDER BY md5(concat_ws(':', 17, global_index)), global_index LIMIT 200", ("latents",),
)
def _(t: Tables):
    return sampling.sample_exact(t.latents, 200, 17).select("global_index", "label")


ORDERS = "SELECT o_orderkey AS global_index, o_custkey % 1000 AS label, o_orderstatus FROM orders"


def _orders(t: Tables):
    return t.read("orders").select(
        F.col("o_orderkey").alias("global_index"), (F.col("o_custkey") % 1000).alias("label"), "o_orderstatus"
    )


@query(
    "sample_exact_large",
    f"SELECT global_index, label FROM ({ORDERS}) ORDER BY md5(concat_ws(':', 5, global_index)), global_index LIMIT 1200",
)
def _(t: Tables):
    """The bucketed form used for samples too large for one top-n task."""
    return sampling.sample_exact(_orders(t), 1200, 5, top_n_limit=0).select("global_index", "label")


@query(
    "choose_view",
    f"""SELECT global_index, CASE WHEN o_orderstatus <> 'P' AND
      CAST('0x' || substr(md5(concat_ws(':', 9, 3, global_index)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.5
      THEN 'latents_flip' ELSE 'latents' END AS chosen_view FROM ({ORDERS})""",
)
def _(t: Tables):
    rows = _orders(t).withColumn("has_flip", F.col("o_orderstatus") != "P")
    return sampling.choose_view(rows, 0.5, 9, 3).select("global_index", "chosen_view")


@query(
    "label_preview",
    f"""WITH o AS ({ORDERS}), h AS (SELECT * FROM o WHERE global_index < 2048)
    SELECT count(*) AS num_previewed, min(label) AS "min", max(label) AS "max", count(DISTINCT label) AS unique_count,
      (SELECT string_agg(label, ',' ORDER BY global_index) FROM h WHERE global_index < 32) AS first_32 FROM h""",
)
def _(t: Tables):
    return sampling.label_preview(_orders(t))


@query(
    "verify_dataset",
    """WITH f AS (SELECT shard_index, count(*) AS c FROM headers GROUP BY shard_index),
    t AS (SELECT count(*) AS num_files, CAST(sum(num_samples) AS BIGINT) AS total_samples,
      CAST(sum(num_samples * 256) AS BIGINT) AS total_bytes,
      bool_and(num_samples % 2 = 0 AND num_samples < 9) AS shape_ok FROM headers)
    SELECT num_files, total_samples, total_bytes,
      (SELECT min(shard_index) = 0 AND max(shard_index) = count(*) - 1 FROM f) AS contiguous_shards, shape_ok,
      true AS dtype_ok, total_samples = 60000 AS total_ok, false AS ok FROM t""",
    ("headers",),
)
def _(t: Tables):
    return validation.verify_dataset(t.headers, 60_000, [4, 4, 4])


@query(
    "probe_points",
    f"""WITH o AS ({ORDERS}), n AS (SELECT max(global_index) + 1 AS n FROM o)
    SELECT global_index, label FROM o, n WHERE global_index IN (0, n // 2, n - 1)""",
)
def _(t: Tables):
    return sampling.probe_points(_orders(t)).select("global_index", "label")


@query(
    "table_digest",
    """WITH h AS (SELECT o_orderstatus, CAST('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)), 1, 15) AS BIGINT) AS h FROM orders)
    SELECT o_orderstatus, count(*) AS "rows", bit_xor(h) AS digest_xor, CAST(sum(h % 1000003) AS BIGINT) AS digest_sum
    FROM h GROUP BY o_orderstatus""",
)
def _(t: Tables):
    rows = t.read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return validation.table_digest(rows, ["o_orderstatus"], portable=True)


@query(
    "epoch_batches",
    f"""WITH r AS (SELECT global_index, label, row_number() OVER (ORDER BY md5(concat_ws(':', 11, 2, global_index)), global_index) - 1 AS perm_rank
      FROM ({ORDERS}))
    SELECT global_index, label, perm_rank, perm_rank // 96 AS batch_id, perm_rank % 96 AS pos FROM r
    WHERE perm_rank // 96 < (SELECT count(*) // 96 FROM orders)""",
)
def _(t: Tables):
    return sampling.epoch_batches(_orders(t).drop("o_orderstatus"), 96, 11, 2)


@query(
    "eval_labels",
    """SELECT pos, CAST('0x' || substr(md5(concat_ws(':', 7, pos)), 1, 12) AS BIGINT) % 10 AS label
    FROM (SELECT unnest(range((SELECT count(*) FROM documents))) AS pos)""",
)
def _(t: Tables):
    return sampling.eval_labels(t.spark, t.read("documents").count(), num_classes=10, seed=7)


@query(
    "eval_labels_fixed",
    "SELECT pos, ([1, 7, 207, 360, 387])[pos % 5 + 1]::BIGINT AS label FROM (SELECT unnest(range((SELECT count(*) FROM documents))) AS pos)",
)
def _(t: Tables):
    return sampling.eval_labels(t.spark, t.read("documents").count(), fixed=[1, 7, 207, 360, 387])


@query(
    "matched_labels",
    """WITH n AS (SELECT count(*) AS n, count(*) * 2 + 100 AS want FROM latents),
    r AS (SELECT label, row_number() OVER (ORDER BY md5(concat_ws(':', 3, global_index)), global_index) - 1 AS r FROM latents)
    SELECT turn * n + r AS pos, label FROM r, n, (SELECT unnest(range(3)) AS turn) WHERE turn * n + r < want""",
    ("latents",),
)
def _(t: Tables):
    return sampling.matched_labels(t.latents, t.latents.count() * 2 + 100, 3)


@query("label_histogram", f"SELECT label, count(*) AS n FROM ({ORDERS}) GROUP BY label")
def _(t: Tables):
    return sampling.label_histogram(_orders(t))


@query(
    "label_marginal_gap",
    """WITH a AS (SELECT label, count(*) / sum(count(*)) OVER () AS sa FROM latents GROUP BY label),
    b AS (SELECT label, count(*) / sum(count(*)) OVER () AS sb FROM (SELECT o_custkey % 12 AS label FROM orders) GROUP BY label)
    SELECT count(*) AS classes, round(max(abs(coalesce(sa, 0) - coalesce(sb, 0))), 6) AS max_share_gap FROM a FULL JOIN b USING (label)""",
    ("latents",),
)
def _(t: Tables):
    b = t.read("orders").select((F.col("o_custkey") % 12).alias("label"))
    return rounded(sampling.label_marginal_gap(t.latents, b))


@query("resume_plan", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables):
    return validation.resume_plan(t.read("documents").select("doc_id", "source"), t.read("labels"), "doc_id")


@query(
    "resume_after_prefix",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey < 1000)",
)
def _(t: Tables):
    orders = t.read("orders").select("o_orderkey")
    return validation.resume_after_prefix(orders, orders.where("o_orderkey < 1000"), "o_orderkey")


@query(
    "order_audit",
    f"""WITH {ITEMS},
    d AS (SELECT l_orderkey AS k, l_suppkey % 7 AS label, "start" + local_index AS pos FROM items JOIN registry USING (path)),
    c AS (SELECT k, count(*) AS n, min(label) AS lo, max(label) AS hi FROM d GROUP BY k),
    s AS (SELECT o_orderkey AS k, o_custkey % 7 AS label FROM orders),
    j AS (SELECT s.k AS sk, c.k AS ck, n, lo, hi, label FROM s FULL JOIN c ON s.k = c.k),
    o AS (SELECT count(*) AS breaks FROM d JOIN d p ON d.pos = p.pos + 1 WHERE d.k <= p.k)
    SELECT count(*) FILTER (ck IS NULL) AS gaps, count(*) FILTER (sk IS NULL) AS extra,
      CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS duplicates,
      count(*) FILTER (sk IS NOT NULL AND ck IS NOT NULL AND NOT (label = lo AND label = hi)) AS label_mismatches,
      any_value(breaks) AS order_breaks, false AS ok FROM j, o""",
    ("registry",),
)
def _(t: Tables):
    derived = registry.with_global_index(_items(t), t.registry).select(
        F.col("l_orderkey").alias("source_index"), (F.col("l_suppkey") % 7).alias("label"), F.col("global_index").alias("position")
    )
    source = t.read("orders").select(F.col("o_orderkey").alias("source_index"), (F.col("o_custkey") % 7).alias("label"))
    return validation.order_audit(source, derived)


@query(
    "match_pairs",
    """WITH j AS (SELECT d.doc_id AS a, l.doc_id AS b, n_chars % 2 AS la, quality AS lb FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id)
    SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (la = lb) AS labels_equal,
      count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, false AS ok FROM j""",
)
def _(t: Tables):
    a = t.read("documents").select("doc_id", (F.col("n_chars") % 2).alias("label"))
    b = t.read("labels").select("doc_id", F.col("quality").cast("bigint").alias("label"))
    return validation.match_pairs(a, b, "doc_id")
