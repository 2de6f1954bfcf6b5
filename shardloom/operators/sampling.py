"""Slices, exact samples, epoch order and label draws; deterministic and safe to recompute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shardloom.functions.hashing import draw_key, hex_prefix, unit_draw
from shardloom.functions.ordering import running_before
from shardloom.session import broadcast_if_small, require

INDEX = "global_index"
# Above this a sample is cut by key buckets instead of one top-n task.
_TOP_N_LIMIT = 100_000


def _prefix_digits(rows: int) -> int:
    """Hex digits of a key that give buckets of at most about a million rows, up to 16^5 buckets."""
    return 2 if rows <= 10**8 else 3 if rows <= 10**9 else 4 if rows <= 10**11 else 5


def slice_samples(df: DataFrame, start: int, count: int, total: int | None = None, index: str = INDEX) -> DataFrame:
    """Contiguous slice of the index; a start outside the dataset is an error, the count is clipped."""
    total = df.agg(F.max(index)).first()[0] + 1 if total is None else total
    require(0 <= start < total, f"start {start} outside 0..{total - 1}")
    require(count > 0, "count must be positive")
    return df.where((F.col(index) >= start) & (F.col(index) < min(start + count, total)))


def slice_provenance(sliced: DataFrame, index: str = INDEX) -> DataFrame:
    """First and last shard, local and global index, label and source of a slice."""
    fields = [c for c in ("shard", "local_index", "label", "source_index") if c in sliced.columns]
    ends = [(F.min_by, "first"), (F.max_by, "last")]
    picks = [fn(c, index).alias(f"{end}_{c}") for fn, end in ends for c in fields]
    return sliced.agg(
        F.count("*").alias("loaded"), F.min(index).alias("first_global_index"), F.max(index).alias("last_global_index"),
        F.min("label").alias("label_min"), F.max("label").alias("label_max"), *picks,
    )


def take_per_view(df: DataFrame, n: int, index: str = INDEX) -> DataFrame:
    """First ``n`` samples of every view in index order, whatever gaps a selection has left.

    Only (view, index) is ranked; every task keeps its own first ``n`` before they meet. Rows that share an index with
    the n-th sample come along.
    """
    rank = F.row_number().over(Window.partitionBy("view").orderBy(index))
    upto = df.select("view", index).withColumn("__rank", rank).where(F.col("__rank") <= n).groupBy("view").agg(F.max(index).alias("__last"))
    return df.join(broadcast_if_small(upto), "view").where(F.col(index) <= F.col("__last")).select(df.columns)


def first_n(df: DataFrame, n: int, index: str = INDEX) -> DataFrame:
    """Contiguous prefix; use the same ``n`` on the reference side."""
    return df.where(F.col(index) < n)


def sample_exact(
    df: DataFrame, n: int, seed: int, cap: bool = False, index: str = INDEX, top_n_limit: int = _TOP_N_LIMIT,
    ordered: bool = True,
) -> DataFrame:
    """Exactly ``n`` rows without replacement, in index order unless ``ordered`` is off.

    The rows with the ``n`` smallest keys md5(seed:index). ``n`` larger than the table is an error, or the
    whole table with ``cap``. Only the index column is ranked; the rows are fetched by a semi-join.
    """
    total = df.count()
    require(cap or n <= total, f"cannot draw {n} from {total} rows")
    if n >= total:
        return df.orderBy(index) if ordered else df
    keyed = df.select(index, draw_key(seed, F.col(index)).alias("__key"))
    if n <= top_n_limit:
        chosen = F.broadcast(keyed.orderBy("__key", index).limit(n).select(index))
    else:
        bucket = hex_prefix(F.col("__key"), _prefix_digits(total))
        chosen = running_before(keyed, ["__key", index], bucket, name="__rank").where(F.col("__rank") < n)
    drawn = df.join(chosen.select(index), index, "left_semi")
    return drawn.orderBy(index) if ordered else drawn


def choose_view(
    df: DataFrame, flip_prob: float, seed: int, epoch: int, view: str = "latents", flip_view: str = "latents_flip",
    index: str = INDEX,
) -> DataFrame:
    """Adds ``chosen_view``: the flip view with probability ``flip_prob`` where ``has_flip``."""
    require(0.0 <= flip_prob <= 1.0, f"flip_prob must be in [0,1], got {flip_prob}")
    flip = F.col("has_flip") & (unit_draw(seed, epoch, F.col(index)) < F.lit(flip_prob))
    return df.withColumn("chosen_view", F.when(flip, flip_view).otherwise(view))


def label_preview(df: DataFrame, n: int = 2048, index: str = INDEX) -> DataFrame:
    """Count, min, max, distinct and the first 32 labels among the first ``n`` samples."""
    head = df.where(F.col(index) < n)
    first = F.sort_array(F.collect_list(F.when(F.col(index) < 32, F.struct(index, "label"))))
    return head.agg(
        F.count("label").alias("num_previewed"), F.min("label").alias("min"), F.max("label").alias("max"),
        F.count_distinct("label").alias("unique_count"),
        F.array_join(F.transform(first, lambda s: s["label"].cast("string")), ",").alias("first_32"),
    )


def probe_points(df: DataFrame, total: int | None = None, index: str = INDEX) -> DataFrame:
    """First, middle and last sample, each once."""
    total = df.agg(F.max(index)).first()[0] + 1 if total is None else total
    return df.where(F.col(index).isin(sorted({0, max(0, total // 2), max(0, total - 1)})))


def epoch_batches(
    df: DataFrame, batch_size: int, seed: int, epoch: int, drop_last: bool = True, index: str = INDEX
) -> DataFrame:
    """Shuffled permutation of one epoch: ``perm_rank``, ``batch_id``, ``pos``.

    Keys are uniform, so their prefix is the bucket: a count per bucket gives each bucket's offset and the
    rank is exact without a global sort.
    """
    require(batch_size > 0, "batch_size must be positive")
    total = df.count()
    keyed = df.withColumn("__key", draw_key(seed, epoch, F.col(index)))
    bucket = hex_prefix(F.col("__key"), _prefix_digits(total))
    ranked = running_before(keyed, ["__key", index], bucket, name="perm_rank").drop("__key")
    out = ranked.withColumn("batch_id", F.floor(F.col("perm_rank") / batch_size)).withColumn(
        "pos", F.col("perm_rank") % batch_size
    )
    if drop_last:
        out = out.where(F.col("batch_id") < total // batch_size)
    return out


def eval_labels(
    spark: SparkSession, n: int, num_classes: int | None = None, seed: int = 0, fixed: Sequence[int] | None = None
) -> DataFrame:
    """``(pos, label)``: a fixed list repeated and cut to ``n``, or uniform draws."""
    rows = spark.range(n).withColumnRenamed("id", "pos")
    if fixed:
        options = F.array(*[F.lit(int(v)).cast("bigint") for v in fixed])
        return rows.withColumn("label", F.get(options, (F.col("pos") % len(fixed)).cast("int")))
    require(bool(num_classes), "num_classes is required without fixed labels")
    return rows.withColumn("label", F.pmod(hex_prefix(draw_key(seed, F.col("pos")), 12), F.lit(int(num_classes))))


def matched_labels(subset: DataFrame, n: int, seed: int, index: str = INDEX) -> DataFrame:
    """``(pos, label)`` drawn from a subset's own labels, so class shares match: whole passes, then a sample."""
    total = subset.count()
    require(total > 0, "the subset is empty")
    whole, rest = divmod(n, total)
    key = draw_key(seed, F.col(index))
    ranked = running_before(
        subset.select(index, "label").withColumn("__key", key), ["__key", index],
        hex_prefix(F.col("__key"), _prefix_digits(total)), name="__rank",
    )
    passes = F.when(F.col("__rank") < rest, F.lit(whole + 1)).otherwise(F.lit(whole))
    turns = ranked.where(passes > 0).withColumn("__turn", F.explode(F.sequence(F.lit(0), passes - 1)))
    return turns.select((F.col("__turn") * F.lit(total) + F.col("__rank")).alias("pos"), "label")


def label_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def label_marginal_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: largest absolute difference of class shares, and the class count."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = label_histogram(df)
        # one row per class reaches this window, never the samples
        return counts.select("label", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))

    both = shares(a, "__a").join(shares(b, "__b"), "label", "full_outer").na.fill(0.0, ["__a", "__b"])
    return both.agg(
        F.count("*").alias("classes"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("max_share_gap")
    )
