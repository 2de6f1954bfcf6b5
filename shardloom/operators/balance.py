"""Class-balanced subsets and how the spread of features divides within and between classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from shardloom.functions.batches import extended_schema, group_rows, key_columns, list_column, matrix
from shardloom.functions.hashing import draw_key
from shardloom.functions.hot_joins import join_counted
from shardloom.functions.joins import with_row
from shardloom.operators.moments import feature_width, moments, vector_sums
from shardloom.session import is_small, materialize, require

KEY_DIGITS = 32
#: Hex digits of the keys that one step finds: a label has at most 16^4 counts.
STEP_DIGITS = 4
#: Rows of a label among which its last key is found by ranking them in one task.
RANKED_ROWS = 100_000


def _thresholds(keyed: DataFrame, sizes: DataFrame, n: int, rows: int, step: int, ranked: int) -> DataFrame:
    """``__group, __n, __cut``: the n-th smallest key of every group that has more than n rows; null for the others.

    Counts per prefix tell which longer prefix the n-th key starts with; only rows with that prefix are counted again.
    """
    state = sizes.withColumn("__prefix", F.lit("")).withColumn("__rest", F.lit(n)).withColumn("__in", F.col("__n"))
    whole = state.where(F.col("__n") <= n).select("__group", "__n", F.lit(None).cast("string").alias("__cut"))
    open_ = materialize(state.where(F.col("__n") > n), "balance")
    for digits in range(step, KEY_DIGITS + step, step):
        if open_.where(F.col("__in") > ranked).isEmpty():
            break
        digits = min(digits, KEY_DIGITS)
        inside = _joined(keyed, open_, rows).where(F.startswith("__key", "__prefix"))
        counts = inside.groupBy("__group", F.substring("__key", 1, digits).alias("__longer")).agg(F.count("*").alias("__c"), *[F.first(c).alias(c) for c in ("__n", "__rest")])
        before = F.sum("__c").over(Window.partitionBy("__group").orderBy("__longer")) - F.col("__c")
        placed = counts.withColumn("__before", before).where((F.col("__before") < F.col("__rest")) & (F.col("__rest") <= F.col("__before") + F.col("__c")))
        open_ = materialize(placed.select("__group", "__n", F.col("__longer").alias("__prefix"), (F.col("__rest") - F.col("__before")).alias("__rest"), F.col("__c").alias("__in")), "balance")
    done = open_.where(F.length("__prefix") == KEY_DIGITS).select("__group", "__n", F.col("__prefix").alias("__cut"))
    last = _joined(keyed, open_.where(F.length("__prefix") < KEY_DIGITS), rows).where(F.startswith("__key", "__prefix"))
    place = F.row_number().over(Window.partitionBy("__group").orderBy("__key"))
    last = last.withColumn("__place", place).where(F.col("__place") == F.col("__rest")).select("__group", "__n", F.col("__key").alias("__cut"))
    return materialize(whole.unionByName(done).unionByName(last), "thresholds")


def _joined(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Rows with the facts of their group; rows of large groups are not shuffled."""
    return rows.join(F.broadcast(groups), "__group") if is_small(groups) else join_counted(rows, groups.withColumn("__times", F.col("__n")), ["__group"], "__times", total)


def balanced_subset(
    df: DataFrame, n: int | None = None, seed: int = 0, label: str = "label", index: str = "global_index", cap: bool = False,
    step: int = STEP_DIGITS, ranked: int = RANKED_ROWS,
) -> DataFrame:
    """``n`` rows of every label (default: as many as the rarest label has), those with the smallest keys md5(seed:index).

    A label with fewer than ``n`` rows is an error, or kept whole with ``cap``. A null label is a label. Rows that share an
    index share a key, and those that tie with the n-th key come along. A label with most of the rows costs no task more:
    its n-th key is found by counting key prefixes, and rows are then kept by comparing keys where they are.
    """
    require(n is None or n >= 1, "at least one row per label is needed")
    rows = df.withColumn("__group", F.struct(label)).withColumn("__key", draw_key(seed, F.col(index)))
    sizes = materialize(rows.groupBy("__group").agg(F.count("*").alias("__n")), "labels")
    least, total = sizes.agg(F.min("__n"), F.sum("__n")).first()
    if least is None:
        return df
    require(n is None or cap or n <= least, f"cannot draw {n} rows of every label, the rarest has {least}")
    keyed = materialize(rows.select("__group", "__key"), "keys")
    cuts = _thresholds(keyed, sizes, least if n is None else n, total, step, ranked)
    kept = _joined(rows, cuts, total).where(F.col("__cut").isNull() | (F.col("__key") <= F.col("__cut")))
    return kept.select(df.columns)


def class_sums(df: DataFrame, label: str = "label", features: str = "features", width: int | None = None) -> DataFrame:
    """``label, n, mu``: count and mean of every class; tasks fold their rows into one sum per class."""
    width = feature_width(df, features) if width is None else width
    schema = extended_schema(df.select(label).schema, "sums array<double>")
    kinds = {label: schema[label].dataType}

    def fold(batches):
        groups: dict[tuple, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column(features), width)
            for key, some in group_rows(batch, [label]):
                total = np.append(x[some].sum(axis=0), len(x[some]))
                groups[key] = groups[key] + total if key in groups else total
        for key, total in groups.items():
            yield pa.RecordBatch.from_pydict(key_columns(key, [label], kinds, 1) | {"sums": list_column(total[None], pa.float64())})

    sums = vector_sums(df.select(label, features).mapInArrow(fold, schema), [label], "sums")
    n = F.get("sums", F.lit(width))
    return sums.select(label, n.cast("bigint").alias("n"), F.transform(F.slice("sums", 1, width), lambda s: s / n).alias("mu"))


def class_scatter(df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """``i, n, classes, within, between``: row i of the pooled intra-class covariance (divisor n - classes, null if that is 0)
    and of the covariance of class means weighted by their classes' sizes (divisor n).

    The scatter of all rows is that within and that between classes, so one Gram matrix and the class means suffice; no
    matrix is kept per class.
    """
    width = feature_width(df, features)
    classes = materialize(class_sums(df, label, features, width), "classes")
    count = classes.count()
    weight = F.col("n") / F.sum("n").over(Window.partitionBy())  # one row per class
    shares = classes.withColumn("__w", weight)
    center = shares.select("__w", F.posexplode("mu").alias("i", "m")).groupBy("i").agg(F.sum(F.col("__w") * F.col("m")).alias("m"))
    center = center.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("__center"))  # one row
    moved = with_row(shares, center).select(F.zip_with("mu", "__center", lambda a, b: F.sqrt("n") * (a - b)).alias("moved"))
    total = moments(df, features, width=width, strict=False)
    if count == 1:
        scatter = total.select("i", F.array_repeat(F.lit(0.0), width).alias("__between"))
    else:
        spread = materialize(moments(moved, "moved", width=width), "between")
        means = spread.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mu"))), lambda s: s["mu"]).alias("__mu"))
        cells = F.zip_with("sigma", "__mu", lambda s, m: s * (count - 1) + F.col("mu") * m * count)
        scatter = with_row(spread, means).select("i", cells.alias("__between"))
    inner = F.zip_with("sigma", "__between", lambda s, b: (s * (F.col("n") - 1) - b) / (F.col("n") - count))
    return total.join(scatter, "i").select(
        "i", "n", F.lit(count).alias("classes"), F.when(F.col("n") > count, inner).alias("within"),
        F.transform("__between", lambda b: b / F.col("n")).alias("between"),
    )


def class_coverage(gen: DataFrame, real: DataFrame, label: str = "label", least: int = 1) -> DataFrame:
    """One row: ``classes`` of the real rows, ``covered`` (those with ``least`` generated rows or more), ``coverage``, and
    ``foreign`` generated rows, whose label no real row has. A null label is a label."""
    def counts(df, name):
        return df.groupBy(F.struct(label).alias("__group")).agg(F.count("*").alias(name))

    both = counts(real, "__real").join(counts(gen, "__gen"), "__group", "full_outer")
    found = both.agg(
        F.count("__real").alias("classes"), F.count_if(F.col("__real").isNotNull() & (F.col("__gen") >= least)).alias("covered"),
        F.coalesce(F.sum(F.when(F.col("__real").isNull(), F.col("__gen"))), F.lit(0)).alias("foreign"),
    )
    return found.select("classes", "covered", F.try_divide("covered", "classes").alias("coverage"), "foreign")
