"""Distances seen by several feature extractors ("judges"), the gap between training and hold-out judges, and how well
conditioned a covariance is."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shardloom.functions.batches import extended_schema
from shardloom.operators.distances import frechet
from shardloom.operators.moments import moments
from shardloom.session import materialize, require


def _by_judge(tables: Mapping[str, DataFrame], features: str) -> DataFrame:
    """Moments of every judge's features, whose widths may differ; each table is read once."""
    out = None
    for judge, df in tables.items():
        mom = moments(df, features).withColumn("judge", F.lit(judge))
        out = mom if out is None else out.unionByName(mom)
    return materialize(out, "judges")


def judge_distances(
    gen: Mapping[str, DataFrame], real: Mapping[str, DataFrame], floor: Mapping[str, DataFrame] | None = None, features: str = "features"
) -> DataFrame:
    """``judge, n1, n2, dims, fid, fid_ratio`` for each judge's generated and real features.

    ``floor`` holds other real features: ``fid_ratio`` is the distance over theirs, which makes judges of different scale
    comparable. Without it the ratio is null; a floor of 0 gives infinity.
    """
    require(bool(gen) and gen.keys() == real.keys(), "generated and real features need the same judges")
    reference = _by_judge(real, features)
    found = frechet(_by_judge(gen, features), reference, ["judge"])
    if floor is None:
        return found.withColumn("fid_ratio", F.lit(None).cast("double"))
    require(floor.keys() == real.keys(), "floors are needed for all judges")
    base = frechet(_by_judge(floor, features), reference, ["judge"]).select("judge", F.col("fid").alias("__floor"))
    ratio = F.when(F.col("__floor") > 0, F.col("fid") / F.col("__floor")).otherwise(F.lit(float("inf")))
    return found.join(base, "judge").select(*found.columns, ratio.alias("fid_ratio"))


def judge_gap(found: DataFrame, train: Sequence[str], value: str = "fid_ratio") -> DataFrame:
    """``train_judges, holdout_judges, train_mean, holdout_mean, gap`` (hold-out minus train) over the rows of
    ``judge_distances``. A judge not named in ``train`` is held out; without judges on a side its mean and the gap are null."""
    trained = F.col("judge").isin(list(train))
    row = found.agg(
        F.count_if(trained).alias("train_judges"), F.count_if(~trained).alias("holdout_judges"),
        F.avg(F.when(trained, F.col(value))).alias("train_mean"), F.avg(F.when(~trained, F.col(value))).alias("holdout_mean"),
    )
    return row.withColumn("gap", F.col("holdout_mean") - F.col("train_mean"))


def condition_number(mom: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., n, dims, eig_max, eig_min, condition`` of the covariances of a moment table.

    A smallest eigenvalue that is 0 up to rounding gives infinity; a group without a covariance (one row) gives nulls.
    """
    by = list(by)
    schema = extended_schema(mom.select(*by).schema, "n bigint, dims int, eig_max double, eig_min double, condition double")
    names = [f.name for f in schema.fields]

    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n, dims = int(pdf["n"].iloc[0]), len(pdf)
        if pdf["sigma"].iloc[0] is None:
            return pd.DataFrame([[*key[: len(by)], n, dims, None, None, None]], columns=names).astype({c: "float64" for c in names[-3:]})
        e = np.linalg.eigvalsh(np.array(pdf["sigma"].tolist(), dtype=np.float64))
        low = float(e[0]) if e[0] > dims * np.finfo(np.float64).eps * abs(e[-1]) else 0.0
        return pd.DataFrame([[*key[: len(by)], n, dims, float(e[-1]), low, float(e[-1]) / low if low > 0 else np.inf]], columns=names)

    # as many rows as features, whatever the table's length
    return mom.select(*by, "i", "n", "sigma").withColumn("__one", F.lit(1)).groupBy(*by, "__one").applyInPandas(step, schema)
