"""Embedding whitening: principal components of a covariance by QDWH divide and conquer, then one broadcast projection.

1. Every vector becomes integers, ``floor(scale * c)``. The fit list holds each distinct integer vector once.
2. Exact sums give the mean; tasks fold the centred vectors of the fit list into one Gram matrix each, which are summed as
   a tree. Only matrices of width x width cells reach the driver, and the width is checked.
3. The covariance is split into components (``spectral``). Mean and components go to the tasks, which project all rows.

Null or odd input: rows whose vector is null, empty, or holds a null, a non-finite component or one of ``LARGEST`` or more
in size take no part, nor do vectors of another length than the commonest (the longer one of two). Ids may be null or
repeated, further columns are kept. A component without variance has null in ``whitened``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shardloom.functions.batches import list_column, matrix
from shardloom.llm import workers
from shardloom.llm.registry import query, table
from shardloom.llm.spectral import EPS, leading_components
from shardloom.operators.moments import gram_partials, vector_sums
from shardloom.session import materialize, require

SCALE = 256
COMPONENTS = 4
LARGEST = float(1 << 40)
#: The covariance of so many dimensions takes 128 MB.
MOST_DIMENSIONS = 4096


def usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))


def common_width(rows: DataFrame, vector: str) -> int | None:
    """The commonest length of the vectors, the longer one of two; None for an empty table."""
    found = rows.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return found and found["width"]


def integers(vector: str, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


@dataclass(frozen=True)
class Whitening:
    """``n`` and exact ``sums`` of the fit list, trace of its covariance, eigenvalues and unit eigenvectors (columns)."""

    scale: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sums``, exactly: 64-bit integers where they fit, else Python's."""
        sums = np.array(self.sums, dtype=object)
        most = self.n * int(np.abs(x).max(initial=0)) + int(max(map(abs, self.sums), default=0))
        if most < 1 << 62:
            return self.n * x - sums.astype(np.int64)
        return self.n * x.astype(object) - sums

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        """Sum of squares of each row of ``n * x - sums``; null beyond 38 digits."""
        y = self.centred(x)
        if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return [Decimal(v) for v in (y * y).sum(axis=1).tolist()]
        found = (y.astype(object) ** 2).sum(axis=1).tolist()
        return [Decimal(v) if v < 10**38 else None for v in found]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN for components without variance."""
        gain = np.where(self.flat, np.nan, 1.0 / np.sqrt(np.where(self.flat, 1.0, self.values)))
        return (self.centred(x) / self.n).astype(np.float64) @ self.vectors * gain

    @property
    def flat(self) -> np.ndarray:
        """Components whose eigenvalue cannot be told from 0."""
        return self.values <= 4 * len(self.sums) * EPS * max(self.trace, 0.0)


def fit_list(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Each distinct integer vector of usable rows once, as ``x``; copies meet in the tasks before the shuffle."""
    return materialize(rows.select(integers(vector, scale).alias("x")).distinct(), "fit_list")


def _exact_sums(width: int):
    def run(batches):
        n, sums = 0, [0] * width
        for batch in batches:
            x = matrix(batch.column("x"), width).astype(np.int64)  # below 2**53, so exact
            wide = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
            sums = [s + int(v) for s, v in zip(sums, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "s": pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)),
        })

    return run, "i int, n long, s decimal(38,0)"


def _gram(rows: DataFrame, features: str, width: int, pilot: np.ndarray | None) -> np.ndarray:
    """Sum of outer products of ``[x - pilot, 1]``."""
    found = vector_sums(gram_partials(rows, features, width, pilot=pilot), ["chunk"], "cells").orderBy("chunk").toPandas()
    return np.concatenate(found["cells"].to_numpy()).reshape(-1, width + 1)


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Mean and leading components of a fit list that is not empty."""
    require(width <= MOST_DIMENSIONS, f"at most {MOST_DIMENSIONS} dimensions are supported")
    run, schema = _exact_sums(width)
    totals = distinct.mapInArrow(workers.batches(run), schema).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    n, sums = totals[0]["n"], [int(r["s"]) for r in totals]
    cells = _gram(distinct, "x", width, np.array([s / n for s in sums]))[:width, :width] / n
    covariance = (cells + cells.T) / 2.0
    values, vectors = leading_components(covariance, components)
    return Whitening(scale, n, sums, float(np.trace(covariance)), values, vectors)


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of the whitened fit list minus the identity; None without a component."""
    kept = np.flatnonzero(~model.flat)
    if not len(kept):
        return None
    width = len(model.sums)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), width).astype(np.int64)
            yield pa.RecordBatch.from_arrays([list_column(model.project(x)[:, kept], pa.float64())], ["w"])

    whitened = distinct.mapInArrow(workers.batches(run), "w array<double>")
    cells = _gram(whitened, "w", len(kept), None)
    mean = cells[-1, :-1] / model.n  # centred before, so rounding only
    covariance = cells[:-1, :-1] / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(len(kept))).max())


def apply(rows: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Usable rows with ``whitened array<double>`` and ``deviation decimal(38,0)`` (exact, times n squared)."""
    rows = rows.drop("whitened", "deviation")
    width = len(model.sums)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    sent = rows.sparkSession.sparkContext.broadcast(model)  # width x components numbers

    def run(batches):
        model = sent.value
        for batch in batches:
            x = np.floor(model.scale * matrix(batch.column(vector), width)).astype(np.int64)
            found = model.project(x)
            flat = pa.array(np.isnan(found).ravel())
            values = pa.array(found.ravel(), pa.float64(), mask=np.asarray(flat)) if len(found) else pa.array([], pa.float64())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, values), pa.array(model.deviations(x), pa.decimal128(38, 0))],
                [*batch.schema.names, "whitened", "deviation"],
            )

    return rows.mapInArrow(workers.batches(run), f"{fields}, whitened array<double>, deviation decimal(38,0)")


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE):
    """Whitened rows, the model and its identity error; ``(no rows, None, None)`` for a table without usable vectors."""
    rows = rows.where(usable(vector))
    width = common_width(rows, vector)
    if width is None:
        return rows.drop("whitened", "deviation").selectExpr("*", "cast(NULL AS array<double>) AS whitened", "cast(NULL AS decimal(38,0)) AS deviation"), None, None
    rows = rows.where(F.size(vector) == width)
    distinct = fit_list(rows, vector, scale)
    model = fit(distinct, width, components, scale)
    return apply(rows, model, vector), model, identity_error(distinct, model)


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found, model, error = whiten(rows)
    number = lambda x, kind: F.lit(x).cast(kind)
    explained = [e / model.trace if model.trace > 0 else None for e in model.values.tolist()] if model else []
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), number(model and model.n, "long").alias("n"),
        F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened",
        F.get(F.array(*[number(e, "double") for e in explained]).cast("array<double>"), "at").alias("explained"), number(error, "double").alias("identity_error"),
    )
