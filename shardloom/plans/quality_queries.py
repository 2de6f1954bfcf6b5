"""Bootstrap intervals, precision and recall, Inception Score, ranks, class balance, memorisation and judges over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.operators import balance, bootstrap, coverage, distances, judges, memorisation, moments, ranks
from shardloom.plans.catalog import query, rounded
from shardloom.plans.distance_queries import _stretched
from shardloom.plans.views import Tables

REPLICATES, SEED = 10, 3
WEIGHTS = f"""keys AS (SELECT global_index, g, md5('{SEED}:' || g || ':' || global_index) AS k FROM (SELECT DISTINCT global_index FROM elements), range({-(-REPLICATES // 4)}) t(g)),
    draws AS (SELECT global_index, g * 4 + j AS replicate, ('0x' || substr(k, j * 8 + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM keys, range(4) t(j)),
    weights AS (SELECT global_index, replicate, len(list_filter([{", ".join(f"{c!r}::DOUBLE" for c in bootstrap.POISSON_CUTS)}], lambda c: c <= u)) AS w
      FROM draws WHERE replicate < {REPLICATES}),
    sums AS (SELECT replicate, pos, sum(w) AS n, sum(w * v) / sum(w) AS mu, sum(w * v * v) AS q FROM elements JOIN weights USING (global_index) GROUP BY replicate, pos),
    boot AS (SELECT CAST(replicate AS INTEGER) AS replicate, CAST(any_value(n) AS BIGINT) AS n,
      sum(pow(0.5 * mu + 0.25, 2)) + 0.25 * sum((q - n * mu * mu) / (n - 1)) AS fid FROM sums GROUP BY replicate)"""


@query("frechet_replicates", f"WITH {WEIGHTS} SELECT replicate, n AS n1, n AS n2, 64 AS dims, round(fid, 4) AS fid FROM boot", ("elements",))
def _(t: Tables):
    """Every replicate's distance, both sides drawn with the same weights; stretching gives it a closed form."""
    one, two = (bootstrap.bootstrap_moments(df, REPLICATES, seed=SEED) for df in (_stretched(t), t.features))
    return rounded(distances.frechet(one, two, ["replicate"]).withColumn("dims", F.col("dims").cast("int")), 4)


@query(
    "frechet_interval",
    f"""WITH {WEIGHTS}, m AS (SELECT pos, avg(v) AS mu, var_samp(v) AS s, count(*) AS n FROM elements GROUP BY pos)
    SELECT count(*) AS replicates, round(avg(fid), 4) AS boot_mean, round(quantile_cont(fid, 0.1), 4) AS low, round(quantile_cont(fid, 0.9), 4) AS high,
      (SELECT round(sum(pow(0.5 * mu + 0.25, 2)) + 0.25 * sum(s), 4) FROM m) AS fid FROM boot""",
    ("elements",),
)
def _(t: Tables):
    found = bootstrap.frechet_interval(_stretched(t), t.features, REPLICATES, 0.8, seed=SEED, both=True)
    return rounded(found.select("replicates", "boot_mean", "low", "high", "fid"), 4)


def _radius(side: str, k: int) -> str:
    return f"""(SELECT a.id, a.x, (list_sort(list(list_sum(list_transform(list_zip(a.x, b.x), lambda z: pow(z[1] - z[2], 2)))))) [{k}] AS r
      FROM {side} a JOIN {side} b ON a.id <> b.id GROUP BY a.id, a.x)"""


def _covered(side: str, balls: str) -> str:
    return f"""(SELECT count(DISTINCT a.id) FROM {side} a JOIN {balls} b
      ON list_sum(list_transform(list_zip(a.x, b.x), lambda z: pow(z[1] - z[2], 2))) <= b.r) / (SELECT count(*) FROM {side})::DOUBLE"""


@query(
    "precision_recall",
    f"""WITH g AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 2 = 1),
    d AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 2 = 0),
    gb AS MATERIALIZED {_radius("g", 3)}, db AS MATERIALIZED {_radius("d", 3)}
    SELECT (SELECT count(*) FROM g) AS n_gen, (SELECT count(*) FROM d) AS n_real,
      round({_covered("g", "db")}, 6) AS precision, round({_covered("d", "gb")}, 6) AS recall""",
)
def _(t: Tables):
    """Odd samples as the generated ones, even ones as the real ones."""
    gen, real = (t.features.where(F.col("global_index") % 2 == k) for k in (1, 0))
    return rounded(coverage.precision_recall(gen, real))


@query(
    "inception_score",
    """WITH p AS (SELECT label, global_index, pos, exp(8 * v) / sum(exp(8 * v)) OVER (PARTITION BY global_index) AS p FROM elements),
    n AS (SELECT label, count(DISTINCT global_index) AS n FROM p GROUP BY label),
    own AS (SELECT label, sum(p * ln(p)) AS s FROM p GROUP BY label),
    mixed AS (SELECT label, sum(q * ln(q)) AS s FROM (SELECT label, avg(p) AS q FROM p GROUP BY label, pos) GROUP BY label)
    SELECT label, n, round(exp(own.s / n - mixed.s), 6) AS inception_score FROM n JOIN own USING (label) JOIN mixed USING (label)""",
    ("elements",),
)
def _(t: Tables):
    """Softmax of the features as class probabilities, one score per label."""
    powers = F.transform("features", lambda v: F.exp(v.cast("double") * 8))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, v: acc + v)
    rows = t.features.select("label", F.transform(powers, lambda v: v / total).alias("probabilities"))
    return rounded(coverage.inception_score(rows, by=["label"]))


@query(
    "average_ranks",
    """SELECT l_orderkey, l_linenumber, l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank
    FROM lineitem""",
)
def _(t: Tables):
    """Fifty quantities over all line items: every value is a large tie."""
    return ranks.average_ranks(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query(
    "rank_sum",
    """SELECT run, step, CAST(rank() OVER (ORDER BY loss) + (count(*) OVER (PARTITION BY loss) - 1) / 2.0
      + count(*) OVER () + 1 - rank() OVER (ORDER BY peak_memory_mb) - (count(*) OVER (PARTITION BY peak_memory_mb) - 1) / 2.0 AS DOUBLE) AS rank_sum
    FROM (SELECT run, step, CASE WHEN isnan(loss) THEN 'NaN'::DOUBLE ELSE loss END AS loss, peak_memory_mb FROM runlog WHERE loss IS NOT NULL AND peak_memory_mb IS NOT NULL)""",
    ("runlog",),
)
def _(t: Tables):
    """Events by low loss and much memory; losses that are not numbers are one tie at the end."""
    rows = t.log.where("loss IS NOT NULL AND peak_memory_mb IS NOT NULL").select("run", "step", "loss", "peak_memory_mb")
    return ranks.rank_sum(rows, {"loss": False, "peak_memory_mb": True}).select("run", "step", "rank_sum")


def _balanced(table: str, label: str, index: str, seed: int, n: str) -> str:
    return f"""WITH k AS (SELECT {label} AS label, {index} AS id, rank() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || {index})) AS place FROM {table})
    SELECT label, id FROM k WHERE place <= {n}"""


@query("balanced_subset", _balanced("events", "event_type", "event_id", 5, "(SELECT min(c) FROM (SELECT count(*) AS c FROM events GROUP BY event_type))"))
def _(t: Tables):
    """As many events of every type as the rarest type has."""
    rows = t.read("events").select(F.col("event_type").alias("label"), F.col("event_id").alias("id"))
    return balance.balanced_subset(rows, seed=5, index="id")


@query("balanced_subset_large", _balanced("lineitem", "l_linestatus", "l_orderkey", 8, "1000"))
def _(t: Tables):
    """The form for labels too large to rank in one task; the lines of an order share a key and stay together."""
    rows = t.read("lineitem").select(F.col("l_linestatus").alias("label"), F.col("l_orderkey").alias("id"))
    return balance.balanced_subset(rows, 1000, 8, index="id", cap=True, step=1, ranked=20)


@query(
    "class_scatter",
    """WITH m AS (SELECT pos, avg(v) AS mu FROM elements GROUP BY pos),
    c AS (SELECT label, pos, avg(v) AS mu, count(*) AS n FROM elements GROUP BY label, pos),
    d AS (SELECT label, pos, n, c.mu - m.mu AS d FROM c JOIN m USING (pos)),
    b AS (SELECT x.pos AS i, y.pos AS j, sum(x.n * x.d * y.d) AS s FROM d x JOIN d y ON x.label IS NOT DISTINCT FROM y.label GROUP BY ALL),
    r AS (SELECT global_index, e.pos, e.v - c.mu AS r FROM elements e JOIN c ON e.pos = c.pos AND e.label IS NOT DISTINCT FROM c.label),
    w AS (SELECT x.pos AS i, y.pos AS j, sum(x.r * y.r) AS s, count(*) AS n FROM r x JOIN r y USING (global_index) GROUP BY ALL)
    SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, n, (SELECT count(*) FROM c WHERE pos = 0) AS classes,
      round(w.s / (n - (SELECT count(*) FROM c WHERE pos = 0)), 8) AS within, round(b.s / n, 8) AS between FROM w JOIN b USING (i, j)""",
    ("elements",),
)
def _(t: Tables):
    found = balance.class_scatter(t.features)
    cells = found.select("i", "n", F.col("classes").cast("bigint"), F.posexplode(F.arrays_zip("within", "between")).alias("j", "c"))
    return rounded(cells.select("i", "j", "n", "classes", "c.within", "c.between"), 8)


@query(
    "class_coverage",
    """WITH r AS (SELECT label, count(*) AS n FROM latents WHERE global_index % 3 > 0 GROUP BY label),
    g AS (SELECT label, count(*) AS n FROM latents WHERE global_index % 3 = 0 GROUP BY label),
    x AS (SELECT r.n AS r, g.n AS g FROM r FULL JOIN g ON r.label IS NOT DISTINCT FROM g.label)
    SELECT count(r) AS classes, count(*) FILTER (r IS NOT NULL AND g >= 2) AS covered,
      round(count(*) FILTER (r IS NOT NULL AND g >= 2) / count(r), 6) AS coverage, CAST(coalesce(sum(g) FILTER (r IS NULL), 0) AS BIGINT) AS "foreign" FROM x""",
    ("latents",),
)
def _(t: Tables):
    gen, real = t.latents.where("global_index % 3 = 0"), t.latents.where("global_index % 3 > 0")
    return rounded(balance.class_coverage(gen, real, least=2))


NEAREST = """WITH x AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, [round(v::DOUBLE, 1) FOR v IN embedding] AS y FROM embeddings),
    d AS (SELECT a.id, b.id AS other, list_distance(a.{g}, b.x) AS d FROM x a JOIN x b ON {on}),
    n AS (SELECT id AS global_index, arg_min(other, {{'d': d, 'id': other}}) AS nearest, min(d) AS distance FROM d GROUP BY id)"""


@query("nearest_training_rows", NEAREST.format(g="y", on="true") + " SELECT global_index, nearest, round(distance, 9) AS distance FROM n")
def _(t: Tables):
    """Every rounded sample against all samples."""
    found = memorisation.nearest_training_rows(t.recon_features(1), t.features)
    return rounded(found.select("global_index", "nearest", "distance"), 9)


@query(
    "memorisation",
    NEAREST.format(g="x", on="a.id % 2 = 1 AND b.id % 2 = 0")
    + """ SELECT count(*) AS n, count(*) FILTER (distance = 0) AS copies, count(*) FILTER (distance <= 1.05) AS near,
      round(count(*) FILTER (distance <= 1.05) / count(*), 6) AS near_rate, round(avg(distance), 6) AS mean_distance FROM n""",
)
def _(t: Tables):
    """Odd samples as the generated ones, even ones as the training set, in blocks of a hundred."""
    gen, real = (t.features.where(F.col("global_index") % 2 == k) for k in (1, 0))
    return rounded(memorisation.memorisation(gen, real, 1.05, block=100).drop("verified_share"))


@query(
    "near_duplicate_rate",
    NEAREST.format(g="y", on="true") + """ SELECT count(*) AS n, count(*) FILTER (distance <= 0.23) AS near,
      round(count(*) FILTER (distance <= 0.23) / count(*), 6) AS near_rate FROM n""",
)
def _(t: Tables):
    return rounded(memorisation.near_duplicate_rate(t.recon_features(1), t.features, 0.23))


JUDGES = {"one": (1.5, 0.25), "two": (0.5, 0.0), "three": (1.25, -0.125)}


@query(
    "judge_gap",
    f"""WITH m AS (SELECT pos, avg(v) AS mu, var_samp(v) AS s FROM elements GROUP BY pos),
    j AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in JUDGES.items())}) v(judge, a, b)),
    f AS (SELECT judge, sum(pow((a - 1) * mu + b, 2)) + any_value(pow(a - 1, 2)) * sum(s) AS fid,
      sum(pow(0.125 * mu, 2)) + pow(0.125, 2) * sum(s) AS base FROM j, m GROUP BY judge)
    SELECT count(*) FILTER (judge <> 'three') AS train_judges, count(*) FILTER (judge = 'three') AS holdout_judges,
      round(avg(fid / base) FILTER (judge <> 'three'), 4) AS train_mean, round(avg(fid / base) FILTER (judge = 'three'), 4) AS holdout_mean,
      round(avg(fid / base) FILTER (judge = 'three') - avg(fid / base) FILTER (judge <> 'three'), 4) AS gap FROM f""",
    ("elements",),
)
def _(t: Tables):
    """Three judges that see the samples stretched and moved differently; the floor is a stretch by an eighth."""
    moved = lambda a, b: t.features.withColumn("features", F.transform("features", lambda v: v.cast("double") * a + b))
    real = dict.fromkeys(JUDGES, t.features)
    found = judges.judge_distances({k: moved(a, b) for k, (a, b) in JUDGES.items()}, real, dict.fromkeys(JUDGES, moved(1.125, 0.0)))
    return rounded(judges.judge_gap(found, ["one", "two"]), 4)


@query(
    "condition_number",
    """WITH p AS (SELECT label, max(v) FILTER (pos = 0) AS x, max(v) FILTER (pos = 1) AS y FROM elements WHERE pos < 2 GROUP BY global_index, label),
    c AS (SELECT label, count(*) AS n, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b FROM p GROUP BY label),
    e AS (SELECT label, n, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + b * b) AS hi, (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + b * b) AS lo FROM c)
    SELECT label, n, 2 AS dims, round(hi, 6) AS eig_max, round(lo, 6) AS eig_min, round(hi / lo, 6) AS condition FROM e""",
    ("elements",),
)
def _(t: Tables):
    """Of the first two features per label, where the eigenvalues have a closed form."""
    rows = t.features.withColumn("features", F.slice("features", 1, 2))
    return rounded(judges.condition_number(moments.moments(rows, by=["label"], strict=False), ["label"]))
