"""URL filters: a sort-merge range join of canonical URL keys with rule prefixes, in DataFrame functions only.

A host is written from its last label to its first, then a separator and the path, so a rule is a prefix of the keys it
covers and its keys form one interval of the sorted order. Because a rule also covers subdomains, a URL has one key for
each suffix of its host. URL keys and rule starts are sorted together; prefixes nest, so the rules open at any point are
the stack of the last rule start before it, and the sweep only has to carry that stack along.

URLs are dealt to buckets by a hash of the whole row and every bucket gets all rule starts: a hot host is spread like any
other, and a bucket reads its share of the URLs plus the rules, as a stream with a sort that can spill.

Null or odd input: a null URL, or one without ``://``, has empty host and path and fits no rule. Repeated rows come back
as often as they went in. Rules with a null host or path are left out; of two rules with one host and path the blocking
one counts. Further columns of the input are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from shardloom.llm.registry import query, table

# The rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
MARK = "\u0001"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, SMALL)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Each rule start with the rules open there, itself included: those whose key is a prefix of its key."""
    clean = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("key", F.concat(reversed_host(F.col("host")), F.lit(MARK), F.col("path")))
    )
    prefixes = clean.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select(
        "key", F.expr("substring(key, 1, n)").alias("prefix")
    )
    outer = clean.select(
        F.col("key").alias("prefix"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
            F.col("key").alias("key"), "host", "path", "verdict",
        ).alias("rule"),
    )
    return prefixes.join(outer, "prefix").groupBy("key").agg(F.collect_list("rule").alias("stack"))


def judge_urls(
    urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
    default: str = "allow", buckets: int | None = None,
) -> DataFrame:
    """Verdict of the longest fitting rule for every URL; ``default`` where none fits.

    A rule fits its host and all subdomains if the URL's path starts with its path. Longest means host and path together,
    then the host. Returns the id, host, path, rule (null if none fits) and verdict.
    """
    spark = urls.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(f"`{url_col}`")
    rows = urls.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    # Equal rows must share a bucket to be counted together; the id is part of the key, so only true copies do.
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "host", "path"), F.lit(buckets)).cast("int"))
    labels = F.split("host", r"\.", -1)
    keys = rows.select(
        "*", labels.alias("labels"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("depth")
    ).select(
        "bucket", "id", "host", "path", (F.col("depth") == 1).cast("long").alias("copies"),
        F.expr("array_join(slice(labels, size(labels) - depth + 1, depth), '.')").alias("suffix"),
    ).withColumn("key", F.concat(reversed_host(F.col("suffix")), F.lit(MARK), F.col("path"))).withColumn("is_url", F.lit(True))
    starts = rule_stacks(rules).select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "key", "stack", F.lit(False).alias("is_url")
    )
    sweep = Window.partitionBy("bucket").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        keys.unionByName(starts, allowMissingColumns=True)
        .withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("is_url")
    )
    fits = F.filter("open", lambda r: F.col("key").startswith(r["key"]) & (r["host"] == F.col("suffix")))
    best = swept.withColumn("best", F.array_max(fits)).groupBy("bucket", "id", "host", "path").agg(
        F.max("best").alias("best"), F.sum("copies").alias("copies")
    )
    return best.select(
        F.col("id").alias(id_col), "host", "path",
        F.concat("best.host", "best.path").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.expr("array_repeat(0, int(copies))")).alias("copy"),
    ).drop("copy")


OP2_SQL = r"""
WITH rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT row_number() OVER () AS n, page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
m AS (SELECT n, max({'size': length(rh) + length(rp), 'host': length(rh), 'rule': rh || rp, 'v': v}) AS best
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""


@query("op2_url_filters", OP2_SQL)
def op2_url_filters(spark, sf_dir):
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS t(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)
