"""URL filters [native]: host-suffix and path-prefix expressions joined on short digest prefixes.

Every distinct (host, path) is expanded into the expressions a rule could have
been written as: each suffix of the host at a label border, combined with each
prefix of the path that ends in ``/`` (and the whole path). The expressions meet
the rules in an equi-join on the first ``PREFIX_HEX`` hex digits of their SHA-256
digest; a match counts once the full digests agree. Of the confirmed rules the
longest host, then the longest path wins; ``block`` wins between two rules of one
expression.

Defined cases: a null url, or one without ``://``, has empty host and path and
gets the default verdict; so does an empty path (no rule path is a prefix of it).
Repeated urls are judged once and joined back, null-safe. Rule paths must start
and end with ``/`` or equal the whole path. An empty rule or page table is fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8
DEFAULT_VERDICT = "allow"
#: Rule tables up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_RULES = 10_000
#: Fixed values of the query: host, path, action.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, action string")


def split_url(url):
    """(host, path) columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return host, path


def judge(urls: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """Distinct (host, path) rows with rule and verdict."""
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split(F.col("path"), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")),
    )
    prefixes = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.array_union(prefixes, F.array("path")))
    expressions = urls.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes))
    digest = F.sha2(F.concat("h", F.lit(" "), "p"), 256)
    expressions = expressions.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    rule_digest = F.sha2(F.concat("host", F.lit(" "), "path"), 256)
    listed = rules.select(
        F.substring(rule_digest, 1, PREFIX_HEX).alias("short"),
        rule_digest.alias("full"),
        F.struct(
            F.length("host").alias("by_host"), F.length("path").alias("by_path"), (F.col("action") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"), F.col("action").alias("verdict"),
        ).alias("best"),
    )
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    won = (
        expressions.join(listed, "short").where(F.col("digest") == F.col("full"))
        .groupBy("host", "path").agg(F.max("best").alias("best"))
    )
    return won.select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of `pages` (page_id, url)."""
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    verdicts = judge(rows.select("host", "path").distinct(), rules, default)
    return rows.join(verdicts, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark))


ORACLE_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id,
             translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)', 1) AS path FROM r),
v AS (SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
      END AS rule FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""
