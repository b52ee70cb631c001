"""URL filters by host-suffix and path-prefix expressions.

Each URL is expanded into the expressions (host suffix, path prefix) that a
rule could have, as far as the rules' own depth goes; expressions meet rules
by an equi-join on a short hash prefix (crc32), the full digests (SHA-256) of
those that meet confirm, and the longest rule wins. Without a rule the verdict is ``allow``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DEFAULT = "allow"


def parts(url) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; empty for a null or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def _places(rules: DataFrame) -> tuple[int, int, int, int, list[int]]:
    """Least and most labels of rules' hosts, least and most slashes of their paths, and lengths after the last slash."""
    path = F.col("rule_path")
    tail = F.length(F.substring_index(path, "/", -1))
    labels, slashes = F.size(F.split("rule_host", r"\.", -1)), F.size(F.split(path, "/", -1)) - 1
    row = rules.agg(F.min(labels), F.max(labels), F.min(slashes), F.max(slashes), F.sort_array(F.collect_set(tail))).first()
    return row[0], row[1], row[2], row[3], list(row[4])  # as many lengths as a path's last part can have


def expand(host, path, least_labels: int, most_labels: int, least_slashes: int, most_slashes: int, tails: list[int]) -> F.Column:
    """Expressions ``host suffix + path prefix`` of a URL, as far as rules go.

    Host suffixes are cut at dots and path prefixes after slashes, each to the
    depth that rules have; ``tails`` are the lengths that rules' paths have
    after their last slash (0: all end there), which no slash may interrupt.
    So a URL has no more expressions than labels times path prefixes.
    """
    labels, parts_ = F.split(host, r"\.", -1), F.split(path, "/", most_slashes + 1)
    depth = F.least(F.size(labels), F.lit(most_labels))
    hosts = F.when(depth >= least_labels, F.transform(F.sequence(F.lit(least_labels), F.greatest(depth, F.lit(least_labels))), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")))
    found = F.size(parts_) - 1  # slashes, ``most_slashes`` of them at most
    upto = lambda k: F.when(k > 0, F.concat(F.array_join(F.slice(parts_, 1, k), "/"), F.lit("/"))).otherwise("")
    paths = F.when(found >= least_slashes, F.transform(F.sequence(F.lit(least_slashes), F.greatest(found, F.lit(least_slashes))), upto))
    if any(tails):
        size = F.array(*[F.lit(t) for t in tails])
        longer = lambda d: F.transform(size, lambda t: F.substr(path, F.lit(1), F.length(d) + t))
        fits = lambda d: F.filter(longer(d), lambda x: (F.length(x) == F.length(d)) | F.array_contains(size, F.length(x) - F.length(d)) & (F.instr(F.substr(x, F.length(d) + 1), "/") == 0))
        paths = F.array_distinct(F.flatten(F.transform(paths, fits)))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, F.lit("\0"), p))))


def rule_table(spark: SparkSession, rules: DataFrame) -> DataFrame:
    """Rules as rows (prefix, digest, rule, rule_len, verdict); a repeated rule counts once, block before allow."""
    expr = F.concat("rule_host", F.lit("\0"), "rule_path")
    one = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    return one.select(F.crc32(expr.cast("binary")).alias("prefix"), F.sha2(expr, 256).alias("digest"), F.concat("rule_host", "rule_path").alias("rule"), F.length(F.concat("rule_host", "rule_path")).alias("rule_len"), "verdict")


def judge(pages: DataFrame, rules=RULES, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    ``rules``: (host, path, verdict) rows, or a table of rule_host, rule_path
    and verdict; those with a null take no part. Null or malformed URLs have an
    empty host and path, which no rule fits. Repeated rows are judged one by
    one. All other columns pass unchanged, whatever their names: each row goes
    as one struct. Rows meet rules on the short hash prefix alone; the full
    digest is taken of what meets, and confirms. A row is put together again
    under a number of its own, so that no host or URL, however frequent, meets
    in one task; Spark broadcasts the rules if they are small enough and else
    shuffles both sides by hash prefix, splitting frequent expressions.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, verdict string")
    rules = rules.select("rule_host", "rule_path", "verdict").dropna()
    depth = _places(rules)
    host, path = parts(F.col(url))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(F.lit(0).alias("none"), *[pages[c] for c in keep]).alias("page"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    exprs = F.array().cast("array<string>") if depth[0] is None else expand(F.col("host"), F.col("path"), *depth)
    met = rows.withColumn("expr", F.explode_outer(exprs)).withColumn("prefix", F.crc32(F.col("expr").cast("binary"))).join(rule_table(spark, rules), "prefix", "left")
    confirmed = F.when(F.col("digest").isNotNull(), F.sha2("expr", 256) == F.col("digest"))
    best = F.max(F.when(confirmed, F.struct("rule_len", "rule", F.col("verdict").alias("v")))).alias("best")
    out = met.groupBy("row").agg(*[F.first(c).alias(c) for c in ("page", "host", "path")], best)
    return out.select(*[F.col("page")[c].alias(c) for c in keep], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), s AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM u
), r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT s.page_id, s.host, s.path, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM s LEFT JOIN r ON (s.host = rh OR ends_with(s.host, '.' || rh)) AND starts_with(s.path, rp)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1
"""
