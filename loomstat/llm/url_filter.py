"""URL rules by a sort-merge range join over reversed-host keys.

A host turned round label by label ("www.example.com" -> "com.example.www.") makes "this host and all
its subdomains" one interval of keys, [com.example. , com.example/), and intervals of different rule
hosts nest or are disjoint. Sorting urls together with the interval ends and carrying the stack of the
intervals that are open (the rules of the current host and of its ancestors) answers every url in one
sweep. The sweep is a window with last(..., ignore nulls), so all of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_host(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What stands after the host up to ?, # or the end."""
    rest = _after_scheme(url)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_markers(rules: DataFrame) -> DataFrame:
    """Two rows a rule host, key and the stack that holds from that key on: its own with its ancestors' rules at the
    start of its interval, its ancestors' alone at the end.

    Of several verdicts for one (host, path) "block" wins (the largest string).
    """
    host = F.translate(F.coalesce(F.col("host"), F.lit("")), UPPER, LOWER)
    one = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    size = F.length("host") + F.length("path")
    own = one.groupBy("host").agg(F.collect_list(F.struct(size.alias("size"), F.length("host").alias("host_size"), "host", "path", "verdict")).alias("own"))
    labels = F.split("host", r"\.", -1)
    above = own.select(F.col("host").alias("of"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("i"), labels.alias("labels"))
    above = above.select("of", "i", F.array_join(F.expr("slice(labels, i, size(labels) - i + 1)"), ".").alias("host"))
    chain = above.join(own, "host").groupBy("of").agg(
        F.flatten(F.collect_list("own")).alias("stack"),
        F.flatten(F.collect_list(F.when(F.col("i") > 1, F.col("own")))).alias("outer"),
    )
    key = reversed_key(F.col("of"))
    start = chain.select(key.alias("key"), "stack")
    ends = chain.withColumn("key", key).select(F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("key"), F.col("outer").alias("stack"))
    return start.unionByName(ends)


def filter_urls(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url", default: str = "allow", per_salt: int = 2_000) -> DataFrame:
    """Judge every url: page_id, host, path, rule (host and path of the longest rule that fits, else null), verdict.

    A rule fits its host and all subdomains where the url's path starts with the rule's path. The longest host and path
    together win, of equally long ones the longer host, then the larger strings. Without a rule the verdict is default.
    Null urls and urls without :// have an empty host and path. Repeated rows are each judged. An empty table or an
    empty rule set gives no rows, or default everywhere. Only page_id and url are read, so other columns can't clash.

    Rows are dealt by a salt of their own hash, so a host with most of the rows spreads like any other; the interval
    ends are copied to each salt. There are as many salts as keep at least four urls to a copied rule (or per_salt
    urls), so the copies stay fewer than the urls for any number of rules.
    """
    rows, n_rules = pages.count(), rules.count()
    salts = max(1, -(-rows // max(per_salt, 4 * n_rules)))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    urls = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select("page_id", host.alias("host"), path.alias("path"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"))
    urls = urls.select("salt", reversed_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path")
    marks = rule_markers(rules).select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", F.lit(0).alias("kind"), "stack")
    swept = Window.partitionBy("salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = urls.unionByName(marks, allowMissingColumns=True).withColumn("open", F.last("stack", ignorenulls=True).over(swept))
    best = F.array_max(F.filter("open", lambda r: F.col("path").startswith(r["path"])))
    return lines.where("kind = 1").withColumn("best", best).select(
        "page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS rules(host, path, verdict)"))


OP5_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM cut),
fits AS (SELECT p.n, r.host || r.path AS rule, r.verdict FROM parts p JOIN rules r
         ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
         QUALIFY row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) = 1)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (n)
"""
