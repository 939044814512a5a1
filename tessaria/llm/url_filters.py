"""Operator 13, URL filters: host-suffix and path-prefix expressions of each URL, looked up by short hash prefixes.

A URL gives one expression for each host suffix that some rule's host has and each path length that this host's rules
have; no other text could equal a rule. Expressions meet rules by the first eight hex digits of their SHA-256, the
whole digest confirms, and the longest rule decides. Rules of a checked size are broadcast; more are joined by a
shuffle, whose crowded keys (`com`) adaptive execution splits, as both sides are plain exchanges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, cut, shared_dir, table

#: The rules of the query (fixed values): verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that make a join key, and rules that are broadcast at most (a row is under 1 kB: 100 MB).
SHORT, BROADCAST_RULES = 8, 100_000


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """The host, A-Z in lower case, after the first `://` up to `/`, `?`, `#` or the end, and then the path up to `?`, `#` or the end; empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    path = F.substring_index(F.substring_index(F.substr(rest, F.length(host) + 1), "?", 1), "#", 1)
    return F.translate(host, UPPER, LOWER), path


def _short(text: F.Column) -> F.Column:
    return F.left(F.sha2(text, 256), F.lit(SHORT))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", carry: tuple[str, ...] = ("page_id",), broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """One row per input row: the carried columns, host, path, rule and verdict.

    rules has host, path and verdict. A rule fits its host and all hosts below it, where the URL's path starts with the
    rule's, both as code points. The rule with the longest text (host, then path) decides, of equally long ones that
    with the longer host; of rules of one text `block` stands above any other verdict, else the smallest. rule is null
    where none fits and verdict is `default`. A null URL, or one without `://`, has an empty host and path, which fit
    no rule. Rules with an empty or null host or a null verdict fit nothing; a null path is empty. Rule hosts are taken with A-Z in
    lower case. Repeated rows each come back; a carried column named like an output gets `_carried` after its name.
    Empty tables give empty results, an empty rule table gives `default`. The tables written on the way lie in the
    shared folder.
    """
    folder, outputs = shared_dir(pages.sparkSession), ("host", "path", "rule", "verdict")
    first = F.min_by("verdict", F.struct(F.col("verdict") != "block", F.col("verdict")))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host != '' and verdict is not null")
    rules = rules.groupBy("host", "path").agg(first.alias("verdict")).withColumn("rule", F.concat("host", "path"))
    rules = cut(rules.withColumn("digest", F.sha2("rule", 256)), folder, "rules")
    small = rules.count() <= broadcast_rules
    near = F.broadcast if small else lambda x: x
    # What each host's rules ask for: the lengths of their paths. At most as many as the longest path has characters.
    hosts = rules.groupBy("host").agg(F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).select(_short(F.col("host")).alias("short"), "lengths", F.sha2("host", 256).alias("host_digest"))
    host, path = host_and_path(F.col(url))
    pages = pages.select(*carried(carry, outputs), host.alias("host"), path.alias("path"))
    urls = pages.select("host", "path").filter("host != ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host", "path", F.explode(suffixes).alias("suffix")).withColumn("short", _short(F.col("suffix")))
    asked = asked.join(near(hosts), "short").filter(F.sha2("suffix", 256) == F.col("host_digest"))
    asked = asked.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    asked = asked.withColumn("full", F.sha2(F.concat("suffix", F.left("path", F.col("n"))), 256)).withColumn("short", F.left("full", F.lit(SHORT)))
    listed = rules.select(F.left("digest", F.lit(SHORT)).alias("short"), "digest", F.length("host").alias("host_length"), "rule", "verdict")
    # Equal texts of another split (`a.b` + `/c` has no other) differ in the host's length, so that is compared as well.
    fits = asked.join(near(listed), "short").filter((F.col("full") == F.col("digest")) & (F.col("host_length") == F.length("suffix")))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("host_length")))
    judged = cut(fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict"), folder, "judged")
    return pages.join(judged, ["host", "path"], "left").select(*[c for c in pages.columns if c not in ("host", "path")], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


_SQL = r"""
with r(verdict, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p as (select row_number() over () as k, page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
q as (select k, page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from p),
u as (select k, page_id, host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') as path from q),
f as (select u.k, r.verdict, r.host || r.path as rule, row_number() over (partition by u.k order by length(r.host || r.path) desc, length(r.host) desc) as n
      from u join r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path))
select u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') as verdict from u left join f on u.k = f.k and f.n = 1
"""
QUERIES = {"op13_url_filters": op13_url_filters}
ORACLE = {"op13_url_filters": _SQL}
