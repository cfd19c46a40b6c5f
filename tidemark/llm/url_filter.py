"""URL filters: host-suffix and path-prefix expressions, short hash prefixes, full digests, rule precedence.

Each URL is expanded into all pairs of a suffix of its host (at label borders, of as many labels as rules have) and a
prefix of its path (of the lengths that rules have), so that a long host or path costs no more than a short one. Expressions and rules meet in an equi-join on four bytes of their digest; the full digest
confirms, and of the rules that fit a URL the longest wins. Equal expressions are joined once however many URLs hold
them, so a host that a third of the pages share is one row of that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import fresh, read

#: Fixed values of the contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z alone) and path; both empty without a scheme."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    after = F.regexp_replace(url, "(?s)^.*?://", "")
    host = F.translate(F.regexp_extract(after, "(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(after, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of pages with host, path, rule (host and path of the rule that decides, else null) and verdict.

    Rules are rows (verdict, host, path); a rule fits its host and all subdomains when the path starts with its own.
    Of several that fit, the longest rule wins, then the longest host, then a block. Null and malformed URLs have an
    empty host and path, which no rule fits unless its host is empty too. Every row is kept once; columns of pages
    that are named like the added ones are replaced.
    """
    added = ["host", "path", "rule", "verdict"]
    base = pages.drop(*added)
    expr, digest, key, fit, sizes, depths = fresh(base, "__expr", "__digest", "__key", "__fit", "__sizes", "__depths")
    host, path = host_and_path(F.col(url_col))
    base = base.withColumns({"host": host, "path": path})
    rules = rules.filter("verdict is not null and host is not null and path is not null").select("verdict", F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
    # as many lengths as rule paths have, and as many label counts as rule hosts
    base = base.withColumn(sizes, rules.agg(F.array_sort(F.collect_set(F.length("rule_path"))).alias("l")).scalar())
    base = base.withColumn(depths, rules.agg(F.array_sort(F.collect_set(F.size(F.split("rule_host", r"\.", -1)))).alias("l")).scalar())
    lengths = F.col(sizes)
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.filter(F.col(depths), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("h"), p.alias("p")))))
    # one row for each host and path prefix that occurs, with all its expressions
    keyed = F.concat_ws("\n", "host", F.substring("path", F.lit(1), F.coalesce(F.array_max(lengths), F.lit(0))))
    base = base.withColumn(key, F.sha2(keyed, 256))
    known = base.select(key, pairs.alias(expr)).dropDuplicates([key])
    known = known.select(key, F.explode(expr).alias(expr)).withColumn(digest, F.sha2(F.concat_ws("\n", f"{expr}.h", f"{expr}.p"), 256))
    rules = rules.withColumn("d", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)).withColumn("short", F.substring("d", 1, 8))
    met = known.withColumn("short", F.substring(digest, 1, 8)).join(rules, "short").filter(F.col(digest) == F.col("d"))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), (F.col("verdict") == "block").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict"))
    best = met.groupBy(key).agg(F.max(rank).alias(fit))
    out = base.join(best, key, "left")
    return out.withColumns({"rule": F.col(f"{fit}.rule"), "verdict": F.coalesce(F.col(f"{fit}.verdict"), F.lit(default))}).select(*[c for c in pages.columns if c not in added], *added)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five fixed rules over every page; pages that no rule fits are allowed."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
with u as (
  select page_id, row_number() over () as r, coalesce(strpos(url, '://'), 0) > 0 as ok,
         substr(url, strpos(url, '://') + 3) as after from pages),
p as (
  select page_id, r,
    case when ok then translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when ok then regexp_extract(after, '^[^/?#]*([^?#]*)', 1) else '' end as path from u),
rules(verdict, h, q) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit as (
  select r, arg_max(h || q, length(h || q)) as rule, arg_max(verdict, length(h || q)) as verdict
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by r)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join fit using (r)
"""
