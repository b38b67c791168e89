"""URL filter: path rules first, then a list of URLs behind a blocked Bloom filter.

Rules for edge cases: a null url, or one without ``://``, has an empty host and path, no rule and is allowed; repeated
rows are judged alike; an empty table or list is fine; other columns are carried along only where named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bloom
from plumbline.llm.common import table

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# (verdict, host, path): a rule holds for the host and its subdomains where the path starts with the rule's.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
# Words in host names that put a site on the list of the registered query (fixed values).
LISTED_WORDS = ["casino", "poker", "betting", "lottery", "viagra", "pharma", "porn", "xxx", "escort", "payday"]


def host(url: Column) -> Column:
    # A character class with \\n: the whole text counts, also across line ends.
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, then the path without ``.html`` or a last slash; null where there is no host."""
    short = F.regexp_replace(host(url), r"^(www|m)\.", "")
    return F.when(short != "", F.concat(short, F.regexp_replace(path(url), r"(\.html?|/+)$", "")))


def rule_columns(host_col: Column, path_col: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def listed_flag(rows: DataFrame, listed: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: is ``key`` among the values of the one column of ``listed``?

    The Bloom filter settles most rows as absent without a shuffle; the rest meet the list in an exact join, whose skewed
    side adaptive execution splits (one URL may hold most rows).
    """
    exact = listed.select(F.col(listed.columns[0]).alias("_listed")).where("_listed IS NOT NULL").distinct()
    probed = bloom.probe(rows, key, bloom.build(exact, "_listed"), "_maybe")
    absent = probed.where(~F.col("_maybe")).drop("_maybe").withColumn(flag, F.lit(False))
    met = probed.where("_maybe").drop("_maybe").join(exact, F.col(key) == F.col("_listed"), "left")
    return absent.unionByName(met.withColumn(flag, F.col("_listed").isNotNull()).drop("_listed"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, keep=("page_id",)) -> DataFrame:
    """``keep`` columns with ``host``, ``path``, ``rule``, ``verdict``: the longest rule's, else block if listed."""
    rows = pages.select(*[F.col(c) for c in keep], host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                        canonical(F.col("url")).alias("_canonical"))
    flagged = listed_flag(rows, listed, "_canonical", "_on_list")
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return flagged.select(*keep, "host", "path", name.alias("rule"), F.coalesce(
        verdict, F.when(F.col("_on_list"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of pages on hosts that carry a listed word."""
    return pages.where(host(F.col("url")).rlike("|".join(LISTED_WORDS))).select(
        canonical(F.col("url")).alias("url")).distinct()


def op2(spark, folder):
    pages = table(spark, folder, "pages")
    return judge(pages, listed_urls(pages))


SQL = f"""
WITH p AS (
  SELECT page_id,
    translate(CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN ''
      ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') END, '{UPPER}', '{LOWER}') AS host,
    CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN ''
      ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
k AS (SELECT *, CASE WHEN regexp_replace(host, '^(www|m)\\.', '') <> ''
    THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html?|/+)$', '') END AS canonical FROM p),
listed AS (SELECT DISTINCT canonical AS c FROM k WHERE canonical IS NOT NULL AND regexp_matches(host, '{"|".join(LISTED_WORDS)}')),
r AS (SELECT k.*, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM k)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN canonical IN (SELECT c FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
