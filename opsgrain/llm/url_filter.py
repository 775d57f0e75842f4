"""Op 8, URL filters: rules looked up by their rarest literal token.

Two kinds of rules, both written as patterns:

* host rules ``example.com/en/``: fit the host and its subdomains where the path begins so; the longest that
  fits decides;
* pattern rules: ``*`` stands for any characters and ``^`` for one that ends a token; a rule without them fits
  anywhere in the URL. They decide where no host rule fits: blocked if a block rule fits and no allow rule.

A rule's literal tokens are its runs of letters and digits that stand whole in every URL it fits. The index
keeps each rule under the one token that is rarest among the URLs; a URL's tokens fetch candidate rules, and
only those run their regular expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgrain.llm.common import lower_az

RULES = "rule string, kind string, verdict string"


def host_path(url):
    """Host and path of a URL, both empty where it is null or has no ``://``."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.when(known, lower_az(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).otherwise("")
    path = F.when(known, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def _compile(rule: str, kind: str) -> tuple[str, list[str]]:
    """The regular expression of a rule over ``host + path`` or the lower-cased URL, and its literal tokens."""
    if kind == "host":
        host, slash, path = rule.partition("/")
        tokens = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
        return rf"(?s)^(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", tokens
    low = rule.lower()
    regex = "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in low)
    whole = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", low)  # an end or * may cut a token
    return "(?s)" + regex, whole


def index(spark: SparkSession, rules: list[tuple[str, str, str]], tokens: DataFrame) -> DataFrame:
    """Rules by their rarest token: token, rule, kind, verdict, regex. ``tokens`` has the token counts ``token, n``.

    A rule without literal tokens is kept under the empty token, which every URL has.
    """
    rows = [(i, rule, kind, verdict, *_compile(rule, kind)) for i, (rule, kind, verdict) in enumerate(rules)]
    made = spark.createDataFrame(rows, f"id int, {RULES}, regex string, tokens array<string>")
    each = made.select("id", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    rarest = each.join(tokens, "token", "left").groupBy("id").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    )
    return made.join(rarest, "id").drop("tokens", "id")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """A verdict for each row of ``page_id, url``; other columns are not read.

    Returns page_id, host, path, rule (the longest host rule that fits, of two as long the smaller one, else
    null), verdict, and matched (the pattern rules that fit, sorted and comma-joined). Each distinct URL is judged once;
    repeated rows stay. A null or empty URL has no host, fits no host rule, and gets ``default`` unless a
    pattern rule fits.
    """
    spark = pages.sparkSession
    url = F.coalesce("url", F.lit(""))
    host, path = host_path(url)
    distinct = pages.select(url.alias("u")).distinct()
    tokens = F.array_distinct(F.concat(F.regexp_extract_all(F.lower("u"), F.lit("[a-z0-9]+"), F.lit(0)), F.array(F.lit(""))))
    each = distinct.select("u", F.explode(tokens).alias("token"))
    found = index(spark, rules, each.groupBy("token").agg(F.count("*").alias("n")))
    at, under = host_path(F.col("u"))
    text = F.when(F.col("kind") == "host", F.concat(at, under)).otherwise(F.lower("u"))
    fits = each.join(found, "token").where(F.regexp_like(text, F.col("regex")))
    best = F.struct(-F.length("rule"), "rule", "verdict")
    of_kind = lambda kind, verdict: F.max((F.col("kind") == kind) & (F.col("verdict") == verdict))
    judged = fits.groupBy("u").agg(
        F.min(F.when(F.col("kind") == "host", best)).alias("best"),
        of_kind("pattern", "block").alias("blocked"), of_kind("pattern", "allow").alias("allowed"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "pattern", F.col("rule")))).alias("matched"),
    )
    own = F.when(F.col("blocked") & ~F.col("allowed"), "block").when(F.col("allowed"), "allow").otherwise(default)
    return pages.select("page_id", url.alias("u"), host.alias("host"), path.alias("path")).join(judged, "u", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", own).alias("verdict"), F.coalesce(F.array_join("matched", ","), F.lit("")).alias("matched"),
    )


#: The host rules of the query, and pattern rules for the rest.
HOST_RULES = [
    ("com/", "host", "allow"), ("example.com/en/", "host", "block"), ("www.example.com/en/", "host", "allow"),
    ("net/es/", "host", "block"), ("net/fr/", "host", "block"),
]
PATTERN_RULES = [
    ("?utm_source=", "pattern", "block"), ("&ref=", "pattern", "block"), ("/amp/", "pattern", "block"),
    ("://m.*.org/de/", "pattern", "block"), (".html^", "pattern", "allow"), ("/login^", "pattern", "block"),
]

SQL = r"""
WITH parts AS (
  SELECT page_id, lower(coalesce(url, '')) AS low, coalesce(url, '') AS u,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rule, rhost, rpath, rverdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), judged AS (
  SELECT *, (SELECT arg_max({'rule': rule, 'verdict': rverdict}, length(rule)) FROM rules
             WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS best,
    concat_ws(',', CASE WHEN contains(low, '&ref=') THEN '&ref=' END, CASE WHEN regexp_matches(low, '\.html([^a-z0-9_.%-]|$)') THEN '.html^' END,
      CASE WHEN contains(low, '/amp/') THEN '/amp/' END, CASE WHEN regexp_matches(low, '/login([^a-z0-9_.%-]|$)') THEN '/login^' END,
      CASE WHEN regexp_matches(low, '://m\..*\.org/de/') THEN '://m.*.org/de/' END, CASE WHEN contains(low, '?utm_source=') THEN '?utm_source=' END) AS matched
  FROM split
)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN contains(matched, '.html^') THEN 'allow' WHEN matched <> '' THEN 'block' ELSE 'allow' END) AS verdict,
       matched FROM judged
"""
