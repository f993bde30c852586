"""URL verdicts from pattern rules indexed by their rarest literal token.

Native expressions only. Every rule is a regular expression on host + path that comes
with its complete literal tokens (runs of [A-Za-z0-9] that any URL it fits must hold as
whole tokens). It is filed under the one of them that fewest distinct URLs hold. A URL's
tokens fetch candidate rules by an equality join and only those run as regular expressions;
rules without a token are filed under the empty token, which every URL has.

Defined cases: a null URL or one without "://" has empty host and path, fits no rule and
gets the default verdict. Equal URLs are judged once. Ties of length go to the rule
whose text sorts first. Columns other than page_id and url are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkeel.llm.frames import lower_ascii, sized

TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path begins with `path`."""
    whole = re.match(r"(.*[^A-Za-z0-9])?", path, re.S)[0]
    tokens = tuple(re.findall(TOKEN, host) + re.findall(TOKEN, whole))
    literal = "".join("\\" + c if not c.isalnum() else c for c in host + path)
    return Rule(host + path, rf"^([^/]*\.)?{literal}", tokens, verdict, 1)


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    """A fallback rule: decides only where no prefix rule fits."""
    return Rule(pattern, pattern, tokens, verdict, 0)


#: The stated host and path rules.
STATED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Fallback patterns for advertising and tracking hosts and paths.
FALLBACK = (
    pattern_rule("block", r"^([^/]*\.)?ads-track\.", "ads", "track"),
    pattern_rule("block", r"^(ad|ads|adserver|tracker|tracking)[0-9]*\."),
    pattern_rule("block", r"/(ads|banners|popunder)/"),
)
RULES = tuple(prefix_rule(*r) for r in STATED) + FALLBACK


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.pattern, list(r.tokens), r.verdict, r.rank) for r in rules],
                                 "name string, pattern string, tokens array<string>, rule_verdict string, rank int")


def split_url(pages: DataFrame) -> DataFrame:
    there = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        "page_id", lower_ascii(F.regexp_extract(there, r"(?s)^.*?://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(there, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url).

    The prefix rule with the longest text decides and is named in `rule`; where none
    fits, the longest fallback pattern decides, else `default`, and `rule` is null.
    """
    split = split_url(pages)
    urls = split.select("host", "path").distinct()
    tokens = urls.select("host", "path", F.explode(F.array_distinct(F.concat(
        F.array(F.lit("")), F.regexp_extract_all(F.concat("host", "path"), F.lit(TOKEN), F.lit(0))))).alias("token"))
    named = rules.select("name", F.explode("tokens").alias("token"))
    held = tokens.join(sized(named.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = named.join(held, "token", "left").groupBy("name").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"))
    index = rules.join(rarest, "name", "left").select(
        F.coalesce("r.token", F.lit("")).alias("token"), "name", "pattern", "rule_verdict", "rank")
    fits = tokens.join(sized(index), "token").filter(F.expr("concat(host, path) rlike pattern"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct(
        (-F.col("rank")).alias("rank"), (-F.length("name")).alias("length"), "name", "rule_verdict")).alias("b"))
    return split.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.when(F.col("b.rank") == -1, F.col("b.name")).alias("rule"),
        F.coalesce("b.rule_verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH split AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
named AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host || path, '^([^/]*\.)?ads-track\.|^(ad|ads|adserver|tracker|tracking)[0-9]*\.|/(ads|banners|popunder)/')
  THEN 'block' ELSE 'allow' END AS verdict
FROM named"""
