"""URL filters: pattern rules found by their rarest literal token (DataFrame functions only).

Two rule lists are compiled into one index. Site rules (host and path prefix) decide first, the
longest that fits wins. Where none fits, pattern rules decide: a url that one of them matches is
blocked, any other allowed.

Each rule is a regular expression with the literal tokens a matching url must contain. How often these
tokens occur is counted over all urls, and the rule is filed under its rarest one. A url's own tokens
are looked up in that index by a join, broadcast where the rules are measured small, and only the rules so
fetched run their expression; what a url costs does not grow with the list. The few matches are
reduced to one row a url and joined back.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
allowed; repeated rows are judged one by one; ties in length go to the smaller rule text; a rule without any
token is filed under a blank that every url has; two site rules of one text with other verdicts are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import settle

BROADCAST_CHARS = 32_000_000
# letters and digits, and every character beyond ASCII
TOKEN = r"[0-9A-Za-z\u0080-\x{10FFFF}]+"
ALPHABET = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# The site rules asked for, and the patterns that decide elsewhere.
SITE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
PATTERN_RULES = (
    ("spam", r"[./-]spam[.-]"), ("casino", r"[./-]casino[./-]"), ("pills", r"[./-]pills[./-]"), ("bets", r"[./-]bets[./-]"),
    ("adult", r"[./-]adult[./-]"), ("ads", r"[./]ads[./-]"), ("track", r"-track[./]"), ("porn", r"[./-]porn[./-]"),
    ("viagra", r"[./-]viagra[./-]"), ("poker", r"[./-]poker[./-]"), ("warez", r"[./-]warez[./-]"), ("phishing", r"[./-]phishing[./-]"),
)


@dataclass(frozen=True)
class Rule:
    """``literal``: text whose tokens every url has that the expression matches."""

    text: str
    verdict: str
    regex: str
    literal: str
    site: bool


def site_rule(verdict: str, text: str) -> Rule:
    """The host itself or any subdomain, then the path prefix, against ``//host path``."""
    host, slash, path = text.partition("/")
    host = host.translate(ALPHABET)
    regex = r"^//(?:[^/]*\.)?" + re.escape(host) + (re.escape(slash + path) if slash else "(?:/|$)")
    return Rule(text, verdict, regex, host, True)


def pattern_rule(token: str, regex: str) -> Rule:
    """``token``: a literal that every url the pattern matches has as a token of its host or path."""
    return Rule(regex, "block", regex, token, False)


def host_of(url: Column) -> Column:
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    return F.when(url.contains("://"), F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                                   "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(url, r"(?s)^.*?://[^/?#]*", "")
    return F.when(url.contains("://"), F.regexp_extract(rest, r"^[^?#]*", 0)).otherwise(F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1))


def rule_index(spark, rules: list[Rule], urls: DataFrame) -> DataFrame:
    """text, verdict, regex, site, token: each rule under its token with the fewest urls (then the smallest token)."""
    listed = spark.createDataFrame([(r.text, r.verdict, r.regex, r.literal, r.site) for r in rules],
                                   "text string, verdict string, regex string, literal string, site boolean")
    wanted = settle(listed.select("text", "verdict", "regex", "site", F.explode(F.when(F.size(_tokens(F.col("literal"))) > 0, _tokens(F.col("literal")))
                                                                                 .otherwise(F.array(F.lit("")))).alias("token")))
    kinds = small(wanted.select("token").distinct(), rules)
    counts = urls.select(F.explode(url_tokens()).alias("token")).join(kinds, "token").groupBy("token").count()
    counted = wanted.join(counts, "token", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    return settle(counted.groupBy("text", "verdict", "regex", "site").agg(F.min_by("token", F.struct("n", "token")).alias("token")))


def url_tokens() -> Column:
    """The tokens of host and path, and the blank."""
    return F.concat(F.array(F.lit("")), _tokens(F.concat(F.col("host"), F.lit("/"), F.col("path"))))


def small(table: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hinted for broadcast where the rules' characters are few; a longer list is left to an equi-join."""
    size = sum(len(r.text) + len(r.regex) + len(r.literal) for r in rules)
    return F.broadcast(table) if size <= BROADCAST_CHARS else table


def judge(pages: DataFrame, row: list[str], url_col: str = "url", site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """Columns: row (a struct of the named columns), host, path, rule (site rule or null), pattern (or null), verdict."""
    verdicts: dict[str, str] = {}
    for verdict, text in site_rules:
        if verdicts.setdefault(text, verdict) != verdict:
            raise ValueError(f"two verdicts for the rule {text!r}")
    rules = list(dict.fromkeys([site_rule(v, t) for v, t in site_rules] + [pattern_rule(t, p) for t, p in pattern_rules]))
    url = F.coalesce(F.col(url_col), F.lit(""))
    split = pages.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    if not rules:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("pattern"), F.lit("allow").alias("verdict"))
    whole = F.concat(F.lit("//"), F.col("host"), F.col("path"))
    index = small(rule_index(pages.sparkSession, rules, split), rules)
    fetched = split.select("host", "path", F.explode(url_tokens()).alias("token")).join(index, "token")
    hits = fetched.where(F.rlike(F.when(F.col("site"), whole).otherwise(F.lower(whole)), F.col("regex")))
    longest = F.min(F.when(F.col("site"), F.struct((-F.length("text")).alias("n"), "text", "verdict")))
    found = hits.groupBy("host", "path").agg(longest.alias("best"), F.min(F.when(~F.col("site"), F.col("text"))).alias("pattern"))
    return split.join(found, ["host", "path"], "left").select(
        "row", "host", "path", F.col("best.text").alias("rule"), "pattern",
        F.coalesce(F.col("best.verdict"), F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def _sql() -> str:
    site = ", ".join(f"('{v}', '{t}', '{site_rule(v, t).regex}')" for v, t in SITE_RULES)
    patterns = ", ".join(f"('{p}')" for _, p in PATTERN_RULES)
    return rf"""
WITH site(verdict, rule, regex) AS (VALUES {site}), pattern(regex) AS (VALUES {patterns}),
split AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
hit AS (
  SELECT u.host, u.path, arg_min(s.rule, (-length(s.rule), s.rule)) AS rule, arg_min(s.verdict, (-length(s.rule), s.rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split) u JOIN site s ON regexp_matches('//' || u.host || u.path, s.regex) GROUP BY ALL),
bad AS (
  SELECT DISTINCT u.host, u.path FROM (SELECT DISTINCT host, path FROM split) u JOIN pattern p
  ON regexp_matches('//' || lower(u.host || u.path), p.regex))
SELECT page_id, split.host, split.path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN bad.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM split LEFT JOIN hit USING (host, path) LEFT JOIN bad USING (host, path)
"""


URL_SQL = _sql()
