"""URL filter: pattern rules indexed by their rarest literal token (DataFrame functions only).

A rule is a regular expression with literal tokens that every URL it fits must contain; they
are derived from the rule's text. The tokens are counted over all URLs and each rule is filed under its rarest
one; a URL's own tokens fetch candidate rules, and only those run their expressions.

pattern_rule reads the usual filter syntax: `||host` fits a host and its subdomains, `|` at either
end anchors, `*` stands for anything, `^` for a separator or the end, and `@@` marks an exception.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reverie.llm.common import boxed, lower_ascii
from reverie.llm.url_patterns import pattern_lines

#: Tiers: a rule of a higher one wins.
BLOCKS, EXCEPTIONS, CONTRACT = 0, 1, 2


@dataclass(frozen=True)
class UrlRule:
    name: str
    regex: str
    verdict: str
    tokens: tuple[str, ...]
    #: Rules of a higher tier win, then the longer ones, then the name.
    tier: int = 0
    length: int = 0


def host_path_rule(rule: str, verdict: str) -> UrlRule:
    """`host/path`: fits the host and all its subdomains where the URL's path starts with the rule's."""
    host, slash, path = rule.partition("/")
    shown = host + slash + path
    inner = [t for t in re.split("[^A-Za-z0-9]+", shown) if t]
    if path and path[-1].isalnum():
        inner = inner[:-1]  # the last word may go on in the URL
    return UrlRule(shown, f"^(?:[^/]*\\.)?{re.escape(host)}{re.escape(slash + path)}", verdict, tuple(inner), CONTRACT, len(shown))


def host_word_rule(word: str, verdict: str = "block") -> UrlRule:
    """A word of a host, between dots or hyphens."""
    return UrlRule(f"word:{word}", f"^(?:[^/]*[.-])?{re.escape(word)}[.-]", verdict, (word,), BLOCKS, len(word))


def pattern_rule(line: str) -> UrlRule:
    """A rule in filter syntax; it reads host and path, without the scheme, and tells letters' case apart in the path.

    A run of letters and digits is a literal token if what stands on both its sides in the rule
    can't continue it in a URL: another literal, a separator or an anchor.
    """
    body = line.removeprefix("@@")
    host, start = body.startswith("||"), body.startswith("|")
    inner = body[2 if host else 1 if start else 0 :]
    end = inner.endswith("|")
    inner = inner[:-1] if end else inner
    part = {"*": ".*", "^": "(?:[^A-Za-z0-9_.%-]|$)"}
    regex = ("^(?:[^/]*\\.)?" if host else "^" if start else "") + "".join(part.get(c) or re.escape(c) for c in inner) + ("$" if end else "")
    tokens = [t[0] for t in re.finditer("[A-Za-z0-9]+", inner) if (inner[t.start() - 1] != "*" if t.start() else start) and (inner[t.end()] != "*" if t.end() < len(inner) else end)]
    verdict, tier = ("allow", EXCEPTIONS) if line.startswith("@@") else ("block", BLOCKS)
    return UrlRule(line, regex, verdict, tuple(dict.fromkeys(tokens)), tier, len(inner))


# The words of a host that the method blocks.
BLOCKED_WORDS = ("ads", "bets", "casino", "lottery", "phishing", "pills", "porn", "spam", "torrent", "viagra")

CONTRACT_RULES = (
    host_path_rule("net/", "block"),
    host_path_rule("example.net/en/", "allow"),
    host_path_rule("example.com/de/", "block"),
    host_path_rule("org/fr/", "allow"),
)
METHOD_RULES = tuple(host_word_rule(w) for w in BLOCKED_WORDS) + tuple(map(pattern_rule, pattern_lines()))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = rest.substr(F.length(host) + 1, F.length(rest))
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(F.regexp_extract(tail, r"^[^?#]*", 0), F.lit(""))


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda t: t != ""))


RULE = "name string, tier int, len int, verdict string, regex string, tokens array<string>"


def filed_rules(spark: SparkSession, tokens: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    """The rules (RULE) with `token`: of each its token that the fewest URLs hold, ties to the first, '' if it has none.

    tokens has a row for each token of each URL; the counts cover all of them.
    """
    table = spark.createDataFrame([(r.name, r.tier, r.length, r.verdict, r.regex, list(r.tokens)) for r in rules], RULE)
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    counts = tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    owned = table.select("name", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = owned.groupBy("name").agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).alias("rarest"))
    return table.join(rarest, "name", "left").select(*table.columns, F.coalesce("rarest.token", F.lit("")).alias("token"))


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...], url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with `host`, `path`, `best` (the winning rule's tier, len, name, verdict; null if none fits) and `verdict`.

    Rules have names of their own; of those that fit, the highest tier wins, then the longest,
    then the last name. Null URLs and URLs without `://` have an empty host and path and get the
    default unless a rule without tokens fits. An empty table gives an empty table; repeated rows
    are judged alike. Columns named host, path, best or verdict are replaced.
    """
    host, path = url_parts(F.col(url_col))
    own = boxed(pages, host.alias("host"), path.alias("path"))
    addresses = own.select("host", "path").distinct().withColumn("address", F.concat("host", "path"))
    own_tokens = tokens_of(F.col("address"))
    if not all(r.tokens for r in rules):  # rules without a literal are filed under '' and run on every URL
        own_tokens = F.array_append(own_tokens, F.lit(""))
    tokens = addresses.select("host", "path", "address", F.explode(own_tokens).alias("token"))
    filed = filed_rules(pages.sparkSession, tokens.select("token"), rules)
    fits = tokens.join(filed, "token").where(F.regexp_like("address", F.col("regex")))
    hits = fits.groupBy("host", "path").agg(F.max(F.struct("tier", "len", "name", "verdict")).alias("best"))
    judged = own.join(hits, ["host", "path"], "left")
    kept = [F.col("row").getField(c).alias(c) for c in pages.columns if c not in ("host", "path", "best", "verdict")]
    return judged.select(*kept, "host", "path", "best", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    from reverie.llm.common import load

    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, CONTRACT_RULES + METHOD_RULES)
    rule = F.when(F.col("best.tier") == CONTRACT, F.col("best.name"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict")


def _any(verdict: str) -> str:
    return "regexp_matches(host || path, '" + "|".join(f"(?:{r.regex})" for r in METHOD_RULES if r.verdict == verdict) + "')"


ORACLE = (
    r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h FROM a),
c AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN """
    + _any("allow")
    + r""" THEN 'allow'
  WHEN regexp_matches(host, '(^|[.-])(ads|bets|casino|lottery|phishing|pills|porn|spam|torrent|viagra)[.-]') OR """
    + _any("block")
    + " THEN 'block' ELSE 'allow' END AS verdict FROM d"
)
