"""URL filter: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path`` with the literal tokens
that every match must contain.  The rule is filed under the one of them that
occurs least often in the URLs at hand.  A URL's tokens fetch candidate rules
from that index, and only the candidates' regular expressions run; rules
without a literal token are tried on every URL.

Up to INLINE_RULES rules the index is a literal map, so the plan is one
projection: no shuffle, no join.  Larger lists are a table: the tokens of the
distinct addresses are joined with it, broadcast where its size is checked.
``load_rules`` reads lists in the syntax of public filter lists and hosts
files.  All of it is DataFrame functions.

Among the rules that fit, those of a host and path (``prefix``) come first, the
longest of them; otherwise a URL is blocked if a rule blocks it and none allows
it.  Null URLs and URLs without ``://`` have an empty host and path and are
allowed.  Each input row gives one output row, repeated rows included; an empty
table gives no row.  Columns named host, path, rule and verdict are replaced,
others are kept, whatever their names; URLs of any length are read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, unused

#: Rules of an index that is part of the plan, and of one that may be broadcast (about 300 bytes each).
INLINE_RULES, BROADCAST_RULES = 64, 100_000

#: Host and path rules of the contract (verdict, rule).
PREFIX_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: Host words of unwanted sites: (verdict, tokens that appear next to each other in the host).
HOST_WORDS = (
    ("block", "casino-win"),
    ("block", "free-bets"),
    ("block", "cheap-pills"),
    ("block", "adult-x"),
    ("block", "ads-track"),
    ("block", "casino"),
    ("block", "poker"),
    ("block", "porn"),
    ("block", "xxx"),
    ("block", "viagra"),
    ("block", "doubleclick"),
    ("block", "adserver"),
)

#: Path segments of unwanted pages.
PATH_WORDS = (("block", "ads"), ("block", "banner"), ("block", "popunder"), ("block", "tracking-pixel"))


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    prefix: bool = False  # a host and path rule: it overrides the others, the longest first


def prefix_rule(verdict: str, text: str) -> Rule:
    """``host/path``: the host and its subdomains, paths that start alike.

    The last token of the path may go on in the URL, so only tokens that a
    separator closes are literal.
    """
    host, _, path = text.partition("/")
    whole = re.findall("[a-z0-9]+", host) + re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(text, verdict, rf"^([^/]*\.)?{re.escape(host)}/{re.escape(path)}", tuple(whole), True)


def host_rule(verdict: str, words: str) -> Rule:
    return Rule(f"host:{words}", verdict, rf"^([^/]*[^a-z0-9/])?{re.escape(words)}([^a-z0-9]|$)", tuple(re.findall("[a-z0-9]+", words)))


def path_rule(verdict: str, word: str) -> Rule:
    return Rule(f"path:{word}", verdict, rf"(?i)^[^/]*/(.*/)?{re.escape(word)}(/|$)", tuple(re.findall("[a-z0-9]+", word)))


RULES = (
    *(prefix_rule(v, r) for v, r in PREFIX_RULES),
    *(host_rule(v, w) for v, w in HOST_WORDS),
    *(path_rule(v, w) for v, w in PATH_WORDS),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    part = lambda group: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", group)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def tokens_of(address: Column) -> Column:
    lower = F.translate(address, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit("([a-z0-9]+)"), 1))


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: What a list says of a rule's use; rules with other options are about parts of pages.
PAGE_OPTIONS = ("document", "doc", "all", "important")
RULE_TABLE = "name string, verdict string, pattern string, tokens array<string>, prefix boolean"


def load_rules(spark: SparkSession, *paths: str) -> DataFrame:
    """The rules of lists, one a line, as (name, verdict, pattern, tokens, prefix).

    ``||host^`` a host and its subdomains, ``|`` the address's beginning or end, ``*`` anything, ``^`` a separator,
    ``/.../`` a regular expression, ``@@`` an exception, ``!`` and ``#`` comments, ``0.0.0.0 host`` a line of a hosts file.
    Rules for parts of pages (element hiding, options such as ``$image``) are left out.
    """
    line = F.trim(F.col("value"))
    hosts = F.regexp_extract(line, r"^(?:0\.0\.0\.0|127\.0\.0\.1|::1?)\s+([^\s#]+)", 1)
    read = spark.read.text(list(paths)).select(F.when(hosts != "", F.concat(F.lit("||"), hosts, F.lit("^"))).otherwise(line).alias("name"))
    read = read.filter(~F.rlike("name", F.lit(r"^\s*$|^[!\[#]|#@?[#?$%]")) & ~F.col("name").isin("||localhost^", "||0.0.0.0^")).distinct()
    bare = F.regexp_replace("name", "^@@", "")
    cut = F.when(F.rlike("bare", F.lit("^/.*/$")), F.lit("")).otherwise(F.regexp_extract("bare", r"\$([a-z~][^/$]*)$", 1))
    known = F.forall(F.split("options", ","), lambda o: o.isin("", *PAGE_OPTIONS))
    rules = read.withColumn("bare", bare).withColumn("options", cut).filter(known)
    body = F.when(F.col("options") != "", F.expr("substring(bare, 1, length(bare) - length(options) - 1)")).otherwise(F.col("bare"))
    rules = rules.withColumn("body", F.regexp_replace(body, r"^\|(?:https?://)", "|"))
    own = F.regexp_replace("body", r"([.+?${}()\[\]\\])", r"\\$1")
    own = F.regexp_replace(F.regexp_replace(own, r"\*+", ".*"), r"\^", "(?:[^a-zA-Z0-9_.%-]|\\$)")
    own = F.regexp_replace(F.regexp_replace(own, r"\|$", "\\$"), r"^\|\|", "^(?:[^/]*\\\\.)?")
    own = F.concat(F.lit("(?i)"), F.regexp_replace(own, r"^\|", "^"))
    expression = F.rlike("body", F.lit("^/.+/$"))
    pattern = F.when(expression, F.concat(F.lit("(?i)"), F.expr("substring(body, 2, length(body) - 2)"))).otherwise(own)
    tokens = F.when(expression, F.array().cast("array<string>")).otherwise(F.array_distinct(F.regexp_extract_all(lowered(F.col("body")), F.lit("(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), 1)))
    verdict = F.when(F.startswith("name", F.lit("@@")), "allow").otherwise("block")
    return rules.select("name", verdict.alias("verdict"), pattern.alias("pattern"), tokens.alias("tokens"), F.lit(False).alias("prefix"))


def token_counts(urls: DataFrame, url_col: str, rules: tuple[Rule, ...] = RULES) -> dict[str, int]:
    """How many URLs hold each token of a few rules: at most one number for each token comes back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    host, path = url_parts(urls[url_col])
    own = F.filter(tokens_of(F.concat(host, path)), lambda t: t.isin(*wanted))
    counted = urls.select(F.explode(own).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """The rules under their rarest token; those without one under None."""
    index: dict[str | None, list[Rule]] = defaultdict(list)
    for r in rules:
        index[min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None)].append(r)
    return dict(index)


def indexed(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """rules with ``token``: their rarest in addresses (host, path), null for rules without one."""
    by_token = rules.select("name", F.explode("tokens").alias("token"))
    wanted = by_token.select("token").distinct()
    seen = addresses.select(F.explode(tokens_of(F.concat("host", "path"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(wanted, "token", "left_semi")
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("token"))
    rarest = by_token.join(seen, "token", "left").groupBy("name").agg(F.min(rank)["token"].alias("token"))
    return stored(rules.join(rarest, "name", "left"), "rules")


def judged(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, best, blocked, allowed) of the addresses (host, path, distinct) that a rule fits."""
    index = indexed(rules, addresses)
    entry = F.struct("prefix", F.length("name").alias("length"), "name", "verdict", "pattern").alias("r")
    filed = index.filter("token is not null").select("token", entry)
    filed = F.broadcast(filed) if index.count() <= BROADCAST_RULES else filed
    address = F.concat("host", "path")
    met = addresses.withColumn("token", F.explode(tokens_of(address))).join(filed, "token").filter(F.rlike(address, F.col("r.pattern"))).drop("token")
    always = [r["r"] for r in index.filter("token is null").select(entry).collect()]
    if always:
        each = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in ("prefix", "length", "name", "verdict", "pattern"))) for r in always))
        met = met.unionByName(addresses.withColumn("r", F.explode(F.filter(each, lambda r: F.rlike(address, r["pattern"])))))
    return met.groupBy("host", "path").agg(F.max(F.when(F.col("r.prefix"), F.col("r"))).alias("best"), F.bool_or(F.col("r.verdict") == "block").alias("blocked"), F.bool_or(F.col("r.verdict") == "allow").alias("allowed"))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), r.prefix) for r in rules], RULE_TABLE)


def judge(urls: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] | DataFrame = RULES) -> DataFrame:
    """urls with host, path, rule and verdict added (replacing columns of these names); rules also as a table such as ``load_rules`` gives."""
    host, path = url_parts(urls[url_col])
    others = [c for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    address = F.concat("host", "path")
    final = lambda best, blocked, allowed: [best["name"].alias("rule"), F.coalesce(best["verdict"], F.when(blocked & ~allowed, "block").otherwise("allow")).alias("verdict")]
    parted = urls.select(*others, host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame) or len(rules) > INLINE_RULES:
        rules = rules if isinstance(rules, DataFrame) else rule_table(urls.sparkSession, rules)
        found = unused(urls, "found")
        fits = judged(parted.select("host", "path").distinct(), rules).select("host", "path", F.struct("best", "blocked", "allowed").alias(found))
        # An address that a third of all rows share is on the rows' side of the join, which adaptive execution splits.
        flag = lambda c: F.coalesce(F.col(found)[c], F.lit(False))
        return parted.join(fits, ["host", "path"], "left").select(*others, "host", "path", *final(F.col(found)["best"], flag("blocked"), flag("allowed")))
    index = build_index(rules, token_counts(urls, url_col, rules))
    entry = lambda r: F.struct(F.lit(r.prefix).alias("prefix"), F.lit(len(r.name)).alias("length"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
    entries = lambda rs: F.array(*map(entry, rs))
    always = index.pop(None, [])
    if index:
        filed = F.create_map(*(x for t, rs in sorted(index.items()) for x in (F.lit(t), entries(rs))))
        tokens = F.filter(tokens_of(address), lambda t: t.isin(*sorted(index)))
        fetched = F.flatten(F.transform(tokens, lambda t: F.element_at(filed, t)))
        fetched = F.concat(fetched, entries(always)) if always else fetched
    else:
        fetched = entries(always) if always else F.filter(entries(RULES[:1]), lambda r: F.lit(False))
    fits, best = unused(parted, "fits"), unused(parted, "best")
    marked = parted.withColumn(fits, F.filter(fetched, lambda r: F.rlike(address, r["pattern"])))
    marked = marked.withColumn(best, F.array_max(F.filter(fits, lambda r: r["prefix"])))  # the longest of the host and path rules
    some = lambda v: F.exists(fits, lambda r: r["verdict"] == v)
    return marked.select(*others, "host", "path", *final(F.col(best), some("block"), some("allow")))


def op3_url_filter(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql() -> str:
    """The same rows in DuckDB: every rule tried on every URL."""
    fits = lambda text: (lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}'))")(*text.split("/", 1))
    longest = sorted(PREFIX_RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(text)} THEN '{text}'" for _, text in longest)
    verdict = " ".join(f"WHEN {fits(text)} THEN '{v}'" for v, text in longest)
    words = "|".join(re.escape(w).replace(r"\-", "-") for _, w in HOST_WORDS)
    paths = "|".join(re.escape(w).replace(r"\-", "-") for _, w in PATH_WORDS)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH cut AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS x FROM pages
), parts AS (
  SELECT page_id, {lower.format("x.h")} AS host, x.p AS path FROM cut
)
SELECT page_id, host, path,
  CASE {rule} ELSE NULL END AS rule,
  CASE {verdict}
    WHEN regexp_matches(host, '(^|[^a-z0-9])({words})([^a-z0-9]|$)') THEN 'block'
    WHEN regexp_matches(path, '(?i)^/(.*/)?({paths})(/|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM parts"""
