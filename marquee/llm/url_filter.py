"""Operator 3 [native]: URL filters indexed by their rarest literal token.

A rule is a regular expression over the URL (or over host and path) with some literal
tokens that every match contains.  Each rule is filed under the one of its tokens that
fewest URLs have; a URL's own tokens fetch the candidate rules, and only those run their
expressions.  Tokens are the maximal runs of a-z and 0-9 of the lower-cased URL.

The index is an array of buckets by the token's CRC-32, a literal in the plan, so a URL
is judged in one scan without a shuffle or a join: a host that a third of all pages have
costs nothing more.  Rules come as a list (they are configuration); ``MOST`` bounds it.

Null URLs, and URLs without ``://``, have an empty host and path; no host rule fits them,
and the pattern rules read what there is.  Repeated rows are judged alike.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 20_000
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``tokens``: literals that a match must contain as whole tokens of the URL.

    on_host: the expression reads host + path, else the lower-cased URL.  The highest ``rank`` wins,
    then block before allow, then the smaller name."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    on_host: bool = False


def host_rule(verdict: str, rule: str) -> Rule:
    """``example.com/en/``: the host and its subdomains, paths that start with /en/; longer rules win."""
    host, _, path = rule.partition("/")
    path = "/" + path
    whole = TOKEN.findall(path.lower())
    if whole and path[-1].isalnum():
        whole.pop()  # the last token may go on in the URL
    literal = lambda s: "".join(c if c.isalnum() else "\\" + c if ord(c) < 128 else c for c in s)
    return Rule(rule, verdict, f"(?s)\\A(?:[^/]*\\.)?{literal(host)}{literal(path)}", (*TOKEN.findall(host.lower()), *whole), len(rule), True)


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    after = F.regexp_extract(u, r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)\A[^/?#]*(/[^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def tokens(url: str = "url") -> Column:
    u = F.lower(F.coalesce(F.col(url), F.lit("")))
    return F.array_distinct(F.split(u, "[^a-z0-9]+"))


def frequencies(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """How many rows have each token that the rules name, over all rows."""
    named = sorted({t for r in rules for t in r.tokens})
    if not named:
        return {}
    found = pages.select(F.explode(F.array_intersect(tokens(url_col), F.array(*map(F.lit, named)))).alias("token"))
    return {r.token: r.n for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}  # named tokens only


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, rank_of and verdict of the winning rule (rule null, ``default``: none)."""
    if len(rules) > MOST or not all(r.tokens for r in rules):
        raise ValueError(f"at most {MOST} rules, each with a literal token")
    seen = frequencies(pages, rules, url_col)
    size = max(1, 2 * len(rules))
    buckets: list[list[tuple[str, Rule]]] = [[] for _ in range(size)]
    for rule in sorted(set(rules), key=lambda r: (-r.rank, r.verdict != "block", r.name)):
        rarest = min(rule.tokens, key=lambda t: (seen.get(t, 0), t))
        buckets[zlib.crc32(rarest.encode()) % size].append((rarest, rule))
    kind = "array<struct<token:string,name:string,verdict:string,pattern:string,rank:int,on_host:boolean>>"

    def row(token: str, r: Rule) -> Column:
        return F.struct(F.lit(token), F.lit(r.name), F.lit(r.verdict), F.lit(r.pattern), F.lit(r.rank), F.lit(r.on_host))

    index = F.array(*[F.array(*[row(t, r) for t, r in b]).cast(kind) for b in buckets])
    host, path = host_and_path(url_col)
    url = F.lower(F.coalesce(F.col(url_col), F.lit("")))
    fetched = F.flatten(F.transform(
        tokens(url_col), lambda t: F.filter(F.element_at(index, (F.crc32(t.cast("binary")) % size + 1).cast("int")), lambda r: r.token == t)))
    hits = F.filter(fetched, lambda r: F.rlike(F.when(r.on_host, F.concat(host, path)).otherwise(url), r.pattern))
    order = F.transform(hits, lambda r: F.struct((-r["rank"]).alias("a"), (r["verdict"] != "block").alias("b"), r["name"].alias("name"), r["verdict"].alias("verdict")))
    judged = pages.withColumn("host", host).withColumn("path", path).withColumn("_best", F.array_min(order))
    return judged.withColumn("rule", F.col("_best.name")).withColumn("rank_of", -F.col("_best.a")).withColumn(
        "verdict", F.coalesce(F.col("_best.verdict"), F.lit(default))).drop("_best")
