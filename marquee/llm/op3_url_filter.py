"""Query op3_url_filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.llm.common import read
from marquee.llm.url_filter import Rule, host_rule, judge

#: The rules of the contract.
HOST_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Pattern rules for URLs that no host rule fits; they rank below every host rule.
PATTERN_RULES = [
    Rule("ads-track host", "block", r"://([^/]*\.)?ads-track\.", ("ads", "track"), -1),
    Rule("spam-farm host", "block", r"://([^/]*\.)?spam-farm\.", ("spam", "farm"), -1),
    Rule("tracker host", "block", r"://([^/]*\.)?(pixel|tracker)\.", ("tracker",), -1),
    Rule("campaign link", "block", r"[?&]utm_campaign=", ("utm", "campaign"), -2),
    Rule("archive file", "block", r"\.(zip)([?#]|$)", ("zip",), -2),
    Rule("program file", "block", r"\.(exe)([?#]|$)", ("exe",), -2),
    Rule("gambling", "block", r"[/.-]casino[/.-]", ("casino",), -2),
]
RULES = [host_rule(v, r) for v, r in HOST_RULES] + PATTERN_RULES


def query(spark, sf_dir):
    """page_id, host, path, rule (host rules; else null), verdict, pattern_rule (the method's own, else null)."""
    judged = judge(read(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    by_host = F.col("rank_of") >= 0
    return judged.select("page_id", "host", "path", F.when(by_host, F.col("rule")).alias("rule"), "verdict",
                         F.when(~by_host, F.col("rule")).alias("pattern_rule"))


_HOST = "lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1))"
_FITS = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
    for _, r in sorted(HOST_RULES, key=lambda x: -len(x[1])))
ORACLE = f"""
WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u, {_HOST} AS host,
                  regexp_extract(regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1), '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {_FITS} END AS rule,
             CASE WHEN regexp_matches(u, '://([^/]*\\.)?ads-track\\.') THEN 'ads-track host'
                  WHEN regexp_matches(u, '://([^/]*\\.)?spam-farm\\.') THEN 'spam-farm host'
                  WHEN regexp_matches(u, '://([^/]*\\.)?(pixel|tracker)\\.') AND regexp_matches(u, '(^|[^a-z0-9])tracker([^a-z0-9]|$)') THEN 'tracker host'
                  WHEN regexp_matches(u, '\\.zip([?#]|$)') THEN 'archive file'
                  WHEN regexp_matches(u, '[?&]utm_campaign=') THEN 'campaign link'
                  WHEN regexp_matches(u, '[/.-]casino[/.-]') THEN 'gambling'
                  WHEN regexp_matches(u, '\\.exe([?#]|$)') THEN 'program file' END AS pat FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN pat IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN pat END AS pattern_rule
FROM r"""
