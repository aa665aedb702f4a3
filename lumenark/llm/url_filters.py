r"""URL filters by pattern rules, in DataFrame functions only.

A rule is a regular expression over ``host || path`` with the literal tokens that
every match must hold. Rules are indexed by the one of their tokens that is rarest
over all URLs; the tokens of a URL fetch candidate rules from the index, and only
those run their expressions. A rule without a sure literal is indexed under the
empty token, which every URL has.

A verdict depends on its row alone, so no row is shuffled: one pass counts the rules'
literals over all URLs (counts combine in the tasks; at most one row for each literal
comes back), then the index, an array of hash buckets, is one constant of the plan and
each row looks its tokens up in it. That constant grows with the rule list, which the
caller holds in memory; more than ``MOST_RULES`` rules are an error.

Defined results: a null URL or one without ``://`` has an empty host and path,
matches nothing and is allowed; of the listed rules that match the longest wins (of
equal length the one later in the list), then of the others likewise; very long URLs are
read whole; repeated rows stay; columns named as an added one are replaced, all others
pass through; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import unused

#: About 20 MB of constants.
MOST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str  # Java regular expression, searched in host || path
    literals: tuple[str, ...]  # lower-case alphanumeric tokens that every match holds
    verdict: str  # allow or block
    listed: bool = False  # named in the result; beats every rule that is not

    @staticmethod
    def prefix(name: str, verdict: str) -> Rule:
        """``host/path`` that fits its host, all subdomains and all paths below."""
        tokens = re.findall(r"[a-z0-9]+(?![a-z0-9])", name.lower())
        if tokens and name[-1:].isalnum():
            tokens.pop()  # may be the start of a longer token
        return Rule(name, rf"^([^/]*\.)?\Q{name}\E", tuple(tokens), verdict, True)

    @staticmethod
    def host_words(words: str, verdict: str = "block") -> Rule:
        """Hyphen-joined words that stand by themselves within the host."""
        return Rule(f"host:{words}", rf"^([^/]*[^a-z0-9/])?\Q{words}\E([^a-z0-9]|$)", tuple(words.split("-")), verdict)


#: The contract's rules, then the method's own (fixed values).
RULES = (
    Rule.prefix("net/", "block"),
    Rule.prefix("example.net/en/", "allow"),
    Rule.prefix("example.com/de/", "block"),
    Rule.prefix("org/fr/", "allow"),
    *map(Rule.host_words, ("spam-farm", "cheap-pills", "link-farm", "online-casino", "free-money", "spam", "casino", "poker", "viagra", "porn", "xxx")),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_BUCKET = "array<struct<token:string,rank:bigint,pattern:string,rule:string,verdict:string>>"


def _tokens(target: str) -> str:
    """SQL for the distinct alphanumeric runs of a target, and the empty token."""
    return f"array_distinct(concat(split(lower({target}), '[^a-z0-9]+'), array('')))"


def _constant(value: object, kind: str) -> str:
    """SQL for a constant of the given type; Spark folds it to one literal."""
    text = json.dumps(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{text}', '{kind}')"


def literal_counts(urls: DataFrame, literals: list[str]) -> dict[str, int]:
    """In how many rows of ``urls`` (target) each literal stands as a token."""
    tokens = F.explode(F.expr(f"array_intersect({_tokens('target')}, {_constant(literals, 'array<string>')})"))
    return {r["token"]: r["count"] for r in urls.select(tokens.alias("token")).groupBy("token").count().collect()}


def rule_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> list[list[dict]]:
    """The rules under their rarest literals, in buckets by the literal's crc32. A
    literal that no URL holds is the rarest of all. Unlisted rules rank below listed
    ones, shorter below longer."""
    buckets: list[list[dict]] = [[] for _ in range(max(1, len(rules)))]
    order = sorted(rules, key=lambda r: (r.listed, len(r.name)))
    for rank, r in enumerate(order, 1):
        token = min(r.literals or ("",), key=lambda t: (counts.get(t, 0), t))
        entry = {"token": token, "rank": rank, "pattern": r.pattern, "rule": r.name if r.listed else None, "verdict": r.verdict}
        buckets[zlib.crc32(token.encode()) % len(buckets)].append(entry)
    return buckets


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    url = F.col(url_col)
    target = F.when(url.contains("://"), F.concat(host_of(url), path_of(url)))
    counts = literal_counts(pages.select(target.alias("target")).where("target is not null"), sorted({t for r in rules for t in r.literals}))
    index = rule_index(rules, counts)
    held, best = unused(pages.columns, "_target"), unused(pages.columns, "_best")
    bucket = f"element_at({_constant(index, f'array<{_BUCKET}>')}, int(crc32(t) % {len(index)}) + 1)"
    candidates = f"flatten(transform({_tokens(f'`{held}`')}, t -> filter({bucket}, e -> e.token = t)))"
    hits = f"array_max(transform(filter({candidates}, e -> `{held}` rlike e.pattern), e -> struct(e.rank, e.rule, e.verdict)))"
    out = pages.withColumn(held, target).withColumn(best, F.expr(f"IF(`{held}` is null, null, {hits})"))
    host, path = host_of(url), path_of(url)
    if url_col in ("host", "path", "rule", "verdict"):
        raise ValueError(f"the URLs' column must not be named {url_col}")
    out = out.withColumns({"host": host, "path": path, "rule": F.col(f"`{best}`.rule"), "verdict": F.coalesce(F.col(f"`{best}`.verdict"), F.lit("allow"))})
    return out.drop(held, best)


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches(host, '(^|[^a-z0-9])(spam-farm|cheap-pills|link-farm|online-casino|free-money|spam|casino|poker|viagra|porn|xxx)([^a-z0-9]|$)') THEN 'block'
       ELSE 'allow' END AS verdict
FROM f
"""
