"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names whole tokens (runs of ASCII letters and digits) that any URL it
matches must hold. The rule is filed under the one of them that fewest distinct
URLs hold; a URL's own tokens fetch the rules to try, and only those run their
regular expression. Rules without such a token are tried on every URL. All of it
is DataFrame code; distinct URLs are judged once and joined back to the rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "[A-Za-z0-9]+"
#: Rules come from the caller; beyond this many their index is joined by shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is tried on host + rest of the URL (scheme removed); ``tokens`` are in every match."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    is_host: bool = False


def host_rule(spec: str, verdict: str) -> UrlRule:
    """``example.net/en/``: this host and its subdomains, paths that start with ``/en/``."""
    host, slash, path = spec.partition("/")
    path = slash + path
    # a path that ends inside a token may go on in the URL, so that token is no index key
    whole = re.findall(_TOKEN, host) + [m[0] for m in re.finditer(_TOKEN, path) if m.end() < len(path)]
    pattern = r"^(?:[^/?#]*\.)?" + _quoted(host + path)
    return UrlRule(spec, verdict, pattern, tuple(whole), True)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


#: Fixed values of the contract: (host and path, verdict); the longest that fits wins.
HOST_RULES = (
    host_rule("net/", "block"),
    host_rule("example.net/en/", "allow"),
    host_rule("example.com/de/", "block"),
    host_rule("org/fr/", "allow"),
)
#: For URLs that no host rule fits: addresses that carry advertising, sessions, forms or binaries.
PATTERN_RULES = (
    UrlRule("path-ads", "block", r"^[^?#]*/ads/", ("ads",)),
    UrlRule("path-banner", "block", r"^[^?#]*/banner/", ("banner",)),
    UrlRule("path-login", "block", r"^[^?#]*/login(?:[/?#.]|$)", ("login",)),
    UrlRule("path-cart", "block", r"^[^?#]*/cart(?:[/?#]|$)", ("cart",)),
    UrlRule("query-sid", "block", r"[?&]sid=", ("sid",)),
    UrlRule("query-sessionid", "block", r"[?&]sessionid=", ("sessionid",)),
    UrlRule("file-exe", "block", r"^[^?#]*\.exe(?:[?#]|$)", ("exe",)),
    UrlRule("file-zip", "block", r"^[^?#]*\.zip(?:[?#]|$)", ("zip",)),
)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest): host lower-cased in A-Z; all empty for NULL or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.substr(after, F.length(host) + 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^?#]*", 0), rest


def rule_index(urls: DataFrame, rules: Sequence[UrlRule]) -> DataFrame:
    """(token, priority, size, name, is_host, verdict, pattern): each rule under its rarest token.

    ``urls`` holds distinct ``tokens`` arrays. Only counts of the rules' own tokens reach the driver.
    """
    known = sorted({t for r in rules for t in r.tokens})
    counts = dict.fromkeys(known, 0)
    if known:
        found = urls.select(F.explode("tokens").alias("token")).where(F.col("token").isin(known))
        counts |= {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}
    rows = [
        F.struct(
            F.lit(min(r.tokens, key=lambda t: (counts[t], t)) if r.tokens else "").alias("token"),
            F.lit(int(r.is_host)).alias("priority"),
            F.lit(len(r.name)).alias("size"),
            F.lit(r.name).alias("name"),
            F.lit(r.verdict).alias("rule_verdict"),
            F.lit(r.pattern).alias("pattern"),
        )
        for r in rules
    ]
    index = urls.sparkSession.range(1).select(F.inline(F.array(*rows)))
    return F.broadcast(index) if len(rules) <= BROADCAST_RULES else index


def filter_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule] = HOST_RULES + PATTERN_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, pattern_rule.

    Among fitting host rules the longest wins, then pattern rules decide (longest name, then
    the last in alphabetical order), then ``default``. ``rule`` names the host rule only,
    ``pattern_rule`` the pattern rule that decided. NULL or odd URLs get empty host and path
    and the default; repeated rows stay repeated; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"))
    host, _, rest = url_parts(F.col("url"))
    urls = rows.where(F.col("url").isNotNull()).select("url").distinct()
    urls = urls.select("url", F.concat(host, rest).alias("subject"))
    urls = urls.withColumn("tokens", F.array_distinct(F.regexp_extract_all("subject", F.lit(f"({_TOKEN})"), 1)))
    index = rule_index(urls, rules)
    tried = urls.select("url", "subject", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("token")).join(index, "token")
    best = (
        tried.where(F.regexp_like("subject", F.col("pattern")))
        .groupBy("url")
        .agg(F.max(F.struct("priority", "size", "name", "rule_verdict")).alias("best"))
    )
    host, path, _ = url_parts(F.col("url"))
    by_host = F.col("best.priority") == 1
    return rows.join(best, "url", "left").select(
        id_col,
        host.alias("host"),
        path.alias("path"),
        F.when(by_host, F.col("best.name")).alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
        F.when(~by_host, F.col("best.name")).alias("pattern_rule"),
    )
