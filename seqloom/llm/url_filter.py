"""URL filters: rules found by a token of the URL, regular expressions run only on what was found.

Two kinds of rules:

* host rules ``(action, host, path)`` fit the host, all its subdomains and every path below; they are
  found by the host's trailing labels, and the longest one wins;
* pattern rules ``(action, pattern)`` judge what no host rule fits. In a pattern ``*`` stands for any
  text and ``^`` for a separator (anything but a letter or digit) or an end of the URL. A pattern is
  filed under the rarest of its literal tokens, rarest by count over the very URLs to be judged; the
  tokens of a URL fetch the patterns filed under them, and only those run as regular expressions.
  A pattern without a whole token is tried on every URL. Any fitting ``allow`` beats a ``block``.

The rules are a parameter; their size is checked before they travel with the tasks. Judging is one
pass over the URLs without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: All rules travel to every task.
MAX_RULE_BYTES = 64 * 2**20

RULE_SCHEMA = "host string, path string, rule string, pattern string, verdict string"
HostRule = tuple[str, str, str]
PatternRule = tuple[str, str]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return lower(host), path


def lower(s: str) -> str:
    """A-Z only, as every engine does it alike."""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def pattern_regex(pattern: str) -> str:
    """The regular expression of a pattern, in the syntax that common engines share."""
    parts = {"*": ".*", "^": "(?:[^a-z0-9]|^|$)"}
    return "".join(parts.get(c) or re.escape(c) for c in lower(pattern))


def pattern_tokens(pattern: str) -> list[str]:
    """Letters and digits that must be a whole token of a fitting URL: bounded by separators, not ``*`` or an end."""
    return [m[0] for m in re.finditer(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", lower(pattern))]


def url_tokens(url: str) -> set[str]:
    return set(re.findall("[a-z0-9]+", url))


def token_counts(pages: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """URLs with each of the given tokens; at most one row per token comes back."""
    if not tokens:
        return {}
    text = F.translate(F.col(url), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = pages.select(F.explode(F.array_distinct(F.split(text, "[^a-z0-9]+"))).alias("token"))
    return {r["token"]: r["count"] for r in found.where(F.col("token").isin(tokens)).groupBy("token").count().collect()}


def index_patterns(patterns: list[PatternRule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Patterns by their rarest token (ties: the longer, then the first by code), and those without one."""
    index, anywhere = defaultdict(list), []
    for i, (_, pattern) in enumerate(patterns):
        tokens = pattern_tokens(pattern)
        if tokens:
            index[min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))].append(i)
        else:
            anywhere.append(i)
    return dict(index), anywhere


def judge(
    pages: DataFrame,
    url: str,
    hosts: list[HostRule],
    patterns: list[PatternRule],
    otherwise: str = "allow",
) -> DataFrame:
    """Add ``host, path, rule, pattern, verdict`` to every row; columns of these names are replaced.

    A null URL and one without ``://`` have an empty host and path, which no host rule fits; a null
    URL fits no pattern either and gets ``otherwise``. Repeated rows are judged alike; an empty table
    gives an empty result. ``rule`` names the host rule that decided, ``pattern`` the pattern.
    """
    if sum(len(x.encode()) for r in [*hosts, *patterns] for x in r) > MAX_RULE_BYTES:
        raise ValueError(f"rules of more than {MAX_RULE_BYTES} bytes: judge in several calls")
    by_host = defaultdict(list)
    for action, host, path in hosts:
        by_host[lower(host)].append((path, action))
    by_host = {h: sorted(p, key=lambda x: -len(x[0])) for h, p in by_host.items()}
    index, anywhere = index_patterns(patterns, token_counts(pages, url, sorted({t for _, p in patterns for t in pattern_tokens(p)})))
    rules = pages.sparkSession.sparkContext.broadcast((by_host, patterns, index, anywhere, otherwise))

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_host, patterns, index, anywhere, otherwise = rules.value
        longest = max((h.count(".") + 1 for h in by_host), default=0)
        compiled: dict[int, re.Pattern] = {}

        def fits(i: int, text: str) -> bool:
            if i not in compiled:
                compiled[i] = re.compile(pattern_regex(patterns[i][1]), re.S)
            return compiled[i].search(text) is not None

        def one(url: str | None) -> tuple:
            host, path = split_url(url)
            best = None
            labels = host.split(".")
            for n in range(1, min(longest, len(labels)) + 1):
                suffix = ".".join(labels[-n:])
                for start, action in by_host.get(suffix, ()):
                    if path.startswith(start):
                        best = max(best or (0,), (len(suffix) + len(start), n, suffix + start, action))
                        break
            if best:
                return host, path, best[2], None, best[3]
            if url is None:
                return host, path, None, None, otherwise
            text = lower(url)
            found = {i for t in url_tokens(text) for i in index.get(t, ())}
            hit = [i for i in sorted(found.union(anywhere)) if fits(i, text)]
            hit.sort(key=lambda i: (patterns[i][0] != "allow", i))
            return (host, path, None, patterns[hit[0]][1], patterns[hit[0]][0]) if hit else (host, path, None, None, otherwise)

        for urls in batches:
            yield pd.DataFrame([one(u) for u in urls], columns=["host", "path", "rule", "pattern", "verdict"], dtype=object)

    added = ["host", "path", "rule", "pattern", "verdict"]
    rest = [c for c in pages.columns if c not in added]
    result = F.pandas_udf(judged, RULE_SCHEMA)(F.col(url))
    judged_rows = pages.select(F.struct(*rest).alias("page"), result.alias("judged"))
    return judged_rows.select("page.*", *(F.col(f"judged.{c}").alias(c) for c in added))
