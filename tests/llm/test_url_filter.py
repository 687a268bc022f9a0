import re

import pytest

from seqloom.llm import url_filter
from seqloom.llm.queries import HOST_RULES, PATTERN_RULES

URLS = [
    None,
    "",
    "no scheme.net/en/",
    "http://",
    "HTTP://EXAMPLE.NET/en/1",
    "http://example.net",
    "http://a.b.example.net/en/x?y#z",
    "http://notexample.net/en/",
    "http://net/",
    "http://x.example.com/de/page",
    "http://x.example.com/DE/page",
    "http://fr.org/fr/",
    "http://x.org#/fr/",
    "http://x.org?casino",
    "http://x.org/my-casino-site",
    "http://x.org/casinos",
    "http://m.x.org/a?page=2&ref=x",
    "http://m.x.org/a?page=2&ref=xy",
    "a://b://c.net/d",
    "http://x.org/" + "long/" * 20000 + "casino",
    "http://x.org/my-casino-site",
]


def brute(url):
    """The definitions, with every rule tried on every URL."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, a) for a, h, p in HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], None, max(fits)[2]
    text = re.sub("[A-Z]", lambda m: m[0].lower(), url) if url is not None else None
    hit = [(a != "allow", i, p, a) for i, (a, p) in enumerate(PATTERN_RULES) if text is not None and re.search(url_filter.pattern_regex(p), text, re.S)]
    return (host, path, None, min(hit)[2], min(hit)[3]) if hit else (host, path, None, None, "allow")


def test_against_every_rule_on_every_url(spark):
    rows = [(i if i != 3 else None, u, "kept") for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")  # a clashing column
    got = url_filter.judge(df, "url", HOST_RULES, PATTERN_RULES).collect()
    assert len(got) == len(URLS)
    assert sorted(map(str, ((r["url"], *r[2:]) for r in got))) == sorted(map(str, ((u, *brute(u)) for u in URLS)))


def test_tokens_are_whole_and_the_rarest_is_chosen():
    assert url_filter.pattern_tokens("^ads*^") == []
    assert url_filter.pattern_tokens("://m.*^page=*^ref=x") == ["m", "page", "ref"]
    index, anywhere = url_filter.index_patterns([("block", "^a^b^"), ("block", "x*")], {"a": 5, "b": 2})
    assert index == {"b": [0]} and anywhere == [1]


def test_empty_table_and_rule_bound(spark, monkeypatch):
    empty = spark.createDataFrame([], "url string")
    assert url_filter.judge(empty, "url", HOST_RULES, PATTERN_RULES).count() == 0
    monkeypatch.setattr(url_filter, "MAX_RULE_BYTES", 3)
    with pytest.raises(ValueError):
        url_filter.judge(empty, "url", HOST_RULES, PATTERN_RULES)
