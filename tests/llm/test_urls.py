import re

from foretally.llm import urls


def brute(url, strict=urls.STRICT_TERMS, soft=urls.SOFT_TERMS):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    there = [[t for t in terms if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)] for terms in (strict, soft)]
    return len(there[0]), len(there[1])


def test_terms_stand_alone():
    cases = [
        "http://spam-farm.example.com/", "http://spammer.example.com/ads", "HTTP://CHEAP-PILLS.example.org/x",
        "http://a.org/ads/ads?ads", "http://tracker.track.io/", "http://a.b/xxx1 xxx", "", "ads", "bet",
    ]
    for url in cases:
        assert urls.count_terms(url, urls.STRICT_TERMS, urls.SOFT_TERMS) == brute(url), url


def test_rules_and_verdicts(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://a.net": ("a.net", "", None, "allow"),
        "https://M.Example.NET/en/1?x=/de/": ("m.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.com/de/spam": ("example.com", "/de/spam", "example.com/de/", "block"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "https://porn.org/fr/": ("porn.org", "/fr/", "org/fr/", "allow"),
        "https://porn.org/es/": ("porn.org", "/es/", None, "block"),
        "https://a.org/cheap/pills": ("a.org", "/cheap/pills", None, "block"),
        "https://a.org/cheap/cheap": ("a.org", "/cheap/cheap", None, "allow"),
        "no scheme casino": ("", "", None, "block"),
        "x://h\n/a\nb#://k/": ("h\n", "/a\nb", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, url, "clash", i) for i, url in enumerate(cases)]
    df = spark.createDataFrame(rows + rows, "page_id long, url string, host string, at long")
    found = urls.judge_urls(df).collect()
    assert len(found) == 2 * len(cases)
    for row in found:
        url = list(cases)[row.page_id]
        assert (row.host, row.path, row.rule, row.verdict) == cases[url]
    assert urls.judge_urls(df.limit(0)).collect() == []
