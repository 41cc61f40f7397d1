import re

from tagloom.llm import url_filter
from tests.conftest import SF_SMALL

V = url_filter.Vocabulary()
SCHEMA = "page_id long, url string, html string, host string, path string, rule string, lowered string"
URLS = ["http://a.example.org/en/12", "http://example.org/es/x", "https://Example.ORG/es/", "https://example.org/ES/", "http://org/", "http://x.org", "http://xorg/", "http://a.com/fr/casino", "http://a.com/de/", "http://a.com/x?q=/de/",
        "http://casino-win.example.com/en/", "http://mycasino.example.com/", "http://free-bets.example.com/", "http://free.free.example.net/free", "http://ads-track.example.net/", "http://a.net/CHEAP_pills", "http://a.net/cheapest/pillses",
        "http://a.net/éwin/bet", "no scheme casino", "://", "http://", "", None, "a://b://c/d#e", "http://h?x=/y", "http://H#z", "http://a.net/x\ny?z", "http://user:pw@Example.org:80/en/1", "http://a.net/xxx", "http://a.net/xxxx"]


def plain(url):
    """(host, path, rule, verdict, strict hits, soft hits)."""
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    hits = {t for t in (*V.strict, *V.soft) if re.search(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low)}
    strict, soft = len(hits & set(V.strict)), len(hits - set(V.strict))
    bad = strict > 0 or soft >= V.soft_hits
    return host, path, rule and rule[1] + rule[2], rule[0] if rule else "block" if bad else "allow", strict, soft


def test_odd_urls(spark):
    rows = [(i, u, "x", "h", "p", "r", "l") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None, None, None, None), (0, URLS[0], None, None, None, None, None)]
    got = sorted(str(tuple(r)) for r in url_filter.judge(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted(str((i, *plain(u))) for i, u, *_ in rows)


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = sorted(tuple(r) for r in url_filter.judge(pages).collect())
    assert got == sorted((r["page_id"], *plain(r["url"])) for r in pages.collect())


def test_longest_rule_wins_and_contract_cases(spark):
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame([(i, u, "", "", "", "", "") for i, u in enumerate(URLS)], SCHEMA)).collect()}
    assert got[0] == ("example.org/en/1", "block") and got[1] == ("example.org/es/", "block") and got[3] == ("org/", "allow")
    assert got[5] == (None, "allow") and got[7] == ("com/fr/", "allow") and got[8] == ("com/de/", "block") and got[10] == (None, "block")


def test_own_vocabulary_and_no_vocabulary(spark):
    pages = spark.createDataFrame([(1, "http://a.net/spam/ham/eggs", "", "", "", "", "")], SCHEMA)
    judged = lambda v: url_filter.judge(pages, v, rules=[]).first()["verdict"]
    assert judged(url_filter.Vocabulary((), ("spam", "ham", "eggs"), 3)) == "block"
    assert judged(url_filter.Vocabulary((), ("spam", "ham", "egg"), 3)) == "allow"
    assert judged(url_filter.Vocabulary((), (), 2)) == "allow"


def test_empty_table(spark):
    assert url_filter.judge(spark.createDataFrame([], SCHEMA)).count() == 0
