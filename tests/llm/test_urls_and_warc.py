from __future__ import annotations

import random
import re

import pytest

from parsewarden.llm import url_filters as u
from parsewarden.llm import warc_revisits as w
from tests.llm import cases

URLS = [None, "", "no-scheme.com/x", "http://", "HTTP://A.Example.COM/en/x", "https://www.example.com/en/1?q=/fr/#/es/", "http://example.com", "http://example.com/EN/", "http://xexample.com/en/", "ftp://b.net/es/?a", "http://net/fr/", "http://cheap-pills.example.org/en/1", "http://a.cheap-pills.b.org:80/", "x://spam-farm.org#y", "http://m.com?/en/", "http://a.net/e", "http://éx.COM/É"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("#")[0].split("?")[0]
    fit = [(len(h + p), h + p, a) for a, h, p in (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    spam = bool(set(re.split(r"[/?#.:@&=+\-_%~]", host)) & set(u.HOST_WORDS))
    return host, path, None, "block" if spam else "allow"


def test_verdicts_match_brute_force(spark):
    r = random.Random(3)
    urls = URLS + ["".join(r.choice(["http", "://", "/", "?", "#", "www.", "example.com", "net", "en/", "/es/", "/fr/", ".", "com", "spam-farm.", "\n", "casino", "http", "es"]) for _ in range(r.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for block in (100_000, 2):
        got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in u.filter_urls(df, block=block).collect()}
        assert got == {i: brute(x) for i, x in enumerate(urls)}


def test_only_rules_of_the_urls_tokens_are_tried():
    rules = [u.HostRule("block", f"h{i}.com", "/") for i in range(1000)]
    index = u.RuleIndex(rules)
    assert max(len(x) for x in index.by_token.values()) == 1 and index.judge("a.h7.com", "/")[0] == "h7.com/"


def test_a_line_feed_parts_no_host_from_its_path(spark):
    url = "http://./es/httpEN.net\n/es/x"
    got = u.filter_urls(spark.createDataFrame([(1, url), (2, "http://a.b\nnet/es/")], "page_id long, url string")).collect()
    assert [(r["host"], r["rule"], r["verdict"]) for r in sorted(got)] == [brute(x)[:1] + brute(x)[2:] for x in (url, "http://a.b\nnet/es/")]


def test_expressions_are_compiled_on_first_use():
    rules = [u.Pattern(f"w{i}", f"w{i}", (f"w{i}",)) for i in range(100_000)]
    index = u.RuleIndex(rules)
    assert index.judge("w7.com", "/")[2] == "w7" and sum("compiled" in r.__dict__ for r in rules) == 1


def test_odd_url_tables(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "x"), (1, "http://a.com/", "x"), (None, None, None)], "page_id long, url string, host string")
    assert u.filter_urls(df).count() == 3 and u.filter_urls(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        u.filter_urls(df, keep=("host",))


RECORDS = "record_id string, kind string, url string, date long, headers map<string,string>, digest string, length long"


def test_revisits_by_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(600):
        url = "http://hot.com/a" if r.random() < 0.5 else f"http://h{r.randrange(6)}.com/{r.choice(['a', 'a/', 'b'])}"
        etag = r.choice([None, '"1"', 'W/"1"', '"2"'])
        headers = {k: v for k, v in (("etag", etag), ("last-modified", r.choice([None, "m1", "m2"])), ("server", f"s{i}"), ("date", f"d{i}")) if v}
        rows.append((f"r{i:04}", r.choice(["response", "revisit"]), url, r.randrange(200), headers, r.choice(["x", "y"]), i))
    got = {x["record_id"]: (x["status"], x["response_id"], x["headers"]) for x in w.resolve_revisits(spark.createDataFrame(rows, RECORDS).repartition(5)).collect()}
    want = {}
    for i, kind, url, date, headers, digest, _ in rows:
        if kind != "revisit":
            continue
        key = url.replace("http://", "").rstrip("/")
        earlier = [x for x in rows if x[1] == "response" and x[2].replace("http://", "").rstrip("/") == key and x[3] <= date]
        if not earlier:
            want[i] = ("orphan", None, headers)
            continue
        a = max(earlier, key=lambda x: (x[3], x[0]))
        if "etag" in headers and "etag" in a[4]:
            same = headers["etag"].removeprefix("W/") == a[4]["etag"].removeprefix("W/")
        elif "last-modified" in headers and "last-modified" in a[4]:
            same = headers["last-modified"] == a[4]["last-modified"]
        else:
            same = digest == a[5]
        want[i] = ("resolved", a[0], a[4] | {k: v for k, v in headers.items() if k in w.PERMITTED}) if same else ("mismatch", None, headers)
    assert got == want


def test_odd_records(spark):
    rows = [("a", "revisit", None, 1, None, None, None), ("b", "revisit", "http://x", None, {"etag": "1"}, None, None), ("c", "response", "http://x/", 1, None, "d", 2), ("d", "revisit", "x://WWW.X:80?utm_a=1#f", 1, {"etag": None, "vary": "v"}, "d", None), ("d", "revisit", "x://X", 1, {"vary": "v"}, "d", None), ("e", "metadata", "http://x", 5, None, None, None)]
    got = cases.sorted_rows(w.resolve_revisits(spark.createDataFrame(rows, RECORDS)).select("record_id", "status", "response_id", "headers"))
    assert got == [("a", "orphan", None, None), ("b", "orphan", None, {"etag": "1"}), ("d", "resolved", "c", {"vary": "v"}), ("d", "resolved", "c", {"vary": "v"})]
    assert w.resolve_revisits(spark.createDataFrame([], RECORDS)).count() == 0


def test_names_of_headers_in_any_case(spark):
    rows = [("a", "response", "http://x", 1, {"ETag": '"1"', "Server": "s", "SERVER": "t"}, "d", 2), ("b", "revisit", "http://x", 2, {"etag": 'W/"1"', "Cache-Control": "c"}, None, None)]
    out = w.resolve_revisits(spark.createDataFrame(rows, RECORDS)).first()
    assert out["status"] == "resolved" and out["headers"] == {"etag": 'W/"1"', "cache-control": "c", "server": "t"}
    assert w.resolve_revisits(spark.createDataFrame(rows, RECORDS), max_broadcast=0).first()["headers"] == out["headers"]


def test_canonical_urls(spark):
    urls = {"http://www.A.com:80/x/?b=2&a=1&utm_source=q#f": "a.com/x?a=1&b=2", "https://a.com": "a.com", "a.com/": "a.com", "http://a.com/?ref=1": "a.com"}
    df = spark.createDataFrame([(k,) for k in urls], "u string")
    assert {r["u"]: r["c"] for r in df.select("u", w.canonical_url(df["u"]).alias("c")).collect()} == urls
