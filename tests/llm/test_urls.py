import re
from itertools import product

import pytest

from panelwright.llm import plans, urls

from ..conftest import SF

PAGES = "page_id long, url string"
RULES = "host string, path string, verdict string"
GIVEN = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def brute(url, rules):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S) if "://" in (url or "") else None
    host, path = (found[1], found[2]) if found else ("", "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def judged(spark, pages, rules):
    frame = spark.createDataFrame(rules, RULES)
    return sorted((tuple(r) for r in urls.judge(spark.createDataFrame(pages, PAGES), frame, carry=("page_id",)).collect()), key=repr)


HOSTS = ["example.org", "EXAMPLE.org", "a.example.org", "badexample.org", "org", ".org", "example.org.", "x.com", "com", "com:80", "u@x.com", "é.com", "É.com", ""]
PATHS = ["", "/", "/es", "/es/", "/es/1", "/en/1", "/en/12/x", "/EN/1", "/fr/?de/", "/de/#x", "?q=/fr/", "#/fr/", "/fr/a://b/de/", "//de/"]


def test_verdicts_match_brute_force(spark, monkeypatch):
    pages = [(k, f"http{'s' * (k % 2)}://{h}{p}") for k, (h, p) in enumerate(product(HOSTS, PATHS))]
    pages += [(k, t) for k, t in enumerate([None, "", "example.org/es/", "://", "://org/", "x://org/\nb?c", "mailto:a@org", "http:/org/"])]
    want = sorted(((i, *brute(u, GIVEN)) for i, u in pages), key=repr)
    assert {v[3] for v in want} == {None, "org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"}
    assert judged(spark, pages, GIVEN) == want
    many = GIVEN + [("b.example.org", "", "block"), ("é.com", "/d", "block"), *((f"h{k}.com", "/" * k, "block") for k in range(1, 9))]
    pages += [(k, f"a://s.h{k}.com{'/' * n}") for k in range(1, 9) for n in range(10)]
    monkeypatch.setattr(urls, "SHAPES", 2)
    assert judged(spark, pages, many) == sorted(((i, *brute(u, many)) for i, u in pages), key=repr)


def test_whole_digests_decide(spark, monkeypatch):
    monkeypatch.setattr(urls, "SHORT", 0)  # every expression meets every rule
    pages = [(k, f"http://{h}{p}") for k, (h, p) in enumerate(product(HOSTS, PATHS))]
    assert judged(spark, pages, GIVEN) == sorted(((i, *brute(u, GIVEN)) for i, u in pages), key=repr)


def test_edges(spark):
    odd = [("", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("org", "x", "block"), ("o/rg", "/", "block"), ("orgx", "", "maybe"), ("net", "/", "allow"), ("net", "/", "block"), ("NET", "/", "allow")]
    pages = [(None, "a://x.net/"), (1, "a://orgx"), (1, "a://orgx"), (2, f"a://{'s.' * 3000}net/{'p' * 100_000}"), (3, "a:///")]
    got = judged(spark, pages, odd)
    assert [(r[0], r[3], r[4]) for r in got] == [(1, None, "allow")] * 2 + [(2, "net/", "block"), (3, None, "allow"), (None, "net/", "block")]
    assert judged(spark, [], odd) == [] and [r[3:] for r in judged(spark, pages[:1], [])] == [(None, "allow")]
    clash = spark.createDataFrame(pages[:1], PAGES).selectExpr("url", "1 as short", "2 as own", "3 as hit", "4 as labels")
    assert urls.judge(clash, spark.createDataFrame(odd, RULES), carry=("short", "own", "hit", "labels")).first()[:6] == (1, 2, 3, 4, "x.net", "/")


def test_no_python_in_the_plan(spark):
    df = plans.op12_url_filters(spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop|ExistingRDD", plan)


@pytest.mark.parametrize("url", ["http://a.example.org/es/x", "https://www.x.com/de/1"])
def test_block(spark, url):
    assert judged(spark, [(1, url)], GIVEN)[0][4] == "block"
