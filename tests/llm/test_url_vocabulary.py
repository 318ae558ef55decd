"""Hosts, paths, rules and vocabulary on urls of every shape."""

import pytest

from recall_engine.llm import url_vocabulary as urls


def judged(spark, rows, **settings):
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    return {r.page_id: r for r in urls.judge_urls(pages, **settings).collect()}


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("no scheme/casino", "", "", None, "block"),
        ("http://A.Example.COM/en/x?q=1", "a.example.com", "/en/x", "example.com/en/", "block"),
        ("http://www.example.com/en/casino", "www.example.com", "/en/casino", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/1#f", "notexample.com", "/en/1", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://a.net/fr/://b", "a.net", "/fr/://b", "net/fr/", "block"),
        ("http://a.net/free-pills", "a.net", "/free-pills", None, "block"),
        ("http://a.net/free-free", "a.net", "/free-free", None, "allow"),
        ("http://a.net/freedom/cheaply/casinos", "a.net", "/freedom/cheaply/casinos", None, "allow"),
        ("http://ÀÉ.net/CASINO", "ÀÉ.net", "/CASINO", None, "block"),
        ("http://?x", "", "", None, "allow"),
    ],
)
def test_one_url(spark, url, host, path, rule, verdict):
    row = judged(spark, [(1, url, "clash")])[1]
    assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict)


def test_weight_counts_distinct_terms_that_stand_alone():
    terms = (("win", 1), ("winner", 1), ("a.b", 2))
    assert urls.weight_of("win/win/win", terms) == 1
    assert urls.weight_of("winner-win", terms) == 2
    assert urls.weight_of("xwin winx a.b", terms) == 2
    assert urls.weight_of("x" * 100_000 + "/win", terms) == 1
    assert urls.weight_of(None, terms) == 0 and urls.weight_of("win", ()) == 0


def test_repeats_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.net/xxx"), (1, "http://a.net/xxx"), (None, None)], "page_id long, url string")
    assert sorted(r.verdict for r in urls.judge_urls(pages).collect()) == ["allow", "block", "block"]
    assert urls.judge_urls(pages.limit(0)).collect() == []
    assert {r.rule for r in urls.judge_urls(pages, rules=()).collect()} == {None}
