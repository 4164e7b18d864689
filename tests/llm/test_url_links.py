"""Every way in which a page declares where it is."""

import pytest
from pyspark.sql import functions as F

from gatecrest.llm import url_filter

BAD = "http://casino.example/x"
PAGES = {
    "second of two canonical links": f'<link rel="canonical" href="https://other.org/y"><link rel="canonical" href="{BAD}">',
    "attributes the other way round": f"<LINK href='{BAD}' title=t rel='canonical'>",
    "no quotes": f"<link rel=canonical href={BAD}>",
    "refresh": f'<meta http-equiv="refresh" content="0; url={BAD}">',
    "refresh, content first": f"<meta content='5;URL=\"{BAD}\"' http-equiv=refresh>",
    "script": f'<script>window.location = "{BAD}"</script>',
    "second script": f'<script>location.href = "/here"; if (x) location.href = "{BAD}"</script>',
    "replace": f"<script>location.replace('{BAD}')</script>",
    "assign": f"<script>document.location.assign( '{BAD}')</script>",
    "no scheme": '<link rel="canonical" href="//casino.example/x">',
}


def test_every_declared_alias_counts(spark):
    rows = [(k, f"https://good{k}.org/p", html) for k, html in enumerate(PAGES.values())]
    rows += [(100, "https://good.org/q", f'<a href="{BAD}">x</a><link rel="stylesheet" href="{BAD}"><meta name=d content="url={BAD}">'), (101, "https://good.org/r", '<link rel=canonical href="mailto:a@casino.example"><link rel=canonical href="#top">')]
    got = {r.page_id: r.reason for r in url_filter.decide(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {n: got[k] for k, n in enumerate(PAGES)} == dict.fromkeys(PAGES, "alias")
    assert got[100] == got[101] == "clean"


@pytest.mark.parametrize(
    ("target", "full"),
    [("b", "http://h.org/d/e/b"), ("./b", "http://h.org/d/e/b"), ("../b?x=1", "http://h.org/d/b?x=1"), ("../../../b", "http://h.org/b"), ("/b", "http://h.org/b"), ("?p=2", "http://h.org/d/e/f?p=2"), ("//i.org/b", "http://i.org/b"), ("#x", None), ("javascript:void(0)", None), ("HTTPS://i.org", "HTTPS://i.org")],
)
def test_relative_targets(spark, target, full):
    assert spark.range(1).select(url_filter.absolute(F.lit(target), F.lit("http://h.org/d/e/f?q=1")).alias("x")).first().x == full


def test_relative_target_of_a_bare_host(spark):
    assert spark.range(1).select(url_filter.absolute(F.lit("b"), F.lit("http://h.org")).alias("x")).first().x == "http://h.org/b"
