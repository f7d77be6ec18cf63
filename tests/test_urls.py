"""URL rules on hand-written rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from visitweave.functions import urls as U
from visitweave.functions.entities import unescape
from visitweave.operators import links, urls
from visitweave.sources import suffixes

from tests.suffix_extract import SUFFIXES

RULES = ["com", "co.uk", "il", "co.il", "*.ck", "!www.ck"]

VALID = [  # url, raw_url, first level, sub domain, tokens
    ("http://www.google.com", "google.com", "google.com", None, ["google.com", ""]),
    ("HTTPS://Mail.Google.com/A/b?Q=1&x", "mail.google.com/A/b?Q=1&x", "google.com", "mail",
     ["google.com", "", "A", "b", "Q", "x"]),
    ("www.a.b.com/", "a.b.com", "b.com", "a", ["b.com", ""]),
    ("http://www.google.co.il/x//y/", "google.co.il/x//y", "google.co.il", None, ["google.co.il", "", "x", "", "y"]),
    ("http://X.com?Q=CATS", "x.com?q=cats", "x.com", None, ["x.com", "", "q"]),
    ("x.com/?a=1&amp;amp;b=2", "x.com/?a=1&b=2", "x.com", None, ["x.com", "a", "b"]),
    ("x.com/p#top", "x.com/p#top", "x.com", None, ["x.com", "", "p"]),
    ("co.uk", "co.uk", "co.uk", None, ["co.uk", ""]),
    ("https://www.www.x.com:8080/A?", "x.com:8080/A", "x.com", None, ["x.com", "", "A"]),
    ("x.com/a|b c?d={e}", "x.com/a|b c?d={e}", "x.com", None, ["x.com", "", "a|b c", "d"]),
    ("x.com/a\tb\n", "x.com/ab", "x.com", None, ["x.com", "", "ab"]),
    ("x.com/?copy=1&copy=2", "x.com/?copy=1&copy=2", "x.com", None, ["x.com", "copy", "copy"]),
    ("x.com/?a=1&==", "x.com/?a=1&==", "x.com", None, ["x.com", "a", ""]),
    ("a.b.foo.ck/x", "a.b.foo.ck/x", "b.foo.ck", "a", ["b.foo.ck", "", "x"]),
    ("a.www.ck", "a.www.ck", "www.ck", "a", ["www.ck", ""]),
    ("a/b//c.com", None, None, None, []),
]
INVALID = [("http://localhost/x", "no_suffix"), ("http://10.0.0.1/", "bad_domain"), ("u:p@x.com", "user_info"),
           ("x.com./a", "trailing_dot"), ("  ", "blank"), (None, "blank"), ("x.com/" + "a" * 4096, "too_long"),
           ("-x.com", "bad_domain"), ("x_.com", "bad_domain"), ("a..com", "bad_domain"), ("com", "no_dot"),
           ("x.com:99999999999/a", "bad_port"), ("x.com:8a/", "bad_port"), ("x.unknown", "no_suffix"),
           ("a" * 64 + ".com", "bad_domain")]


@pytest.fixture(scope="module")
def rules(spark):
    return suffixes.suffixes(spark, RULES)


@pytest.fixture(scope="module")
def enriched(spark, rules):
    rows = [(u,) for u, *_ in VALID] + [(u,) for u, _ in INVALID]
    return {r.url: r for r in urls.enrich(spark.createDataFrame(rows, "url string"), "url", rules).collect()}


@pytest.mark.parametrize("url,raw,fld,sub,tokens", VALID)
def test_valid(enriched, url, raw, fld, sub, tokens):
    r = enriched[url]
    assert (r.raw_url or None, r.first_level_domain, r.sub_domain, r.url_tokens) == (raw, fld, sub, tokens)


@pytest.mark.parametrize("url,reason", INVALID)
def test_invalid(enriched, url, reason):
    r = enriched[url]
    assert (r.reject_reason, r.raw_url, r.domain_or_default, r.url_tokens) == (reason, "", "<NO_DOMAIN>", [])
    assert not r.is_valid and r.host is None and r.protocol is None and r.path is None


def test_parts(spark, rules):
    r = urls.enrich(spark.createDataFrame([("https://a.b.x.co.uk:80/p/../q/./r?k=1&=&m#f&g",)], "url string"),
                    "url", rules).first()
    assert (r.protocol, r.host, r.path, r.query) == ("https", "a.b.x.co.uk", "/q/r", "k=1&=&m")
    assert (r.page, r.raw_page) == ("/q/r?k=1&=&m", "/q/r?k=1&=&m#f&g")
    assert r.query_params == ["k=1", "=", "m", "f", "g"] and r.folders == ["p", "..", "q", ".", "r"]
    assert (r.public_suffix, r.top_level_domain, r.is_country_domain) == ("co.uk", "uk", True)
    assert (r.first_level_domain_key, r.second_level_domain, r.second_level_domain_key) == (
        "x.co.uk*", "b.x.co.uk", "b.x.co.uk#")
    assert (r.main_domain, r.domain, r.sub_domain) == ("x", "a.b.x", "a.b")
    assert (r.is_subdomain, r.is_first_level_domain, r.is_second_level_domain) == (True, False, False)
    assert (r.short_url, r.short_url_www, r.short_url_www_http) == (
        "a.b.x.co.uk", "a.b.x.co.uk", "https://a.b.x.co.uk")
    assert not r.is_homepage


def test_homepage_and_www(spark, rules):
    got = {r.url: r for r in urls.enrich(spark.createDataFrame(
        [("www.x.com/",), ("x.com?a=b",), ("m.x.com",), ("co.uk",)], "url string"), "url", rules).collect()}
    assert [got[u].is_homepage for u in ("www.x.com/", "x.com?a=b", "m.x.com")] == [True, False, True]
    assert got["www.x.com/"].short_url_www_http == "http://www.x.com"
    assert got["m.x.com"].is_second_level_domain and got["m.x.com"].second_level_domain == "m.x.com"
    suffix = got["co.uk"]
    assert (suffix.public_suffix, suffix.domain, suffix.main_domain) == (None, None, "co")


def test_literal_tokens(spark, rules):
    df = spark.createDataFrame([("x.com/a",), ("x.com/a?b=1",), ("x.com/?==&c=1",)], "url string")
    got = {r.url: r.url_tokens for r in urls.enrich(df, "url", rules, literal=True).collect()}
    assert got == {"x.com/a": [], "x.com/a?b=1": ["x.com", "", "a", "b"], "x.com/?==&c=1": []}


def test_lenient_length(spark, rules):
    df = spark.createDataFrame([("x.com/" + "a" * 5000,)], "url string")
    assert urls.canonical(df, "url", rules, lenient=True).first().reject_reason == "ok"


UNESCAPED = [
    ("&amp;lt;", "&lt;"), ("&lt;a&gt;", "<a>"), ("a&copy=2", "a&copy=2"), ("&copy;", "©"), ("&#65;&#x42;&#X43;", "ABC"),
    ("&#8364;", "€"), ("&#xD800;", "&#xD800;"), ("&#99999;", "&#99999;"), ("&;", "&;"), ("&nope;", "&nope;"),
    ("&a&amp;b;", "&a&b;"), ("&AMP;", "&AMP;"), ("x;y", "x;y"), ("&thetasym;&theta;", "ϑθ"), ("", "")]


def test_unescape(spark):
    got = spark.createDataFrame(UNESCAPED, "t string, w string").selectExpr("t", f"{unescape('t')} as v").collect()
    assert [tuple(r) for r in got] == UNESCAPED


PATHS = [
    ("", ""), ("/", "/"), ("/a/./b", "/a/b"), ("/a/../b", "/b"), ("/../a", "/../a"), ("/a/..", "/"), ("/a/.", "/a/"),
    ("/a/b/..", "/a/"), ("/..", "/.."), ("/.", "/"), ("/a//../b", "/a/b"), ("/a/../../b", "/../b"), ("/a.b/..c", "/a.b/..c")]


def test_remove_dots(spark):
    got = spark.createDataFrame(PATHS, "t string, w string").selectExpr("t", f"{U.remove_dots('t')} as v").collect()
    assert [tuple(r) for r in got] == PATHS


def test_canonical_is_stable(spark, rules, sf):
    rules2 = suffixes.suffixes(spark, SUFFIXES)
    once = urls.same_url(spark.read.parquet(f"{sf}/pages.parquet"), rules2)
    twice = urls.same_url(once, rules2, "raw_url")
    assert once.exceptAll(twice).count() == 0 and once.count() > 0


LINKS = [
    ("/c", "http://h.com/c"), ("c", "http://h.com/a/c"), ("../c", "http://h.com/c"), ("?z=1", "http://h.com/a/?z=1"),
    ("#t", "http://h.com/a/b?q=1#t"), ("", "http://h.com/a/b?q=1"), ("//o.com/x", "http://o.com/x"),
    ("https://o.com/./x", "https://o.com/./x"), ("mailto:a@b.com", None), ("c?d#e", "http://h.com/a/c?d#e")]


def test_links(spark):
    df = spark.createDataFrame(LINKS, "h string, w string").selectExpr(
        "h", "'http' as p", "'h.com' as a", "'/a/b' as f", "'q=1' as q")
    got = df.selectExpr("h", f"{links.resolve('p', 'a', 'f', 'q', 'h')} as v").collect()
    assert [tuple(r) for r in got] == LINKS


def test_suffix_file_format(spark, tmp_path):
    f = tmp_path / "list.dat"
    f.write_text("// comment\n\ncom\n*.ck\n!www.ck\nCO.UK  trailing\n")
    rules = suffixes.read_suffixes(spark, str(f))
    got = {tuple(r) for r in rules.frame.select("suffix", "exact", "exception", "wildcard").collect()}
    assert got == {("com", True, False, False), ("ck", False, False, True), ("www.ck", False, True, False),
                   ("co.uk", True, False, False)}
    assert rules.depth == 2
    listed = suffixes.suffixes(spark, ["com", "*.ck", "!www.ck", "co.uk"])
    assert {tuple(r) for r in listed.frame.collect()} == got and listed.depth == 2
    assert rules.patterns == listed.patterns


def test_compiled_rules_and_joined_rules_agree(spark):
    draw = random.Random(6)
    listed = [*SUFFIXES, "a.b.c.uk", "*.q.uk", "!x.q.uk", "co.co", "münchen.de", "*.kawasaki.jp", "!city.kawasaki.jp"]
    rules = suffixes.suffixes(spark, listed)
    labels = ["co", "uk", "www", "ck", "com", "a", "b", "c", "q", "x", "bd", "münchen", "de", "kawasaki", "city", "jp", "comx", "github", "io"]
    names = [".".join(draw.choice(labels) for _ in range(draw.randrange(1, 6))) for _ in range(3000)] + ["", None, ".", "com.", "a..uk"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    one, other = (urls.public_suffix(df, "name", r) for r in (rules, rules._replace(patterns=None)))
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in other.collect()}
    found = {r.name: r.suffix_labels for r in one.collect()}
    assert found["com"] == 1 and {v for k, v in found.items() if k and k.endswith(".www.ck")} == {1}


def test_a_long_list_of_rules_is_one_small_pattern():
    names = [f"{a}{b}{c}.jp" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    pattern = suffixes.trie_pattern(names)
    assert len(pattern) < len("|".join(names)) and pattern.count("k") == 10      # one for each first letter
    plain = re.compile(f"(?:{pattern})$")
    assert all(plain.match(n) for n in names) and not plain.match("aku") and not plain.match("akuu.jp")


def test_percent_coding(spark):
    df = spark.createDataFrame([("a b&ü",), ("%zz",)], "t string")
    got = [tuple(r) for r in urls.percent_coding(df, "t").collect()]
    assert got == [("a b&ü", "a+b%26%C3%BC", "a b&ü"), ("%zz", "%25zz", None)]


def test_dimension_tokens(spark, rules):
    df = spark.createDataFrame([("x.com/a?==&b=1", None, "x.com/1/2/3/4/5/6/7/8/9/10")], "a string, b string, c string")
    got = {r.url: r.vector_tokens for r in urls.url_dimension(df, ["a", "b", "c"], rules).collect()}
    assert got == {"x.com/a?==&b=1": ["x.com", "", "a"], "": [],
                   "x.com/1/2/3/4/5/6/7/8/9/10": ["x.com", "", "1", "2", "3", "4", "5", "6", "7", "8"]}
    assert dict(urls.enrich(df.select(F.col("a")), "a", rules).dtypes)["folders"] == "array<string>"
