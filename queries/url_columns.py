"""URL enrichment over the whole page table, one query per derived column."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import fixture as X
from queries.catalog import query
from visitweave.functions.urls import unescape_if_needed
from visitweave.operators import links, urls
from visitweave.sources import suffixes
from visitweave.storage import fresh_path

# The page URLs hold no HTML entity, so the twin leaves unescaping out.
_PARTS = r"""
with u0 as (select page_id, url, strpos(url,'//') s from pages),
u1 as (select *, case when s between 2 and 8 then s+2 else 1 end st from u0),
u2 as (select *, strpos(substr(url,st),'/') e from u1),
u3 as (select *, case when e=0 then lower(url) else lower(substr(url,1,st+e-2))||substr(url,st+e-1) end low from u2),
u4 as (select *, regexp_replace(rtrim(regexp_replace(low,'^(https?://)?(www\.)*',''),'/#?&'),'[\t\n\r]','','g') raw_url,
              case when starts_with(low,'https://') then 'https' else 'http' end protocol from u3),
u5 as (select *, regexp_extract(raw_url,'^([^/?#:]*)',1) host, regexp_extract(raw_url,'^[^/?#]*([^?#]*)',1) "path",
              case when strpos(split_part(raw_url,'#',1),'?')>0
                   then regexp_extract(raw_url,'^[^?#]*\?([^#]*)',1) end query,
              case when strpos(raw_url,'?')>0 then nullif(substr(raw_url,strpos(raw_url,'?')+1),'') end params from u4),
rules as (select * from (values ('com'),('net'),('org'),('example.com'),('example.net'),('example.org')) t(sfx)),
u6 as (select *, string_split(host,'.') labels,
              (select max(len(string_split(sfx,'.'))) from rules where host = sfx or ends_with(host,'.'||sfx)) ns from u5),
u7 as (select *, len(labels) n, case when len(labels)=ns then ns else ns+1 end nf from u6),
u as (select *, array_to_string(labels[n-nf+1:],'.') fld, case when n>nf then array_to_string(labels[:n-nf],'.') end sub,
             case when n>nf then array_to_string(labels[n-nf:],'.') end sld,
             case when "path"='' then [''] when rtrim("path",'/')='' then []::varchar[]
                  else string_split(rtrim("path",'/'),'/') end segs,
             case when params is null then null when rtrim(params,'&#')='' then []::varchar[]
                  else string_split_regex(rtrim(params,'&#'),'[&#]') end plist from u7),
w as (select *, case when sub is null then fld else host end short_url,
             "path"||coalesce('?'||query,'') page,
             list_concat(list_concat([fld],segs), coalesce(list_transform(plist, lambda p: split_part(p,'=',1)),
                         []::varchar[])) tokens from u)
"""
_WWW = "case when sub is null then 'www.'||short_url else short_url end"


def _join(col):
    return F.array_join(col, "|")


# name -> (Spark column, SQL expression)
COLUMNS = {
    "u01_raw_url": ("raw_url", "raw_url"),
    "u03_protocol": ("protocol", "protocol"),
    "u04_host": ("host", "host"),
    "u05_path": ("path", '"path"'),
    "u06_page": ("page", "page"),
    "u07_raw_page": ("raw_page", "page||case when strpos(raw_url,'#')>0 then substr(raw_url,strpos(raw_url,'#')) else '' end"),
    "u08_query_params": ("query_params", "array_to_string(plist,'|')"),
    "u09_folders": ("folders",
                    "array_to_string(string_split(rtrim(regexp_extract(raw_url,'^([^?#]*)',1),'/'),'/')[2:],'|')"),
    "u10_public_suffix": ("public_suffix", "case when n>ns then array_to_string(labels[n-ns+1:],'.') end"),
    "u11_top_level_domain": ("top_level_domain", "string_split(short_url,'.')[-1]"),
    "u12_is_country_domain": ("is_country_domain", "length(string_split(short_url,'.')[-1])=2"),
    "u13_first_level_domain": ("first_level_domain", "fld"),
    "u14_first_level_domain_key": ("first_level_domain_key", "fld||'*'"),
    "u15_second_level_domain": ("second_level_domain", "sld"),
    "u16_second_level_domain_key": ("second_level_domain_key", "sld||'#'"),
    "u17_main_domain": ("main_domain", "split_part(fld,'.',1)"),
    "u18_domain": ("domain", "case when n>ns then array_to_string(labels[:n-ns],'.') end"),
    "u19_sub_domain": ("sub_domain", "sub"),
    "u19_is_subdomain": ("is_subdomain", "sub is not null"),
    "u20_short_url": ("short_url", "short_url"),
    "u20_short_url_www": ("short_url_www", _WWW),
    "u20_short_url_www_http": ("short_url_www_http", f"protocol||'://'||{_WWW}"),
    "u21_is_first_level_domain": ("is_first_level_domain", "n=nf"),
    "u21_is_second_level_domain": ("is_second_level_domain", "n=nf+1"),
    "u22_is_homepage": ("is_homepage", "query is null and \"path\" in ('','/')"),
    "u23_domain_or_default": ("domain_or_default", "fld"),
    "u24_url_tokens": ("url_tokens", "array_to_string(tokens,'|')"),
    "u25_url_tokens_10": ("first_tokens", "array_to_string(tokens[:10],'|')"),
    "u28_is_valid": ("is_valid", "ns is not null"),
}


def _pages(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", "url")


def _column_query(expr):
    def run(spark, sf):
        dim = urls.enrich(_pages(spark, sf), "url", X.rules(spark))
        if expr == "first_tokens":
            col = _join(F.slice("url_tokens", 1, 10))
        else:
            col = _join(expr) if dict(dim.dtypes)[expr].startswith("array") else F.col(expr)
        return dim.select("page_id", col.alias("value"))
    return run


def _register():
    for name, (expr, sql) in COLUMNS.items():
        query(name, _PARTS + f'select page_id, {sql} "value" from w')(_column_query(expr))


@query("u24_url_tokens_literal", _PARTS + """
select page_id, case when plist is null then '' else array_to_string(tokens,'|') end "value" from w""")
def u24_literal(spark, sf):
    dim = urls.enrich(_pages(spark, sf), "url", X.rules(spark), literal=True)
    return dim.select("page_id", _join("url_tokens").alias("value"))


# The page texts hold four kinds of entity references; the twin replaces those.
@query("u02_double_html_unescape", """
select page_id, md5('x.com/?t='||replace(replace(replace(replace(html,'&copy;','©'),'&middot;','·'),'&quot;','"'),
       '&amp;','&')) "value" from pages""")
def u02(spark, sf):
    """Whole page texts as a parameter, escaped once more and unescaped twice."""
    text = F.concat(F.lit("x.com/?t="), F.replace("html", F.lit("&"), F.lit("&amp;")))
    once = X.table(spark, sf, "pages").select("page_id", text.alias("t")).selectExpr(
        "page_id", f"{unescape_if_needed('t')} as t")
    return once.selectExpr("page_id", f"md5({unescape_if_needed('t')}) as value")


@query("u26_percent_encode_decode", r"""
select page_id, regexp_replace(replace(url_encode(url), '~', '%7E'), '%20', '+', 'g') encoded, url decoded from pages""")
def u26(spark, sf):
    out = urls.percent_coding(_pages(spark, sf), "url").select("page_id", "encoded")
    return out.select("page_id", "encoded", F.try_url_decode(F.col("encoded")).alias("decoded"))


@query("u27_distinct_urls", r"""
select distinct rtrim(regexp_replace(url,'^https?://(www\.)*',''),'/#?&') raw_url from pages""")
def u27(spark, sf):
    return urls.same_url(_pages(spark, sf), X.rules(spark))


@query("j8_public_suffix", _PARTS + "select page_id, host, ns suffix_labels from w")
def j8(spark, sf):
    hosts = _pages(spark, sf).select("page_id", F.regexp_extract("url", r"^https?://(?:www\.)*([^/?#:]*)", 1).alias("host"))
    return urls.public_suffix(hosts, "host", X.rules(spark))


_LISTED = """// rules in the format of the list
com
net
org

*.example.com  // any label below
!cheap-pills.example.com
example.net
*.org
"""


@query("j8_wildcards_and_exceptions", r"""
with h as (select page_id, regexp_extract(url, '^https?://(?:www\.)*([^/?#:]*)', 1) host from pages)
select page_id, host, case when regexp_matches(host, '(^|\.)cheap-pills\.example\.com$') then 2
    when regexp_matches(host, '[^.]+\.example\.com$') then 3 when regexp_matches(host, '(^|\.)example\.net$') then 2
    when regexp_matches(host, '[^.]+\.org$') then 2 when regexp_matches(host, '(^|\.)(com|net|org)$') then 1 end suffix_labels
from h""")
def j8_kinds(spark, sf):
    """All kinds of rules, read from a file."""
    path = fresh_path(spark, "rules")
    spark.range(1).select(F.explode(F.split(F.lit(_LISTED), "\n")).alias("value")).write.text(path)
    hosts = _pages(spark, sf).select("page_id", F.regexp_extract("url", r"^https?://(?:www\.)*([^/?#:]*)", 1).alias("host"))
    return urls.public_suffix(hosts, "host", suffixes.read_suffixes(spark, path))


@query("f10_reject_reasons", X.sql("""
select case when event_type = 'error' then 'blank' when event_type = 'signup' then 'user_info' when event_type = 'purchase'
       then 'no_suffix' else 'ok' end reject_reason, count(*) n_urls from ev group by 1"""))
def f10(spark, sf):
    kind = F.col("event_type")
    url = (F.when(kind == "error", " ").when(kind == "signup", F.concat(F.lit("http://me@"), F.regexp_replace(
        "request_url", "^https?://", ""))).when(kind == "purchase", F.regexp_replace(
            "request_url", r"\.example\.(com|net|org)", ".example.internal")).otherwise(F.col("request_url")))
    return urls.reject_counts(X.page_views(spark, sf).select(url.alias("url")), "url", X.rules(spark))


_LONG = r"""
, r as (select request_url||'/'||repeat('a', case when event_type='error' then 5000 else 1 end) url from ev)
select case when {0} then 'too_long' else 'ok' end reject_reason, count(*) n_urls from r group by 1"""


def _long(spark, sf):
    extra = F.repeat(F.lit("a"), F.when(F.col("event_type") == "error", 5000).otherwise(1))
    return X.page_views(spark, sf).select(F.concat("request_url", F.lit("/"), extra).alias("url"))


@query("f10_length_limit", X.sql(_LONG.format("length(url) > 4096")))
def f10_long(spark, sf):
    return urls.reject_counts(_long(spark, sf), "url", X.rules(spark))


@query("f10_length_limit_lenient", X.sql(_LONG.format("false")))
def f10_lenient(spark, sf):
    return urls.reject_counts(_long(spark, sf), "url", X.rules(spark), lenient=True)


@query("j10_link_edges", r"""
with l as (select page_id, url, unnest(hs) href, generate_subscripts(hs,1)-1 link_no from (
  select page_id, url, regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1) hs from pages))
select page_id, link_no, href,
  case when regexp_matches(href,'(?i)^https?://') then href
       when starts_with(href,'/') and not starts_with(href,'//')
       then regexp_replace(regexp_extract(url,'^(https?://[^/?#]+)',1),'^(https?://)(www\.)*','\1')||href
       else '?' end link_url from l""")
def j10(spark, sf):
    return links.link_edges(X.table(spark, sf, "pages"), X.rules(spark))


# An anchor of each kind of link, and in SQL the URL that it leads to.
_ANCHORS = {
    "//cdn.example.com/x?a=1&b=2": ('<a href="//cdn.example.com/x?a=1&amp;b=2">', "proto||'://cdn.example.com/x?a=1&b=2'"),
    "?q=1": ("<A class='k' HREF=?q=1>", "site||folder||'?q=1'"),
    "#top": ("<a href='#top'>", "site||path||query||'#top'"),
    "mailto:x@example.com": ('<a href="mailto:x@example.com">', "null::varchar"),
    "rel/./p/../q#f": ('<a data-href="/no" href = "rel/./p/../q#f">', "site||folder||'rel/q#f'"),
    "": ('<a href="">', "site||path||query"),
    "/it's/x": ('<a href="/it\'s/x">', "site||'/it''s/x'"),
    'say"so': ("<a href='say\"so'>", "site||folder||'say\"so'"),
}


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


@query("j10_link_kinds", r"""
with u as (select page_id, regexp_extract(url,'^(https?)',1) proto,
         regexp_replace(regexp_extract(url,'^(https?://[^/?#]+)',1),'^(https?://)(www\.)*','\1') site,
         regexp_extract(url,'^https?://[^/?#]+([^?#]*)',1) path, regexp_extract(url,'([?][^#]*)',1) query
       from (select page_id, rtrim(url,'/#?&') url from pages)),
p as (select *, case when contains(path,'/') then regexp_extract(path,'^(.*/)[^/]*$',1) else '/' end folder from u)
""" + " union all ".join(
    f"select page_id, {i} link_no, {_quoted(href)} href, {url} link_url from p" for i, (href, (_, url)) in enumerate(_ANCHORS.items())))
def j10_kinds(spark, sf):
    pages = X.table(spark, sf, "pages").withColumn("html", F.lit("".join(tag for tag, _ in _ANCHORS.values())))
    return links.link_edges(pages, X.rules(spark))


_register()
