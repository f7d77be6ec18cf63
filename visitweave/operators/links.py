"""Links of HTML pages as an edge table of absolute URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitweave.functions import urls as U
from visitweave.functions.entities import unescape
from visitweave.operators import urls
from visitweave.sources.suffixes import SuffixRules

# The value ends at the quote that began it or, without one, at a blank or the tag's end.
HREF = r"""(?i)<a\s(?:[^>]*?[\s"'])?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def page_links(pages: DataFrame, *keep: str) -> DataFrame:
    """Every anchor of every page: ``page_id``, kept columns, ``link_no, href`` (entities resolved)."""
    found = pages.select("page_id", *keep, F.posexplode(
        F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("link_no", "_value"))
    bare = found.withColumn("_value", F.when(
        F.substring("_value", 1, 1).isin('"', "'"), F.expr("substring(_value, 2, length(_value) - 2)")).otherwise(F.col("_value")))
    return bare.selectExpr("page_id", *keep, "link_no", f"{unescape('_value')} as href")


def resolve(protocol: str, auth: str, path: str, query: str, href: str) -> str:
    """Absolute URL of ``href`` on a page; null for a protocol that is neither http nor https.

    A bare query is resolved against the page's folder, an empty link against the page.
    """
    link = f"trim({href})"
    site = f"concat({protocol}, '://', {auth})"
    folder = f"if(contains({path}, '/'), regexp_extract({path}, '^(.*/)[^/]*$', 1), '/')"
    file = f"regexp_extract({link}, '^([^?#]*)', 1)"
    rest = f"regexp_extract({link}, '^[^?#]*(.*)$', 1)"
    return f"""case when {link} rlike '(?i)^https?://' then {link}
 when {link} rlike '^[A-Za-z][A-Za-z0-9+.-]*:' then null
 when startswith({link}, '//') then concat({protocol}, ':', {link})
 when {link} = '' or startswith({link}, '#')
   then concat({site}, {path}, coalesce(concat('?', {query}), ''), {link})
 when startswith({link}, '?') then concat({site}, {folder}, {link})
 when startswith({link}, '/') then concat({site}, {U.remove_dots(file)}, {rest})
 else concat({site}, {U.remove_dots(f'concat({folder}, {file})')}, {rest}) end"""


def link_edges(pages: DataFrame, rules: SuffixRules) -> DataFrame:
    """``(page_id, link_no, href, link_url)`` for pages with a valid URL."""
    base = urls.enrich(pages.select("page_id", "url", "html"), "url", rules).filter("is_valid").selectExpr(
        "page_id", "html", "protocol", f"{U.authority('raw_url')} as auth", "path", "query")
    return page_links(base, "protocol", "auth", "path", "query").selectExpr(
        "page_id", "link_no", "href", f"{resolve('protocol', 'auth', 'path', 'query', 'href')} as link_url")
