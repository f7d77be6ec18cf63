"""URL enrichment: canonical URL, validity, domain levels and tokens as columns.

Everything is a narrow projection.  The public suffix comes from rules compiled into a few constant
patterns; rules too many for that are joined, once per name length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitweave.config import NO_DOMAIN, URL_TOKENS
from visitweave.functions import urls as U
from visitweave.sources.suffixes import SuffixRules


def public_suffix(df: DataFrame, name: str, rules: SuffixRules, out: str = "suffix_labels") -> DataFrame:
    """Number of labels in the longest matching suffix of domain ``name``; null if none."""
    if rules.patterns is not None:
        choice = [F.when(F.col(name).rlike(pattern), labels) for pattern, labels in rules.patterns]
        # One row each: filters on the result, pushed further down, would repeat all that leads to the name.
        return df.select("*", F.explode_outer(F.array(F.coalesce(*choice, F.lit(None).cast("int")))).alias(out))
    count = rf"size(split({name}, r'\.'))"
    joined = df
    for d in range(1, rules.depth + 1):
        side = rules.frame.selectExpr(*[f"{c} as _{c}{d}" for c in rules.frame.columns])
        tail = F.expr(f"if({count} >= {d}, substring_index({name}, '.', -{d}), null) = _suffix{d}")
        joined = joined.join(side, tail, "left")
    choice = []
    for c in range(rules.depth + 1, 0, -1):
        if c <= rules.depth:
            choice += [f"if(_exact{c}, {c}, null)", f"if(_exception{c}, {c - 1}, null)"]
        if c > 1:
            choice.append(f"if(_wildcard{c - 1} and {count} >= {c}, {c}, null)")
    return joined.selectExpr(*df.columns, f"coalesce({', '.join(choice)}) as {out}")


def canonical(df: DataFrame, url: str, rules: SuffixRules, prefix: str = "",
              lenient: bool = False) -> DataFrame:
    """Add ``raw_url`` ('' when invalid), ``reject_reason`` and the pieces they come from."""
    p = prefix
    low, bare, once, raw = p + "_low", p + "_bare", p + "_once", p + "_raw"
    auth, host, name, n = p + "_auth", p + "_host", p + "_name", p + "_suffix_labels"
    # The second unescaping only follows a first one that left a semicolon.
    again = f"case when position(';', {bare}) > 1 then {U.unescape_if_needed(once)} else {once} end"
    step = df
    for expr in (f"{U.lower_host(url)} as {low}", f"{U.strip_ends(low)} as {bare}",
                 f"{U.unescape_if_needed(bare)} as {once}", f"{U.drop_controls(again)} as {raw}",
                 f"{U.authority(raw)} as {auth}", f"{U.host(auth)} as {host}", f"{U.domain_name(host)} as {name}"):
        step = step.selectExpr("*", expr)
    step = public_suffix(step, name, rules, n)
    reason = f"""coalesce({U.syntax_reason(url, auth, name, lenient)},
 case when {n} is null then 'no_suffix' when not contains({name}, '.') then 'no_dot' else 'ok' end)"""
    step = step.selectExpr("*", f"{reason} as {p}reject_reason")
    return step.selectExpr(*df.columns, raw, low, host, name, n, f"{p}reject_reason",
                           f"if({p}reject_reason = 'ok', {raw}, '') as {p}raw_url")


def standardise(df: DataFrame, columns: list[str], rules: SuffixRules) -> DataFrame:
    """Replace URL columns by their canonical form, '' where invalid."""
    out = df
    for col in columns:
        out = canonical(out, col, rules, prefix=f"_{col}_").selectExpr(
            *[f"_{col}_raw_url as {col}" if c == col else c for c in df.columns])
    return out


def domains(df: DataFrame, url: str, rules: SuffixRules, out: str = "domain") -> DataFrame:
    """Add only the first-level domain of ``url``, the no-domain mark when invalid."""
    fld = "substring_index(_d__name, '.', -(_d__suffix_labels + 1))"
    return canonical(df, url, rules, prefix="_d_").selectExpr(
        *df.columns, f"if(_d_reject_reason = 'ok', {fld}, '{NO_DOMAIN}') as {out}")


def enrich(df: DataFrame, url: str, rules: SuffixRules, literal: bool = False) -> DataFrame:
    """Add all derived URL columns; they are null for an invalid URL (tolerant creation)."""
    keep = [*df.columns, "raw_url", "reject_reason"]
    step = canonical(df, url, rules).selectExpr(
        *keep, "reject_reason = 'ok' as is_valid", "if(is_valid, _raw, null) as _u",
        f"if(is_valid, {U.protocol('_low')}, null) as protocol", "if(is_valid, _host, null) as host",
        "if(is_valid, _name, null) as _dns", r"size(split(_dns, r'\.')) as _n",
        "if(is_valid, _suffix_labels, null) as _ns", "if(_n = _ns, _n, _ns + 1) as _nf")
    step = step.selectExpr(
        "*", f"{U.path('_u')} as path", f"{U.query('_u')} as query", f"{U.query_params('_u')} as query_params",
        f"{U.folders('_u')} as folders", "substring_index(_dns, '.', -_nf) as first_level_domain",
        "_n > _nf as is_subdomain", "_n = _nf as is_first_level_domain", "_n = _nf + 1 as is_second_level_domain",
        "if(_n > _ns, substring_index(_dns, '.', -_ns), null) as public_suffix",
        "if(_n > _ns, substring_index(_dns, '.', _n - _ns), null) as domain",
        "if(_n > _nf, substring_index(_dns, '.', _n - _nf), null) as sub_domain",
        "if(_n > _nf, substring_index(_dns, '.', -(_nf + 1)), null) as second_level_domain")
    step = step.selectExpr(
        "*", "if(is_subdomain, lower(host), first_level_domain) as short_url",
        "concat(path, coalesce(concat('?', query), '')) as page")
    fragment = "if(contains(_u, '#'), substring(_u, position('#', _u)), '')"
    return step.selectExpr(
        *keep, "is_valid", "protocol", "host", "path", "query", "page", f"concat(page, {fragment}) as raw_page",
        "query_params", "folders", "public_suffix", "substring_index(short_url, '.', -1) as top_level_domain",
        "length(top_level_domain) = 2 as is_country_domain", "first_level_domain",
        "concat(first_level_domain, '*') as first_level_domain_key", "second_level_domain",
        "concat(second_level_domain, '#') as second_level_domain_key",
        "substring_index(first_level_domain, '.', 1) as main_domain", "domain", "sub_domain",
        "is_subdomain", "is_first_level_domain", "is_second_level_domain", "short_url",
        "if(is_first_level_domain, concat('www.', short_url), short_url) as short_url_www",
        "concat(protocol, '://', short_url_www) as short_url_www_http",
        "query is null and path in ('', '/') as is_homepage",
        f"coalesce(first_level_domain, '{NO_DOMAIN}') as domain_or_default",
        f"{U.url_tokens('first_level_domain', 'path', 'query_params', literal)} as url_tokens")


def url_dimension(df: DataFrame, columns: list[str], rules: SuffixRules) -> DataFrame:
    """One enriched row per distinct URL found in ``columns`` ('' for a missing one).

    ``vector_tokens`` are the first token positions that enter the URL vector.  A parameter
    made of ``=`` signs only voids the parameter positions there.
    """
    stacked = df.select(F.explode(F.array(*[F.coalesce(c, F.lit("")) for c in columns])).alias("url"))
    dim = enrich(stacked.distinct(), "url", rules)
    usable = f"if({U.only_equals('query_params')}, null, query_params)"
    tokens = U.url_tokens("first_level_domain", "path", usable)
    return dim.selectExpr("*", f"slice({tokens}, 1, {URL_TOKENS}) as vector_tokens")


def same_url(df: DataFrame, rules: SuffixRules, url: str = "url") -> DataFrame:
    """One row per URL identity, which is the canonical URL."""
    return canonical(df.select(F.col(url).alias("url")), "url", rules).filter(
        "reject_reason = 'ok'").select("raw_url").distinct()


def reject_counts(df: DataFrame, url: str, rules: SuffixRules, lenient: bool = False) -> DataFrame:
    return canonical(df, url, rules, lenient=lenient).groupBy("reject_reason").agg(
        F.count(F.lit(1)).alias("n_urls"))


def percent_coding(df: DataFrame, text: str) -> DataFrame:
    """Form encoding of a text and back; undecodable text gives null."""
    return df.selectExpr("*", f"url_encode({text}) as encoded", f"try_url_decode({text}) as decoded")
