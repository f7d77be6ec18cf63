"""URL rules as SQL expressions over a URL column: canonical form and its parts.

Each function takes column names (or SQL) and gives SQL.  ``operators.urls`` chains them in
projections, so a part used by many columns is computed once.
"""

from __future__ import annotations

from visitweave.config import MAX_URL_LENGTH
from visitweave.functions.entities import unescape

# What a host name may look like.
_CHAR = r"(?:[A-Za-z0-9]|[^\x00-\x7F])"
_LABEL = rf"{_CHAR}(?:(?:{_CHAR}|[_-]){{0,61}}{_CHAR})?"
_HOST = rf"^(?:{_LABEL}\.){{0,126}}(?![0-9]){_LABEL}$"
_DOTS = "。．｡"


def lower_host(url: str) -> str:
    """Lower-case up to the first slash after the protocol; all of it when there is none."""
    start = f"if(position('//', {url}) between 2 and 8, position('//', {url}) + 2, 1)"
    end = f"position('/', {url}, {start})"
    return f"""case when {end} = 0 then lower({url})
 else concat(lower(substring({url}, 1, {end} - 1)), substring({url}, {end})) end"""


def protocol(lowered: str) -> str:
    return f"if(startswith({lowered}, 'https://'), 'https', 'http')"


def strip_ends(lowered: str) -> str:
    """Without protocol, leading ``www.`` and trailing ``/ # ? &``."""
    return rf"rtrim('/#?&', regexp_replace({lowered}, r'^(?:https?://)?(?:www\.)*', ''))"


def unescape_if_needed(text: str) -> str:
    return f"case when position(';', {text}) > 1 then {unescape(text)} else {text} end"


def drop_controls(text: str) -> str:
    return rf"regexp_replace({text}, r'[\t\n\r\x00]', '')"


def authority(raw: str) -> str:
    return f"regexp_extract({raw}, '^([^/?#]*)', 1)"


def host(auth: str) -> str:
    return f"regexp_extract({auth}, '^(?:[^@]*@)?([^:]*)', 1)"


def domain_name(host_: str) -> str:
    """Host as a lower-case domain name with plain dots."""
    return f"translate(lower({host_}), '{_DOTS}', '...')"


def path(raw: str) -> str:
    return remove_dots(f"regexp_extract(rtrim({raw}), '^[^/?#]*([^?#]*)', 1)")


def query(raw: str) -> str:
    """Text between the first ``?`` and the fragment, null without one."""
    main = f"substring_index(rtrim({raw}), '#', 1)"
    return f"if(contains({main}, '?'), substring({main}, position('?', {main}) + 1), null)"


def remove_dots(text: str) -> str:
    """Resolve ``.`` and ``..`` segments of an absolute path.

    ``..`` with nothing before it stays, as does a leading run of them.
    """
    kept = f"""aggregate(split({text}, '/'), cast(array() as array<string>), (acc, seg) -> case
 when seg = '.' then acc
 when seg = '..' and size(acc) > 1 and try_element_at(acc, -1) <> '..' then slice(acc, 1, size(acc) - 1)
 else concat(acc, array(seg)) end)"""
    closing = rf"if({text} rlike r'/\.{{1,2}}$' and element_at({kept}, -1) <> '..', '/', '')"
    return rf"""case when {text} rlike r'/\.{{1,2}}(?:/|$)'
 then concat(array_join({kept}, '/'), {closing}) else {text} end"""


def syntax_reason(original: str, auth: str, name: str, lenient: bool = False) -> str:
    """Why a URL is rejected before its suffix is looked up; null when it is not."""
    port = f"regexp_extract({auth}, ':(.*)$', 1)"
    bad_port = rf"""({port} <> '' and ({port} not rlike r'^(?:\+?[0-9]+|-1)$' or try_cast({port} as int) is null))"""
    too_long = "" if lenient else f"when length({original}) > {MAX_URL_LENGTH} then 'too_long'"
    return rf"""case when {original} is null or {original} not rlike r'\S' then 'blank' {too_long}
 when trim(regexp_extract({auth}, '^(.*)@', 1)) <> '' then 'user_info'
 when {bad_port} then 'bad_port'
 when endswith({name}, '.') then 'trailing_dot'
 when length({name}) > 253 or {name} not rlike r'{_HOST}' then 'bad_domain' end"""


def _split_trimmed(text: str, chars: str, pattern: str) -> str:
    """Split on single characters, dropping trailing empty pieces.

    The empty text gives one empty piece, a text of separators only gives none.
    """
    body = f"rtrim('{chars}', {text})"
    return f"""case when {text} = '' then array('') when {body} = '' then cast(array() as array<string>)
 else split({body}, '{pattern}') end"""


def query_params(raw: str) -> str:
    """Pieces after the first ``?`` of the raw URL, cut at ``&`` or ``#``; null without any."""
    text = f"substring({raw}, position('?', {raw}) + 1)"
    return f"case when contains({raw}, '?') and {text} <> '' then {_split_trimmed(text, '&#', '[&#]')} end"


def folders(raw: str) -> str:
    """Path pieces of the raw URL without its host."""
    pieces = _split_trimmed(f"regexp_extract({raw}, '^([^?#]*)', 1)", "/", "/")
    return f"filter({pieces}, (x, i) -> i > 0)"


def path_segments(path_: str) -> str:
    return _split_trimmed(path_, "/", "/")


def param_names(params: str) -> str:
    return f"transform({params}, p -> substring_index(p, '=', 1))"


def only_equals(params: str) -> str:
    """Whether some parameter is made of ``=`` signs only."""
    return f"exists({params}, p -> p rlike '^=+$')"


def url_tokens(fld: str, path_: str, params: str, literal: bool = False) -> str:
    """First-level domain, path pieces and parameter names, in order.

    ``literal`` gives the published program's result, which is empty when the URL has
    no parameters or one made of ``=`` signs only.
    """
    none = "cast(array() as array<string>)"
    tokens = f"concat(array({fld}), {path_segments(path_)}, coalesce({param_names(params)}, {none}))"
    void = f"{fld} is null" + (f" or {params} is null or {only_equals(params)}" if literal else "")
    return f"case when {void} then {none} else {tokens} end"


def strip_key(site: str) -> str:
    """Site without the one-character suffix of an aggregated key."""
    return f"regexp_replace({site}, '[*#]$', '')"
