"""HTML 4.01 entity references in URLs, as a SQL expression."""

from __future__ import annotations

from html.entities import name2codepoint

# Entity name -> character as one text constant, which Spark folds into a map literal.
_NAMES = "\x01".join(f"{name}\x02{chr(code)}" for name, code in sorted(name2codepoint.items()))
_MAP = f"str_to_map('{_NAMES}', '\x01', '\x02')"

_BODY = "substring_index(p, ';', 1)"
# ``#60`` or ``#x3c``; above 65535, and for surrogate halves, the text stays as it is.
_CODE = f"""case when {_BODY} rlike '^#[xX][0-9A-Fa-f]{{1,8}}$' then cast(conv(substring({_BODY}, 3), 16, 10) as bigint)
 when {_BODY} rlike '^#[0-9]{{1,9}}$' then cast(substring({_BODY}, 2) as bigint) end"""
_CHAR = f"""case when ({_CODE}) <= 65535 and not ({_CODE}) between 55296 and 57343
 then decode(unhex(lpad(hex({_CODE}), 4, '0')), 'UTF-16BE') end"""
_VALUE = f"coalesce(try_element_at({_MAP}, {_BODY}), {_CHAR})"
# ``p`` is the text after one ``&`` up to the next.
_PIECE = f"""case when contains(p, ';') and {_VALUE} is not null
 then concat({_VALUE}, substring(p, length({_BODY}) + 2)) else concat('&', p) end"""


def unescape(text: str) -> str:
    """Replace named and numeric references that end in a semicolon, once."""
    pieces = f"split({text}, '&')"
    rest = f"slice({pieces}, 2, greatest(size({pieces}) - 1, 1))"
    return f"""case when {text} rlike '&[^&;]+;' then concat({pieces}[0],
 array_join(transform({rest}, p -> {_PIECE}), '')) else {text} end"""
