"""Compatibility decomposition to ASCII, as a Column and as SQL.

The SQL has a table of the code points whose NFKD form holds ASCII characters, made
once from the interpreter's Unicode data and bounded by Unicode: those with one such
character go through ``translate``, the few with several through a map that is
looked at only where a text holds one of them.  Everything else beyond ASCII is
dropped, as the decomposition's other parts are.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@cache
def ascii_forms() -> dict[str, str]:
    """Character beyond ASCII → the ASCII characters of its NFKD form, where there are any."""
    out = {}
    for code in range(0x80, 0x110000):
        if not 0xD800 <= code < 0xE000:
            form = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
            if form:
                out[chr(code)] = form
    return out


@cache
def tables() -> tuple[str, str, dict[str, str]]:
    """(characters with one ASCII character, those characters, the others' map)."""
    one = {c: f for c, f in ascii_forms().items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in ascii_forms().items() if len(f) > 1}


def char_class(chars) -> str:
    """A class of these characters, runs as ranges; they are beyond ASCII, so nothing needs escaping."""
    codes, out, i = sorted(map(ord, chars)), [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(chr(codes[i]) + (f"-{chr(codes[j])}" if j > i else ""))
        i = j + 1
    return "[" + "".join(out) + "]"


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def fold_ascii(text: Column) -> Column:
    """NFKD decomposition, then every code point beyond ASCII dropped; a text is decomposed once, in its task."""
    return _folded(text)


def fold_sql(text: str) -> str:
    """DuckDB SQL of :func:`fold_ascii`."""
    source, target, several = tables()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = f"map([{', '.join(map(quoted, several))}], [{', '.join(map(quoted, several.values()))}])"
    spread = (f"CASE WHEN regexp_matches({text}, {quoted(char_class(several))}) THEN array_to_string(list_transform(string_split({text}, ''), "
              f"lambda c: coalesce({names}[c], c)), '') ELSE {text} END")
    return f"regexp_replace(translate({spread}, {quoted(source)}, {quoted(target)}), '[^\\x00-\\x7F]+', '', 'g')"
