"""LIKE patterns as the directory tools use them, translated for Spark.

* The backslash in ``DOMAIN\\User%`` is plain text: we pass an escape
  character that does not occur in the pattern, so Spark never treats the
  backslash as an escape (its default would raise on ``CORP\\Admin%``).
* ``[abc]`` / ``[^a-z]`` character classes become a regex (``rlike``); plain
  patterns stay LIKE so Catalyst can turn ``prefix%`` into ``StartsWith`` and
  push it to the parquet scan.
* Non-string columns are compared as their string form (ISO text for dates).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

_ESCAPE_CANDIDATES = "~!^`|#&"
_CLASS = re.compile(r"\[(\^?)([^\]]*)\]")


def _escape_char(pattern: str) -> str:
    for ch in _ESCAPE_CANDIDATES:
        if ch not in pattern:
            return ch
    for code in range(0x2400, 0x2500):  # control-picture symbols, never in data patterns
        if chr(code) not in pattern:
            return chr(code)
    raise ValueError("no free escape character for LIKE pattern")


def has_char_class(pattern: str) -> bool:
    return bool(_CLASS.search(pattern))


def like_to_regex(pattern: str) -> str:
    """Translate a LIKE pattern with ``[...]`` classes to an anchored regex."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        m = _CLASS.match(pattern, i) if ch == "[" else None
        if m:
            neg, body = m.group(1), m.group(2)
            body = body.replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[{'^' if neg else ''}{body}]")
            i = m.end()
            continue
        if ch == "%":
            out.append(".*")
        elif ch == "_":
            out.append(".")
        else:
            out.append(re.escape(ch))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"  # \z: a trailing line break is part of the text


def as_text(col: Column, dtype: DataType) -> Column:
    return col if isinstance(dtype, StringType) else col.cast("string")


def like(col: Column, pattern: str, dtype: DataType = StringType(), ignore_case: bool = False) -> Column:
    """``col LIKE pattern`` with the tool semantics described above."""
    text = as_text(col, dtype)
    if has_char_class(pattern):
        regex = like_to_regex(pattern)
        if ignore_case:
            regex = "(?i)" + regex
        return text.rlike(regex)
    esc = F.lit(_escape_char(pattern))
    fn = F.ilike if ignore_case else F.like
    return fn(text, F.lit(pattern), esc)
