"""Safe fingerprints of logged text (literals, numbers and e-mails masked)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The masking rules, applied in this order (numbers before
# e-mail shapes), then the length cut.
FINGERPRINT_RULES = (
    (r"'[^']*'", "'?'"),
    (r'"[^"]*"', '"?"'),
    (r"\b\d+\.?\d*\b", "?"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "?@?"),
)
FINGERPRINT_MAX_LENGTH = 150
FINGERPRINT_ELLIPSIS = "..."


def masked(text: Column | str) -> Column:
    """The whole text under the masking rules; an empty or NULL input gives ''.

    Runs as chained JVM ``regexp_replace`` calls (no Python UDF).
    """
    col = F.col(text) if isinstance(text, str) else text
    out = F.coalesce(col, F.lit(""))
    for pattern, repl in FINGERPRINT_RULES:
        out = F.regexp_replace(out, pattern, repl)
    return out


def shortened(text: Column, max_length: int = FINGERPRINT_MAX_LENGTH) -> Column:
    """``text`` cut at ``max_length`` characters, with an ellipsis if it was longer (a label, never a key)."""
    return F.when(F.length(text) > max_length,
                  F.concat(F.substring(text, 1, max_length), F.lit(FINGERPRINT_ELLIPSIS))).otherwise(text)


def fingerprint(text: Column | str, max_length: int = FINGERPRINT_MAX_LENGTH) -> Column:
    """The masked text as it is shown in a log: :func:`masked`, then :func:`shortened`."""
    return shortened(masked(text), max_length)
