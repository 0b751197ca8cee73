"""Driver-side input checks, run before any plan is built."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType,
                               ShortType, StringType, TimestampNTZType, TimestampType)


_SEP = "\\"
_UNC_START = re.compile(r"[\\/]{2}")


def check_trustee(trustee: str) -> str:
    """An account is written as a domain (or host) and a name with a backslash between."""
    if not isinstance(trustee, str) or _SEP not in trustee:
        raise ValueError(f"expected a trustee as DOMAIN{_SEP}NAME, got {trustee!r}")
    return trustee


def normalize_unc(path: str) -> str:
    """Accept ``\\\\server\\share`` or ``//server/share``; return the backslash form
    without a trailing separator (how traversal paths are stored)."""
    if not isinstance(path, str) or not _UNC_START.match(path):
        raise ValueError(f"expected a network path that starts with two separators, got {path!r}")
    parts = path[2:].replace("/", _SEP)
    return 2 * _SEP + parts.rstrip(_SEP)


def normalized_unc(path: Column | str) -> Column:
    """:func:`normalize_unc` for a column; NULL where the text is no network path."""
    c = F.col(path) if isinstance(path, str) else path
    back = F.translate(c, "/", _SEP)
    return F.when(back.startswith(2 * _SEP), F.concat(F.lit(2 * _SEP), F.rtrim(F.substr(back, F.lit(3)), F.lit(_SEP))))


def check_non_negative(value: int, name: str) -> int:
    if int(value) != value or value < 0:
        raise ValueError(f"{name}: expected a whole number from 0 on, got {value!r}")
    return int(value)


def check_positive(value: int, name: str) -> int:
    if int(value) != value or value <= 0:
        raise ValueError(f"{name}: expected a whole number from 1 on, got {value!r}")
    return int(value)


def check_flag(value: str, name: str) -> int:
    if value not in ("0", "1"):
        raise ValueError(f"{name}: expected '0' or '1', got {value!r}")
    return int(value)


def coerce_literal(value, dtype: DataType, name: str):
    """Cast a bound text value to the column's type once, on the driver."""
    try:
        if isinstance(dtype, (ByteType, ShortType, IntegerType, LongType)):
            if isinstance(value, str):
                value = value.strip()
            return int(value)
        if isinstance(dtype, (DoubleType, FloatType)):
            return float(value)
        if isinstance(dtype, (TimestampType, TimestampNTZType)):
            return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
        if isinstance(dtype, DateType):
            return value if isinstance(value, date) else date.fromisoformat(str(value))
        if isinstance(dtype, StringType):
            return str(value)
    except (TypeError, ValueError) as exc:
        raise ValueError(f"Value {value!r} for {name} does not fit column type {dtype.simpleString()}") from exc
    return value
