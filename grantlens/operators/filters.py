"""P-12: optional-filter builder (spec table -> one Column, AND of the given filters)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlens.functions.like import like
from grantlens.functions.validate import check_flag, coerce_literal

LIKE, EQ, FLAG = "like", "eq", "flag"


@dataclass(frozen=True)
class FilterSpec:
    param: str   # keyword argument name, e.g. "nt_account_filter"
    column: str  # column it filters
    mode: str    # LIKE, EQ or FLAG


def specs(mode: str, pairs: dict[str, str]) -> list[FilterSpec]:
    return [FilterSpec(p, c, mode) for p, c in pairs.items()]


def build_filter(df: DataFrame, spec_list: list[FilterSpec], values: dict, *, skip_empty: bool = False,
                 ignore_case: bool = False) -> Column | None:
    """AND of the filters whose value is given.

    ``skip_empty`` mirrors tools that test truthiness ('' is ignored);
    otherwise '' is a real pattern that matches only empty text. Flag values
    must be '0' or '1' and numeric equality values must parse: both are
    checked here, on the driver, before any job runs.
    """
    known = {s.param: s for s in spec_list}
    unknown = sorted(set(values) - set(known))
    if unknown:
        raise TypeError(f"unknown filter(s): {', '.join(unknown)}")
    types = {f.name: f.dataType for f in df.schema.fields}
    conds: list[Column] = []
    for s in spec_list:
        v = values.get(s.param)
        if v is None or (skip_empty and v == ""):
            continue
        col = F.col(f"`{s.column}`")
        if s.mode == LIKE:
            conds.append(like(col, str(v), types[s.column], ignore_case))
        elif s.mode == EQ:
            conds.append(col == F.lit(coerce_literal(v, types[s.column], s.param)))
        elif s.mode == FLAG:
            conds.append(col == F.lit(check_flag(v, s.param)))
        else:
            raise ValueError(f"unknown filter mode {s.mode}")
    return reduce(lambda a, b: a & b, conds) if conds else None


def apply(df: DataFrame, cond: Column | None) -> DataFrame:
    return df if cond is None else df.filter(cond)
