"""Hot-key handling for joins whose key may hold a large share of all rows.

A membership group such as "everyone" can hold a third of all members, and
the same group can appear on millions of ACL entries. Joining on such a key
puts one group's whole product into one task. We detect hot keys with one
aggregate (the key list is bounded: at most ``1 / min_share`` keys can pass
the threshold), then split the hot key's rows on the larger side into as many
salts as its own rows need and replicate only the hot rows of the other side.
Salts come from a hash of row content, never from ``rand()``, so a task that
is re-run after an executor loss produces the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MIN_SHARE = 0.02
DEFAULT_MIN_ROWS = 1000


def share_for(partitions: int, factor: float = 4.0) -> float:
    """Hot-key share threshold for a shuffle of ``partitions``: a key is hot
    when it holds more than ``factor`` average partitions' worth of rows
    (capped at the default 2 %). At 2,000 partitions that is 0.2 %."""
    return min(DEFAULT_MIN_SHARE, factor / max(1, partitions))


def hot_key_counts(df: DataFrame, key: str, min_share: float = DEFAULT_MIN_SHARE,
                   min_rows: int = DEFAULT_MIN_ROWS) -> dict:
    """{key: rows} for the keys holding at least ``min_share`` of the rows (and ``min_rows``).

    One partial-aggregated count per key, of which only the top
    ``ceil(1 / min_share) + 1`` keys reach the driver: at most ``1 / min_share``
    keys can pass the share threshold, so none is missed and the collected
    list is bounded whatever the data size.
    """
    limit = int(1 / min_share) + 1
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.filter(F.col("_n") >= min_rows).orderBy(F.desc("_n")).limit(limit).collect()
    if not top:
        return {}
    threshold = max(df.count() * min_share, min_rows)
    return {r[key]: r["_n"] for r in top if r["_n"] >= threshold}


def hot_keys(df: DataFrame, key: str, min_share: float = DEFAULT_MIN_SHARE,
             min_rows: int = DEFAULT_MIN_ROWS) -> list:
    """The hot keys of ``df`` (see :func:`hot_key_counts`), largest first."""
    return list(hot_key_counts(df, key, min_share, min_rows))


def hot_plan(left: DataFrame, right: DataFrame, key: str, min_share: float = DEFAULT_MIN_SHARE,
             min_rows: int = DEFAULT_MIN_ROWS) -> dict:
    """How to split each hot key of a join: ``{key: n}``, n > 0 splits ``left``'s rows
    of that key over n salts (and replicates ``right``'s), n < 0 the reverse.

    Hot keys are found on both inputs; a key hot on one side only is counted
    on the other side too (bounded: at most ``2 / min_share`` keys). The
    larger side of each key is split, so replication always copies the
    smaller one. The number of salts follows from the key's own rows: as many
    as average shuffle partitions of its side they would fill.
    """
    lc = hot_key_counts(left, key, min_share, min_rows)
    rc = hot_key_counts(right, key, min_share, min_rows)
    keys = list(dict.fromkeys([*lc, *rc]))
    if not keys:
        return {}

    def fill(df: DataFrame, have: dict) -> dict:
        missing = [k for k in keys if k not in have]
        if missing:
            rows = df.filter(F.col(key).isin(missing)).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).collect()
            have = {**have, **{r[key]: r["_n"] for r in rows}}
        return have

    lc, rc = fill(left, lc), fill(right, rc)
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = {True: max(1, left.count() // partitions), False: max(1, right.count() // partitions)}
    plan = {}
    for k in keys:
        on_left = lc.get(k, 0) >= rc.get(k, 0)
        n = max(2, -(-(lc if on_left else rc)[k] // each[on_left]))
        plan[k] = n if on_left else -n
    return plan


def salt(fan: DataFrame, other: DataFrame, key: str, plan: dict) -> tuple[DataFrame, DataFrame, list[str]]:
    """The two sides of :func:`skew_join` with their salt columns, plus the join keys.

    ``plan`` is a :func:`hot_plan`. A split row gets one salt from a hash of
    its content; the other side's rows of that key are replicated once per
    salt; all other rows get salt 0.
    """
    if not plan:
        return fan, other, [key]

    def salted(df: DataFrame, split: dict, replicate: dict) -> DataFrame:
        content = [F.col(c) for c in df.columns if c != key] or [F.col(key)]
        arr = F.array(F.lit(0))
        # Keys with the same number of salts share one branch of the expression.
        for n in sorted(set(replicate.values())):
            same = [k for k, v in replicate.items() if v == n]
            arr = F.when(F.col(key).isin(same), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(arr)
        for n in sorted(set(split.values())):
            same = [k for k, v in split.items() if v == n]
            one = F.array(F.pmod(F.xxhash64(*content), F.lit(n)).cast("int"))
            arr = F.when(F.col(key).isin(same), one).otherwise(arr)
        return df.withColumn("_salt", F.explode(arr))

    split_fan = {k: n for k, n in plan.items() if n > 0}
    split_other = {k: -n for k, n in plan.items() if n < 0}
    return salted(fan, split_fan, split_other), salted(other, split_other, split_fan), [key, "_salt"]


def skew_join(fan: DataFrame, other: DataFrame, key: str, plan: dict, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` with hot keys spread over salts as :func:`hot_plan` says.

    Each split row keeps exactly one salt and the other side's rows of that
    key are replicated once per salt, so inner joins (and left joins that only
    split the left side) give exactly the plain join. The shuffle is the
    join's own, so AQE can still split what stays large.
    """
    if how not in ("inner", "left"):
        raise ValueError("skew_join supports inner and left joins")
    if how == "left" and any(n < 0 for n in plan.values()):
        raise ValueError("a left join may only split its left side")
    fan_s, other_s, keys = salt(fan, other, key, plan)
    joined = fan_s.join(other_s, keys, how)
    return joined.drop("_salt") if len(keys) > 1 else joined
