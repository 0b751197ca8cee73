"""Prefix (path-containment) join as an equi-join.

"Folder path starts with share path" inside one host/gate is a range-like
join: joined on (host, gate) and filtered with ``startswith``, every folder
row meets every share of its server, so a server with thousands of shares
multiplies the folder rows by thousands before the filter.

Here each path is cut at the lengths that occur among the targets of its own
keys (one array per host/gate, joined as a table, so nothing is collected and
no bound is needed) and the cuts are equi-joined with the targets on
(keys, path). A row fans out to at most as many rows as there are such
lengths within its own length, the join keys are as selective as the paths
themselves, and the result is exactly the ``startswith`` result:

* plain prefix: cut == target;
* strict (the target itself or below its separator): cut == target and the
  character after the cut is the end of the path or a backslash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEP = "\\"


def prefix_join(rows: DataFrame, path_col: str, targets: DataFrame, target_path_col: str, keys: list[str],
                strict: bool = False) -> DataFrame:
    """Rows paired with every target (same ``keys``) whose path is a prefix of theirs."""
    path, target = F.col(path_col), F.col(target_path_col)
    lengths = targets.groupBy(*keys).agg(F.collect_set(F.length(target)).alias("_lengths"))
    own = F.filter("_lengths", lambda n: n <= F.length(path))
    cuts = rows.join(lengths, keys).withColumn("_cut", F.explode(F.transform(own, lambda n: F.substr(path, F.lit(1), n))))
    j = cuts.drop("_lengths").join(targets.withColumn("_cut", target), [*keys, "_cut"])
    if strict:
        nxt = F.substr(path, F.length(target) + 1, F.lit(1))
        j = j.filter((nxt == "") | (nxt == F.lit(SEP)))
    return j.drop("_cut")
