"""Physical layout for the governance views: write once, prune on read.

The large views are written as parquet partitioned by ``HostID`` (a file
server) and sorted within each file by the key the operators probe (resource
or trustee). A question about one path resolves its host/gate/resource keys
first (bounded lookup) and turns them into literal filters: on this layout
``HostID IN (...)`` prunes whole directories (``PartitionFilters``) and the
resource/trustee filters skip row groups by their min/max statistics.

Small or hot-key-free views are written unpartitioned. The closure and
trustee-name views are written as they are (the closure loop already
balanced them).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# view -> (partition columns, sort-within-partition columns)
LAYOUT: dict[str, tuple[list[str], list[str]]] = {
    "acl": (["HostID"], ["ResourceID", "TrusteeSid"]),
    "traversal": (["HostID"], ["NetworkPath"]),
    "daily_activity": (["HostID"], ["FolderID", "UserNTStyleName"]),
    "fs_exceptions": (["HostID"], ["ResourceID"]),
    "content_matches": (["HostID"], ["ParentResourceID"]),
    "users": ([], ["NTAccount"]),
    "groups": ([], ["NTAccount"]),
    "computers": ([], ["NTAccount"]),
    "local_trustees": ([], []),
    "direct_members": ([], ["GroupSid"]),
    "closure": ([], ["MemberSid"]),
    "trustee_names": ([], ["TrusteeSid"]),
    "ad_permissions": ([], ["DistinguishedName"]),
    "job_stats": ([], []),
}


def write_view(df: DataFrame, path: str, partition_cols: list[str], sort_cols: list[str]) -> None:
    """Write one view: range-partition rows to tasks on (partition, sort)
    columns, sort within tasks, and let the writer split directories.

    Range partitioning keeps each task on a contiguous key range, so a host
    holding a third of all rows spreads over many tasks (no straggler) while
    the file count stays near tasks + hosts instead of tasks x hosts.
    """
    out = df
    if partition_cols:
        out = out.repartitionByRange(*partition_cols, *sort_cols)
    if sort_cols or partition_cols:
        out = out.sortWithinPartitions(*partition_cols, *sort_cols)
    w = out.write.mode("overwrite")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def persist_catalog(cat, root: str, views: list[str] | None = None) -> None:
    """Materialise the catalog's views under ``root`` (shared storage on a cluster).

    Each view's schema is stored next to it (``_schemas/<view>``, one JSON
    line written by Spark) so loading restores column order and types that
    partition discovery would otherwise change.
    """
    root = root.rstrip("/")
    for name in views or list(LAYOUT):
        parts, order = LAYOUT[name]
        df = getattr(cat, name)
        write_view(df, f"{root}/{name}", parts, order)
        cat.spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1) \
            .write.mode("overwrite").text(f"{root}/_schemas/{name}")


def load_views(spark: SparkSession, root: str, views: list[str] | None = None) -> dict[str, DataFrame]:
    """Read persisted views back with their original schema (order and types)."""
    root = root.rstrip("/")
    out = {}
    for name in views or list(LAYOUT):
        schema = StructType.fromJson(json.loads(spark.read.text(f"{root}/_schemas/{name}").first()[0]))
        df = spark.read.schema(schema).parquet(f"{root}/{name}")
        out[name] = df.select(*[f"`{f.name}`" for f in schema.fields])
    return out
