"""D-1..D-5: schema facts measured on the data, parameterised SQL, log fingerprints.

Parquet declares neither lengths, NOT NULL nor keys, so the catalog questions
become data checks, each a single distributed aggregate.
"""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from grantlens.functions.fingerprint import masked, shortened


_TABLE_NAME = re.compile(r"\w+")


def check_table_name(name: str) -> str:
    """Table names: letters, digits and underscores only, with at least one letter or digit."""
    if not isinstance(name, str) or not _TABLE_NAME.fullmatch(name) or set(name) == {"_"}:
        raise ValueError(f"not a plain table name: {name!r}")
    return name


def column_profile(df: DataFrame, table_name: str, exact: bool = True) -> DataFrame:
    """Per column: ordinal, name, type, null count, max text length, distinct count.

    One global aggregate over the table (partial aggregation per task, a
    single-row final stage), then an unpivot of that one row. ``exact=False``
    uses HyperLogLog (``approx_count_distinct``), the right choice at scale.
    Exact counts of text columns shuffle 32-byte SHA-256 digests, not texts.
    """
    check_table_name(table_name)
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"_nn{i}"))
        aggs.append((F.max(F.length(c)) if isinstance(f.dataType, StringType) else F.lit(None).cast("int"))
                    .alias(f"_ml{i}"))
        key = F.unhex(F.sha2(c, 256)) if isinstance(f.dataType, StringType) else c
        aggs.append((F.countDistinct(key) if exact else F.approx_count_distinct(c)).alias(f"_dc{i}"))
    row = df.agg(*aggs)
    items = [F.struct(F.lit(i + 1).alias("ordinal"), F.lit(f.name).alias("column_name"),
                      F.lit(f.dataType.simpleString()).alias("data_type"),
                      (F.col("_rows") - F.col(f"_nn{i}")).alias("null_count"),
                      F.col(f"_ml{i}").cast("int").alias("max_length"),
                      F.col(f"_dc{i}").cast("bigint").alias("distinct_count"))
             for i, f in enumerate(fields)]
    return row.select(F.explode(F.array(*items)).alias("p")).select(
        F.lit(table_name).alias("table_name"), "p.*")


def primary_key_check(df: DataFrame, table_name: str, key_cols: list[str]) -> DataFrame:
    """Does ``key_cols`` identify rows? rows, distinct keys, null-key rows, duplicate groups.

    One groupBy on the key (partial counts per task collapse hot keys before
    the shuffle), then a global aggregate of the per-key counts.
    """
    any_null = None
    for k in key_cols:
        any_null = F.col(k).isNull() if any_null is None else (any_null | F.col(k).isNull())
    per_key = df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_n")).withColumn("_null", any_null)
    out = per_key.agg(
        F.sum("_n").cast("bigint").alias("row_count"),
        F.count(F.when(~F.col("_null"), 1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).cast("bigint").alias("null_key_rows"),
        F.count(F.when(~F.col("_null") & (F.col("_n") > 1), 1)).alias("duplicate_groups"))
    return out.select(F.lit(table_name).alias("table_name"), F.lit(",".join(key_cols)).alias("key_columns"), "*",
                      ((F.col("null_key_rows") == 0) & (F.col("duplicate_groups") == 0)).alias("is_key"))


def foreign_key_check(child: DataFrame, child_table: str, child_cols: str | list[str],
                      parent: DataFrame, parent_table: str, parent_cols: str | list[str]) -> DataFrame:
    """Orphans of ``child(child_cols) -> parent(parent_cols)``; the keys may have several columns.

    A child key with a NULL in any column refers to nothing and is no orphan.
    The child is pre-aggregated per key value first, so a value holding a
    third of all rows shrinks to one row per task before the shuffle; the
    left join against the distinct parent keys then marks orphans.
    """
    cc = [child_cols] if isinstance(child_cols, str) else list(child_cols)
    pc = [parent_cols] if isinstance(parent_cols, str) else list(parent_cols)
    if len(cc) != len(pc) or not cc:
        raise ValueError("child and parent need the same number of key columns")
    keys = [f"_k{i}" for i in range(len(cc))]
    c = child.select(*[F.col(x).alias(k) for x, k in zip(cc, keys)]).dropna() \
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    p = parent.select(*[F.col(x).alias(k) for x, k in zip(pc, keys)]).distinct().withColumn("_hit", F.lit(True))
    j = c.join(p, keys, "left")
    orphan = F.col("_hit").isNull()
    out = j.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("child_rows"),
                F.coalesce(F.sum(F.when(orphan, F.col("_n"))), F.lit(0)).cast("bigint").alias("orphan_rows"),
                F.count(F.when(orphan, 1)).alias("orphan_keys"))
    return out.select(F.lit(child_table).alias("child_table"), F.lit(",".join(cc)).alias("child_column"),
                      F.lit(parent_table).alias("parent_table"), F.lit(",".join(pc)).alias("parent_column"),
                      "*", (F.col("orphan_rows") == 0).alias("is_valid"))


def _writes(node, command) -> bool:
    """Does a parsed plan hold a command or an insert anywhere?"""
    name = node.getClass().getSimpleName()
    if command.isInstance(node) or name.startswith("Insert") or name.endswith("Command"):
        return True
    children = node.children()
    return any(_writes(children.apply(i), command) for i in range(children.size()))


def check_query(spark: SparkSession, text: str) -> None:
    """Raise unless Spark's own parser says that ``text`` only reads.

    Commands and inserts in every form (also below WITH, multi-insert and
    INSERT OVERWRITE DIRECTORY) are refused; so is a text about which the
    parser cannot be asked. A text that does not parse raises its parse error.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        command = spark.sparkContext._jvm.java.lang.Class.forName(
            "org.apache.spark.sql.catalyst.plans.logical.Command")
        writes = _writes(plan, command)
    except ParseException:
        raise
    except Exception as exc:  # no access to the parser: fail closed
        raise ValueError("cannot tell whether this text only reads, so it does not run") from exc
    if writes:
        raise ValueError("only queries can run here (no DDL/DML statements)")


def run_sql(spark: SparkSession, text: str, params=None, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Parameterised SQL over registered views: ``?`` markers bound from a list
    (or ``:name`` markers from a dict). Values are bound, never spliced into
    the text. Only queries run: spark.sql executes commands (DDL/DML)
    immediately, so they are refused before execution."""
    check_query(spark, text)
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=params) if params else spark.sql(text)


def query_fingerprints(df: DataFrame, text_col: str) -> DataFrame:
    """Group logged texts by their whole masked text: (fingerprint, label, n); the label is the shortened form."""
    counts = df.groupBy(masked(F.col(text_col)).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("fingerprint", shortened(F.col("fingerprint")).alias("label"), "n")
