"""Loaders for the driver's parquet tables, with a schema check on load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns each consumed input must provide (a subset check: extra columns pass).
RAW_SCHEMAS: dict[str, dict[str, str]] = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
               "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
                 "l_quantity": "double", "l_returnflag": "string", "l_linestatus": "string",
                 "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string"},
    "documents": {"doc_id": "bigint", "text": "string"},
    "pages": {"page_id": "bigint", "url": "string"},
    "labels": {"doc_id": "bigint"},
}


def read_table(spark: SparkSession, sf_dir: str, name: str, check: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if check and name in RAW_SCHEMAS:
        have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        for col, typ in RAW_SCHEMAS[name].items():
            if col not in have:
                raise ValueError(f"{name}: missing column {col}")
            if have[col] != typ:
                raise ValueError(f"{name}.{col}: expected {typ}, found {have[col]}")
    return df
