"""Sources and sinks (A*): raw-zone and bronze writes, documented tables,
previews, catalog profiles, and key-based upsert/replace on Parquet.

Parquet tables support neither ``MERGE`` nor ``DELETE``, so A8/A9 are
DataFrame jobs (anti join + union) over a table in hash partitions of the key:
only the partitions that the source touches are read and rewritten.  All paths
live under the session's shared folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dealerlens.session import scratch_path
from dealerlens.sources.state import HashTable


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Read a Parquet table as its row groups split it; never a shuffle."""
    return spark.read.parquet(path)


def write_raw(df: DataFrame, path: str) -> DataFrame:
    """A2: land a frame as a Parquet folder (overwrite) and return it re-read."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def ingest_bronze(spark: SparkSession, source_path: str, table_path: str) -> DataFrame:
    """A1: read a Parquet folder, stamp ``_ingested_at`` (one value per run,
    fixed at planning), overwrite the bronze location including its schema."""
    df = spark.read.parquet(source_path).withColumn("_ingested_at", F.current_timestamp())
    df.write.mode("overwrite").option("mergeSchema", "false").parquet(table_path)
    return spark.read.parquet(table_path)


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: StructType) -> DataFrame:
    """A3: a small master table from literal rows with an explicit schema."""
    return spark.createDataFrame(list(rows), schema)


def read_with_schema(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A3 on stored masters: read with an explicit schema, never inferred."""
    return spark.read.schema(schema).parquet(path)


def _ident(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"bad identifier {name!r}")
    return name


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def write_documented_table(df: DataFrame, name: str, comment: str, col_comments: Mapping[str, str],
                           path: str | None = None) -> DataFrame:
    """A4: write a table (external, at ``path``), then set the table comment and
    one comment per column."""
    spark = df.sparkSession
    name = _ident(name)
    path = path or scratch_path(spark, f"tables/{name}")
    df.write.mode("overwrite").option("path", path).saveAsTable(name)
    spark.sql(f"COMMENT ON TABLE {name} IS {_sql_text(comment)}")
    for col, text in col_comments.items():
        spark.sql(f"ALTER TABLE {name} ALTER COLUMN {_ident(col)} COMMENT {_sql_text(text)}")
    return spark.table(name)


def preview_table(df: DataFrame, key: str | list[str], limit: int = 10) -> DataFrame:
    """A5: first ``limit`` (≤ 100) rows in key order (a distributed top-k)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1..100")
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(*keys).limit(limit)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table, one job (union of global aggregates)."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def table_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, type, column count and list, row count per table, plus a
    ``*`` totals row.  Column metadata comes from the schemas; counts are one
    union of aggregates; the totals aggregate the per-table rows."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.lit("TABLE").alias("table_type"),
                    F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                    F.lit(",".join(df.columns)).alias("column_list"),
                    F.count(F.lit(1)).alias("row_count"))
             for name, df in tables.items()]
    per_table = reduce(DataFrame.unionByName, parts)
    total = per_table.agg(F.lit("*").alias("table_name"), F.lit("TOTAL").alias("table_type"),
                          F.sum("n_columns").cast("bigint").alias("n_columns"), F.lit("").alias("column_list"),
                          F.sum("row_count").cast("bigint").alias("row_count"))
    return per_table.unionByName(total)


def assert_unique_keys(source: DataFrame, keys: Sequence[str]) -> None:
    """Raise when a key occurs twice in ``source`` (as MERGE does)."""
    dup = source.groupBy(*keys).count().where(F.col("count") > 1)
    if not dup.isEmpty():
        raise ValueError(f"source holds duplicate keys on {list(keys)}")


def upsert_by_key(target: DataFrame, source: DataFrame, keys: Sequence[str], check: bool = True) -> DataFrame:
    """MERGE semantics – matched keys take the source row (all non-key
    columns updated), unmatched source rows are inserted, unmatched target rows
    are kept.  Columns are aligned by name."""
    if check:
        assert_unique_keys(source, keys)
    kept = target.join(source.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(source.select(*target.columns))


def replace_by_key(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete every target row of the keys present in ``source``, then
    insert the source rows (a key with fewer new rows shrinks)."""
    kept = target.join(source.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(source.select(*target.columns))


def upsert_into(table: HashTable, source: DataFrame) -> list[int]:
    """A8 on a stored table: the partitions rewritten.  Raises on duplicate source keys before anything is written."""
    assert_unique_keys(source, table.keys)
    return table.change(source, lambda old, new: upsert_by_key(old, new, table.keys, check=False))


def replace_into(table: HashTable, source: DataFrame) -> list[int]:
    """A9 on a stored table: the partitions rewritten."""
    return table.change(source, lambda old, new: replace_by_key(old, new, table.keys))


def materialize(df: DataFrame, path: str | None = None, name: str = "gold") -> DataFrame:
    """A10 (create-or-replace from a query): write to a new location under the
    shared folder and return the table re-read from it.  The new location is
    what an upsert/replace "swaps" in, so readers of the old one are never
    disturbed; a catalog table is repointed with ``point_table``."""
    path = path or scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:6]}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def point_table(spark: SparkSession, table: str, path: str) -> None:
    """Make ``path`` the current location of a catalog table (the swap step)."""
    spark.sql(f"ALTER TABLE {_ident(table)} SET LOCATION {_sql_text(path)}")
    spark.catalog.refreshTable(table)
