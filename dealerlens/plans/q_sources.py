"""Registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.types import IntegerType, StringType, StructField, StructType  # noqa: E402

from dealerlens.fixtures import RAW_TABLES  # noqa: E402
from dealerlens.operators import aggregates as agg  # noqa: E402
from dealerlens.plans.registry import register  # noqa: E402
from dealerlens.session import scratch_path  # noqa: E402
from dealerlens.sources import io  # noqa: E402
from dealerlens.sources.state import HashTable  # noqa: E402


@register("ingest_bronze", "SELECT * FROM orders")
def _ingest_bronze(fx):
    bronze = io.ingest_bronze(fx.spark, f"{fx.sf_dir}/orders.parquet", scratch_path(fx.spark, "bronze-orders"))
    return bronze.drop("_ingested_at")


@register("write_raw_zone", "SELECT * FROM events")
def _write_raw_zone(fx):
    return io.write_raw(fx.events, scratch_path(fx.spark, "raw-events"))


_REGION_SCHEMA = StructType([StructField("r_regionkey", IntegerType(), False), StructField("r_name", StringType(), False)])
_NATION_SCHEMA = StructType([StructField("n_nationkey", IntegerType(), False), StructField("n_name", StringType(), False),
                             StructField("n_regionkey", IntegerType(), False)])


@register("inline_dimension", """
SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _inline_dimension(fx):
    r = io.read_with_schema(fx.spark, f"{fx.sf_dir}/region.parquet", _REGION_SCHEMA)
    n = io.read_with_schema(fx.spark, f"{fx.sf_dir}/nation.parquet", _NATION_SCHEMA)
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "n_regionkey", "r_name")


@register("write_documented_table", "SELECT * FROM customers")
def _write_documented_table(fx):
    import uuid

    name = f"customers_{uuid.uuid4().hex[:10]}"
    return io.write_documented_table(fx.customers, name, "Customer master (silver)",
                                     {"customer_id": "customer key", "opp_id": "opportunity key (not the customer key)"})


@register("preview_table", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def _preview_table(fx):
    return io.preview_table(fx.orders, "o_orderkey", 10)


def _raw_tables(fx):
    return {t: fx.raw(t) for t in RAW_TABLES}


@register("table_counts", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in RAW_TABLES))
def _table_counts(fx):
    return io.table_counts(_raw_tables(fx))


def _catalog_sql() -> str:
    # The column lists of the driver's tables (their schemas).
    cols = {
        "region": "r_regionkey,r_name",
        "nation": "n_nationkey,n_name,n_regionkey",
        "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
        "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
        "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
        "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
        "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,"
                    "l_returnflag,l_linestatus,l_shipdate",
        "events": "event_id,ts,user_id,event_type,value,props",
        "documents": "doc_id,text,lang,source,n_chars",
        "embeddings": "vec_id,embedding,label",
        "pages": "page_id,url,html",
        "benchmark": "item_id,text",
        "labels": "doc_id,quality,toxic",
        "conversations": "conv_id,turn,role,text",
    }
    per = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, 'TABLE' AS table_type, CAST({len(cols[t].split(','))} AS BIGINT) AS n_columns, "
        f"'{cols[t]}' AS column_list, count(*) AS row_count FROM {t}" for t in RAW_TABLES)
    return (f"WITH p AS ({per})\nSELECT * FROM p UNION ALL SELECT '*', 'TOTAL', CAST(sum(n_columns) AS BIGINT), '', "
            f"CAST(sum(row_count) AS BIGINT) FROM p")


@register("table_catalog", _catalog_sql())
def _table_catalog(fx):
    return io.table_catalog(_raw_tables(fx))


_UPSERT_SRC = "contact_name = upper(contact_name) || ' (upd)'"


@register("upsert_by_key", """
SELECT * FROM customers WHERE customer_id % 3 <> 0 AND customer_id % 2 <> 0
UNION ALL
SELECT customer_id, opp_id, rep_key, upper(contact_name) || ' (upd)' AS contact_name, occupation, persona, budget_min, budget_max
FROM customers WHERE customer_id % 2 = 0""")
def _upsert_by_key(fx):
    c = fx.customers
    table = HashTable(fx.spark, scratch_path(fx.spark, "customers"), ["customer_id"]).create(c.where(F.col("customer_id") % 3 != 0))
    source = c.where(F.col("customer_id") % 2 == 0).withColumn(
        "contact_name", F.concat(F.upper("contact_name"), F.lit(" (upd)")))
    io.upsert_into(table, source)
    return table.read(c.schema)


@register("replace_by_key", """
SELECT * FROM recs WHERE customer_id % 5 <> 0
UNION ALL
SELECT customer_id, rnk, vehicle_key + 1 AS vehicle_key, match_score, 'replaced' AS talk_script FROM recs
WHERE customer_id % 5 = 0 AND rnk = 1""")
def _replace_by_key(fx):
    table = HashTable(fx.spark, scratch_path(fx.spark, "recs"), ["customer_id"]).create(fx.recs)
    source = (fx.recs.where((F.col("customer_id") % 5 == 0) & (F.col("rnk") == 1))
              .withColumn("vehicle_key", F.col("vehicle_key") + 1).withColumn("talk_script", F.lit("replaced")))
    io.replace_into(table, source.select(*fx.recs.columns))
    return table.read(fx.recs.schema)


@register("ctas_gold", """
SELECT s.sale_date AS activity_date, year(s.sale_date) AS yr, s.region, s.store_name,
       st.latitude AS store_lat, st.longitude AS store_lon, s.category AS vehicle_category,
       count(*) AS inquiries, CAST(floor(count(*) * 7 / 10) AS BIGINT) AS test_drives,
       CAST(floor(count(*) * 5 / 10) AS BIGINT) AS quotes_sent,
       CAST(sum(CASE WHEN s.outcome = 'won' THEN 1 ELSE 0 END) AS BIGINT) AS contracts,
       CAST(sum(CASE WHEN s.outcome = 'won' THEN CAST(s.sale_price AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS revenue
FROM sales s LEFT JOIN stores st ON s.store_name = st.store_name
GROUP BY 1, 2, 3, 4, 5, 6, 7""")
def _ctas_gold(fx):
    return io.materialize(agg.store_daily_activity(fx.sales, fx.stores), name="gd_store_daily_activity")
