"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerlens.llm.common import save


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> node, component (the smallest node it reaches).

    Each round joins every node's neighbours to the smallest of them (large
    star), then does the same among smaller neighbours only (small star).  A
    round writes its links to the shared folder; links never leave Spark.
    Self-links and nulls are ignored; nodes without links are not listed.
    """
    e = save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    before = None
    while True:
        n, mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if not n or (n, mark) == before:
            # Every link now leads from a node to its component's smallest node.
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                e.select("b", "b").toDF("node", "component").distinct())
        before = (n, mark)
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b > m").select("b", "m").unionAll(low.select("a", "m"))
        e = save(small.toDF("a", "b").distinct(), "links")
