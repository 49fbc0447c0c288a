"""F1 at any depth: pages of a totally ordered table without sorting what lies before them.

* :class:`PageIndex` – the table stored in ranges of its order, with the rows of
  each; a page starts in its own range.
* :func:`page_after` – the page behind the last row of the one before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dealerlens.operators.projection import check_limit

RANGE = "_range"


class PageIndex:
    """A stored copy of a frame in contiguous ranges of a total order, and the rows before each range.

    ``order`` is a list of (column, descending?).  Built once by a range
    sort; the ranges are read off the stored rows, so their number bounds all
    that the driver holds.
    """

    def __init__(self, spark: SparkSession, path: str, order: Sequence[tuple[str, bool]], schema: StructType, before: list[tuple[int, int, int]]):
        self.spark, self.path, self.order, self.schema, self.before = spark, path, list(order), schema, before

    @classmethod
    def build(cls, df: DataFrame, order: Sequence[tuple[str, bool]], path: str, ranges: int = 200) -> PageIndex:
        spark = df.sparkSession
        (df.repartitionByRange(ranges, *_columns(order)).withColumn(RANGE, F.spark_partition_id())
         .write.partitionBy(RANGE).parquet(path))
        stored = spark.read.schema(StructType([*df.schema.fields]).add(RANGE, "integer")).parquet(path)
        counts = stored.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).orderBy(RANGE).collect()  # bounded: one row a range
        before, at = [], 0
        for r in counts:
            before.append((r[RANGE], at, r.n))
            at += r.n
        return cls(spark, path, order, df.schema, before)

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.before)

    def ranges_of(self, limit: int, offset: int) -> list[tuple[int, int]]:
        """(range, rows before it) of the ranges that hold rows ``offset`` to ``offset + limit``."""
        return [(r, at) for r, at, n in self.before if at < offset + limit and at + n > offset]

    def page(self, limit: int, offset: int = 0, max_limit: int = 100) -> DataFrame:
        """A page with ``filtered_total`` beside it; reads the ranges it lies in and no other."""
        check_limit(limit, max_limit)
        held = self.ranges_of(limit, offset)
        stored = self.spark.read.schema(StructType([*self.schema.fields]).add(RANGE, "integer")).parquet(self.path)
        rows = stored.where(F.col(RANGE).isin([r for r, _ in held])).drop(RANGE)
        skip = offset - held[0][1] if held else 0
        return rows.orderBy(*_columns(self.order)).offset(skip).limit(limit).withColumn("filtered_total", F.lit(self.total).cast("bigint"))


def _columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]


def page_after(df: DataFrame, order: Sequence[tuple[str, bool]], limit: int, last: Mapping | None = None, max_limit: int = 100) -> DataFrame:
    """The page behind ``last`` (the ordered columns of the last row seen; None:
    the first page).  A filter on the order's columns and a distributed top-k,
    whatever the depth.  As in Spark's order, nulls come first ascending and
    last descending."""
    check_limit(limit, max_limit)
    if last is not None:
        steps, same = [], F.lit(True)
        for c, desc in order:
            v = last[c]
            if v is None:
                further = F.lit(False) if desc else F.col(c).isNotNull()
            else:
                further = (F.col(c) < F.lit(v)) | F.col(c).isNull() if desc else F.col(c) > F.lit(v)
            steps.append(same & further)
            same = same & F.col(c).eqNullSafe(F.lit(v))
        # The first column alone bounds the scan: the filter on it is pushed down.
        c, desc = order[0]
        if last[c] is not None and not desc:
            df = df.where(F.col(c) >= F.lit(last[c]))
        df = df.where(reduce(lambda a, b: a | b, steps))
    return df.orderBy(*_columns(order)).limit(limit)
