"""State that streams keep in Parquet below the shared folder.

* :class:`RunLog` – mergeable state.  A batch appends the state of its own rows
  as one run; every ``fan`` runs are merged into one, and so on by powers of
  ``fan``.  A batch therefore costs what it holds (plus its share of the
  merges), never what came before, and a reader adds up at most
  ``fan - 1`` runs a level.
* :class:`HashTable` – rows by key in hash partitions.  A change reads and
  rewrites only the partitions of the keys it touches.

Both are idempotent per batch: a batch that is run again writes the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _folder(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def last_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last batch that a stream's checkpoint folder records as done; -1 before the first."""
    fs, p = _folder(spark, f"{checkpoint}/commits")
    if not fs.exists(p):
        return -1
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max((int(n) for n in names if n.isdigit()), default=-1)


class RunLog:
    """Runs of mergeable state: ``merge`` turns the rows of several runs into those of one."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fan: int = 8):
        self.spark, self.path, self.merge, self.fan = spark, path, merge, fan

    def _run(self, first: int, last: int) -> str:
        return f"{self.path}/{first}-{last}"

    def runs(self, last: int) -> list[tuple[int, int]]:
        """The runs that together hold batches 0 to ``last``: the widest merged ones, then narrower."""
        out, at, width = [], 0, 1
        while width * self.fan <= last + 1:
            width *= self.fan
        while width:
            while at + width <= last + 1:
                out.append((at, at + width - 1))
                at += width
            width //= self.fan
        return out

    def _merges(self, batch: int) -> list[list[tuple[int, int]]]:
        """The merges due after a batch, narrowest first, each as the runs it takes."""
        out, width = [], 1
        while batch >= 0 and (batch + 1) % (width * self.fan) == 0:
            first = batch + 1 - width * self.fan
            out.append([(a, a + width - 1) for a in range(first, batch + 1, width)])
            width *= self.fan
        return out

    def add(self, batch: int, state: DataFrame) -> None:
        """Write a batch's state and the merges that fall due.  Runs merged by
        the batch before go now: that batch can no longer be run again."""
        for taken in self._merges(batch - 1):
            for run in taken:
                remove(self.spark, self._run(*run))
        state.write.mode("overwrite").parquet(self._run(batch, batch))
        for taken in self._merges(batch):
            self.merge(self._rows(taken, state.schema)).write.mode("overwrite").parquet(self._run(taken[0][0], batch))

    def _rows(self, runs: list[tuple[int, int]], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self._run(*r) for r in runs])

    def read(self, last: int, schema: StructType) -> DataFrame:
        """The merged state of batches 0 to ``last``."""
        if last < 0:
            return self.spark.createDataFrame([], schema)
        return self.merge(self._rows(self.runs(last), schema))


PART = "_part"


class HashTable:
    """A Parquet table partitioned by a hash of its keys; changes rewrite the partitions they touch.

    A rewrite is Spark's dynamic partition overwrite: new files are staged,
    then put in place of the partition's old ones, which are removed.  Readers
    that need one state of all partitions at once must not read in between.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], parts: int = 64):
        self.spark, self.path, self.keys, self.parts = spark, path, list(keys), parts

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def create(self, rows: DataFrame) -> HashTable:
        self._write(rows)
        return self

    def _write(self, rows: DataFrame) -> None:
        (rows.withColumn(PART, self.part_of()).repartition(PART).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path))

    def read(self, schema: StructType) -> DataFrame:
        """All rows; a table without a row so far is empty."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(StructType([*schema.fields]).add(PART, "integer")).parquet(self.path).drop(PART)

    def touched(self, source: DataFrame) -> list[int]:
        """Numbers of the partitions of the source's keys (at most ``parts`` of them)."""
        return sorted(r[0] for r in source.select(self.part_of().alias(PART)).distinct().collect())  # bounded: partitions

    def rows_of(self, parts: list[int], schema: StructType) -> DataFrame:
        """The rows of some partitions: a filter on the partition column, so other folders are not read."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        t = self.spark.read.schema(StructType([*schema.fields]).add(PART, "integer")).parquet(self.path)
        return t.where(F.col(PART).isin(parts)).drop(PART)

    def change(self, source: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], schema: StructType | None = None) -> list[int]:
        """Replace the touched partitions' rows by ``combine(rows, source)``; the
        partitions rewritten.  A partition left without rows is removed."""
        parts = self.touched(source)
        if not parts:
            return []
        schema = schema or source.schema
        out = combine(self.rows_of(parts, schema), source).select(*schema.fieldNames())
        left = out.select(self.part_of().alias(PART)).distinct()
        gone = set(parts) - {r[0] for r in left.collect()}  # bounded: partitions
        self._write(out)
        for p in gone:
            remove(self.spark, f"{self.path}/{PART}={p}")
        return parts
