"""Exact top-k search: Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096  # queries sent to the tasks at a time
ROW_BLOCK = 4096    # rows whose lists are sorted together
FIRST_DEPTH = 8


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of every component.

    Rows with a null id, a null vector, or a null or non-finite component take
    no part.  An id that is repeated counts once, with its smallest vector.
    """
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    x = x.where("vec_id is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    return x.groupBy("vec_id").agg(F.min("e").alias("e")).select("vec_id", F.transform("e", lambda c: F.floor(c * 256)).alias("v"))


class Lists:
    """A block of rows as one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n = len(ids)
        order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, order, axis=0)
        rank = np.empty((rows.shape[1], n), np.int32)
        for d in range(rows.shape[1]):
            rank[d, order[:, d]] = np.arange(n, dtype=np.int32)
        self.from_low, self.from_high = rank, n - 1 - rank
        depths = [FIRST_DEPTH]
        while depths[-1] < n:
            depths.append(depths[-1] * 2)
        self.depths = np.minimum(depths, n)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest score that a row not met up to each depth can have, per query."""
        high, low = self.values[len(self.ids) - self.depths], self.values[self.depths - 1]
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """Go down all lists together, score the rows met, and stop once no other row can enter ``best``.

        ``best``: the k best (-score, vec_id) so far.  A row that is not met
        and ties with the kth score could have the smaller id, so the search
        goes on until the bound is below that score.
        """
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = np.full(len(self.ids), len(self.ids), np.int32)  # depth at which the lists first name a row
        if len(up):
            np.minimum(met, self.from_high[up].min(axis=0), out=met)
        if len(down):
            np.minimum(met, self.from_low[down].min(axis=0), out=met)
        if not len(up) and not len(down):
            met[:] = 0
        start = 0
        for depth, most in zip(self.depths, bound):
            fresh = np.flatnonzero((met >= start) & (met < depth))
            start = depth
            if len(fresh):
                score = self.rows[fresh] @ query
                if len(best) == k:
                    keep = score >= -best[-1][0]
                    fresh, score = fresh[keep], score[keep]
                ids = self.ids[fresh]
                keep = ids != own
                ids, score = ids[keep], score[keep]
                if len(ids) > k:
                    top = np.lexsort((ids, -score))[:k]
                    ids, score = ids[top], score[top]
                best = sorted(best + [(-int(s), int(i)) for s, i in zip(score, ids)])[:k]
            if len(best) == k and most < -best[-1][0]:
                break
        return best


def _exact(rows: np.ndarray, queries: np.ndarray) -> bool:
    """Whether all inner products fit a double's integers."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    return most < 2.0 ** 53


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product, ties to the smaller vec_id.

    ``rows`` and ``queries``: vec_id (unique), v array<long>.  A row is no
    candidate of the query of its own id; only vectors of equal length are
    compared.  Queries go out in blocks of about ``QUERY_BLOCK`` (a bounded
    broadcast); each task keeps a query's best rows over its row blocks, so
    later blocks stop earlier.  Empty inputs give no rows.
    """
    spark = rows.sparkSession
    blocks = -(-queries.count() // QUERY_BLOCK)
    found = None
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "v").collect()
        by_size: dict[int, tuple[list[int], list[list[int]]]] = {}
        for r in sorted(mine):
            ids, vs = by_size.setdefault(len(r.v), ([], []))
            ids.append(r.vec_id)
            vs.append(r.v)
        sent = spark.sparkContext.broadcast({n: (ids, np.array(vs, np.int64).reshape(len(ids), n)) for n, (ids, vs) in by_size.items()})
        part = rows.select("vec_id", "v").mapInArrow(_search_blocks(sent, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_blocks(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(i, ROW_BLOCK)
                ids, v = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                sizes = np.diff(v.offsets.to_numpy())
                for n, (query_ids, queries) in sent.value.items():
                    pick = np.flatnonzero(sizes == n)
                    if not len(pick):
                        continue
                    flat = v.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False).reshape(len(pick), n)
                    kind = np.float64 if _exact(flat, queries) else np.int64
                    lists, asked = Lists(ids[pick], flat.astype(kind)), queries.astype(kind)
                    for q, own, bound in zip(asked, query_ids, lists.bounds(asked)):
                        best[own] = lists.search(q, own, bound, best.get(own, []), k)
        rows = [(own, i, -s) for own, top in best.items() for s, i in top]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["query_id", "vec_id", "score"])

    return run
