"""Embedding near-duplicates: vectors described by their nearest reference points, in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerlens.llm.common import power_of_two, save
from dealerlens.llm.components import connected_components

NEAREST = 8         # pivots that describe a vector
SHARED = 2          # pivots that a candidate pair has in common
MAX_PIVOTS = 1024   # the pivots are a bounded sample, at most 64 to 1024 vectors by table size
DRAWN = 4           # vectors drawn per pivot, for those that are too near to an earlier pivot
BLOCK = 1024        # vectors of a list that one task compares at a time


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, e (array<double>) of the vectors that can link."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    return x.where("""vec_id is not null and label is not null and e is not null
        and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(e, x -> x <> 0)""")


def _unit(flat: np.ndarray, n: int, size: int) -> np.ndarray:
    x = flat.reshape(n, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def apart(points: list[np.ndarray], n: int, cosine: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The first n points that are below the cosine to all kept before them: by length, their numbers and unit vectors.

    A large group of near copies would else supply many reference points, and
    which of these are a member's nearest would hang on its noise alone.
    """
    kept: dict[int, tuple[list[int], np.ndarray]] = {}
    taken = 0
    for v in points:
        x, size = _unit(v, 1, len(v))[0], len(v)
        at, held = kept.setdefault(size, ([], np.empty((n, size))))
        if (held[:len(at)] @ x < cosine).all():
            held[len(at)] = x
            at.append(taken)
            taken += 1
            if taken == n:
                break
    return {size: (np.array(at), held[:len(at)].copy()) for size, (at, held) in kept.items()}


def describe(classes: DataFrame, cosine: float, nearest: int = NEAREST) -> DataFrame:
    """Adds pivots: the numbers of each vector's nearest reference points, nearest first.

    The reference points are a sample of the vectors, first in a hash order,
    without those that link with an earlier one.  Vectors of a length that no
    reference point has get the list [-1].
    """
    count = classes.count()
    n = min(MAX_PIVOTS, max(64, power_of_two(count ** 0.5)))
    drawn = classes.select("e").orderBy(F.xxhash64("e", F.lit(17)), "e").limit(DRAWN * n).toArrow()
    tables = apart(drawn["e"].to_numpy(), n, cosine)
    sent = classes.sparkSession.sparkContext.broadcast(tables)
    columns = classes.columns
    at_e = columns.index("e")

    def run(batches):
        for b in batches:
            e = b.column(at_e)
            sizes = np.diff(e.offsets.to_numpy())
            out: list = [[-1]] * b.num_rows
            for s, (numbers, points) in sent.value.items():
                pick = np.flatnonzero(sizes == s)
                if len(pick):
                    x = _unit(e.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False), len(pick), s)
                    near = numbers[np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :nearest]]
                    for i, row in zip(pick, near.tolist()):
                        out[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*columns, "pivots"])

    return classes.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema) + ", pivots array<int>")


def _least_labels(link: np.ndarray, labels_a: np.ndarray, labels_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label that links inside the block lead to."""
    top = np.iinfo(np.int64).max
    while True:
        a = np.minimum(labels_a, np.where(link, labels_b[None, :], top).min(axis=1))
        b = np.minimum(labels_b, np.where(link, a[:, None], top).min(axis=0))
        if (a == labels_a).all() and (b == labels_b).all():
            return a, b
        labels_a, labels_b = a, b


def compare_lists(described: DataFrame, cosine: float, shared: int = SHARED) -> DataFrame:
    """Walk the inverted lists: (a, b, n) rows with links a-b and link counts.

    Each (label, pivot) list holds the vectors that name the pivot.  Two
    vectors are candidates when they share ``shared`` pivots (all they have, if
    fewer); the list of the smallest shared pivot compares them by exact cosine.  Lists longer than ``BLOCK`` are cut
    into hashed blocks that are compared pair by pair in separate tasks.  Per
    pair of blocks only each vector's number of links (weighted by copies) and
    one link toward the smallest vector it reaches come out.
    """
    posted = described.select("rep", "copies", "label", F.size("e").alias("size"), "e", "pivots", F.explode("pivots").alias("pivot"))
    lists = posted.groupBy("label", "size", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    posted = posted.join(lists, ["label", "size", "pivot"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    pairs = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("label", "size", "pivot", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "copies", "e", "pivots")

    def compare(key, table):
        size, pivot, i, j = (k.as_py() for k in key[1:])
        table = table.combine_chunks()
        part = table["part"].to_numpy()
        rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        x = _unit(table["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False), len(rep), size)
        names = table["pivots"].to_pylist()
        has = np.zeros((len(rep), max(max(p) for p in names) + 2), np.float32)
        for r, p in enumerate(names):
            has[r, np.array(p) + 1] = 1
        need = np.minimum(shared, has.sum(axis=1))
        a, b = np.flatnonzero(part == i), np.flatnonzero(part == j)
        in_common = has[a] @ has[b].T
        first = (has[a, :pivot + 1] @ has[b, :pivot + 1].T) == 0
        candidate = first & (in_common >= np.minimum(need[a][:, None], need[b][None, :]))
        if i == j:
            candidate &= rep[a][:, None] < rep[b][None, :]
        link = candidate & (x[a] @ x[b].T >= cosine)
        if not link.any():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        n = np.zeros(len(rep), np.int64)
        np.add.at(n, a, link @ copies[b])
        np.add.at(n, b, link.T @ copies[a])
        low = rep.copy()
        if i == j:
            low[a], _ = _least_labels(link | link.T, rep[a], rep[a])
        else:
            low[a], low[b] = _least_labels(link, rep[a], rep[b])
        keep = n > 0
        return pa.table({"a": rep[keep], "b": low[keep], "n": n[keep]})

    return pairs.groupBy("label", "size", "pivot", "i", "j").applyInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Only vectors of equal, non-null label link.  Equal vectors of a label are
    one class: copies link with each other and share the class's links, without
    being compared one by one.  Null, zero and non-finite vectors (and null
    labels) link with nothing; a null vec_id stays null and unlinked.
    """
    valid = valid_vectors(vectors)
    classes = save(valid.groupBy("label", "e").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    found = save(compare_lists(describe(classes, cosine), cosine), "found")
    component = connected_components(found.select("a", "b")).toDF("rep", "_component")
    linked = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("_n"))
    classes = classes.join(linked, "rep", "left").join(component, "rep", "left")
    classes = classes.select("label", "e", (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("_component", "rep").alias("component_id"))
    mine = valid.join(classes, ["label", "e"]).select("vec_id", "n_links", "component_id")
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    rest = rest.where("""not coalesce(vec_id is not null and label is not null and e is not null
        and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(e, x -> x <> 0), false)""")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.unionAll(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
