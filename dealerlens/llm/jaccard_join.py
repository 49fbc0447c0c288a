"""N-gram Jaccard join: grouped prefix join over sets of word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerlens.llm.common import (
    document_runs, mix64, possibly_in, power_of_two, read_coded, save, save_by_key, slices, sorted_coded, stream64, texts, total_bytes, window_hashes, word_hashes,
)
from dealerlens.llm.components import connected_components

SHINGLE = 5
PERCENT = 75            # link when 100 * intersection >= PERCENT * union
COMMON = 32             # a shingle of more documents is ordered after all rarer ones
MAX_COMMON = 1 << 20    # so many common shingles at most are told apart (8 MB in each task)
LONG = 64               # longer lists link neighbours first, and other pairs only across components
CHUNK = 800_000       # shingles that a task gathers before it sends them on
BUCKET = 1_000_000      # shingles per bucket, on average
CELLS = 256             # parts of the hash space whose counts bound an intersection
LOW = 16                # bits of a hash that bound an intersection
LOW_MOST = 3_600        # sets of more shingles are always compared whole
SURE = 60               # low bits decide a link where they err in less than one of 2^60 pairs
SKETCH = 32             # minima of a set that choose its nearest pairs
BLOCK = 2_000           # members of a long list that one task compares at a time
BYTES_PER_WORD = 6      # only sets the number of buckets


# --- shingle sets -------------------------------------------------------------

def shingle_sets(data: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; a text of fewer words has its whole sequence as one."""
    words, counts = word_hashes(data, lower=True)
    shingles, n = window_hashes(words, counts, SHINGLE)
    out, at, first = [], 0, 0
    keys = stream64(SHINGLE, 23)
    for words_here, here in zip(counts.tolist(), n.tolist()):
        if here:
            out.append(np.unique(shingles[at:at + here]))
        elif words_here:
            with np.errstate(over="ignore"):
                out.append(mix64(np.array([(words[first:first + words_here] * keys[:words_here]).sum() + np.uint64(words_here)])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += here
        first += words_here
    return out


def set_key(s: np.ndarray, seed: int) -> int:
    """A 64-bit key of a sorted array of hashes."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s + np.uint64(seed)).sum() + np.uint64(len(s))], np.uint64))[0].astype(np.int64))


def prefix_length(n: int) -> int:
    """Two sets that link share one of their first so many shingles, in any common order."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def index_length(n: int) -> int:
    """The smaller of two linked sets has a shared shingle among its first so many."""
    return n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1 if n else 0


# --- how many documents have a shingle -------------------------------------------

def common_shingles(docs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (first ``24 + bits`` bits of the hash) of shingles in more than ``COMMON`` documents, and their counts.

    Counts cover all documents; they only order shingles, so merged keys cost
    time, not results.  Past ``MAX_COMMON`` the rarer ones count as rare.
    """
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for _, data in document_runs(batches):
            for s in shingle_sets(data):
                waiting.append(s)
                size += len(s)
            if size >= CHUNK:
                yield _by_bucket(waiting, bits)
                waiting, size = [], 0
        if size:
            yield _by_bucket(waiting, bits)

    def count(key, table):
        low = np.sort(np.concatenate([read_coded(x) for x in table["keys"].to_pylist()]))
        edge = np.flatnonzero(np.diff(low, prepend=-1))
        n = np.diff(edge, append=len(low))
        keep = n > COMMON
        return pa.table({"key": low[edge[keep]] + (key[0].as_py() << 24), "n": n[keep]})

    counted = texts(docs).mapInArrow(post, "bucket int, keys binary").groupBy("bucket").applyInArrow(count, "key long, n long")
    counted = save(counted, "common")
    level = F.floor(F.log2("n")).cast("int")
    least, total = 0, 0
    for row in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):  # 64 rows at most
        total += row["count"]
        if total > MAX_COMMON:
            least = row.level + 1
            break
    found = counted.where(level >= least).toArrow()  # MAX_COMMON rows at most
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _by_bucket(sets: list[np.ndarray], bits: int) -> pa.RecordBatch:
    keys = np.sort(np.concatenate(sets) >> np.uint64(40 - bits)).astype(np.int64)
    bucket = keys >> 24
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[edge], pa.int32()), pa.array([sorted_coded(x & 0xFFFFFF) for x in np.split(keys, edge[1:])], pa.binary())], ["bucket", "keys"])


# --- groups and their prefixes ------------------------------------------------------

class Prefixes:
    """Puts a set in the common order: rare shingles by hash, then common ones by count."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bits: int):
        self.keys, self.n, self.shift = keys, n, np.uint64(40 - bits)

    def of(self, s: np.ndarray) -> np.ndarray:
        p = prefix_length(len(s))
        if not len(self.keys):
            return s[:p]
        short = (s >> self.shift).astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, short), len(self.keys) - 1)
        common = self.keys[at] == short
        rare = s[~common]
        if len(rare) >= p:
            return rare[:p]
        rest = s[common]
        return np.concatenate([rare, rest[np.lexsort((rest, self.n[at[common]]))][:p - len(rare)]])


def groups(docs: DataFrame, order) -> DataFrame:
    """doc_id, n, gid (identical prefix and size), sid (identical set) of every row."""
    def run(batches):
        prefixes = order.value
        for ids, data in document_runs(batches):
            sets = shingle_sets(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_gid(prefixes.of(s), len(s)) for s in sets], pa.int64()), pa.array([set_key(s, 31) for s in sets], pa.int64())],
                ["doc_id", "n", "gid", "sid"])

    return texts(docs).mapInArrow(run, "doc_id long, n long, gid long, sid long")


def _gid(prefix: np.ndarray, n: int) -> int:
    return set_key(np.concatenate([np.sort(prefix), np.array([n], np.uint64)]), 37)


def group_postings(docs: DataFrame, order, bits: int) -> DataFrame:
    """Prefix shingles by bucket: keys (40 + bits bits of the hash), and each one's group and size.

    A size is doubled, plus one where the shingle is among the first
    ``index_length``: the smaller member of a pair must meet the larger there.
    Documents of one group that a task meets together are posted once.
    """
    def run(batches):
        prefixes = order.value
        seen: dict[int, tuple[np.ndarray, int]] = {}
        size = 0
        for _, data in document_runs(batches):
            for s in shingle_sets(data):
                if len(s):
                    p = prefixes.of(s)
                    g = _gid(p, len(s))
                    if g not in seen:
                        seen[g] = p, len(s)
                        size += len(p)
            if size >= CHUNK:
                yield _postings(seen, bits)
                seen, size = {}, 0
        if seen:
            yield _postings(seen, bits)

    return texts(docs).mapInArrow(run, "bucket int, keys binary, gids binary, sizes binary")


def _postings(seen: dict[int, tuple[np.ndarray, int]], bits: int) -> pa.RecordBatch:
    lengths = [len(p) for p, _ in seen.values()]
    keys = (np.concatenate([p for p, _ in seen.values()]) >> np.uint64(24 - bits)).astype(np.int64)
    gids = np.repeat(np.array(list(seen), np.int64), lengths)
    sizes = np.concatenate([2 * n + (np.arange(len(p)) < index_length(n)) for p, n in seen.values()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, gids, sizes = keys[order], gids[order], sizes[order]
    bucket = keys >> 40
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    cut = [np.split(x, edge[1:]) for x in (keys & (1 << 40) - 1, gids, sizes)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[edge], pa.int32()), pa.array([sorted_coded(x) for x in cut[0]], pa.binary()),
         pa.array([x.tobytes() for x in cut[1]], pa.binary()), pa.array([x.tobytes() for x in cut[2]], pa.binary())],
        ["bucket", "keys", "gids", "sizes"])


# --- candidate pairs from lists ------------------------------------------------------

LIST_SCHEMA = "kind string, list long, a long, b long, n long"


def list_pairs(lists: np.ndarray, members: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """Candidates of many lists at once: rows ("pair", -, a, b, lists shared) and ("long", list, member, -, size).

    ``sizes`` are doubled, plus one where the member may be the smaller of a
    pair.  A list of up to ``LONG`` members gives all pairs whose sizes allow a
    link.  A longer one only links the members of a size class to the one of
    smallest id; its members come out too, for ``cross_pairs``.
    """
    order = np.lexsort((members, sizes, lists))
    lists, members, sizes = lists[order], members[order], sizes[order]
    keep = np.ones(len(lists), bool)
    keep[1:] = (lists[1:] != lists[:-1]) | (members[1:] != members[:-1])
    lists, members, sizes = lists[keep], members[keep], sizes[keep]
    start = np.flatnonzero(np.diff(lists, prepend=lists[:1] - 1)) if len(lists) else np.zeros(0, int)
    length = np.diff(start, append=len(lists))
    able = np.add.reduceat(sizes & 1, start) > 0 if len(lists) else np.zeros(0, bool)
    multi = np.repeat((length > 1) & able, length)
    long = np.repeat(length > LONG, length)
    lists, members, sizes, long = lists[multi], members[multi], sizes[multi], long[multi]
    n, first = sizes >> 1, (sizes & 1).astype(bool)
    at = np.arange(len(lists))
    a, b = [], []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        smaller = np.where(n[i] <= n[j], i, j)
        ok = (lists[i] == lists[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & (members[i] != members[j])
        ok &= first[smaller] & (first[i] & first[j] | (n[i] != n[j]))
        a.append(np.minimum(members[i], members[j])[ok])
        b.append(np.maximum(members[i], members[j])[ok])

    for step in range(1, min(LONG, len(lists))):
        i = at[:-step]
        same = lists[i] == lists[i + step]
        if not same.any():
            break
        i = i[same & ~long[i]]
        add(i, i + step)
    if long.any():
        i = np.flatnonzero(long)
        step = np.floor(np.log(np.maximum(n[i], 1)) / np.log(100 / PERCENT) + 1e-9).astype(np.int64)
        i = i[np.lexsort((members[i], step, lists[i]))]
        step = np.floor(np.log(np.maximum(n[i], 1)) / np.log(100 / PERCENT) + 1e-9).astype(np.int64)
        fresh = np.r_[True, (lists[i][1:] != lists[i][:-1]) | (step[1:] != step[:-1])]
        add(i[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]], i)
    a, b = np.concatenate(a or [members[:0]]), np.concatenate(b or [members[:0]])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    edge = np.flatnonzero((np.diff(a, prepend=0) != 0) | (np.diff(b, prepend=0) != 0) | (np.arange(len(a)) == 0))
    lists_shared = np.diff(edge, append=len(a))
    a, b = a[edge], b[edge]
    n_long = int(long.sum())
    pad = np.zeros(n_long, np.int64)
    return pa.table({"kind": pa.array(["pair"] * len(a) + ["long"] * n_long, pa.string()),
                     "list": pa.array(np.concatenate([np.zeros(len(a), np.int64), lists[long]])),
                     "a": pa.array(np.concatenate([a, members[long]])), "b": pa.array(np.concatenate([b, pad])),
                     "n": pa.array(np.concatenate([lists_shared, sizes[long]]))})


def _bucket_pairs(key, table):
    lists = np.concatenate([read_coded(x) for x in table["keys"].to_pylist()]) + (key[0].as_py() << 40)
    gids = np.concatenate([np.frombuffer(x, np.int64) for x in table["gids"].to_pylist()])
    sizes = np.concatenate([np.frombuffer(x, np.int64) for x in table["sizes"].to_pylist()])
    # Most shingles are in one list of one group: leave these first.
    order = np.argsort(lists, kind="stable")
    near = lists[order]
    twice = np.zeros(len(near), bool)
    same = near[1:] == near[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    pick = order[twice]
    return list_pairs(lists[pick], gids[pick], sizes[pick])


def cross_pairs(long: DataFrame, component: DataFrame, sets: DataFrame, homes: DataFrame, nearest: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b) of members of one long list that are not in one component yet, and
    the rows of ``long`` that a later round still needs (closed lists stay closed).

    ``nearest``: of each member's pairs in a block only two come out, the most
    alike by their sketches and the most alike in the smallest component; else
    all that the bound lets through.

    ``long``: list, sid, n (as in ``list_pairs``); ``component``: node,
    component; ``sets``: home, sid, cells, sketch; ``homes``: sid, home.  Before
    any pair is formed, lists inside one component go, and of lists with the same members (the shingles of one
    passage) one stays.  The sum of the smaller counts of each cell is an upper
    bound of the intersection; only pairs that it lets through come out.  Lists
    longer than ``BLOCK`` are compared in pairs of hashed blocks.
    """
    named = long.join(component.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mark = F.sum(F.xxhash64("sid", "n").cast("decimal(20,0)"))
    lists = named.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), mark.alias("mark"), F.count("*").alias("c"))
    lists = lists.where("lo <> hi").groupBy("mark", "c").agg(F.min("list").alias("list")).select("list", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts"))
    still = save(named.join(lists, "list"), "open")
    named = with_sets(still, sets, homes, {"sketch" if nearest else "cells": "marks"})
    named = named.withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    named = named.select("list", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "sid", "n", "component", "marks")

    def compare(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        part, sid, n, component = (table[c].to_numpy() for c in ("part", "sid", "n", "component"))
        size, first = n >> 1, (n & 1).astype(bool)
        marks = np.stack([np.frombuffer(x, np.uint32) for x in table["marks"].to_pylist()])
        right = np.flatnonzero(part == j)
        a, b = [], []
        for x in np.flatnonzero(part == i):
            y = right[(component[right] != component[x]) & (nearest | (sid[right] > sid[x]) | (i != j))]
            y = y[100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y])]
            y = y[np.where(size[x] < size[y], first[x], np.where(size[x] > size[y], first[y], first[x] & first[y]))]
            if len(y) and nearest:
                same = (marks[x] == marks[y]).sum(axis=1)
                y, same = y[2 * same >= SKETCH], same[2 * same >= SKETCH]
                if len(y):
                    y = y[np.unique([np.argmax(same), np.lexsort((-same, component[y]))[0]])]
            elif len(y):
                most = np.minimum(marks[x], marks[y]).sum(axis=1, dtype=np.int64)
                y = y[100 * most >= PERCENT * (size[x] + size[y] - most)]
            if len(y):
                a.append(np.minimum(sid[x], sid[y]))
                b.append(np.maximum(sid[x], sid[y]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(a or none)), "b": pa.array(np.concatenate(b or none))})

    pairs = named.groupBy("list", "i", "j").applyInArrow(compare, "a long, b long").distinct()
    return pairs, still.select("list", "sid", "n")


# --- verification -----------------------------------------------------------------------

def verify(pairs: DataFrame, sets: DataFrame, homes: DataFrame, likely: bool) -> DataFrame:
    """The pairs (a, b) of set ids whose sets link.

    ``sets``: home, sid, n, counts, low (distinct lowest 16 bits, ascending),
    full (hashes); ``homes``: sid, home.  Pairs that are not ``likely`` to link
    first meet by their counts, an eighth of the low bits.  Low bits bound the intersection from above
    and, less their accidental matches, from below (``surely``), so most pairs
    end there; the others compare their whole sets.
    """
    if not likely:
        pairs = save(meet(pairs, sets, homes, "counts").select("a", "b"), "near")
    near = save(meet(pairs, sets, homes, "low"), "near")
    whole = meet(near.where("not sure").select("a", "b"), sets, homes, "full")
    return near.where("sure").select("a", "b").unionAll(whole.select("a", "b"))


def surely(shared: int, n: int, m: int) -> bool:
    """Whether sets of n and m hashes link, as ``shared`` equal low bits say by themselves.

    If they did not link, s < need hashes would be equal, and k = shared - s
    values would match by accident, of (n - s)(m - s) / 2^LOW expected.
    Chernoff bounds that; with k at least a sixteenth of the larger rest and
    at most ``LOW_MOST`` hashes the bound is largest at s = need - 1.  It is of the
    order of what 64-bit hashes err by anyway.
    """
    s = -(-PERCENT * (n + m) // (100 + PERCENT)) - 1
    k, rest = shared - s, max(n, m) - s
    if max(n, m) > LOW_MOST or k <= 0 or 16 * k < rest:
        return False
    return accident(k, (n - s) * (m - s) / (1 << LOW)) < -SURE


def accident(k: int, mean: float) -> float:
    """Log2 of Chernoff's bound of k or more accidents, of a mean below k."""
    return (k - mean + k * math.log(mean / k)) / math.log(2) if mean < k else 0.0


def meet(pairs: DataFrame, sets: DataFrame, homes: DataFrame, column: str) -> DataFrame:
    """The pairs that the sets' ``column`` lets through, and whether they link for sure: a, b, sure.

    Each set a is a centre: up to ``BLOCK`` of its partners b travel to it in
    one block, and a's own set once per block, ahead of them.  A task holds one
    centre and one batch of partners.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    blocks = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").alias("block"), F.col("b").alias("sid"))
    blocks = blocks.unionAll(blocks.select("a", "block", F.col("a").alias("sid")).distinct())
    rows = with_sets(save(blocks, "blocks"), sets, homes, {"n": "n", column: "marks"})
    rows = rows.select("a", "block", (F.col("sid") != F.col("a")).alias("partner"), "sid", "n", "marks")
    kind = np.uint64 if column == "full" else np.uint16

    def marks_of(x: pa.Scalar) -> np.ndarray:
        return unpacked(x.as_buffer()) if column == "counts" else np.frombuffer(x.as_buffer(), kind).copy()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, size = np.zeros(0, kind), 0
        for batch in batches:
            partner, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("partner", "n"))
            keep, sure = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            for i, marks in enumerate(batch.column("marks")):
                here = marks_of(marks)
                if not partner[i]:
                    centre, size = here, n[i]
                    continue
                if column == "counts":
                    most = most_shared(centre, here, size, n[i])
                else:
                    both = np.concatenate([centre, here])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    most = shared + min(size - len(centre), n[i] - len(here))
                    sure[i] = column == "full" or surely(shared, int(size), int(n[i]))
                keep[i] = 100 * most >= PERCENT * (size + n[i] - most)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("sid"), pa.array(sure)], ["a", "b", "sure"]).filter(pa.array(keep))

    return rows.repartition("a", "block").sortWithinPartitions("a", "block", "partner").mapInArrow(compare, "a long, b long, sure boolean")


def packed_counts(s: np.ndarray) -> bytes:
    """How many hashes each of len(s) or more cells (a power of two) has, 3 for three or more, in two bits."""
    cells = power_of_two(max(4, len(s)))
    n = np.minimum(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 3).reshape(-1, 4)
    return (n << np.arange(0, 8, 2)).sum(axis=1).astype(np.uint8).tobytes()


def unpacked(data) -> np.ndarray:
    return (np.frombuffer(data, np.uint8)[:, None] >> np.arange(0, 8, 2, dtype=np.uint8) & 3).ravel()


def most_shared(x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
    """An upper bound of the intersection of sets of n and m hashes, from their cells' counts.

    What one set has in a cell beyond the other's count is not shared.  A 3 is
    at least three of the one and without bound of the other; the longer counts
    are folded to the cells of the shorter.
    """
    cells = min(len(x), len(y))
    least, most = [], []
    for c in (x.reshape(-1, cells), y.reshape(-1, cells)):
        least.append(c.sum(axis=0, dtype=np.int64))
        most.append(np.where((c == 3).any(axis=0), np.iinfo(np.int64).max, least[-1]))
    return int(min(n - np.maximum(least[0] - most[1], 0).sum(), m - np.maximum(least[1] - most[0], 0).sum()))


def apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one component."""
    of = {c: component.select(F.col("node").alias(c), F.col("component").alias("c" + c)) for c in "ab"}
    named = pairs.join(of["a"], "a", "left").join(of["b"], "b", "left")
    return named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def nearest(pairs: DataFrame) -> DataFrame:
    """Each set's pair with the set that it shares the most lists with (ties: the smallest)."""
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    best = both.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _cells(s: np.ndarray) -> bytes:
    return np.bincount((s % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint32).tobytes()


def _sketch(s: np.ndarray) -> bytes:
    """The least hash (upper half) of each part of an ascending set; two sets agree in about their similarity's share of the parts."""
    part, at = np.unique((s % np.uint64(SKETCH)).astype(np.int64), return_index=True)
    out = np.zeros(SKETCH, np.uint32)
    out[part] = s[at] >> np.uint64(32)
    return out.tobytes()


def with_sets(rows: DataFrame, sets: DataFrame, homes: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` (sid, ...) with columns of their sets, under new names.

    The rows, narrow, learn the document of their set and travel to its bucket;
    the sets stay where they are.  Several sets of one document (rows that
    share a doc_id) are told apart there.
    """
    have = sets.select("home", F.col("sid").alias("of"), *(F.col(c).alias(name) for c, name in columns.items()))
    # Not an equality of two columns: that would be a key of the join, and the table is bucketed by one key.
    return rows.join(homes, "sid").join(have, "home").where(F.col("of").bitwiseXOR(F.col("sid")) == 0).drop("home", "of")


def sets_of(docs: DataFrame, homes: DataFrame) -> str:
    """The name of a table of home, sid, n, cells, sketch, counts, low, full of the sets in ``homes`` (sid, home), read from the texts again.

    A set's home is the document that it is read from.  The table is bucketed
    by home, as the texts arrive, so the texts of homes are shuffled once, the
    others (``possibly_in``) not at all, and the rounds of verification bring
    the narrow pairs to the sets.  Rows of one doc_id and
    text give one set.
    """
    def run(batches):
        last = None
        for batch in batches:
            keys = list(zip(batch.column("home").to_pylist(), batch.column("sid").to_pylist()))
            for keys, data in slices(keys, batch.column("text").to_pylist()):
                found = []
                for key, s in zip(keys, shingle_sets(data)):
                    if key != last and set_key(s, 31) == key[1]:
                        found.append((*key, s))
                        last = key
                if found:
                    home, sids, sets = zip(*found)
                    marks = [[f(s) for s in sets] for f in (_cells, _sketch, packed_counts, lambda s: np.unique(s.astype(np.uint16)).tobytes(), np.ndarray.tobytes)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(home, pa.int64()), pa.array(sids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                         *(pa.array(x, pa.binary()) for x in marks)], ["home", "sid", "n", "cells", "sketch", "counts", "low", "full"])

    buckets = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 100_000)  # the most that Spark allows
    found = possibly_in(texts(docs).withColumnRenamed("doc_id", "home"), "home", homes).join(homes, "home").select("home", "sid", "text")
    found = found.repartition(buckets, "home").sortWithinPartitions("home", "sid")
    return save_by_key(found.mapInArrow(run, "home long, sid long, n long, cells binary, sketch binary, counts binary, low binary, full binary"), "sets", "home", buckets)


# --- the join ---------------------------------------------------------------------------

def jaccard_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    Texts without words (null ones too) have no shingles and link with nothing.
    Rows that share a doc_id are compared text by text; a null doc_id links
    with nothing and keeps a null component.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    words = total_bytes(docs) / BYTES_PER_WORD
    bits = min(20, power_of_two(words / BUCKET).bit_length() - 1)
    order = spark.sparkContext.broadcast(Prefixes(*common_shingles(docs, bits), bits))
    rows = save(groups(docs, order), "groups")
    classes = save(rows.where("n > 0 and doc_id is not null").groupBy("gid", "sid", "n").agg(F.min("doc_id").alias("doc_id")), "classes")
    found = save(group_postings(docs, order, bits).groupBy("bucket").applyInArrow(_bucket_pairs, LIST_SCHEMA), "pairs")

    # Expand groups to their classes; the classes of one group link to its smallest, and are a list of their own.
    inside = classes.groupBy("gid").agg(F.count("*").alias("c"), F.min("sid").alias("a")).where("c > 1").select("gid", "a")
    inside = save(classes.join(inside, "gid").select("gid", "a", "sid", "n"), "inside")
    one, two = classes.select(F.col("gid").alias("a"), F.col("sid").alias("sa")), classes.select(F.col("gid").alias("b"), F.col("sid").alias("sb"))
    across = found.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("n")).join(one, "a").join(two, "b")
    across = across.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"), "n")
    pairs = across.unionAll(inside.select("a", F.col("sid").alias("b"), "n")).where("a <> b")
    pairs = save(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")), "candidates")
    long = found.where("kind = 'long'").select("list", F.col("a").alias("gid"), "n").join(classes.select("gid", "sid"), "gid").select("list", "sid", "n")
    long = long.unionAll(inside.select(F.col("gid").alias("list"), "sid", 2 * F.col("n") + 1))

    wanted = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select("b")).unionAll(long.select("sid")).distinct()
    homes = save(classes.groupBy("sid").agg(F.min("doc_id").alias("home")).join(wanted, "sid"), "homes")
    table = sets_of(docs, homes)
    sets = spark.table(table)
    # Nearest pairs first: near copies come together by about one pair each, and
    # only what is still apart is compared further.
    first = save(nearest(pairs), "first")
    component = connected_components(save(verify(first, sets, homes, likely=True), "links"))
    rest = save(apart(pairs.join(first, ["a", "b"], "left_anti"), component), "rest")
    component = connected_components(save(verify(rest, sets, homes, likely=False), "links").unionAll(component.select("node", "component")))
    if long.limit(1).count():
        for by_sketch in (True, False):
            more, long = cross_pairs(long, component, sets, homes, by_sketch)
            more = save(more, "cross")
            if more.limit(1).count():
                more = save(verify(more, sets, homes, likely=by_sketch), "links")
                component = connected_components(more.unionAll(component.select("node", "component")))
    spark.sql(f"DROP TABLE {table}")  # its name only; every round's links are saved
    named = classes.join(component.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_set = named.join(least, "component").groupBy("sid").agg(F.min("least").alias("least"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    return out.join(of_set, "sid", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group (null ids stay)."""
    found = jaccard_groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").unionAll(docs.where("doc_id is null")).select(docs.columns)
