"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about this many bytes inside a task.
SLICE_BYTES = 1_000_000
#: Rows of an Arrow batch of texts: a batch is held whole by the JVM and by Python.
BATCH_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text binary): null text is empty, other columns are dropped."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))


def small_batches(spark: SparkSession) -> None:
    """Texts and sets can be long: hand Python fewer rows at a time than Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def crc32_mod(column: str, m: int) -> Column:
    """crc32 of the value as text, modulo ``m``; a null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % m


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table below spark.checkpoint.dir and read it again: the
    lineage ends there, and a lost executor costs no more than its open tasks."""
    from dealerlens.session import scratch_path

    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_by_key(df: DataFrame, name: str, key: str, buckets: int) -> str:
    """Write to a fresh table in buckets of ``key`` and return its name: a join on the key leaves it where it is.

    Spark keeps a table's buckets in its catalog, so its name there stays until
    it is dropped; the files lie below spark.checkpoint.dir.
    """
    from dealerlens.session import scratch_path

    path = scratch_path(df.sparkSession, f"llm-{name}")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return table


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; it sets the number of groups, never a result."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


_BITMAP = 32_768      # bits of one of Spark's bitmaps
_MOST_MAPS = 2_048    # 8 MB
_BITS_PER_KEY = 16


def possibly_in(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` (long) can be among the saved ``keys``' column of that name: all that are, and few others.

    Each key sets one bit of a row of bitmaps, which are broadcast, 8 MB at
    most, so a join with the keys need not shuffle the other rows.  Past some
    four million keys more of the others come along.
    """
    maps = min(_MOST_MAPS, power_of_two(keys.count() * _BITS_PER_KEY / _BITMAP))

    def placed(df: DataFrame) -> DataFrame:
        at = df.withColumn("_p", F.pmod(F.xxhash64(column), F.lit(maps * _BITMAP)))
        return at.withColumn("_map", F.floor(F.col("_p") / _BITMAP).cast("int")).withColumn("_p", (F.col("_p") % _BITMAP).cast("int"))

    # Dealt by bitmap first: else each task would send a part of every bitmap.
    bits = placed(keys.select(column)).select("_map", "_p").repartition("_map").groupBy("_map").agg(F.bitmap_construct_agg(F.col("_p").cast("long")).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_p") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return placed(rows).join(F.broadcast(bits), "_map").where(F.getbit(byte, F.col("_p") % 8) == 1).drop("_map", "_p", "_bits")


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def slices(ids: list, data: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Cut a batch of documents into runs of about ``limit`` bytes (one document at least)."""
    start, size = 0, 0
    for i, x in enumerate(data):
        if size and size + len(x) > limit:
            yield ids[start:i], data[start:i]
            start, size = i, 0
        size += len(x)
    if start < len(data):
        yield ids[start:], data[start:]


def document_runs(batches: Iterable, limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of (doc ids, UTF-8 texts) from Arrow batches of ``texts()``."""
    for b in batches:
        yield from slices(b.column(0).to_pylist(), b.column(1).to_pylist(), limit)


# --- hashing whole runs of documents with numpy -----------------------------

def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing step (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream64(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers derived from a seed."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1000003)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = stream64(256, 7)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.ones(1, dtype=np.uint64)


def _base_powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            step = np.full(n, _BASE, dtype=np.uint64)
            step[0] = 1
            _powers = np.multiply.accumulate(step)
    return _powers[:n]


def word_hashes(data: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a run of texts, and each text's word count.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``lower`` folds A-Z.  A word's hash is the
    polynomial of its bytes, from differences of one running sum per run.
    """
    raw = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.cumsum([len(x) + 1 for x in data])
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    with np.errstate(over="ignore"):
        power = _base_powers(int((ends - starts).max()) + 1)
        # Horner's rule from the left, all words at once, would take the longest
        # word's length in steps; blocks of a word's bytes are summed instead.
        place = np.arange(len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))[:len(raw) - starts[0]] \
            if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(starts, append=len(raw)))])
        place[space] = 0
        term = _BYTE[raw] * power[place]
        term[space] = 0
        hashes = np.add.reduceat(term, starts)
        return mix64(hashes + (ends - starts).astype(np.uint64)), counts


def window_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words inside one text, and each text's window count."""
    n = np.maximum(counts - k + 1, 0)
    m = len(words) - k + 1
    if m <= 0 or not n.any():
        return np.zeros(0, np.uint64), n
    keys = stream64(k, 11) | np.uint64(1)
    with np.errstate(over="ignore"):
        total = words[:m] * keys[0]
        for j in range(1, k):
            total += words[j:j + m] * keys[j]
    starts = np.cumsum(counts) - counts
    keep = np.zeros(len(words) + 1, np.int32)
    np.add.at(keep, starts[n > 0], 1)
    np.add.at(keep, (starts + n)[n > 0], -1)
    return mix64(total[np.cumsum(keep[:m]) > 0]), n


# --- sorted integers in two bytes each ----------------------------------------

_ESCAPE = 0xFFFF


def sorted_coded(x: np.ndarray) -> bytes:
    """Ascending non-negative integers as differences of 16, 32 or 64 bits, whichever is shortest."""
    d = np.diff(x, prepend=0)
    most = int(d.max(initial=0))
    if most < 1 << 16:
        return b"\2" + d.astype("<u2").tobytes()
    jumps = d // _ESCAPE
    if int(jumps.sum()) < len(d):  # rare large steps: written as runs of an escape
        out = np.full(len(d) + int(jumps.sum()), _ESCAPE, "<u2")
        out[np.cumsum(jumps + 1) - 1] = d % _ESCAPE
        return b"\1" + out.tobytes()
    return (b"\4" + d.astype("<u4").tobytes()) if most < 1 << 32 else b"\x08" + d.astype("<i8").tobytes()


def read_coded(data: bytes) -> np.ndarray:
    kind, body = data[0], memoryview(data)[1:]
    if kind == 1:
        d = np.frombuffer(body, "<u2")
        return np.cumsum(d, dtype=np.int64)[d != _ESCAPE]
    return np.cumsum(np.frombuffer(body, {2: "<u2", 4: "<u4", 8: "<i8"}[kind]), dtype=np.int64)
