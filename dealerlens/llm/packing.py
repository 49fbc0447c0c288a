"""Packing: minimum bin slack over the lengths of what documents leave after full sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealerlens.llm.common import power_of_two, save

SIZE = 1024  # tokens of a sequence; a power of two
END_ID = 0   # closes every document

# Fixed value: the pre-tokenizer pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def load(path: str):
    """The byte-level BPE of a ``tokenizers`` JSON file, run by tiktoken (same merges, several times as fast)."""
    import json

    import tiktoken

    from dealerlens.llm.bpe import byte_symbols

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {s: b for b, s in enumerate(byte_symbols())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), set(special)


def token_ids(text: str, path: str) -> np.ndarray:
    """ids of a whole text as the tokenizers library gives them, then the end id."""
    bpe, special = load(path)
    ids = bpe.encode(text, allowed_special=special, disallowed_special=()) if any(s in text for s in special) else bpe.encode_ordinary(text)
    return np.array([*ids, END_ID], "<u4")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def measure(docs: DataFrame, path: str) -> DataFrame:
    """Token counts and checksums: doc_id, n, rest (n modulo the sequence size), full_crcs, rest_crc, part_crcs.

    ``full_crcs`` has one checksum per full sequence, ``part_crcs`` those of the
    rest cut into powers of two, largest first.  Token ids stay in the task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, full, rest, parts = [], [], [], []
            for text in b.column(1).to_pylist():
                ids = token_ids(text, path)
                tail = len(ids) % SIZE
                n.append(len(ids))
                full.append([_crc(ids[i:i + SIZE]) for i in range(0, len(ids) - tail, SIZE)])
                at = len(ids) - tail
                rest.append(_crc(ids[at:]))
                cut = []
                for part in binary_parts(tail):
                    cut.append(_crc(ids[at:at + part]))
                    at += part
                parts.append(cut)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array([x % SIZE for x in n], pa.int32()), pa.array(full, pa.list_(pa.int64())),
                 pa.array(rest, pa.int64()), pa.array(parts, pa.list_(pa.int64()))],
                ["doc_id", "n", "rest", "full_crcs", "rest_crc", "part_crcs"])

    return rows.mapInArrow(run, "doc_id long, n long, rest int, full_crcs array<long>, rest_crc long, part_crcs array<long>")


def binary_parts(n: int) -> list[int]:
    """Powers of two that sum to n, largest first."""
    return [1 << i for i in reversed(range(n.bit_length())) if n >> i & 1]


def closest_filling(counts: list[int], room: int) -> dict[int, int]:
    """Multiset of the remaining lengths (``counts[length]``) whose sum is closest to ``room`` from below.

    Subset sums are the bits of one integer per length: bit s is set when the
    lengths so far can sum to s.  Going back through these integers gives how
    many of each length the best sum takes.
    """
    window = (1 << room + 1) - 1
    reach, trail = 1, []
    for length in range(min(room, len(counts) - 1), 0, -1):
        if not counts[length]:
            continue
        trail.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:  # at most ``left`` copies, by doubling
            step = min(step, left)
            reach |= (reach << step * length) & window
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    taken = {}
    for length, before in reversed(trail):
        c = 0
        while not before >> total & 1:
            total -= length
            c += 1
        if c:
            taken[length] = c
    return taken


class Plan:
    """Where the pieces of every length go, from the number of rests of each length alone.

    ``runs[length]``: (first rank, last rank + 1, first sequence, pieces per
    sequence, offset of the first): the rests of a length are numbered, and
    runs of these numbers share one filling.  Rests that no filling completes
    are cut into powers of two, which fill sequences without a gap; the last
    sequences then have a power of two of tokens, so nothing is padded.
    """

    def __init__(self, counts: list[int], first_sequence: int):
        left = list(counts)
        used = [0] * SIZE
        self.runs: list[list[tuple[int, int, int, int, int]]] = [[] for _ in range(SIZE)]
        sequence = first_sequence
        self.cut_from = [0] * SIZE
        for longest in range(SIZE - 1, 0, -1):
            while left[longest]:
                left[longest] -= 1
                filling = closest_filling(left, SIZE - longest)
                left[longest] += 1
                filling[longest] = filling.get(longest, 0) + 1
                if sum(k * c for k, c in filling.items()) < SIZE:
                    break  # the closest filling leaves a gap: this length is cut
                times = min(left[k] // c for k, c in filling.items())
                offset = 0
                for k in sorted(filling, reverse=True):
                    c = filling[k]
                    self.runs[k].append((used[k], used[k] + times * c, sequence, c, offset))
                    used[k] += times * c
                    left[k] -= times * c
                    offset += k * c
                sequence += times
            self.cut_from[longest] = used[longest]
            cut, left[longest] = left[longest], 0
            used[longest] = counts[longest] if cut else used[longest]
            self.runs[longest].sort()
        cuts = [counts[k] - self.cut_from[k] for k in range(SIZE)]
        # Parts of one power are numbered by length, then rank; larger powers lie before smaller ones.
        self.part_base = [[0] * SIZE for _ in range(SIZE.bit_length())]
        self.part_start = [0] * SIZE.bit_length()
        place = 0
        for bit in reversed(range(SIZE.bit_length() - 1)):
            self.part_start[bit] = place
            n = 0
            for k in range(1, SIZE):
                self.part_base[bit][k] = n
                n += cuts[k] if k >> bit & 1 else 0
            place += n << bit
        self.part_sequence = sequence
        self.ends = []  # the last sequences: (first place, sequence)
        whole, tail = place // SIZE * SIZE, place % SIZE
        at = whole
        for i, part in enumerate(binary_parts(tail)):
            self.ends.append((at, part, sequence + whole // SIZE + i))
            at += part
        self.whole = whole

    def rest(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(tokens, sequence, offset) of the rest of this rank, in the document's order."""
        if rank < self.cut_from[length]:
            runs = self.runs[length]
            lo, hi = 0, len(runs)
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if runs[mid][0] <= rank else (lo, mid)
            start, _, sequence, c, offset = runs[lo]
            return [(length, sequence + (rank - start) // c, offset + (rank - start) % c * length)]
        out = []
        for part in binary_parts(length):
            bit = part.bit_length() - 1
            place = self.part_start[bit] + (self.part_base[bit][length] + rank - self.cut_from[length] << bit)
            if place < self.whole:
                out.append((part, self.part_sequence + place // SIZE, place % SIZE))
            else:
                at, _, sequence = next(e for e in reversed(self.ends) if e[0] <= place)
                out.append((part, sequence, place - at))
        return out


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` is a document (a null text is empty and has the end
    id only; repeated rows are separate documents).  Full sequences come
    first; the rests are placed by ``Plan``, which sees 1024 counts.  Rests of
    a length are numbered by hashed buckets, so that a length shared by many
    documents is numbered in many tasks.
    """
    known = save(measure(docs, path), "tokens")
    total = known.count()
    buckets = max(64, power_of_two(total / 20_000))
    known = known.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "n"), F.lit(buckets)).cast("int"))
    full = F.size("full_crcs")
    sums = save(known.groupBy("bucket", "rest").agg(F.count("*").alias("c"), F.sum(full).alias("f")), "lengths")
    counts, fulls = [0] * SIZE, [0] * SIZE
    for r in sums.groupBy("rest").agg(F.sum("c").alias("c"), F.sum("f").alias("f")).collect():  # 1024 rows at most
        counts[r.rest], fulls[r.rest] = r.c, r.f
    first_full = np.concatenate([[0], np.cumsum(fulls)]).tolist()
    plan = Plan([0, *counts[1:]], first_full[-1])
    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", "rest", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f0"))
    own = Window.partitionBy("bucket", "rest").orderBy("doc_id", "n", "rest_crc", "full_crcs", "part_crcs")
    ranked = (known.withColumn("c1", F.row_number().over(own) - 1)
              .withColumn("f1", F.coalesce(F.sum(full).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .join(sums, ["bucket", "rest"])
              .select("doc_id", "n", "rest", (F.col("c0") + F.col("c1")).alias("rank"), (F.col("f0") + F.col("f1")).alias("full_rank"), "full_crcs", "rest_crc", "part_crcs"))
    sent = docs.sparkSession.sparkContext.broadcast((plan, first_full))  # a few thousand runs at any input size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = sent.value
        for b in batches:
            rows = []
            for doc, n, rest, rank, full_rank, full_crcs, rest_crc, part_crcs in zip(*(c.to_pylist() for c in b.columns)):
                first = base[rest] + full_rank
                for i, crc in enumerate(full_crcs):
                    rows.append((doc, i * SIZE, SIZE, crc, n, first + i, 0))
                if rest:
                    pieces = where.rest(rest, rank)
                    start = n - rest
                    for (length, sequence, offset), crc in zip(pieces, [rest_crc] if len(pieces) == 1 else part_crcs):
                        rows.append((doc, start, length, crc, n, sequence, offset))
                        start += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
