"""Suffix-array dedup of 200-byte strings: Lyndon grouping, then each group's order by its next smaller suffixes.

Equal 200-byte windows hold the same smallest 24-byte string (their anchor) at
the same place, so they meet in one bucket.  Neighbouring windows of one anchor
travel together as a region of text.  A bucket's regions are cut into 16-byte
blocks counted from the anchor; the suffix array over these blocks, built by
linear grouping, orders all windows, and a window that repeats equals one of
its neighbours in that order, byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerlens.llm.common import mix64, power_of_two, save, small_batches, stream64, total_bytes

LENGTH = 200               # bytes of a window
GRAM = 24                  # bytes of the strings that anchors are chosen from
BLOCK = 16                 # bytes of a symbol of the suffix array
PIECE = 1 << 19            # bytes hashed at once; longer texts are cut, with overlap
CHUNK_BYTES = 6_000_000    # text a task gathers before it sends its regions on
BUCKET_BYTES = 3_000_000   # text per bucket, on average
HEAVY = 1 / 2000           # anchors with this share of all regions are split by further anchors
NO_ID = -(1 << 63)         # stands for a null doc_id in arrays

SPANS = "doc long, mark long, start long, n long"
#: A region's key (half of it: groups that meet by chance are told apart by their bytes), place, anchor's place, windows, seen twice.
COLUMNS = ("<u4", "<i8", "<i4", "<u4", "u1", "u1", "u1")
ROW_BYTES = sum(np.dtype(t).itemsize for t in COLUMNS)


# --- suffix order by linear grouping --------------------------------------------

def lyndon_groups(s: list[int]) -> tuple[list[list[int]], list[int], list[int]]:
    """Groups of suffixes with the same longest Lyndon prefix, in descending order; each suffix's previous smaller suffix and group.

    Groups start as equal symbols.  From the greatest down, a group is final
    when it is reached; the nearest unfinished suffix before each member is
    its previous smaller suffix, and those of them that gained equally many
    members move together to a new group just above the one they were in.
    """
    n = len(s)
    symbols = sorted(set(s))
    number = {c: g for g, c in enumerate(symbols)}
    group = [number[c] for c in s]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    done, previous, out = bytearray(n), [-1] * n, []

    def move(those: list[int], old: int) -> None:
        """Those members of a group leave it for a new one just above; a whole group stays."""
        if len(those) == size[old]:
            return
        size[old] -= len(those)
        new, up = len(members), above[old]
        members.append(those)
        size.append(len(those))
        above.append(up)
        below.append(old)
        above[old] = new
        if up >= 0:
            below[up] = new
        for j in those:
            group[j] = new

    g = len(symbols) - 1
    while g >= 0:
        now = members[g]
        if len(now) > size[g]:
            now = [i for i in now if group[i] == g]
        if len(now) == 1:
            i = now[0]
            done[i] = 1
            j = i - 1
            while j >= 0 and done[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0 and size[group[j]] > 1:
                move([j], group[j])
        elif now:
            now.sort()
            for i in now:
                done[i] = 1
            gained: dict[int, int] = {}
            for i in now:
                j = i - 1
                while j >= 0 and done[j]:
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    gained[j] = gained.get(j, 0) + 1
            parts: dict[tuple[int, int], list[int]] = {}
            for j, k in gained.items():
                parts.setdefault((k, group[j]), []).append(j)
            for k, old in sorted(parts, reverse=True) if len(parts) > 1 else parts:
                move(parts[k, old], old)
        if now:
            out.append(now)
        g = below[g]
    return out, previous, group


def suffix_order(s: list[int]) -> list[int]:
    """The suffix array of a list of integers.

    A group's suffixes differ only behind their Lyndon prefix, where their next
    smaller suffix begins: going through the suffixes in order, those that have
    the current one as next smaller are the next of their groups.
    """
    n = len(s)
    groups, previous, group = lyndon_groups(s)
    place, at = {}, n
    for members in groups:
        at -= len(members)
        place[group[members[0]]] = at
    order = [-1] * n
    p = n - 1
    while p >= 0:  # nothing smaller follows these
        g = group[p]
        order[place[g]] = p
        place[g] += 1
        p = previous[p]
    for k in range(n):
        i = order[k]
        stop, p = previous[i], i - 1
        while p != stop:
            g = group[p]
            order[place[g]] = p
            place[g] += 1
            p = previous[p]
    return order


# --- regions --------------------------------------------------------------------

_BYTE = stream64(256, 23)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 20) - 1  # a place inside a piece


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, PIECE + 2 * LENGTH), _powers(pow(_BASE, -1, 1 << 64), PIECE + 2 * LENGTH)


def _window_minimum(low: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[:len(low) - (width - step)], low[width - step:]) if width > step else low


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a piece: the place of its anchor (leftmost of the smallest), and the hashes of all 24-byte strings."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _UP[:n])])
        gram = mix64((total[GRAM:] - total[:-GRAM]) * _DOWN[:n - GRAM + 1])
    low = (gram & ~np.uint64(_MASK)) | np.arange(len(gram), dtype=np.uint64)
    return (_window_minimum(low, LENGTH - GRAM + 1) & np.uint64(_MASK)).astype(np.int64), gram


def pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of stretches that hold every window once."""
    for at in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        yield at, data[at:at + PIECE + LENGTH - 1]


def regions(batch: list[tuple[int, bytes]], heavy: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(index in the batch, first window, windows, anchor's hash, anchor's place in the region) of runs of windows with one anchor.

    Windows of a heavy anchor are told apart by three more minima over the
    same strings, under other orders: equal windows still agree.
    """
    windows = np.array([max(0, len(x) - LENGTH + 1) for _, x in batch])
    if not windows.any():
        return iter(())
    place, gram = anchors(b"\0".join(x for _, x in batch))
    bounds = np.cumsum([0, *(len(x) + 1 for _, x in batch)])
    key = gram[place]
    if len(heavy):
        at = np.isin(key, heavy)
        if at.any():
            for seed in (1, 2, 3):
                with np.errstate(over="ignore"):
                    other = _window_minimum(mix64(gram + np.uint64(seed * 1000003)), LENGTH - GRAM + 1)
                    key = np.where(at, mix64(key ^ other), key)
    cut = np.r_[True, (place[1:] != place[:-1]) | (key[1:] != key[:-1])]
    inside = np.zeros(len(place) + 1, np.int8)
    for b, w in zip(bounds[:-1].tolist(), windows.tolist()):
        if w:
            cut[b] = True
            if b + w < len(cut):
                cut[b + w] = True
            inside[b:b + w] = 1
    first = np.flatnonzero(cut)
    length = np.diff(first, append=len(place))
    keep = inside[first] > 0
    first, length = first[keep], length[keep]
    which = np.searchsorted(bounds, first, "right") - 1
    return zip(which.tolist(), (first - bounds[which]).tolist(), length.tolist(), key[first].tolist(), (place[first] - first).tolist())


def _batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple[tuple[int, int, int], bytes]]]:
    """Pieces with their (doc, mark, offset), gathered to about PIECE bytes."""
    out, size = [], 0
    for doc, mark, data in rows:
        for at, part in pieces(data):
            if size and size + len(part) > PIECE:
                yield out
                out, size = [], 0
            out.append(((doc, mark, at), part))
            size += len(part) + 1
    if out:
        yield out


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    for doc, mark, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
        yield NO_ID if doc is None else doc, mark, data


class _Chunk:
    """Distinct regions of some texts: bytes and anchor's place → where it was first seen, and whether it was seen again."""

    def __init__(self, bits: int):
        self.bits, self.seen, self.spans, self.size = bits, {}, [], 0

    def add(self, where: tuple[int, int, int], n: int, key: int, anchor: int, data: bytes) -> None:
        known = self.seen.get((data, anchor))
        if known is None:
            self.seen[data, anchor] = [key, where, n, False]
            self.size += len(data) + 200
        elif known[1] != where:
            if not known[3]:
                known[3] = True
                self.spans.append((*known[1], n))
            self.spans.append((*where, n))

    def send(self) -> Iterator[pa.RecordBatch]:
        """One row per bucket: compressed regions and their columns; spans that are settled travel along."""
        by: dict[int, list] = {}
        # Anchors are small hashes: mixed again they are spread evenly.
        mixed = mix64(np.array([x[0] for x in self.seen.values()], np.uint64) + np.uint64(1))
        buckets = (mixed >> np.uint64(64 - self.bits)).tolist() if self.bits else [0] * len(mixed)
        for b, part, ((data, anchor), (_, where, n, again)) in zip(buckets, (mixed & np.uint64(0xFFFFFFFF)).tolist(), self.seen.items()):
            by.setdefault(b, []).append((part, *where, anchor, n, again, data))
        rows = []
        for bucket, found in by.items():
            *columns, data = zip(*found)
            body = b"".join(data)
            packed = b"".join(np.array(c, np.dtype(t)).tobytes() for c, t in zip(columns, COLUMNS))
            rows.append((bucket, len(found), len(body), pa.compress(body, "zstd", asbytes=True), pa.compress(packed, "zstd", asbytes=True)))
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        for at in range(0, len(rows), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 500]), types)], ["bucket", "count", "size", "body", "columns"])
        if self.spans:
            spans = _runs(np.array(self.spans, np.int64))
            spread = int(mix64(spans[:1, 0].astype(np.uint64))[0] >> np.uint64(64 - self.bits)) if self.bits else 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(((spread,), (len(spans),), (-1,), (b"",), (spans.astype("<i8").tobytes(),)), types)],
                                             ["bucket", "count", "size", "body", "columns"])


def _runs(spans: np.ndarray) -> np.ndarray:
    """(doc, mark, start, n) rows, those that follow each other joined."""
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    head = np.ones(len(spans), bool)
    head[1:] = (spans[1:, :2] != spans[:-1, :2]).any(axis=1) | (spans[1:, 2] != spans[:-1, 2] + spans[:-1, 3])
    first = np.flatnonzero(head)
    last = np.r_[first[1:] - 1, len(spans) - 1]
    out = spans[first]
    out[:, 3] = spans[last, 2] + spans[last, 3] - out[:, 2]
    return out


# --- a bucket ---------------------------------------------------------------------

def repeated_windows(data: list[bytes], n: list[int], anchor: list[int], many: list[bool]) -> list[np.ndarray]:
    """Of regions that share anchors: which windows of each also start in another region (or in this one, where it is there twice).

    All windows are ordered by their bytes in front of the next block, then by
    the suffix array's order of that block.
    """
    blocks, lead, first = [], [], []
    body = bytearray()
    total = 0
    for d, a in zip(data, anchor):
        skip = a % BLOCK  # blocks are counted from the anchor
        lead.append(skip)
        first.append(total)
        count = -(-(len(d) - skip) // BLOCK)
        body += d[skip:] + bytes(BLOCK * count - (len(d) - skip))
        total += count
        blocks.append(count)
    _, rank = np.unique(np.frombuffer(bytes(body), f"S{BLOCK}"), return_inverse=True)
    blocks, lead, first = np.array(blocks), np.array(lead), np.array(first)
    # A lowest symbol ends each region.
    at = np.arange(total) + np.repeat(np.arange(len(data)), blocks)
    text = np.zeros(total + len(data), np.int64)
    text[at] = rank + 1
    order = np.array(suffix_order(text.tolist()), np.int64)
    suffix_rank = np.empty(len(order), np.int64)
    suffix_rank[order] = np.arange(len(order))

    n_ = np.array(n)
    which = np.repeat(np.arange(len(data)), n_)
    inside = np.arange(n_.sum()) - np.repeat(np.cumsum(n_) - n_, n_)
    partial = (lead[which] - inside) % BLOCK           # bytes in front of the next block
    block = (inside + partial - lead[which]) // BLOCK  # that block's number in its region
    position = suffix_rank[first[which] + which + block]
    whole = np.frombuffer(b"".join(data), np.uint8)
    size = np.array([len(d) for d in data])
    start = (np.cumsum(size) - size)[which] + inside
    head, more = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for j in range(BLOCK - 1):
        more = np.where(j < partial, (more << np.uint64(8)) | (head >> np.uint64(56)), more)
        head = np.where(j < partial, (head << np.uint64(8)) | whole[np.minimum(start + j, len(whole) - 1)], head)
    by = np.lexsort((position, head, more, partial))
    same = np.zeros(len(by), bool)  # equal to the one before, in order
    near = 1 + np.flatnonzero(np.all([x[by][1:] == x[by][:-1] for x in (partial, head, more)], axis=0))
    views = np.lib.stride_tricks.sliding_window_view(whole, LENGTH)
    for part in np.array_split(near, 1 + len(near) // 20_000):
        same[part] = (views[start[by[part]]] == views[start[by[part - 1]]]).all(axis=1)
    found = np.zeros(len(by), bool)
    found[by] = same | np.r_[same[1:], False]
    found |= np.array(many)[which]
    return np.split(found, np.cumsum(n_)[:-1])


def _decode(rows: list[dict], spans: list[np.ndarray]) -> dict[tuple[bytes, int], list]:
    """The bucket's distinct regions: [key, place of the first, windows, seen at two places]; places of the others go to ``spans``."""
    seen: dict[tuple[bytes, int], list] = {}
    again: list[tuple[int, int, int, int]] = []
    for r in rows:
        m, raw = r["count"], r["columns"]
        if r["size"] < 0:
            spans.append(np.frombuffer(raw, "<i8").reshape(m, 4))
            continue
        body = pa.decompress(r["body"], r["size"], "zstd", asbytes=True)
        packed, at, columns = pa.decompress(raw, m * ROW_BYTES, "zstd", asbytes=True), 0, []
        for t in map(np.dtype, COLUMNS):
            columns.append(np.frombuffer(packed, t, m, at).tolist())
            at += m * t.itemsize
        key, doc, mark, start, anchor, n, many = columns
        where = zip(doc, mark, start)
        at = 0
        for k, w, a, x, twice in zip(key, where, anchor, n, many):
            data = body[at:at + x + LENGTH - 1]
            at += x + LENGTH - 1
            known = seen.get((data, a))
            if known is None:
                seen[data, a] = [k, w, x, bool(twice)]
                continue
            if known[1] == w and not twice:
                continue  # the same place of a row that is there twice
            if not known[3]:
                known[3] = True
                again.append((*known[1], x))
            if not twice:  # places of one that its chunk had twice are known
                again.append((*w, x))
    if again:
        spans.append(np.array(again, np.int64))
    return seen


def _reduce_bucket(rows: list[dict]) -> np.ndarray:
    """Spans (doc, mark, start, n) of all windows of a bucket that start twice."""
    spans: list[np.ndarray] = []
    by: dict[int, list] = {}
    for (data, anchor), (key, where, n, many) in _decode(rows, spans).items():
        by.setdefault(key, []).append((data, n, anchor, many, where))
    open_ = [x for found in by.values() if len(found) > 1 and not all(f[3] for f in found) for x in found]
    if open_:
        data, n, anchor, many, where = (list(c) for c in zip(*open_))
        for found, w, twice in zip(repeated_windows(data, n, anchor, many), where, many):
            if not twice and found.any():  # regions seen twice are settled as a whole
                edge = np.flatnonzero(np.diff(np.r_[False, found, False].astype(np.int8)))
                a, b = edge[::2], edge[1::2]
                part = np.empty((len(a), 4), np.int64)
                part[:, 0], part[:, 1], part[:, 2], part[:, 3] = w[0], w[1], w[2] + a, b - a
                spans.append(part)
    return _runs(np.concatenate(spans)) if spans else np.zeros((0, 4), np.int64)


# --- Spark ------------------------------------------------------------------------

def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text binary): the mark tells rows apart that share a doc_id but not the text."""
    small_batches(docs.sparkSession)
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.hash("text").cast("long").alias("mark"), "text")


def heavy_anchors(rows: DataFrame, limit: float) -> list[int]:
    """Hashes of anchors that hold ``limit`` regions or more: with a limit in proportion to the text, few whatever the input.

    Each task reports what is heavy among its own regions, so an anchor of one
    hot source shows as well.  The list sets how regions are dealt out, never
    a result.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch in _batches(_rows(b)):
                place, gram = anchors(b"\0".join(x for _, x in batch))
                key, n = np.unique(gram[place[np.flatnonzero(np.r_[True, place[1:] != place[:-1]])]], return_counts=True)
                most = n >= max(4, n.sum() * HEAVY)
                yield pa.RecordBatch.from_arrays([pa.array(key[most].view(np.int64)), pa.array(n[most].astype(np.int64))], ["key", "n"])

    found = rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return [r.key for r in found.where(F.col("n") >= limit).collect()]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, mark, start, n: runs of windows that also start elsewhere, over whole texts.

    Null texts are empty, null doc_ids are -2^63.  Rows equal in doc_id and
    text are one document.  A task sends each distinct region of its chunk
    once, however many copies the chunk holds.
    """
    rows = marked(docs)
    size = total_bytes(docs)
    bits = min(30, power_of_two(size / BUCKET_BYTES).bit_length() - 1)
    # About two anchors in the windows of one: that many regions are expected.
    heavy = np.array(heavy_anchors(rows, max(64, HEAVY * 2 * size / (LENGTH - GRAM + 2))), np.int64).view(np.uint64)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(bits)
        for b in batches:
            for batch in _batches(_rows(b)):
                parts = [(w[2], x) for w, x in batch]
                for i, first, n, key, anchor in regions(parts, heavy):
                    doc, mark, at = batch[i][0]
                    chunk.add((doc, mark, at + first), n, key, anchor, batch[i][1][first:first + n + LENGTH - 1])
                if chunk.size >= CHUNK_BYTES * 5:
                    yield from chunk.send()
                    chunk = _Chunk(bits)
        yield from chunk.send()

    def reduce(key, table):
        found = _reduce_bucket(table.to_pylist())
        return pa.table({c: pa.array(found[:, i]) for i, c in enumerate(("doc", "mark", "start", "n"))})

    sent = rows.mapInArrow(post, "bucket int, count int, size long, body binary, columns binary")
    return sent.groupBy("bucket").applyInArrow(reduce, SPANS)


def with_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text binary, spans) for every row of ``docs``."""
    spans = save(repeated_spans(docs), "byte-spans").groupBy("doc", F.col("mark").alias("_mark")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    rows = marked(docs)
    return rows.join(spans, (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("doc")) & (F.col("mark") == F.col("_mark")), "left").select("doc_id", "mark", "text", "spans")


def removed_runs(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs (from, to) of the bytes that the windows cover."""
    out: list[tuple[int, int]] = []
    for s in sorted(spans or (), key=lambda s: s["start"]):
        a, b = s["start"], s["start"] + s["n"] - 1 + LENGTH
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(data)]))


def kept_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary: a cut may fall inside a character), runs removed (from, to), for every row of ``docs``."""
    def run(batches):
        for b in batches:
            runs = [removed_runs(s) for s in b.column(3).to_pylist()]
            kept = [cut(d, r) for d, r in zip(b.column(2).to_pylist(), runs)]
            listed = [[{"from": x, "to": y} for x, y in r] for r in runs]
            item = pa.struct([("from", pa.int64()), ("to", pa.int64())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(listed, pa.list_(item))], ["doc_id", "kept", "removed"])

    return with_spans(docs).mapInArrow(run, "doc_id long, kept binary, removed array<struct<from:long,to:long>>")


def digest_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``.

    Null and empty texts have no bytes.  A null doc_id is a document like any
    other; rows equal in doc_id and text are one document and are answered
    alike; other columns are dropped; an empty table has no rows.
    """
    def run(batches):
        for b in batches:
            n, removed, count, digest = [], [], [], []
            for data, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                runs = removed_runs(spans)
                n.append(len(data))
                removed.append(sum(y - x for x, y in runs))
                count.append(len(runs))
                digest.append(hashlib.sha256(cut(data, runs)).hexdigest())
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, long), pa.array(removed, long), pa.array(count, long), pa.array(digest, pa.string())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
