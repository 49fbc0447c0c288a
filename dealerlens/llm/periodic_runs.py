"""Periodic runs: branching tandem repeats read off an enhanced suffix array, rotated and merged into runs.

For every LCP interval of depth d, each suffix i outside the largest child is
tested: if suffix i+d or i-d lies in the interval too, in another child, two
equal neighbours of d words meet there.  No tree is built; a suffix is tested
at most log2(n) times.  The arrays of many documents are built together in
numpy; words of different documents never compare equal.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dealerlens.llm.common import document_runs, texts

MIN_LENGTH = 24   # words of a run, at least
MIN_PERIODS = 3   # and so many times its period

Run = tuple[int, int, int]  # start, length, period


def prefix_ranks(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all substrings of 1, 2, 4, ... words, until all suffixes differ.

    The last word must be unique.  Equal substrings have equal ranks, and a
    rank is the number of smaller ones, so the last array is the inverse
    suffix array.  Each step sorts only the suffixes that still share a rank.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    size = np.diff(first, append=n)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(first, size)
    levels, step = [rank], 1
    open_ = order[np.repeat(size, size) > 1]
    while len(open_):
        rank = levels[-1]
        key = rank[open_].astype(np.int64) * n + rank[open_ + step]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        at = np.arange(len(open_))
        group = np.flatnonzero(np.r_[True, old[1:] != old[:-1]])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(first, append=len(open_))
        inside = at - np.repeat(group, np.diff(group, append=len(open_)))
        new = rank.copy()
        new[open_] = old + np.repeat(inside[first], size)
        levels.append(new)
        open_ = open_[np.repeat(size, size) > 1]
        step *= 2
    return levels


def adjacent_lcp(levels: list[np.ndarray], sa: np.ndarray) -> np.ndarray:
    """lcp[k]: words that suffixes sa[k-1] and sa[k] share; lcp[0] is 0."""
    lcp = np.zeros(len(sa), np.int32)
    k = 1 + np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b = sa[k - 1].astype(np.int64), sa[k].astype(np.int64)
    start = b.copy()
    for j in range(len(levels) - 1, -1, -1):
        step = (levels[j][a] == levels[j][b]).astype(np.int64) << j
        a += step
        b += step
    lcp[k] = b - start
    return lcp


def smaller_neighbours(lcp: np.ndarray, at: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """For places ``at``: the nearest places before and after with a smaller lcp (each within ``widest``)."""
    n = len(lcp)
    mins, j = [lcp], 0
    while (2 << j) <= widest and (2 << j) <= n:
        low = mins[-1]
        mins.append(np.minimum(low[:-(1 << j)], low[1 << j:]))
        j += 1
    value = lcp[at]
    after, before = at + 1, at.copy()  # before: all of [before, at) is known to be at least as large
    for j in range(len(mins) - 1, -1, -1):
        m = mins[j]
        # A step can be needed twice at the widest level.
        for _ in range(2 if j == len(mins) - 1 else 1):
            ok = (after < len(m)) & (m[np.minimum(after, len(m) - 1)] >= value)
            after = after + (ok.astype(np.int64) << j)
            p = before - (1 << j)
            ok = (p >= 0) & (m[np.clip(p, 0, len(m) - 1)] >= value)
            before = before - (ok.astype(np.int64) << j)
    return before - 1, after


def branching_squares(levels: list[np.ndarray], widest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all neighbouring equal word sequences that cannot be moved one word to the right."""
    isa = levels[-1]
    n = len(isa)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = adjacent_lcp(levels, sa)
    k = np.flatnonzero(lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(k):
        return none, none
    left, right = smaller_neighbours(lcp, k, widest)  # the interval of lcp[k] holds sa[left:right]
    by = np.lexsort((k, right, left))
    k, left, right = k[by], left[by], right[by]
    head = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]
    # Children: from the interval's left end or a split point to the next split point or the right end.
    last = np.r_[head[1:], True]
    begin = np.concatenate([left[head], k])
    end = np.concatenate([k[head], np.where(last, right, np.r_[k[1:], 0])])
    interval = np.concatenate([np.arange(head.sum()), np.cumsum(head) - 1])
    size = end - begin
    by = np.lexsort((begin, -size, interval))
    small = by[np.r_[False, interval[by][1:] == interval[by][:-1]]]  # all but the largest child of each interval
    depth, lo, hi = lcp[k[head]].astype(np.int64), left[head], right[head]
    found = []
    for part in np.array_split(small, 1 + int(size[small].sum()) // 2_000_000):
        w, child = size[part], np.repeat(part, size[part])
        place = np.repeat(begin[part], w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        i, d = sa[place], depth[interval[child]]
        for j, start in ((i + d, i), (i - d, i - d)):
            there = isa[np.clip(j, 0, n - 1)]
            ok = (j >= 0) & (j < n) & (there >= lo[interval[child]]) & (there < hi[interval[child]])
            ok &= (there < begin[child]) | (there >= end[child])
            found.append((start[ok], d[ok]))
    return np.concatenate([x for x, _ in found]), np.concatenate([d for _, d in found])


def find_runs(docs: list[list]) -> list[list[Run]]:
    """Each document's runs (start, length, smallest period), by start, then period."""
    out: list[list[Run]] = [[] for _ in docs]
    taken = [i for i, words in enumerate(docs) if len(words) >= MIN_LENGTH]  # a shorter text holds no run
    if not taken:
        return out
    ids, base, offsets = [], 0, []
    for i in taken:
        number: dict = {}
        offsets.append(len(ids))
        ids.extend([base + number.setdefault(w, len(number)) for w in docs[i]])
        base += len(number)
        ids.append(base)  # a word of its own ends each document
        base += 1
    levels = prefix_ranks(np.array(ids, np.int64))
    start, period = branching_squares(levels, max(len(docs[i]) for i in taken) + 1)
    end, a, b = start + 2 * period, start.copy(), start + period
    for j in range(len(levels) - 1, -1, -1):  # rotate to the left as far as it goes
        ok = a >= (1 << j)
        ok &= levels[j][np.maximum(a - (1 << j), 0)] == levels[j][np.maximum(b - (1 << j), 0)]
        step = ok.astype(np.int64) << j
        a -= step
        b -= step
    keep = (end - a) >= np.maximum(MIN_LENGTH, MIN_PERIODS * period)
    a, end, period = a[keep], end[keep], period[keep]
    by = np.lexsort((period, end, a))
    a, end, period = a[by], end[by], period[by]
    # Multiples of a period reach exactly as far: the smallest stands for them.
    one = np.r_[True, (a[1:] != a[:-1]) | (end[1:] != end[:-1])][:len(a)]
    where = np.searchsorted(offsets, a[one], "right") - 1
    for s, e, p, x in zip(a[one].tolist(), end[one].tolist(), period[one].tolist(), where.tolist()):
        out[taken[x]].append((s - offsets[x], e - s, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list, runs: list[Run]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, x in zip(words, (np.cumsum(gone[:-1]) > 0).tolist()) if not x]


def strongest(runs: list[Run]) -> Run | None:
    """The run that repeats most often (exactly compared); ties: smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def split_words(doc_id: int | None, text: bytes) -> list[bytes]:
    return text.split()  # white space of bytes is exactly 0x20 and 0x09-0x0D


def planted_words(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words of a text; in a tenth of the documents, chosen by crc32 of doc_id, the rest of the text repeats."""
    words = text.split()
    h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _mapped(docs: DataFrame, words_of: Callable, row: Callable, schema: str, types: list[pa.DataType]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in document_runs(batches):
            words = [words_of(i, d) for i, d in zip(ids, data)]
            rows = [(i, *row(w, r)) for i, w, r in zip(ids, words, find_runs(words))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return texts(docs).mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, words_of: Callable = split_words) -> DataFrame:
    """doc_id and its runs, an array of (start, length, period) by start, then period.

    One row per row of ``docs``, whole texts, no shuffle: a document is the
    largest thing a task holds.  Null and empty texts have no words and no
    runs.  Rows that repeat are answered one by one; a null doc_id stays null;
    other columns are dropped.
    """
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    return _mapped(docs, words_of, lambda w, runs: ([dict(zip(("start", "length", "period"), r)) for r in runs],),
                   "doc_id long, runs array<struct<start:long,length:long,period:long>>", [pa.int64(), pa.list_(item)])


def collapsed_texts(docs: DataFrame, words_of: Callable = split_words) -> DataFrame:
    """doc_id and the text without the repeats of its runs, words joined by one space."""
    return _mapped(docs, words_of, lambda w, runs: (b" ".join(collapse(w, runs)).decode(),), "doc_id long, text string", [pa.int64(), pa.string()])


def digest_runs(docs: DataFrame, words_of: Callable = split_words) -> DataFrame:
    """Per document: number of runs, the strongest one (nulls without), digests of all runs and of the collapsed text."""

    def row(words: list, runs: list[Run]) -> tuple:
        start, length, period = strongest(runs) or (None, None, None)
        milli = None if period is None else 1000 * length // period
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        return (len(runs), start, length, period, milli, hashlib.sha256(listed.encode()).hexdigest(),
                hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest())

    long, text = pa.int64(), pa.string()
    return _mapped(docs, words_of, row, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string",
                   [long, long, long, long, long, long, text, text])
