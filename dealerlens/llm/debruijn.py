"""Substring dedup: 20-word windows as edges of a De Bruijn graph, repeated paths compacted and cut out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealerlens.llm.common import document_runs, mix64, power_of_two, save, texts, total_bytes, window_hashes, word_hashes

WINDOW = 20          # words of an edge: it joins the nodes of its first and last 19 words
ANCHOR = 5           # words of the anchors that choose an edge's bucket (a power-of-two count fits a window)
CHUNK = 800_000    # edges that a task gathers before it sends them on
BUCKET = 1_000_000   # edges per bucket, on average
BYTES_PER_WORD = 6   # only sets the number of buckets

PATHS = "doc long, start int, n int, src long, src_start int"


def edges_of(ids: list, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor, doc, start) of every edge of some documents, in order of doc_id and start.

    An edge's anchor is the smallest hash of the five-word runs inside it:
    equal edges have equal anchors, and neighbouring edges mostly share one.
    """
    order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=ids.__getitem__)
    words, counts = word_hashes([data[i] for i in order], lower=False)
    edge, n = window_hashes(words, counts, WINDOW)
    runs, m = window_hashes(words, counts, ANCHOR)
    if not len(edge):
        return edge, edge, np.zeros(0, np.int64), np.zeros(0, np.int32)
    low, step = runs, 1
    while step < WINDOW - ANCHOR + 1:  # smallest of 16 neighbours, by doubling
        low = np.concatenate([np.minimum(low[:-step], low[step:]), low[len(low) - step:]])
        step *= 2
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return edge, low[np.repeat(np.cumsum(m) - m, n) + start], np.repeat(np.array([ids[i] for i in order], np.int64), n), start.astype(np.int32)


def paths(doc: np.ndarray, start: np.ndarray, src: np.ndarray, src_start: np.ndarray) -> list[np.ndarray]:
    """Join repeated edges that follow each other in their document and at their source: doc, start, n, src, src_start."""
    order = np.lexsort((start, doc))
    doc, start, src, src_start = doc[order], start[order], src[order], src_start[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (src[1:] != src[:-1]) | (src_start[1:] != src_start[:-1] + 1)
    at = np.flatnonzero(head)
    return [doc[at], start[at], np.diff(at, append=len(doc)).astype(np.int32), src[at], src_start[at]]


def later_copies(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of edges that start earlier elsewhere, and the place of each one's first copy."""
    order = np.argsort(key, kind="stable")
    near = key[order]
    same = near[1:] == near[:-1]
    twice = np.zeros(len(near), bool)
    twice[1:] |= same
    twice[:-1] |= same
    pick = order[twice]
    if not len(pick):
        return pick, pick
    pick = pick[np.lexsort((start[pick], doc[pick], key[pick]))]
    first = np.r_[True, key[pick][1:] != key[pick][:-1]]
    source = pick[np.flatnonzero(first)[np.cumsum(first) - 1]]
    later = (doc[pick] != doc[source]) | (start[pick] != start[source])
    return pick[later], source[later]


def _send(edge: np.ndarray, anchor: np.ndarray, doc: np.ndarray, start: np.ndarray, bits: int) -> pa.RecordBatch:
    """A chunk's first copies by bucket (runs of neighbours share their coordinates), and its later copies as paths."""
    later, source = later_copies(edge, doc, start)
    found = paths(doc[later], start[later], doc[source], start[source])
    keep = np.ones(len(edge), bool)
    keep[later] = False
    edge, doc, start = edge[keep], doc[keep], start[keep]
    bucket = (mix64(anchor[keep]) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(edge), np.int32)
    order = np.argsort(bucket, kind="stable")
    edge, doc, start, bucket = edge[order], doc[order], start[order], bucket[order]
    rows = []
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cut, [*cut[1:], len(bucket)]):
        d, s = doc[a:b], start[a:b]
        at = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)])
        rows.append((int(bucket[a]), edge[a:b].tobytes(), d[at].tobytes(), s[at].tobytes(), np.diff(at, append=b - a).astype(np.int32).tobytes(), None))
    if len(found[0]):
        # Known already: they only travel with the same shuffle, spread evenly.
        spread = (mix64(found[0].astype(np.uint64)) % np.uint64(1 << bits)).astype(np.int32)
        order = np.argsort(spread, kind="stable")
        found = [x[order] for x in found]
        at = np.flatnonzero(np.diff(spread[order], prepend=-1))
        for i, part in zip(spread[order][at], zip(*(np.split(x, at[1:]) for x in found))):
            rows.append((int(i), None, part[0].tobytes(), part[1].tobytes(), part[2].tobytes(), part[3].tobytes() + part[4].tobytes()))
    types = [pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["bucket", "edges", "docs", "starts", "lengths", "sources"])


def repeated_paths(docs: DataFrame) -> DataFrame:
    """Edges that start earlier elsewhere, as paths inside buckets: doc, start, n, src, src_start.

    Every edge of every text takes part.  Copies inside a task's chunk are
    settled there, so a passage of very many documents reaches its bucket once
    per chunk.  Rows with a null doc_id take no part.
    """
    words = total_bytes(docs) / BYTES_PER_WORD
    bits = min(30, power_of_two(words / BUCKET).bit_length() - 1)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data, size = [], [], 0
        for i, d in document_runs(batches):
            ids += i
            data += d
            size += sum(map(len, d))
            if size >= CHUNK * BYTES_PER_WORD:
                yield from chunk(ids, data)
                ids, data, size = [], [], 0
        if ids:
            yield from chunk(ids, data)

    def chunk(ids: list, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [edges_of(i, d) for i, d in _pieces(ids, data)]
        if not parts:
            return
        edge, anchor, doc, start = (np.concatenate(x) for x in zip(*parts))
        if len(edge):
            yield _send(edge, anchor, doc, start, bits)

    def reduce(key, table):
        edge, doc, start, known = [], [], [], []
        for r in table.to_pylist():
            d, s, n = (np.frombuffer(r[c], t) for c, t in (("docs", np.int64), ("starts", np.int32), ("lengths", np.int32)))
            if r["edges"] is None:
                half = len(d) * 8
                known.append([d, s, n, np.frombuffer(r["sources"][:half], np.int64), np.frombuffer(r["sources"][half:], np.int32)])
                continue
            edge.append(np.frombuffer(r["edges"], np.uint64))
            doc.append(np.repeat(d, n))
            start.append(np.repeat(s - (np.cumsum(n) - n), n).astype(np.int32) + np.arange(len(edge[-1]), dtype=np.int32))
        if edge:
            edge, doc, start = np.concatenate(edge), np.concatenate(doc), np.concatenate(start)
            later, source = later_copies(edge, doc, start)
            known.append(paths(doc[later], start[later], doc[source], start[source]))
        types = (np.int64, np.int32, np.int32, np.int64, np.int32)
        return pa.table({n: pa.array(np.concatenate(x).astype(t)) for n, x, t in zip(("doc", "start", "n", "src", "src_start"), zip(*known), types)})

    sent = texts(docs).mapInArrow(post, "bucket int, edges binary, docs binary, starts binary, lengths binary, sources binary")
    return sent.groupBy("bucket").applyInArrow(reduce, PATHS)


def _pieces(ids: list, data: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of a few MB in order of doc_id: hashing a whole chunk at once would take several times the memory."""
    from dealerlens.llm.common import slices

    order = sorted((i for i in range(len(ids)) if ids[i] is not None), key=ids.__getitem__)
    return slices([ids[i] for i in order], [data[i] for i in order])


def compact(found: DataFrame) -> DataFrame:
    """Longest non-branching paths: a path whose end is another's start, in the document and at the source, is joined to it.

    Paths of one line (document, source, offset between them) form chains.  In
    order of start, a path that starts after all before it have ended is the
    head of a chain: one sort by line, no join.  Paths of rows that repeat a
    doc_id may overlap or repeat; they are one chain too.
    """
    line = ["doc", "src", "offset"]
    p = found.select("doc", "src", (F.col("src_start") - F.col("start")).alias("offset"), F.col("start").alias("at"), (F.col("start") + F.col("n")).alias("to"))
    along = Window.partitionBy(*line).orderBy("at", "to")
    reach = F.max("to").over(along.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumn("head", F.when(reach.isNull() | (F.col("at") > reach), 1).otherwise(0))
    p = p.withColumn("chain", F.sum("head").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = p.groupBy(*line, "chain").agg(F.min("at").alias("at"), F.max("to").alias("to"))
    return spans.select("doc", F.col("at").alias("start"), (F.col("to") - F.col("at")).alias("n"), "src", (F.col("at") + F.col("offset")).alias("src_start"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc, start, n (edges), src, src_start of every compacted repeated path."""
    return compact(save(repeated_paths(docs), "paths"))


def covered(n_words: int, spans: list) -> np.ndarray:
    """Which words of a text the spans' windows cover."""
    change = np.zeros(n_words + 1, np.int64)
    for s in spans or ():
        if s["start"] < n_words:
            change[s["start"]] += 1
            change[min(n_words, s["start"] + s["n"] + WINDOW - 1)] -= 1
    return np.cumsum(change[:-1]) > 0


def with_spans(docs: DataFrame) -> DataFrame:
    spans = repeated_spans(docs).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    return docs.join(spans, F.col("doc_id").cast("long") == F.col("_doc"), "left").drop("_doc")


def digest_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``.

    Null and empty texts have no words.  A null doc_id has no place in the
    order, so nothing is removed from it or because of it.  Rows that repeat a
    doc_id are one document: a window is no earlier copy of itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, digest = [], [], []
            for data, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = data.split()
                gone = covered(len(words), spans)
                kept = [w for w, x in zip(words, gone.tolist()) if not x] if spans else words
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = with_spans(texts(docs)).select("doc_id", "text", "_spans")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def remove_words(data: bytes, spans: list) -> bytes:
    """The text without the covered words: each kept word stays with the white space before it, the text's end with the last word."""
    words = [m.span() for m in _WORD.finditer(data)]
    if not words:
        return data
    gone = covered(len(words), spans).tolist()
    before = [0, *(b for _, b in words[:-1])]
    out = b"".join([data[p:b] for p, (_, b), x in zip(before, words, gone) if not x])
    return out + (b"" if gone[-1] else data[words[-1][1]:])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated words cut from the texts; untouched texts stay as they are."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            text = [t if not s or t is None else remove_words(t.encode(), s).decode() for t, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            columns = [*b.columns[:at], pa.array(text, b.schema.field(at).type), *b.columns[at + 1:-1]]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in b.schema][:-1])

    return with_spans(docs).mapInArrow(run, docs.schema)
