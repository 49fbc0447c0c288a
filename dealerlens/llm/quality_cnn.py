"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealerlens.llm.common import crc32_mod, document_runs, texts

CHUNK = 512        # bytes of a chunk
OVERLAP = 32       # bytes that neighbouring chunks share
WIDTH = 6          # bytes that a filter sees
FILTERS = 16
TRAIN_ROWS = 1500  # at most so many labelled documents of each class are fitted, whole
TRAIN_BYTES = 12_000_000  # and so many bytes of each class: rows up to there
BATCH = 12         # documents of a training step
BLOCK = 256        # chunks that are filtered at once
EPOCHS = 12


@dataclass(frozen=True)
class Network:
    """``table[k, byte]`` holds the filters' weights for a byte at place k."""

    table: np.ndarray   # (WIDTH, 256, FILTERS) float32
    bias: np.ndarray    # (FILTERS,)
    out: np.ndarray     # (FILTERS,)
    out_bias: float


def chunk_starts(n: int) -> np.ndarray:
    """Overlapping chunks that cover all n bytes (one chunk for an empty text)."""
    step = CHUNK - OVERLAP
    return np.arange(0, max(n - OVERLAP, 1), step)


def chunk_matrix(data: bytes, starts: np.ndarray) -> np.ndarray:
    raw = np.zeros(int(starts[-1]) + CHUNK, dtype=np.uint8)
    raw[:min(len(data), len(raw))] = np.frombuffer(data, np.uint8)[:len(raw)]
    return raw[starts[:, None] + np.arange(CHUNK)]


def _pool(net_table: np.ndarray, bias: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Max over the places of each chunk of relu(filters), and where the maximum is."""
    m = chunks.shape[1] - WIDTH + 1
    total = np.take(net_table[0], chunks[:, :m], axis=0)
    for k in range(1, WIDTH):
        total += np.take(net_table[k], chunks[:, k:k + m], axis=0)
    at = total.argmax(axis=1)
    top = np.take_along_axis(total, at[:, None, :], axis=1)[:, 0, :] + bias
    return np.maximum(top, 0), at


def document_logits(net: Network, chunks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One logit per document, the mean over its ``n`` chunks; each chunk's pooled filters and where they are."""
    parts = [_pool(net.table, net.bias, chunks[i:i + BLOCK]) for i in range(0, len(chunks), BLOCK)]
    h, at = (np.concatenate(x) for x in zip(*parts))
    return np.add.reduceat(h @ net.out, np.cumsum(n) - n) / n + net.out_bias, h, at


def gradients(net: Network, chunks: np.ndarray, n: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss of some documents by table, bias, out and out_bias."""
    logit, h, at = document_logits(net, chunks, n)
    g_doc = (1 / (1 + np.exp(-logit)) - target) / len(n)
    g = np.repeat(g_doc / n, n).astype(np.float32)  # each chunk's share of its document's logit
    gh = g[:, None] * net.out * (h > 0)
    gt = np.zeros_like(net.table)
    f = np.arange(FILTERS)
    for k in range(WIDTH):
        np.add.at(gt[k], (np.take_along_axis(chunks, at + k, axis=1), f), gh)
    return [gt, gh.sum(0), h.T @ g, np.array([g_doc.sum()], np.float32)]


def fit(chunks: np.ndarray, n: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Learn filters and output weights with Adam on the log loss of whole documents (``n`` chunks each)."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.full(FILTERS, 0.1, np.float32),
         rng.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32)]
    m1, m2 = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    step, start = 0, np.cumsum(n) - n
    for _ in range(epochs):
        order = rng.permutation(len(n))
        for i in range(0, len(order), BATCH):
            pick = order[i:i + BATCH]
            x = np.concatenate([chunks[start[d]:start[d] + n[d]] for d in pick])
            step += 1
            for j, grad in enumerate(gradients(Network(p[0], p[1], p[2], float(p[3][0])), x, n[pick], target[pick])):
                grad = grad + 1e-4 * p[j] if j in (0, 2) else grad
                m1[j] = 0.9 * m1[j] + 0.1 * grad
                m2[j] = 0.999 * m2[j] + 0.001 * grad * grad
                p[j] -= 0.01 * (m1[j] / (1 - 0.9 ** step)) / (np.sqrt(m2[j] / (1 - 0.999 ** step)) + 1e-8)
    return Network(p[0], p[1], p[2], float(p[3][0]))


def score_bytes(net: Network, run: list[bytes]) -> np.ndarray:
    """One probability per text: the mean of its chunks' logits, squashed."""
    sums, counts = np.zeros(len(run)), np.zeros(len(run))
    waiting, owner = [], []

    def flush() -> None:
        x, who = np.concatenate(waiting), np.concatenate(owner)
        for i in range(0, len(x), 128):
            h, _ = _pool(net.table, net.bias, x[i:i + 128])
            np.add.at(sums, who[i:i + 128], h @ net.out + net.out_bias)
            np.add.at(counts, who[i:i + 128], 1)
        waiting.clear()
        owner.clear()

    for i, data in enumerate(run):
        starts = chunk_starts(len(data))
        for j in range(0, len(starts), 1024):
            part = starts[j:j + 1024]
            waiting.append(chunk_matrix(data[part[0]:part[-1] + CHUNK], part - part[0]))
            owner.append(np.full(len(part), i))
            if sum(map(len, owner)) >= 1024:
                flush()
    if waiting:
        flush()
    return 1 / (1 + np.exp(-np.clip(sums / counts, -500, 500)))


def train_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, fold: int = 2, folds: int = 4,
                  train_bytes: int = TRAIN_BYTES) -> Network | None:
    """Fit on labelled documents outside the held-out fold.

    Of each class at most ``train_rows`` documents are used, those first in a
    hash order of doc_id, and of these the ones up to ``train_bytes`` in all: a
    bounded sample, so the driver holds 24 MB of text at most at any input
    size.  Every chunk of a training document counts, and its logit is pooled
    as in scoring.  A document of more than ``train_bytes`` is no training
    row.  Only text bytes are inputs.  Rows with null labels or ids are
    ignored.  None without labels.
    """
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
           .where("doc_id is not null and quality in (0, 1)").where(crc32_mod("doc_id", folds) != fold).distinct())
    found = {r.quality: r["count"] for r in lab.groupBy("quality").count().collect()}
    picked = None
    for q in (0, 1):
        part = lab.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        picked = part if picked is None else picked.unionAll(part)
    # picked has at most 2 * train_rows rows of 12 bytes; the window below runs over their sizes.
    size = F.octet_length("text").alias("size")
    sized = texts(docs).join(F.broadcast(picked), "doc_id").where(F.octet_length("text") <= train_bytes).select("doc_id", "quality", size, F.xxhash64("text").alias("mark"))
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id", "mark")
    used = sized.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= train_bytes).select("doc_id", "quality").distinct()
    rows = texts(docs).where(F.octet_length("text") <= train_bytes).join(F.broadcast(used), "doc_id").select("doc_id", "quality", "text").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.quality, bytes(r.text)))
    parts = [chunk_matrix(bytes(r.text), chunk_starts(len(r.text))) for r in rows]
    net = fit(np.concatenate(parts), np.array([len(x) for x in parts]), np.array([float(r.quality) for r in rows]))
    # The sample has other class shares than the labels: move the logit to theirs.
    fitted = {q: max(1, sum(r.quality == q for r in rows)) for q in (0, 1)}
    shift = np.log(found.get(1, 1) / fitted[1]) - np.log(found.get(0, 1) / fitted[0])
    return replace(net, out_bias=net.out_bias + float(shift))


def score_quality(docs: DataFrame, net: Network | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Every byte of a text is covered by its chunks.  Null and empty texts get
    the score of a blank chunk.  Without a fitted network every score is 1.
    Repeated rows give repeated results; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 100 kB at any input size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for ids, data in document_runs(batches):
            s = score_bytes(model, data) if model else np.ones(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, net: Network | None, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` (documents' columns) that the classifier does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches):
        model = shared.value
        for b in batches:
            data = [(x or "").encode() for x in b.column(at).to_pylist()]
            s = score_bytes(model, data) if model else np.ones(len(data))
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
