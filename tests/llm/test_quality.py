"""The quality network against plain loops, and what it is fitted on."""

from __future__ import annotations

import random

import numpy as np
import pytest

from dealerlens.llm import quality_cnn as q


def small_network(seed: int) -> q.Network:
    rng = np.random.default_rng(seed)
    return q.Network(rng.normal(0, 0.5, (q.WIDTH, 256, q.FILTERS)).astype(np.float32), rng.normal(0, 0.2, q.FILTERS).astype(np.float32),
                     rng.normal(0, 0.5, q.FILTERS).astype(np.float32), 0.3)


def plain_logit(net: q.Network, data: bytes) -> float:
    logits = []
    start = 0
    while True:
        chunk = (data[start:start + q.CHUNK] + bytes(q.CHUNK))[:q.CHUNK]
        logit = net.out_bias
        for f in range(q.FILTERS):
            best = max(sum(float(net.table[k, chunk[i + k], f]) for k in range(q.WIDTH)) for i in range(q.CHUNK - q.WIDTH + 1))
            logit += max(0.0, best + float(net.bias[f])) * float(net.out[f])
        logits.append(logit)
        start += q.CHUNK - q.OVERLAP
        if start >= len(data) - q.OVERLAP:
            return sum(logits) / len(logits)


def test_scores_equal_plain_loops():
    net, rng = small_network(1), random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5, 480, 511, 512, 513, 992, 993, 1700)]
    got = q.score_bytes(net, texts)
    assert got == pytest.approx([1 / (1 + np.exp(-plain_logit(net, x))) for x in texts], rel=1e-4)


def test_gradients_equal_differences():
    net, rng = small_network(3), np.random.default_rng(4)
    n, target = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    chunks = rng.integers(97, 105, (int(n.sum()), q.CHUNK)).astype(np.uint8)

    def loss(p: q.Network) -> float:
        logit, _, _ = q.document_logits(p, chunks, n)
        return float(np.mean(np.log1p(np.exp(logit)) - target * logit))

    found = q.gradients(net, chunks, n, target)
    step = 1e-3
    for j, name in ((1, "bias"), (2, "out")):
        for f in range(0, q.FILTERS, 5):
            moved = [q.replace(net, **{name: getattr(net, name).astype(np.float64) + d * np.eye(q.FILTERS)[f]}) for d in (step, -step)]
            assert found[j][f] == pytest.approx((loss(moved[0]) - loss(moved[1])) / (2 * step), abs=2e-4)
    up, down = (q.replace(net, out_bias=net.out_bias + d) for d in (step, -step))
    assert found[3][0] == pytest.approx((loss(up) - loss(down)) / (2 * step), abs=2e-4)
    busy = np.argwhere(np.abs(found[0]) > 0.01)[:4]
    for k, byte, f in busy:
        moved = []
        for d in (step, -step):
            table = net.table.astype(np.float64)
            table[k, byte, f] += d
            moved.append(loss(q.replace(net, table=table)))
        assert found[0][k, byte, f] == pytest.approx((moved[0] - moved[1]) / (2 * step), abs=5e-3)


def test_every_chunk_of_a_training_text_counts(spark):
    """Labels follow a mark at any place of a long text: a few chunks of each would not show it."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(["river", "stone", "cloud", "meadow", "lantern"]) for _ in range(600)]
        good = i % 2
        for _ in range(3):
            words[rng.randrange(600)] = "zqxzqx" if good else "jkvjkv"
        rows.append((i, " ".join(words)))
        labels.append((i, good))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = q.train_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in q.score_quality(docs, net).collect()}
    held = [(got[i].score > 0.5) == bool(y) for i, y in labels if got[i].held_out]
    assert len(held) > 60 and np.mean(held) >= 0.95


def test_training_sample_is_bounded_by_bytes(spark):
    rows = [(i, ("good " if i % 2 else "bad ") * 50) for i in range(60)] + [(100, "good " * 5000), (101, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1), (101, 0), (None, 1), (3, None), (77, 1)], "doc_id long, quality int")
    assert q.train_quality(docs, labels, train_bytes=100) is not None  # the empty text alone
    assert q.train_quality(docs.where("doc_id = 100"), labels, train_bytes=1000) is None
    net = q.train_quality(docs, labels, train_bytes=2000)
    assert {r.doc_id for r in q.score_quality(docs, net).collect()} == {r[0] for r in rows}
