"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
rng = np.random.default_rng(5)
VOCAB = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 6))) for _ in range(60)]


def sentence(n):
    return " ".join(rng.choice(VOCAB, n))


def documents(spark, rows, clash=True):
    """doc_id, text, and columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if clash:
        for c in ("n", "bucket", "word", "key", "rank", "score", "sid", "gid", "chunk", "_spans", "start", "component_id", "held_out"):
            df = df.selectExpr("*", f"'x' as {c}")
    return df


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact and near copies, shared passages, nulls, empties, odd white space and a very long text."""
    passage = sentence(60)
    base = sentence(120).split(" ")
    rows = [(i, sentence(int(rng.integers(1, 90)))) for i in range(60)]
    rows += [(100 + i, sentence(30) + "\n" + passage + "\t" + sentence(25)) for i in range(12)]
    for i in range(90):  # a long list of near copies, all different
        copy = list(base)
        copy[int(rng.integers(len(copy)))] = f"w{i}"
        rows.append((200 + i, " ".join(copy)))
    rows += [(400 + i, passage) for i in range(30)]
    rows += [(500, None), (501, ""), (502, " \t\r\n\x0b\x0c"), (503, "One"), (504, "one"), (505, "a b c"), (506, "A b C d"), (507, "a B c D")]
    rows += [(600, sentence(9000)), (601, " ".join(["la"] * 300)), (602, " ".join(["la"] * 200)), (700, "x\x00y z"), (-5, passage)]
    rows += [(508, "same row twice"), (508, "same row twice")]
    return rows


def bytes_of(text, lower):
    data = (text or "").encode()
    return WORDS.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in data) if lower else data)


class Forest(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


# --- shared helpers ---------------------------------------------------------

def test_hashes_are_functions_of_words(spark):
    from dealerlens.llm.common import window_hashes, word_hashes

    data = [b"a B\tc", b"", b"  ", b"a b c a b", b"c", ("é " * 3).encode() + b"a"]
    h, n = word_hashes(data, lower=True)
    want = [w for d in data for w in bytes_of(d.decode(), True)]
    assert n.tolist() == [len(bytes_of(d.decode(), True)) for d in data]
    seen = {}
    for w, x in zip(want, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    w, m = window_hashes(h, n, 2)
    assert m.tolist() == [2, 0, 0, 4, 0, 3] and len(w) == 9
    assert w[0] == w[2] == w[5] and w[1] == w[3]


def test_coded_integers():
    from dealerlens.llm.common import read_coded, sorted_coded

    for x in ([], [0], [0, 0, 5], [1, 70000, 70001, 1 << 20], [3, 1 << 40], sorted(rng.integers(0, 1 << 40, 500).tolist()), [0, 65535, 65535 * 3]):
        x = np.array(x, np.int64)
        assert read_coded(sorted_coded(x)).tolist() == x.tolist()


def test_components(spark):
    from dealerlens.llm.components import connected_components

    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    f = Forest()
    for a, b in links:
        f.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: f.root(x) for a, b in links if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 ------------------------------------------------------------------------

def test_language_model(spark, corpus):
    from dealerlens.llm.pitman_yor import score_documents

    out = score_documents(documents(spark, corpus)).collect()
    assert len(out) == len(corpus)
    again = {(r.doc_id, r.score) for r in score_documents(documents(spark, corpus[::-1])).collect()}
    assert again == {(r.doc_id, r.score) for r in out}
    end = b"\n"
    train, held = Counter(), {}
    for i, t in corpus:
        held[i] = zlib.crc32(str(i).encode()) % 7 == 2
        if not held[i]:
            train.update([*bytes_of(t, True), end])
    n, v = sum(train.values()), len(train)
    texts = dict(corpus)
    better = 0
    for r in out:
        toks = [*bytes_of(texts[r.doc_id], True), end]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(toks), sum(train[t] > 0 for t in toks), n)
        assert r.base_score == pytest.approx(sum(np.log10((train[t] + 1) / (n + v + 1)) for t in toks), rel=1e-9)
        assert r.score < 0
        better += r.score - r.base_score
    assert better > 0


def test_language_model_empty(spark):
    from dealerlens.llm.pitman_yor import score_documents

    assert score_documents(documents(spark, [])).count() == 0
    r = score_documents(documents(spark, [(None, None)])).collect()[0]
    assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens) == (None, False, 1, 1)


def test_probabilities_sum_to_one():
    """Over all words and the unknown one, in every context, for each sample."""
    from pyspark.sql import Row

    from dealerlens.llm import pitman_yor as py

    words = py.mix64(np.arange(1, 40, dtype=np.uint64))
    context = rng.integers(0, 5, 600).astype(np.uint16)
    word = words[np.minimum(rng.geometric(0.12, 600), 39) - 1]
    key = np.lexsort((context, word))
    w, c = word[key], context[key]
    at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    row = Row(bucket=0, chunk=0, words=w[at].tobytes(), per_word=py.small_ints(np.diff(at, append=len(w))), contexts=c.tobytes(), trained=py.small_ints(np.ones(len(w), np.int64)))
    none = np.zeros(0, np.uint64)
    counted = next(py._count(iter([row]), none))
    model = py.Model(none, np.zeros(0, np.int64), counted["customers"], 600, counted["v"], 0.6, 0.7)
    done = [py.Totals(counted["tables"], counted["v"], np.zeros(0, np.int64))]
    b = py.Bucket([row])
    for _ in range(3):
        s = next(py._sweep(iter([row]), model, done))
        done.append(py.Totals(s["tables"], s["root_tables"], s["hot"]))
    for k, (t, c0, t0) in enumerate(b.sweeps(model, done[:-1])):
        p0 = py.root_probability(model, done[k], c0, t0)
        unknown = model.root_share(done[k]) / (py.STRENGTH + done[k].tables.sum())
        assert p0.sum() + unknown == pytest.approx(1)
        for u in range(5):
            mine = b.context == u
            back = (py.STRENGTH + model.discount * done[k].tables[u]) / (py.STRENGTH + model.customers[u])
            seen = ((b.c - model.discount * t)[mine] / (py.STRENGTH + model.customers[u])).sum()
            assert seen + back * (p0.sum() + unknown) == pytest.approx(1)
        assert (t <= b.c).all() and (t >= np.minimum(b.c, 1)).all()


def test_scores_do_not_depend_on_the_bucket_count():
    """Hot words are split over buckets; every sample must use their customers of all buckets."""
    from pyspark.sql import Row

    from dealerlens.llm import pitman_yor as py

    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(50)]
    docs = [Row(chunk=0, doc_id=i, text=" ".join(r.choice(words, 30, p=np.arange(50, 0, -1) / 1275)).encode(), held_out=i % 7 == 2) for i in range(60)]
    train = np.concatenate([py.tokens([d.text]).word for d in docs if not d.held_out])
    word, n = np.unique(train, return_counts=True)
    hot = word[n * 40 >= len(train)]
    assert 5 < len(hot) < len(word)

    def scores(buckets):
        rows = [Row(**dict(zip(("bucket", "chunk", "words", "per_word", "contexts", "trained"), x))) for x in py._post(iter(docs), buckets, hot)]
        counted = next(py._count(iter(rows), hot))
        model = py.Model(hot, counted["hot_count"], counted["customers"], len(train), counted["v"] + len(hot), 0.6, 0.7)
        done = [py.Totals(counted["tables"], counted["v"] + len(hot), counted["hot"])]
        hot_t0 = np.minimum(done[0].hot, 1)
        for k in range(1, py.BURN_IN + py.SAMPLES + 1):
            s = next(py._sweep(iter(rows), model, list(done)))
            hot_t0 = py.root_tables(model, done[-1], s["hot"], hot_t0, hot, k)
            done.append(py.Totals(s["tables"], s["root_tables"] + int(hot_t0.sum()), s["hot"]))
        answers = [Row(**dict(zip(("chunk", "bucket", "log_p", "counts"), x))) for x in py._reply(iter(rows), model, done)]
        return [x[5] for x in py._score(docs, answers, buckets, hot)]

    one = scores(1)
    assert scores(4) == pytest.approx(one, rel=1e-6) and scores(64) == pytest.approx(one, rel=1e-6)


def test_table_draws_follow_their_weights():
    from math import exp

    from dealerlens.llm import pitman_yor as py

    n, c, d, b = 40_000, 7, 0.5, 0.8
    t = py.draw_tables(np.full(n, c), np.full(n, b), d, py.mix64(np.arange(n, dtype=np.uint64)), 3)
    weight = np.array([exp(py.log_stirling(d)[c, k]) * b ** k for k in range(1, c + 1)])
    assert np.bincount(t, minlength=c + 1)[1:] / n == pytest.approx(weight / weight.sum(), abs=0.01)
    big = py.draw_tables(np.full(50, 100_000), np.full(50, 2.0), d, py.mix64(np.arange(50, dtype=np.uint64)), 1)
    assert (big > 5).all() and (big < 100_000).all()


# --- 2 ------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as score", "'q' as query_id", "0 as v", "0 as e", "0 as rep")


def test_top_k(spark):
    from dealerlens.llm.threshold_topk import integer_vectors, top_k

    x = np.round(rng.normal(0, 0.2, (700, 6)), 1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1050, [None] * 6, 0), (1100, [float("nan")] * 6, 0), (1150, [float("inf")] * 6, 0), (1200, [0.0] * 6, 1), (1250, [1.0, 2.0], 1), (None, [0.0] * 6, 1), (0, x[0].tolist(), 0)]
    v = integer_vectors(vectors(spark, rows))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(v, v.where("vec_id % 50 = 0"), 5).collect()}
    whole = {i: np.floor(np.array(e, np.float32).astype(float) * 256).astype(int) for i, e, _ in rows[:700]} | {1200: np.zeros(6, int)}
    want = {}
    for q in [i for i in whole if i % 50 == 0]:
        best = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_threshold_stops_early():
    from dealerlens.llm.threshold_topk import Lists

    rows = np.abs(rng.normal(0, 10, (4096, 3))).round()
    rows[7] = 1000
    lists = Lists(np.arange(4096), rows)
    asked = []
    lists.rows = type("Rows", (), {"__getitem__": lambda self, i: (asked.append(len(i)), rows[i])[1]})()
    q = np.array([1.0, 2.0, 1.0])
    assert lists.search(q, -1, lists.bounds(q[None])[0], [], 1) == [(-4000, 7)]
    assert sum(asked) < 100


# --- 3 ------------------------------------------------------------------------

def jaccard_brute(rows):
    sets = {}
    for i, t in rows:
        w = bytes_of(t, True)
        sets[i] = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    f = Forest()
    ids = sorted(i for i in sets if i is not None)
    for i in ids:
        f.root(i)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                f.join(a, b)
    return {i: (len(sets[i]), f.root(i)) for i in ids}


@pytest.mark.parametrize("common, long", [(32, 64), (3, 4)])
def test_jaccard(spark, corpus, monkeypatch, common, long):
    from dealerlens.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "COMMON", common)
    monkeypatch.setattr(jaccard_join, "LONG", long)
    got = jaccard_join.jaccard_groups(documents(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_brute(corpus)


def test_jaccard_edges(spark):
    from dealerlens.llm.jaccard_join import jaccard_groups, keep_representatives

    assert jaccard_groups(documents(spark, [])).count() == 0
    rows = [(None, "a b c"), (None, None), (3, "a b c"), (2, "A B C"), (9, "a b")]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_groups(documents(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, None), (None, 0, None), (3, 1, 2), (2, 1, 2), (9, 1, 9)], key=str)
    kept = keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 9, None, None]


def test_jaccard_two_texts_of_one_id(spark):
    """Different texts under one doc_id are different sets with one home; each meets its own near copies."""
    from dealerlens.llm.jaccard_join import jaccard_groups

    def text(word, last):
        return " ".join(f"{word}{i}" for i in range(60)) + " " + last

    rows = [(1, text("x", "end")), (1, text("y", "end")), (1, text("y", "end")), (5, text("x", "stop")), (6, text("y", "stop")), (7, text("z", "stop"))]
    got = [(r.doc_id, r.component_id) for r in jaccard_groups(documents(spark, rows)).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (1, 1), (5, 1), (6, 1), (7, 7)]


def test_jaccard_low_bits():
    """Where low bits decide, the sets link, and no smaller intersection explains the matches better than the bound says."""
    from dealerlens.llm.jaccard_join import LOW, SURE, accident, surely

    rng = np.random.default_rng(3)
    for n, m in [(20, 20), (330, 330), (330, 420), (1200, 1000), (3600, 3600), (3600, 2900)]:
        need = -(-75 * (n + m) // 175)
        decided = [c for c in range(min(n, m) + 1) if surely(c, n, m)]
        assert all(c > need for c in decided) and decided == list(range(decided[0], min(n, m) + 1) if decided else [])
        for c in decided[:3]:
            assert max(accident(c - s, (n - s) * (m - s) / (1 << LOW)) for s in range(need)) < -SURE
        for _ in range(20):  # just below the threshold: never decided
            both, one, two = np.split(rng.integers(0, 1 << 63, n + m - need + 1).astype(np.uint64), [need - 1, n])
            low = [set((np.concatenate([both, x]) & np.uint64((1 << LOW) - 1)).tolist()) for x in (one, two)]
            assert len(low[0]) <= n and not surely(len(low[0] & low[1]), n, m)
    assert surely(330, 330, 330) and not surely(283, 330, 330) and not surely(5000, 5000, 5000)


def test_jaccard_counts():
    """Cells' counts never say less than the intersection, and end most pairs that are well below the threshold."""
    from dealerlens.llm.jaccard_join import most_shared, packed_counts, unpacked

    rng = np.random.default_rng(5)
    for n, m, shared in [(1, 1, 0), (1, 1, 1), (3, 4, 3), (16, 17, 15), (330, 330, 247), (300, 520, 290), (2000, 2100, 1500), (40, 5000, 40), (700, 700, 0)]:
        x = np.unique(rng.integers(0, 1 << 63, n + m - shared).astype(np.uint64))
        x = rng.permutation(x)
        one, two = np.sort(x[:n]), np.sort(x[n - shared:])
        most = most_shared(unpacked(packed_counts(one)), unpacked(packed_counts(two)), n, m)
        assert shared <= most <= min(n, m) and most == most_shared(unpacked(packed_counts(two)), unpacked(packed_counts(one)), m, n)
        if 100 <= shared < 0.77 * min(n, m):
            assert 100 * most < 75 * (n + m - most)
    same = np.sort(np.arange(50, dtype=np.uint64) << np.uint64(20))  # all in one cell
    assert most_shared(unpacked(packed_counts(same)), unpacked(packed_counts(same)), 50, 50) == 50


def test_jaccard_sample(spark):
    from dealerlens.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_jaccard_join"](spark, SF).collect()}
    assert got == jaccard_brute(rows)


# --- 4 ------------------------------------------------------------------------

def check_packing(rows, pieces, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    want = Counter()
    ids = {}
    for i, t in rows:
        x = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        ids[i] = x
        want[i] += len(x)
    held, filled = Counter(), defaultdict(list)
    for p in pieces:
        part = ids[p.doc_id][p.start:p.start + p.length]
        assert len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        held[p.doc_id] += p.length
        filled[p.sequence_id].append((p.offset, p.length))
    assert held == want
    padding = 0
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0


def test_packing(spark, corpus):
    import public_tokenizers

    from dealerlens.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = corpus + [(800 + i, "ab " * 700) for i in range(40)] + [(900, "x<|endoftext|>y  \n z"), (901, "é​　 日本 1234567 'll DON'T")]
    check_packing(rows, pack_documents(documents(spark, rows), path).collect(), path)
    assert pack_documents(documents(spark, []), path).count() == 0


def test_closest_filling():
    from dealerlens.llm.packing import Plan, closest_filling

    for _ in range(60):
        counts = [0, *rng.integers(0, 3, 12).tolist()]
        room = int(rng.integers(1, 40))
        sums = {0}
        for k, c in enumerate(counts):
            for _ in range(c):
                sums |= {s + k for s in sums if s + k <= room}
        got = closest_filling(counts, room)
        assert sum(k * c for k, c in got.items()) == max(sums) and all(c <= counts[k] for k, c in got.items())
    plan = Plan([0] * 600 + [10] + [0] * 423, 5)
    places = [p for r in range(10) for p in plan.rest(600, r)]
    assert sum(n for n, _, _ in places) == 6000 and len(set((s, o) for _, s, o in places)) == len(places)


# --- 5 ------------------------------------------------------------------------

def near_brute(rows, cosine=0.93):
    ok = [(i, np.array(e, np.float32).astype(float), lab) for i, e, lab in rows if i is not None and e and lab is not None and None not in e and np.isfinite(e).all() and np.any(np.array(e) != 0)]
    f, n = Forest(), Counter()
    for i, _, _ in rows:
        if i is not None:
            f.root(i)
    for a, (i, x, p) in enumerate(ok):
        for j, y, q in ok[a + 1:]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                f.join(i, j)
                n[i] += 1
                n[j] += 1
    return {i: (n[i], f.root(i)) for i, _, _ in rows if i is not None}


def test_pivot_index(spark):
    from dealerlens.llm.pivot_index import near_duplicates

    centre = rng.normal(0, 1, (40, 16))
    x = np.repeat(centre, 12, axis=0) + rng.normal(0, 0.12, (480, 16))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    rows += [(1000 + i, x[3].tolist(), 0) for i in range(30)]
    rows += [(2000, None, 0), (2001, [None] * 16, 0), (2002, [0.0] * 16, 0), (2003, [float("nan")] * 16, 0), (2004, x[0].tolist(), None), (2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0), (2007, [], 0), (None, x[0].tolist(), 0)]
    got = near_duplicates(vectors(spark, rows)).collect()
    assert len(got) == len(rows)
    want = near_brute(rows)
    found, there = sum(r.n_links for r in got), sum(n for n, _ in want.values())
    assert 0.9 * there <= found <= there
    for r in got:
        if r.vec_id is not None:
            assert r.n_links <= want[r.vec_id][0] and r.kept == (r.vec_id == r.component_id)
            assert want[r.component_id][1] == want[r.vec_id][1]
            if r.vec_id >= 1000:
                assert r.n_links == want[r.vec_id][0]
    assert near_duplicates(vectors(spark, [])).count() == 0


def test_pivot_recall_in_a_large_group(spark):
    """A third of all vectors are differing near copies of one vector."""
    import pandas as pd

    from dealerlens.llm.pivot_index import near_duplicates

    r = np.random.default_rng(9)
    n, size = 17_000, 32
    x = r.normal(0, 1, (n, size))
    x[:n // 3] = x[0] / np.linalg.norm(x[0]) + r.normal(0, 0.24 / size ** 0.5, (n // 3, size))
    x = x.astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist(), "label": np.zeros(n, np.int32)}))
    got = near_duplicates(rows).toPandas().set_index("vec_id").n_links.sort_index().to_numpy()
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = np.concatenate([(y[i:i + 1000] @ y.T >= 0.93).sum(axis=1) - 1 for i in range(0, n, 1000)])
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum() > (n // 3) ** 2 / 2


def test_pivot_recall_sample(spark):
    from dealerlens.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = near_brute(rows)
    got = QUERIES["op5_pivot_index"](spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_links for r in got) >= 0.9 * sum(n for n, _ in want.values())


# --- 6 ------------------------------------------------------------------------

def repeats_brute(rows):
    seen, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = bytes_of(t, False)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            first = seen.setdefault(tuple(w[s:s + 20]), (i, s))
            if first != (i, s):
                gone[s:s + 20] = [True] * 20
        kept = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [2_000_000, 50])
def test_debruijn(spark, corpus, monkeypatch, chunk):
    from dealerlens.llm import debruijn

    monkeypatch.setattr(debruijn, "CHUNK", chunk)
    monkeypatch.setattr(debruijn, "BUCKET", max(chunk, 2000))
    got = debruijn.digest_repeats(documents(spark, corpus).repartition(5)).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == repeats_brute(corpus)


def test_debruijn_edges(spark, corpus):
    from dealerlens.llm.debruijn import digest_repeats, remove_repeats

    assert digest_repeats(documents(spark, [])).count() == 0
    text = sentence(30)
    r = digest_repeats(documents(spark, [(None, text), (4, text), (None, None)])).collect()
    assert sorted(x.n_removed for x in r) == [0, 0, 0]
    cut = {x.doc_id: x.text for x in remove_repeats(spark.createDataFrame([(1, text), (2, "Hi  there " + text + "\nbye "), (3, text), (4, None)], "doc_id long, text string")).collect()}
    assert cut == {1: text, 2: "Hi  there\nbye ", 3: "", 4: None}


# --- 7 ------------------------------------------------------------------------

def test_chat_oracle(spark):
    from dealerlens.llm.queries import ORACLE_SQL, QUERIES
    from dealerlens.plans.check import compare, duck_connection

    ok, why = compare(QUERIES["op7_reply_trees"](spark, SF).toPandas(), duck_connection(SF).execute(ORACLE_SQL["op7_reply_trees"]).df())
    assert ok, why


def test_reply_trees(spark):
    from dealerlens.llm import reply_trees as rt

    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 2, 0.0), ("t", 5, 3, 9.0), ("u", 1, 7, None), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0), (None, 1, None, 0.0), (None, 2, 1, 1.0)]
    nodes += [("long", i, i - 1 if i else None, 1.0) for i in range(70)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    got = defaultdict(list)
    for r in rt.best_paths(df, 2).collect():
        got[r.tree, r.rank].append((r.depth, r.node))
    got = {k: [n for _, n in sorted(v)] for k, v in got.items()}
    assert got == {("t", 1): [1, 3, 5], ("t", 2): [1, 2, 4], ("u", 1): [1], (None, 1): [1, 2], ("long", 1): list(range(70))}
    assert rt.best_paths(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    from dealerlens.llm import reply_trees as rt

    odd = ["", "\\", "\\\\|<|", "<|im_end|>\n", "<\\|", "a\nb", "<|nl|>", "\\<|x", "😀<", "|>"]
    rows = [(i % 3, k, ["user", "assistant", "ro<|le\n\\", None][k % 4], odd[(i + k) % len(odd)] if (i + k) % 7 else None) for i in range(9) for k in range(12)] + [(None, None, None, None)]
    nodes = rt.linear_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as tree")).persist()
    back = rt.read_back(rt.format_paths(nodes, rt.best_paths(nodes))).collect()
    want = defaultdict(list)
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {r.tree: [(t.role, t.text) for t in r.turns] for r in back} == dict(want)
    assert {r.tree: r.loss for r in back} == {c: "".join(t for r, t in v if r == "assistant") for c, v in want.items()}


# --- 8 ------------------------------------------------------------------------

def test_bpe(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    from dealerlens.llm.bpe import digest_documents, encode_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["A\x1cB\x85c　d", "ΑΣ ΣΑΣ İstanbul ẞ", "é ́x", "<|endoftext|>x <|startoftext|>", "<|END|> it's I'LL 123 a1b2 ...!!", "日本語👍🏽 ​", "x" * 3000, "\x00 \x7f", "ﬁ ½ Ⅷ ٣"]
    rows = corpus + [(2000 + i, t) for i, t in enumerate(odd)]
    tok, texts = Tokenizer.from_file(path), dict(rows)
    for r in digest_documents(documents(spark, rows), path).collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = encode_documents(documents(spark, rows[-3:]), path).collect()
    assert [list(r.ids) for r in whole] == [tok.encode(texts[r.doc_id], add_special_tokens=False).ids for r in whole]
    assert digest_documents(documents(spark, []), path).count() == 0


# --- 9 ------------------------------------------------------------------------

def test_quality(spark):
    from dealerlens.llm.quality_cnn import chunk_starts, score_quality, train_quality

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    net = train_quality(docs, labels)
    got = score_quality(docs, net).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() >= 0.9
    odd = score_quality(documents(spark, [(1, None), (1, ""), (None, "x" * 200_000)]), net).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)
    assert score_quality(docs, train_quality(docs, labels.limit(0))).where("predicted = 0").count() == 0
    for n in (0, 1, 31, 512, 513, 5000):
        s = chunk_starts(n)
        assert s[0] == 0 and s[-1] + 512 >= n and (np.diff(s) < 512).all()


# --- 10 -----------------------------------------------------------------------

def test_licenses(spark):
    from dealerlens.llm.licenses import TEMPLATES, scan_licenses
    from dealerlens.llm.queries import ORACLE_SQL, QUERIES
    from dealerlens.plans.check import compare, duck_connection

    ok, why = compare(QUERIES["op10_license_scan"](spark, SF).toPandas(), duck_connection(SF).execute(ORACLE_SQL["op10_license_scan"]).df())
    assert ok, why
    rows = [(i, f"{sentence(20)}\n{t.upper()}\n") for i, t in enumerate(TEMPLATES.values())] + [(50, None), (51, ""), (52, "all rights"), (53, "no licence here at all"), (None, "Released under the MIT License")]
    got = {r.doc_id: (r.license, r.dice, r.unit, r.n_matches) for r in scan_licenses(documents(spark, rows)).collect()}
    for i, name in enumerate(TEMPLATES):
        assert got[i][:3] == (name, 1.0, 2) and got[i][3] in (1, 2)
    assert got[50] == got[51] == got[52] == got[53] == (None, 0.0, -1, 0) and got[None] == ("mit", 1.0, 0, 2)


def test_licenses_inside_larger_texts(spark):
    """Every template wrapped over comment lines, and inside a paragraph line, of a larger text."""
    import textwrap

    from dealerlens.llm.licenses import TEMPLATES, scan_licenses

    rows = []
    for i, t in enumerate(TEMPLATES.values()):
        rows.append((i, "\n".join([sentence(90), *(" * " + x for x in textwrap.wrap(t, 30, break_long_words=False)), sentence(90)])))
        rows.append((100 + i, f"{sentence(20)}\n{sentence(120)} {t} {sentence(120)}\n{sentence(9)}"))
    rows += [(50, "Copyright 2019 ACME Corp. All rights reserved."), (51, "Of the License, a copy; and the software is provided " * 40),
             (52, f"{sentence(30)} all rights reserved {sentence(50)}\n{sentence(50)} Released under\nthe MIT License {sentence(30)}")]
    got = {r.doc_id: (r.license, r.dice, r.unit, r.n_matches) for r in scan_licenses(documents(spark, rows)).collect()}
    for i, name in enumerate(TEMPLATES):
        assert got[i][:2] == (name, 1.0) and got[i][2] >= 2
        assert got[100 + i] == (name, 1.0, 2, 1)
    assert got[50] == ("all-rights-reserved", 1.0, 1, 1) and got[51][0] is None
    assert got[52] == ("all-rights-reserved", 1.0, 1, 2)


# --- pipeline -------------------------------------------------------------------

def test_pipeline(spark):
    """Each stage against brute force on its own input."""
    import public_tokenizers

    import corpus_pipeline as cp
    from dealerlens.llm.common import save

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = save(cp.quality(spark, docs, SF), "t")
    assert kept.columns == docs.columns and 0.6 * docs.count() < kept.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    one = save(cp.near_duplicates(spark, kept, SF), "t")
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in jaccard_brute(rows).items() if i == c)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    cut = save(cp.substrings(spark, one, SF), "t")
    want = repeats_brute(rows)
    after = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and after.keys() == want.keys()
    for i, r in after.items():
        assert hashlib.sha256(b" ".join(bytes_of(r.text, False))).hexdigest() == want[i][2] and r.n_chars == len(r.text)
    check_packing([(i, r.text) for i, r in after.items()], cp.packing(spark, cut, SF).collect(), public_tokenizers.path("byte_bpe_50k.json"))
    assert cp.run(spark, SF).count() > 0
