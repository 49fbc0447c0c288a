"""LM scoring: a hierarchical Pitman-Yor bigram model, seated by Gibbs sampling.

Restaurants.  The root restaurant serves words over a uniform base of V known
words and one unknown; each context has a restaurant whose parent is the root.
A context is the word before (or the start of a text), hashed to one of
``RESTAURANTS`` numbers, so that the totals of all restaurants are a table of
fixed size.  A customer that opens a table in a context restaurant sends a
customer to the root.

Sampling.  A (restaurant, word) pair with c customers holds t tables.  Given
all other tables, t has weight S(c, t) * b**t: S is the generalised Stirling
number of the seatings of c customers at t tables, b the parent's share for
opening one.  One Gibbs sweep draws t of every pair (all at once, with totals
of the sweep before), then the root's tables.  Draws depend only on the pair's
hash and the sweep, so a task that is run again draws the same seating.
Probabilities are averaged over the sweeps after the first ``BURN_IN``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from dealerlens.llm.common import crc32_mod, mix64, power_of_two, slices, texts, total_bytes, word_hashes

RESTAURANTS = 1 << 16
BURN_IN = 1
SAMPLES = 2
STRENGTH = 1.0         # of every restaurant
EXACT = 64             # pairs of up to so many customers are drawn exactly from S(c, t) * b**t
CHUNK_BYTES = 8_000_000   # of text that a group of documents holds, on average
BUCKET_BYTES = 16_000_000  # of text whose words a bucket of the model holds, on average
HOT_SHARE = 1024       # a word of more than this fraction of all tokens is split by its contexts

_END = np.uint64(0x5851F42D4C957F2D)
_MULT = np.uint64(0xD6E8FEB86659FD93)


# --- documents to pairs ---------------------------------------------------------

@dataclass
class Chunk:
    """The tokens of some documents: word hash and restaurant of each, and each document's count."""

    word: np.ndarray
    context: np.ndarray
    count: np.ndarray


def tokens(data: list[bytes]) -> Chunk:
    """Words (A-Z folded), then one end per text; the context of a first word is the end's hash."""
    parts = []
    for _, run in slices(list(range(len(data))), data):
        words, counts = word_hashes(run, lower=True)
        n = counts + 1
        out = np.full(int(n.sum()), _END, np.uint64)
        ends = np.cumsum(n) - 1
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = words
        before = np.concatenate([[_END], out[:-1]])
        parts.append((out, (mix64(before) >> np.uint64(48)).astype(np.uint16), n))
    return Chunk(*(np.concatenate(x) for x in zip(*parts)))


def pair_keys(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(word + (context.astype(np.uint64) + np.uint64(1)) * _MULT)


@dataclass
class Pairs:
    """A chunk's distinct pairs in order of bucket and word, and each token's pair."""

    word: np.ndarray
    context: np.ndarray
    trained: np.ndarray   # training tokens
    bucket: np.ndarray
    of_token: np.ndarray


def distinct_pairs(chunk: Chunk, held: np.ndarray, buckets: int, hot: np.ndarray) -> Pairs:
    """``hot`` (sorted word hashes): their pairs go to buckets by word and context, all others by word."""
    key = pair_keys(chunk.word, chunk.context)
    _, first, inverse = distinct(key)
    word, context = chunk.word[first], chunk.context[first]
    train = np.repeat(~held, chunk.count)
    trained = np.bincount(inverse, weights=train, minlength=len(first)).astype(np.int64)
    place = mix64(word)
    is_hot = find(hot, word) >= 0
    place[is_hot] = key[first][is_hot]
    bucket = ((place >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    # By bucket, then by the word's first bits: a word's pairs stand together (two words that share
    # the bits may alternate, which only makes more runs).
    bits = max(1, int(buckets).bit_length())
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(64 - bits)) | (word >> np.uint64(bits)))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return Pairs(word[order], context[order], trained[order], bucket[order], back[inverse])


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, a place of each, and each key's number: np.unique without a stable sort."""
    order = np.argsort(key)
    near = key[order]
    head = np.ones(len(near), bool)
    head[1:] = near[1:] != near[:-1]
    inverse = np.empty(len(near), np.int64)
    inverse[order] = np.cumsum(head) - 1
    return near[head], order[head], inverse


def find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in a sorted table, -1 where it has none."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def small_ints(x: np.ndarray) -> bytes:
    kind = next(k for k in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * k or k == 8)
    return bytes([kind]) + x.astype(f"<u{kind}").tobytes()


def read_ints(data: bytes) -> np.ndarray:
    return np.frombuffer(memoryview(data)[1:], f"<u{data[0]}").astype(np.int64)


def _documents(rows: Iterator[Row]) -> dict[int, list]:
    """The documents of a partition by chunk, in an order that does not depend on how they arrived."""
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.chunk, []).append((r.doc_id is None, r.doc_id or 0, bytes(r.text), r.held_out))
    for docs in out.values():
        docs.sort()
    return out


def _post(rows: Iterator[Row], buckets: int, hot: np.ndarray) -> Iterator[tuple]:
    for number, docs in _documents(rows).items():
        p = distinct_pairs(tokens([d[2] for d in docs]), np.array([d[3] for d in docs]), buckets, hot)
        cut = np.flatnonzero(np.diff(p.bucket, prepend=-1))
        for a, b in zip(cut, [*cut[1:], len(p.bucket)]):
            w = p.word[a:b]
            at = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            yield (int(p.bucket[a]), number, bytearray(w[at].tobytes()), bytearray(small_ints(np.diff(at, append=b - a))),
                   bytearray(p.context[a:b].tobytes()), bytearray(small_ints(p.trained[a:b])))


POSTED = "bucket int, chunk int, words binary, per_word binary, contexts binary, trained binary"


# --- seating -----------------------------------------------------------------------

def log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) up to ``EXACT`` customers: S(c + 1, t) = S(c, t - 1) + (c - t * discount) * S(c, t)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0
    t = np.arange(EXACT + 1)
    for c in range(1, EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.log(np.maximum(c - t * discount, 0)) + out[c]
        out[c + 1] = np.logaddexp(np.r_[-np.inf, out[c, :-1]], stay)
    return out


def uniform(key: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(key + np.uint64(turn + 1) * _MULT) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


def draw_tables(c: np.ndarray, b: np.ndarray, discount: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of every pair given its customers c and the weight b of a new table.

    Up to ``EXACT`` customers the draw is exact.  Customers beyond them come in
    blocks of at most a sixteenth of those seated, each block with the share
    of new tables that the seating before it gives.
    """
    t = np.minimum(c, 1)
    table = log_stirling(discount)
    u = uniform(key, 1000 * sweep)
    log_b = np.log(np.maximum(b, 1e-300))
    order = np.argsort(np.minimum(c, EXACT), kind="stable")
    seated = np.minimum(c, EXACT)[order]
    for n in range(2, EXACT + 1):
        lo, hi = np.searchsorted(seated, [n, n + 1])
        if lo == hi:
            continue
        pick = order[lo:hi]
        for part in np.array_split(pick, -(-len(pick) // 20_000)):
            weight = table[n, 1:n + 1] + np.arange(1, n + 1) * log_b[part, None]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            t[part] = 1 + (weight < (u[part] * weight[:, -1])[:, None]).sum(axis=1)
    many = np.flatnonzero(c > EXACT)
    here, turn = np.full(len(many), EXACT), 0
    while len(many):
        turn += 1
        block = np.minimum(c[many] - here, np.maximum(1, here // 16))
        share = b[many] / (here - discount * t[many] + b[many])
        t[many] += np.floor(block * share + uniform(key[many], 1000 * sweep + turn)).astype(t.dtype)
        here = here + block
        left = here < c[many]
        many, here = many[left], here[left]
    return t


@dataclass
class Totals:
    """What a sweep leaves for all tasks: fixed-size tables and scalars."""

    tables: np.ndarray                       # per context restaurant
    root_tables: int = 0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # root customers of the hot words


@dataclass
class Model:
    """Counts over all training tokens, fixed after the first pass."""

    hot: np.ndarray          # sorted hashes of hot words
    hot_count: np.ndarray
    customers: np.ndarray    # per context restaurant
    n: int
    v: int
    discount: float
    root_discount: float

    def root_share(self, sweep: Totals) -> float:
        return (STRENGTH + self.root_discount * sweep.root_tables) / (self.v + 1)


class Bucket:
    """All pairs of one bucket, and the chunks they came from."""

    def __init__(self, rows: list[Row]):
        rows = sorted(rows, key=lambda r: r.chunk)
        self.number = rows[0].bucket
        self.chunks = [r.chunk for r in rows]
        words = [np.frombuffer(bytes(r.words), np.uint64) for r in rows]
        self.n_words = [len(w) for w in words]
        per = [read_ints(bytes(r.per_word)) for r in rows]
        word = np.concatenate([np.repeat(w, n) for w, n in zip(words, per)])
        context = np.concatenate([np.frombuffer(bytes(r.contexts), np.uint16) for r in rows])
        trained = np.concatenate([read_ints(bytes(r.trained)) for r in rows])
        self.n_pairs = [int(n.sum()) for n in per]
        self.per = per
        self.key, first, self.of_entry = distinct(pair_keys(word, context))
        self.context = context[first].astype(np.int64)
        self.c = np.bincount(self.of_entry, weights=trained, minlength=len(first)).astype(np.int64)
        self.word, _, self.of_word = distinct(word[first])
        self.count = np.bincount(self.of_word, weights=self.c, minlength=len(self.word)).astype(np.int64)

    def root_customers(self, t: np.ndarray, model: Model, sweep: Totals | None) -> np.ndarray:
        c0 = np.bincount(self.of_word, weights=t, minlength=len(self.word)).astype(np.int64)
        if sweep is not None and len(model.hot):
            at = find(model.hot, self.word)
            c0 = np.where(at >= 0, sweep.hot[at], c0)
        return c0

    def sweeps(self, model: Model, done: list[Totals]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(t, c0, t0) after the start and after each sweep whose predecessor's totals are known."""
        t = np.minimum(self.c, 1)
        for k in range(len(done) + 1):
            if k:
                before = done[k - 1]
                p0 = root_probability(model, before, c0, t0)
                b = (STRENGTH + model.discount * (before.tables[self.context] - t)) * p0[self.of_word]
                t = draw_tables(self.c, b, model.discount, self.key, k)
            c0 = self.root_customers(t, model, done[k] if k < len(done) else None)
            t0 = root_tables(model, done[k - 1] if k else None, c0, t0 if k else None, self.word, k)
            yield t, c0, t0


def root_tables(model: Model, before: Totals | None, c0: np.ndarray, t0: np.ndarray | None, word: np.ndarray, k: int) -> np.ndarray:
    if before is None:
        return np.minimum(c0, 1)
    b0 = (STRENGTH + model.root_discount * (before.root_tables - t0)) / (model.v + 1)
    return draw_tables(c0, b0, model.root_discount, word, k)


def root_probability(model: Model, sweep: Totals, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
    return (c0 - model.root_discount * t0 + model.root_share(sweep)) / (STRENGTH + sweep.tables.sum())


def _buckets(rows: Iterator[Row]) -> Iterator[Bucket]:
    mine: dict[int, list] = {}
    for r in rows:
        mine.setdefault(r.bucket, []).append(r)
    for key in sorted(mine):
        yield Bucket(mine.pop(key))


def _add(a: dict, b: dict) -> dict:
    return {k: a[k] + b[k] for k in a}


def _count(rows: Iterator[Row], hot: np.ndarray) -> Iterator[dict]:
    """Totals of the starting state: one table per pair."""
    out = {"customers": np.zeros(RESTAURANTS, np.int64), "tables": np.zeros(RESTAURANTS, np.int64), "hot_count": np.zeros(len(hot), np.int64),
           "hot": np.zeros(len(hot), np.int64), "v": 0, "ones": np.zeros(4, np.int64)}
    for b in _buckets(rows):
        out["customers"] += np.bincount(b.context, weights=b.c, minlength=RESTAURANTS).astype(np.int64)
        t = np.minimum(b.c, 1)
        out["tables"] += np.bincount(b.context, weights=t, minlength=RESTAURANTS).astype(np.int64)
        c0 = np.bincount(b.of_word, weights=t, minlength=len(b.word)).astype(np.int64)
        at = find(hot, b.word)
        np.add.at(out["hot_count"], at[at >= 0], b.count[at >= 0])
        np.add.at(out["hot"], at[at >= 0], c0[at >= 0])
        cold = at < 0
        out["v"] += int((b.count[cold] > 0).sum())
        out["ones"] += [(b.c == 1).sum(), (b.c == 2).sum(), (c0[cold] == 1).sum(), (c0[cold] == 2).sum()]
    yield out


def _sweep(rows: Iterator[Row], model: Model, done: list[Totals]) -> Iterator[dict]:
    out = {"tables": np.zeros(RESTAURANTS, np.int64), "hot": np.zeros(len(model.hot), np.int64), "root_tables": 0}
    for b in _buckets(rows):
        for t, c0, t0 in b.sweeps(model, done):
            pass
        out["tables"] += np.bincount(b.context, weights=t, minlength=RESTAURANTS).astype(np.int64)
        at = find(model.hot, b.word)
        np.add.at(out["hot"], at[at >= 0], c0[at >= 0])
        out["root_tables"] += int(t0[at < 0].sum())
    yield out


def _reply(rows: Iterator[Row], model: Model, done: list[Totals]) -> Iterator[tuple]:
    """For each chunk the averaged log10 probability of its pairs, and its words' training counts."""
    for b in _buckets(rows):
        total = np.zeros(len(b.c))
        # All sweeps are done: the last one too has the hot words' root customers of all buckets.
        for k, (t, c0, t0) in zip(range(len(done)), b.sweeps(model, done)):
            if k > BURN_IN:
                p0 = root_probability(model, done[k], c0, t0)[b.of_word]
                u = b.context
                total += (b.c - model.discount * t + (STRENGTH + model.discount * done[k].tables[u]) * p0) / (STRENGTH + model.customers[u])
        log_p = np.log10(total / SAMPLES).astype(np.float32)[b.of_entry]
        at = find(model.hot, b.word)
        known = np.where(at >= 0, model.hot_count[at], b.count) if len(model.hot) else b.count
        word = known[b.of_word][b.of_entry]
        start = 0
        for chunk, n, per in zip(b.chunks, b.n_pairs, b.per):
            first = start + np.cumsum(per) - per
            yield chunk, b.number, bytearray(log_p[start:start + n].tobytes()), bytearray(small_ints(word[first]))
            start += n


# --- the operator ----------------------------------------------------------------------

def score_documents(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Learns from documents whose crc32(doc_id as text) modulo ``folds`` is not
    ``fold``, over all their tokens; a null doc_id counts as the empty text, a
    null text is empty (one end token).  Repeated rows count as often as they
    occur.  Without training tokens every token is unknown.

    Documents are grouped once by a hash of doc_id; both passes over the texts
    read that one shuffle.  Each group sends its distinct pairs to the model's
    buckets, which stay in place while the sweeps run; the driver sees sums of
    fixed size only.  A word of over 1/1024 of all tokens (at most 1024 words)
    is split over buckets by its contexts.
    """
    spark = docs.sparkSession
    size = max(1, total_bytes(docs))
    chunks, buckets = max(8, power_of_two(size / CHUNK_BYTES)), max(4, power_of_two(size / BUCKET_BYTES))
    rows = texts(docs).select("doc_id", "text", (crc32_mod("doc_id", folds) == fold).alias("held_out"),
                              F.pmod(F.hash("doc_id", F.length("text")), F.lit(chunks)).cast("int").alias("chunk"))
    grouped = rows.repartition(chunks, "chunk").rdd

    def weigh(part: Iterator[Row]) -> Iterator[tuple]:
        for number, mine in _documents(part).items():
            c = tokens([d[2] for d in mine])
            train = np.repeat(np.array([not d[3] for d in mine]), c.count)
            word, n = np.unique(c.word[train], return_counts=True)
            yield None, int(n.sum())
            for w, k in zip(word[n * HOT_SHARE >= max(1, n.sum())].view(np.int64).tolist(), n[n * HOT_SHARE >= max(1, n.sum())].tolist()):
                yield w, k

    weighed = spark.createDataFrame(grouped.mapPartitions(weigh), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = weighed.where("word is null").agg(F.sum("n")).first()[0] or 0
    found = weighed.where("word is not null").where(F.col("n") * HOT_SHARE >= n).collect()  # HOT_SHARE rows at most
    hot = np.sort(np.array([r.word for r in found], np.int64).view(np.uint64))

    posted = spark.createDataFrame(grouped.mapPartitions(lambda part: _post(part, buckets, hot)), POSTED).repartition(buckets, "bucket").rdd
    counted = posted.mapPartitions(lambda part: _count(part, hot)).treeReduce(_add)
    one, two, root_one, root_two = counted["ones"].tolist()
    model = Model(hot, counted["hot_count"], counted["customers"], n, counted["v"] + int((counted["hot_count"] > 0).sum()),
                  _discount(one, two), _discount(root_one, root_two))
    done = [Totals(counted["tables"], counted["v"] + int((counted["hot"] > 0).sum()), counted["hot"])]
    hot_t0 = np.minimum(done[0].hot, 1)
    for k in range(1, BURN_IN + SAMPLES + 1):
        sent = spark.sparkContext.broadcast((model, list(done)))  # a few MB at any input size
        swept = posted.mapPartitions(lambda part: _sweep(part, *sent.value)).treeReduce(_add)
        hot_t0 = root_tables(model, done[-1], swept["hot"], hot_t0, hot, k) if len(hot) else hot_t0
        done.append(Totals(swept["tables"], swept["root_tables"] + int(hot_t0.sum()), swept["hot"]))

    sent = spark.sparkContext.broadcast((model, done))
    answers = spark.createDataFrame(posted.mapPartitions(lambda part: _reply(part, *sent.value)), "chunk int, bucket int, log_p binary, counts binary")
    answers = answers.repartition(chunks, "chunk").rdd
    pairs = _whole(grouped).zip(_whole(answers))
    scored = pairs.flatMap(lambda x: _score(*x, buckets, hot))
    out = spark.createDataFrame(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("base") - F.col("n_tokens") * float(np.log10(n + model.v + 1))).alias("base_score"), "score")


def _discount(one: int, two: int) -> float:
    """From how many counts are one and two, kept inside (0, 1)."""
    return float(min(0.95, max(0.05, one / (one + 2 * two)))) if one else 0.5


def _whole(rdd: RDD) -> RDD:
    """Each partition as one element, so that two sets of partitions can be paired."""
    return rdd.mapPartitions(lambda part: [list(part)])


def _score(rows: list[Row], answers: list[Row], buckets: int, hot: np.ndarray) -> Iterator[tuple]:
    replies: dict[int, list] = {}
    for a in answers:
        replies.setdefault(a.chunk, []).append(a)
    for number, docs in _documents(iter(rows)).items():
        chunk = tokens([d[2] for d in docs])
        held = np.array([d[3] for d in docs])
        p = distinct_pairs(chunk, held, buckets, hot)
        mine = sorted(replies[number], key=lambda a: a.bucket)
        log_p = np.concatenate([np.frombuffer(bytes(a.log_p), np.float32) for a in mine]).astype(np.float64)
        counts = np.concatenate([read_ints(bytes(a.counts)) for a in mine])
        word_of = np.cumsum(np.r_[True, (p.word[1:] != p.word[:-1]) | (p.bucket[1:] != p.bucket[:-1])]) - 1
        c = counts[word_of][p.of_token]
        at = np.cumsum(chunk.count) - chunk.count
        score = np.add.reduceat(log_p[p.of_token], at)
        base = np.add.reduceat(np.log10(c + 1.0), at)
        known = np.add.reduceat((c > 0).astype(np.int64), at)
        for (null, doc, _, out), n, k, b, s in zip(docs, chunk.count.tolist(), known.tolist(), base.tolist(), score.tolist()):
            yield None if null else doc, out, n, k, b, s
