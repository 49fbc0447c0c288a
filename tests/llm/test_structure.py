"""Suffix-array dedup, conversation repair and periodic runs, held against brute force."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealerlens.llm import lyndon_dedup as ld
from dealerlens.llm import periodic_runs as pr
from dealerlens.llm import turn_repair as tr
from dealerlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def rows_of(df, key):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r[key] is not None, r[key] or 0))


# --- suffix-array dedup -------------------------------------------------------

def covered(texts: dict) -> dict:
    """doc → runs of bytes that a 200-byte string covers which starts twice."""
    count = Counter(x[i:i + 200] for x in texts.values() for i in range(len(x) - 199))
    out = {}
    for k, x in texts.items():
        gone = bytearray(len(x))
        for i in range(len(x) - 199):
            if count[x[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        out[k] = [m.span() for m in re.finditer(rb"\x01+", bytes(gone))]
    return out


def check_digest(got: list[dict], texts: dict):
    want = covered(texts)
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        x, runs = texts[r["doc_id"]], want[r["doc_id"]]
        kept = ld.cut(x, runs)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(x), len(x) - len(kept), len(runs)), r
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_suffix_order_equals_sorting():
    rng = random.Random(2)
    for _ in range(800):
        s = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(50))] * rng.choice([1, 1, 2])
        assert ld.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_lyndon_groups_hold_equal_lyndon_prefixes():
    s = [ord(c) for c in "acedcebceece"]
    groups, previous, _ = ld.lyndon_groups(s)
    smaller = [max((j for j in range(i) if s[j:] < s[i:]), default=-1) for i in range(len(s))]
    assert previous == smaller
    ends = [min((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), default=len(s)) for i in range(len(s))]
    prefix = [[s[i:ends[i]] for i in g] for g in groups]
    assert all(len({tuple(p) for p in g}) == 1 for g in prefix)
    assert [g[0] for g in prefix] == sorted((g[0] for g in prefix), reverse=True)


def odd_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(150))) for _ in range(4)]
    base += ["a" * rng.randrange(700), "ab " * rng.randrange(300), "\0" * rng.randrange(500), "é" * 150]
    out = []
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randrange(3)):
            p = rng.randrange(len(x) + 1)
            x = rng.choice([x[:p] + rng.choice("abcxyz") + x[p + 1:], x[:p] + rng.choice(base) + x[p:], x[p:]])
        out.append(x)
    return out


@pytest.mark.parametrize("heavy", [1 / 2000, 1e-9])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(ld, "HEAVY", heavy)
    monkeypatch.setattr(ld, "BUCKET_BYTES", 4000)
    texts = odd_texts(7, 60) + ["", "short", "the one text " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5)
    check_digest(rows_of(ld.digest_bytes(docs), "doc_id"), {i: x.encode() for i, x in enumerate(texts)})


def test_pieces_of_long_texts_hold_every_window(spark, monkeypatch):
    rng = random.Random(4)
    body = "".join(rng.choice("abcdef ") for _ in range(4000))
    texts = [body, "x" + body[500:2500], body[1000:1199], body[1000:1200]]
    monkeypatch.setattr(ld, "PIECE", 300)
    chunk = ld._Chunk(0)
    for batch in ld._batches((i, 0, x.encode()) for i, x in enumerate(texts)):
        for i, first, n, key, anchor in ld.regions([(w[2], x) for w, x in batch], np.zeros(0, np.uint64)):
            doc, mark, at = batch[i][0]
            chunk.add((doc, mark, at + first), n, key, anchor, batch[i][1][first:first + n + 199])
    spans = ld._reduce_bucket([r for b in chunk.send() for r in b.to_pylist()])
    want = covered({i: x.encode() for i, x in enumerate(texts)})
    for i in want:
        assert ld.removed_runs([{"start": s, "n": n} for d, _, s, n in spans.tolist() if d == i]) == want[i]


def test_dedup_of_nulls_repeats_and_other_columns(spark):
    long = "some words that are said twice in this corpus " * 6
    rows = [(1, long, "a"), (1, long, "b"), (None, None, None), (None, "alone " + "z" * 90, "c"), (3, None, "d"), (3, "x" + long[5:], "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = rows_of(ld.digest_bytes(docs), "n_bytes")
    # A row that is there twice is one document; its own text repeats itself every 46 bytes all the same.
    want = covered({"one": long.encode(), "part": ("x" + long[5:]).encode()})
    assert len(got) == 6
    assert [r["n_removed"] for r in got if r["doc_id"] == 1] == [sum(b - a for a, b in want["one"])] * 2
    assert [r["n_bytes"] for r in got if r["doc_id"] is None] == [0, 96]
    only = spark.createDataFrame([(5, "q" + "unlike " * 20 + "w" * 150)] * 2, DOCS)
    assert [r.n_removed for r in ld.digest_bytes(only).collect()] == [0, 0]
    assert ld.digest_bytes(docs.where("false")).collect() == []
    kept = {r["doc_id"]: r for r in rows_of(ld.kept_bytes(docs.where("doc_id = 3 and text is not null").unionAll(docs.where("doc_id = 1"))), "doc_id")}
    assert bytes(kept[3]["kept"]) == ld.cut(("x" + long[5:]).encode(), want["part"])


def test_op11_on_the_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_digest(rows_of(QUERIES["op11_lyndon_dedup"](spark, SMALL), "doc_id"), {r.doc_id: (r.text or "").encode() for r in docs.collect()})


# --- conversation repair ------------------------------------------------------

STEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
MADE = {0: 2, 1: 2, 2: 3, 3: 2}


def best_edits(symbols) -> tuple[int, str]:
    """Least (cost, audit) by a plain search over rows and states."""
    queue, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, s = heapq.heappop(queue)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(symbols):
            if s in (0, 3):
                return cost, audit
        else:
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, s))
            if symbols[i]:
                kind, late = divmod(symbols[i] - 1, 2)
                if (s, kind) in STEP:
                    heapq.heappush(queue, (cost + late, audit + "K", i + 1, STEP[s, kind]))
                heapq.heappush(queue, (cost + 2 + late, audit + "R", i + 1, MADE[s]))
        heapq.heappush(queue, (cost + 2, audit + "I", i, MADE[s]))


def test_block_tables_find_the_least_audit():
    rng = random.Random(1)
    cases = [list(c) for n in range(4) for c in itertools.product(range(9), repeat=n)]
    cases += [[rng.randrange(9) for _ in range(rng.randrange(4, 15))] for _ in range(600)]
    for c in cases:
        assert tr.cheapest(np.array(c, np.int64)) == best_edits(c), c


SPACE = "[^\x20\x09-\x0D]"


def repair_plainly(rows: list[tuple], damage: bool = True) -> dict:
    """conv_id → expected columns, from (conv_id, turn, role, text) rows, by plain loops."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if x is None else x for x in (role, text))
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            d = zlib.crc32(name.encode()) % 20 if damage else 9
            if d == 0:
                continue
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            after += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        said, faults, symbols = set(), [], []
        for _, role, text in after:
            shown = re.findall(SPACE, text)
            fault = "blank" if not shown else "duplicate" if (role, text) in said else "" if shown[-1] in ".!?" else "truncated"
            said.add((role, text))
            faults.append(fault)
            symbols.append(0 if fault in ("blank", "duplicate") else 1 + 2 * "sua ".find(role[:1] if role[:1] in tuple("sua") else " ") + (fault == "truncated"))
        cost, audit = best_edits(symbols)
        lines, left, state = [], iter(after), 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(left)[1:]
            if letter == "D":
                continue
            state = MADE[state] if letter in "IR" else STEP[state, "sua".index(role[0])]
            lines.append(f"{role if letter == 'K' else 'user' if state == 2 else 'assistant'}:{text}")
        turns = [t for t, *_ in after if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:])]
        out[conv] = {"conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
                     "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def check_repairs(got: list[dict], rows: list[tuple], damage: bool = True):
    want = repair_plainly(rows, damage)
    assert len(got) == len(want)
    for r in got:
        assert r == want[r["conv_id"]]


def odd_conversations(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n", None, "Ends. ", "end.\x0b", "a\x85", "..."]
    return [(rng.choice([None, *range(n)]), rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool", "User", "uther"]), rng.choice(texts)) for _ in range(12 * n)]


def test_repairs_equal_plain_loops(spark):
    rows = odd_conversations(3, 40)
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(4)
    check_repairs(rows_of(tr.digest_repairs(frame), "conv_id"), rows)
    check_repairs(rows_of(tr.digest_repairs(frame, damage=False), "conv_id"), rows, damage=False)


def test_long_conversation_lies_in_several_ranges(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"said {t}", f"Said {t}."])) for t in range(900)] + [(2, 0, "user", "Hi.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rid", F.lit(0))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        assert tr.ordered(frame).where("conv_id = 1").select(F.shiftright("rid", 33)).distinct().count() > 1
        check_repairs(rows_of(tr.digest_repairs(frame), "conv_id"), rows)
    finally:
        spark.conf.set(setting, before)


def test_repaired_rows_fit_the_structure(spark):
    rows = odd_conversations(5, 25)
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    kept = tr.save(tr.ordered(frame), "t-rows")
    solved = tr.save(tr.repairs(kept, frame), "t-solved")
    out: dict = {}
    for r in sorted(tr.repaired(kept, solved).collect(), key=lambda r: r.position):
        out.setdefault(r.conv_id, []).append(r)
    audits = {r.conv_id: r.audit for r in solved.collect()}
    for conv, found in out.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in found))
        assert "".join(r.edit for r in found) == audits[conv].replace("D", "")
        assert [r.position for r in found] == list(range(len(found)))


def test_repairs_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert tr.digest_repairs(empty).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check_repairs(rows_of(tr.digest_repairs(spark.createDataFrame([(gone, 0, "user", "x")], empty.schema)), "conv_id"), [(gone, 0, "user", "x")])


def test_op12_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_repairs(rows_of(QUERIES["op12_turn_repair"](spark, SMALL), "conv_id"), rows)


# --- periodic runs ------------------------------------------------------------

def runs_plainly(words: list) -> list[tuple]:
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            seen = words[start:start + length]
            if j > i and length >= max(24, 3 * q) and not any(all(seen[x] == seen[x + r] for x in range(length - r)) for r in range(1, q)):
                out.append((start, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(1)
    docs = []
    for _ in range(400):
        n, k = rng.choice([0, 1, 23, 24, 25, 60, 130]), rng.choice([1, 2, 2, 3, 20])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 10 and rng.random() < .7:
            a, p = rng.randrange(n), 1 + rng.randrange(n // 3)
            w = w[:a] + [w[a + (i - a) % p] if a + (i - a) % p < n else 0 for i in range(a, n)]
        docs.append(w)
    for at in range(0, len(docs), 40):
        assert pr.find_runs(docs[at:at + 40]) == [runs_plainly(w) for w in docs[at:at + 40]]


def digest_plainly(doc_id, words: list[bytes]) -> dict:
    runs = runs_plainly(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return {"doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
            "exponent_milli": best[2] and 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()}


def planted_plainly(doc_id, text) -> list[bytes]:
    words = [m.encode() for m in re.findall(SPACE + "+", text or "")]
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_op13_on_the_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 4000}
    got = {r["doc_id"]: r for r in rows_of(QUERIES["op13_periodic_runs"](spark, SMALL), "doc_id")}
    assert len(got) == len(docs)
    for k, text in short.items():
        assert got[k] == digest_plainly(k, planted_plainly(k, text))
    assert any(got[k]["n_runs"] for k in short)


def test_runs_of_nulls_repeats_and_other_columns(spark):
    same = "go on " * 30
    rows = [(1, same, 1), (1, same, 2), (None, same, 3), (2, None, 4), (3, "", 5), (4, "a\tb\x0bc\n" * 9 + "é", 6), (5, "x " * 23, 7), (6, "x " * 24, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    got = sorted(pr.digest_runs(docs).collect(), key=str)
    want = sorted((digest_plainly(i, [w.encode() for w in re.findall(SPACE + "+", t or "")]) for i, t, _ in rows), key=lambda r: str(tuple(r.values())))
    assert sorted(str(r.asDict()) for r in got) == sorted(str(r) for r in want)
    assert pr.digest_runs(docs.where("false")).collect() == []
    texts = {r.doc_id: r.text for r in pr.collapsed_texts(docs).collect()}
    assert texts[1] == "go on" and texts[4] == "a b c é" and texts[2] == ""
    assert [tuple(x) for x in pr.periodic_runs(docs.where("doc_id = 6")).first().runs] == [(0, 24, 1)]


# --- Round 3 -------------------------------------------------------------------------

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_compact_joins_paths_without_a_join(spark):
    """Touching paths of one line become one; rows that repeat a doc_id may repeat or overlap paths, which left spans without an end."""
    from dealerlens.llm.debruijn import compact

    paths = [(1, 0, 2, 9, 5), (1, 0, 2, 9, 5), (1, 2, 2, 9, 7), (1, 4, 1, 9, 9), (1, 6, 1, 9, 11), (1, 7, 2, 8, 0), (1, 8, 3, 8, 1), (2, 5, 1, 9, 5), (2, 6, 1, 9, 7)]
    spans = compact(spark.createDataFrame(paths, "doc long, start int, n int, src long, src_start int"))
    plan = plan_of(spans)
    assert "Join" not in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, spans.collect())) == [(1, 0, 5, 9, 5), (1, 6, 1, 9, 11), (1, 7, 4, 8, 0), (2, 5, 1, 9, 5), (2, 6, 1, 9, 7)]


@pytest.mark.parametrize("keys", [[], [0, 7, -3, 2**62, 500], list(range(0, 200_000, 37))])
def test_possibly_in_keeps_all_keys_and_few_others(spark, keys):
    from dealerlens.llm.common import possibly_in, save

    ids = save(spark.createDataFrame([(k,) for k in keys], "id long"), "keys")
    rows = spark.range(100_000).unionAll(spark.createDataFrame([(k,) for k in (-3, -4, 2**62, None)], "id long"))
    found = {r[0] for r in possibly_in(rows, "id", ids).collect()}
    there = set(range(100_000)) | {-3, -4, 2**62}
    assert set(keys) & there <= found
    assert len(found - set(keys)) <= 0.1 * 100_000
    assert possibly_in(rows, "id", ids).columns == ["id"]


def test_only_wanted_texts_are_shuffled(spark, monkeypatch):
    """Texts of documents that are in no candidate pair are dropped before the exchange."""
    from dealerlens.llm import jaccard_join as jj
    from dealerlens.llm.common import save

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "doc_id long, text string")
    homes = save(spark.createDataFrame([(1, 5), (2, 7)], "sid long, home long"), "homes")
    plans = []
    monkeypatch.setattr(jj, "save_by_key", lambda df, *_: plans.append(plan_of(df)) or "none")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        jj.sets_of(docs, homes)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plans[0].splitlines()
    joined = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    assert any("BroadcastHashJoin" in x and "getbit" in x for x in lines[joined:]), plans[0]
