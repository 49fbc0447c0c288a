"""Conversation structure repair: cheapest edits to ``(s?(ua)+)?``, found with Four-Russians block tables.

Roles are read through an automaton of four states.  The cost of finishing
from each state, less the smallest of them, is a vector of which there are few;
a table gives, for every such vector and every block of four symbols, the
vector before the block and what it adds.  Blocks are looked up from the
conversation's end; then each block is expanded backward from the vector behind
it, and at each row the ASCII-least letter among the cheapest is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealerlens.llm.common import save

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
S, U, A, OTHER = range(4)                 # classes of a role's first letter
GOOD, BLANK, DUPLICATE, CUT = range(4)    # a row's first fault
START, AFTER_S, AFTER_U, AFTER_A = range(4)  # states; START and AFTER_A may end
SYMBOLS = 9  # 0: a row that must go; 1 + 2 * class + truncated: any other
WANTED = (U, U, A, U)                     # what insert or rerole can make in each state
NEXT = {(START, S): AFTER_S, (START, U): AFTER_U, (AFTER_S, U): AFTER_U, (AFTER_U, A): AFTER_A, (AFTER_A, U): AFTER_U}
ROLE = {U: "user", A: "assistant"}
_FAR = 1 << 20

Costs = tuple[int, int, int, int]


def _with_inserts(v: list[int]) -> Costs:
    for _ in range(2):  # two inserts lead through every state that one can be needed for
        v = [min(v[s], INSERT + v[NEXT[s, WANTED[s]]]) for s in range(4)]
    return tuple(v)


AT_END: Costs = _with_inserts([0, _FAR, _FAR, 0])


def choices(symbol: int, state: int, after: Costs) -> Iterator[tuple[str, int, int]]:
    """(letter, cost to the end, next state) of what can be done with a row, in ASCII order; inserts are apart."""
    yield "D", DELETE + after[state], state
    if symbol:
        kind, late = (symbol - 1) // 2, TRUNCATED * ((symbol - 1) % 2)
        if (state, kind) in NEXT:
            yield "K", KEEP + late + after[NEXT[state, kind]], NEXT[state, kind]
        made = NEXT[state, WANTED[state]]
        yield "R", REROLE + late + after[made], made


@cache
def before(symbol: int, after: Costs) -> Costs:
    """Costs to the end in front of a row, from those behind it."""
    return _with_inserts([min(c for _, c, _ in choices(symbol, s, after)) for s in range(4)])


@cache
def block_tables() -> tuple[list[Costs], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All normalised vectors; for one symbol and for a whole block: the vector in front and the cost added."""
    vectors, place = [AT_END], {AT_END: 0}
    to, add = [], []
    for v in vectors:  # grows while it is read
        line, more = [], []
        for c in range(SYMBOLS):
            w = before(c, v)
            low = min(w)
            w = tuple(x - low for x in w)
            if w not in place:
                place[w] = len(vectors)
                vectors.append(w)
            line.append(place[w])
            more.append(low)
        to.append(line)
        add.append(more)
    one_to, one_add = np.array(to, np.int32), np.array(add, np.int32)
    all_to, all_add = one_to, one_add
    for _ in range(BLOCK - 1):  # one more symbol in front of the block
        block_to = one_to[all_to]  # vector, block, new first symbol
        block_add = all_add[:, :, None] + one_add[all_to]
        all_to = block_to.transpose(0, 2, 1).reshape(len(vectors), -1)
        all_add = block_add.transpose(0, 2, 1).reshape(len(vectors), -1)
    return vectors, one_to, one_add, all_to, all_add


def cheapest(symbols: np.ndarray) -> tuple[int, str]:
    """Least cost of a conversation and its audit: the letters of the edits in order, ties ASCII-least."""
    vectors, one_to, one_add, block_to, block_add = block_tables()
    lead = len(symbols) % BLOCK
    code = np.zeros(len(symbols) // BLOCK, np.int64)
    for j in range(BLOCK):
        code = code * SYMBOLS + symbols[lead + j::BLOCK][:len(code)]
    v, cost, behind = 0, 0, []
    for c in code[::-1].tolist():
        behind.append(v)
        cost += int(block_add[v, c])
        v = int(block_to[v, c])
    behind.reverse()
    parts = [(symbols[:lead], v)] + [(symbols[lead + BLOCK * i:lead + BLOCK * (i + 1)], b) for i, b in enumerate(behind)]
    for c in symbols[:lead][::-1].tolist():
        cost += int(one_add[v, c])
        v = int(one_to[v, c])
    cost += vectors[v][START]
    state, audit = START, []
    for part, v in parts:
        part = part.tolist()
        inner = [vectors[v]]
        for c in reversed(part):  # expand the block backward from what is behind it
            inner.append(before(c, inner[-1]))
        for i, c in enumerate(part):
            here, after = inner[len(part) - i], inner[len(part) - i - 1]
            while True:
                can = [(x, s) for x, w, s in choices(c, state, after) if w == here[state]]
                step = NEXT[state, WANTED[state]]
                if here[state] == INSERT + here[step]:
                    can.append(("I", step))
                letter, state = min(can)
                audit.append(letter)
                if letter != "I":
                    break
    while AT_END[state]:
        audit.append("I")
        state = NEXT[state, WANTED[state]]
    return cost, "".join(audit)


# --- rows and their faults ----------------------------------------------------

_WHITE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) damaged by crc32(``conv_id:turn``) % 20; nulls of role and text become one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(F.encode(name, "UTF-8")) % 20).alias("_d"))
    d = d.where("_d <> 0")
    text = F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, rid, turn, role, text, kind, fault): rows in ranges of (conv_id, turn, role, text), numbered across them.

    Rows of a long conversation lie in several ranges.  Ties of a turn are in
    order of role and text; equal rows may change places, which changes nothing.
    """
    d = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    d = d.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "_tie"]
    d = d.repartitionByRange(*keys).sortWithinPartitions(*keys)
    said = F.rtrim("text", F.lit(_WHITE))
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(OTHER)
    fault = F.when(said == "", BLANK).when(F.substring(said, -1, 1).isin(".", "!", "?"), GOOD).otherwise(CUT)
    return d.select("conv_id", F.monotonically_increasing_id().alias("rid"), "turn", "role", "text", kind.alias("kind"), fault.alias("fault"))


def _codes(rows: DataFrame) -> DataFrame:
    """Per conversation and range: (conv_id, rid of its first row, codes); a code is one hexadecimal digit, 4 * class + fault."""
    same = F.unhex(F.md5(F.concat(F.encode("role", "UTF-8"), F.unhex(F.lit("00")), F.encode("text", "UTF-8"))))
    slim = rows.select("conv_id", "rid", "kind", "fault", same.alias("said"))
    # Only what is said twice in a conversation comes back: one row a key, combined before the shuffle.
    twice = (slim.where(F.col("fault") != BLANK).groupBy("conv_id", "said").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("conv_id").alias("_c"), F.col("said").alias("_s"), "first"))
    found = slim.join(twice, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("said") == F.col("_s")), "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("rid") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    code = F.lower(F.hex((4 * F.col("kind") + fault).cast("long")))
    part = found.groupBy("conv_id", F.shiftright("rid", 33).alias("part")).agg(F.min("rid").alias("rid"), F.sort_array(F.collect_list(F.struct("rid", code.alias("code")))).alias("c"))
    return part.select("conv_id", "rid", F.array_join(F.transform("c", lambda x: x["code"]), "").alias("codes"))


FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _solve(parts: list[dict]) -> tuple[tuple, list[tuple[int, str]]]:
    """Counts, cost and audit of a conversation, and each range's share of the audit by the rid it starts at."""
    parts = sorted(parts or [], key=lambda p: p["rid"])
    codes = np.frombuffer("".join(p["codes"] for p in parts).encode(), np.uint8)
    codes = np.where(codes >= 97, codes - 87, codes - 48).astype(np.int64)
    kind, fault = codes // 4, codes % 4
    must_go = (fault == BLANK) | (fault == DUPLICATE)
    cost, audit = cheapest(np.where(must_go, 0, 1 + 2 * kind + (fault == CUT)))
    a, b = kind[:-1], kind[1:]
    legal = ((a == S) & (b == U)) | ((a == U) & (b == A)) | ((a == A) & (b == U))
    counts = tuple(int((fault == f).sum()) for f in (BLANK, DUPLICATE, CUT))
    ends = np.flatnonzero(np.frombuffer(audit.encode(), np.uint8) != ord("I")) + 1  # after each row's own letter
    shares, at, row = [], 0, 0
    for i, p in enumerate(parts):
        row += len(p["codes"])
        to = len(audit) if i == len(parts) - 1 else int(ends[row - 1])
        shares.append((p["rid"], audit[at:to]))
        at = to
    return (*counts, int((~legal).sum()), cost, audit), shares


def repairs(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: gaps, counts of faults, cost, audit, and ``shares`` for :func:`repaired`.

    A conversation's codes are one byte a row, no more than its audit.  Null
    conv_ids are one conversation.
    """
    turns = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    parts = _codes(rows).groupBy("conv_id").agg(F.collect_list(F.struct("rid", "codes")).alias("parts"))
    key = conversations.select("conv_id").distinct()
    all_ = key.join(turns.withColumnRenamed("conv_id", "_a"), F.col("conv_id").eqNullSafe(F.col("_a")), "left") \
        .join(parts.withColumnRenamed("conv_id", "_b"), F.col("conv_id").eqNullSafe(F.col("_b")), "left") \
        .select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), "parts")
    kind = all_.schema["conv_id"].dataType.simpleString()
    share = pa.list_(pa.struct([("rid", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            solved = [_solve(p) for p in b.column(2).to_pylist()]
            counts = list(zip(*(x for x, _ in solved))) or [()] * 6
            columns = [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in counts[:5]), pa.array(counts[5], pa.string()),
                       pa.array([[{"rid": r, "audit": a} for r, a in s] for _, s in solved], share)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", *(c.split()[0] for c in FOUND.split(", ")), "shares"])

    return all_.mapInArrow(run, f"conv_id {kind}, {FOUND}, shares array<struct<rid:long,audit:string>>")


class _Reader:
    """Follows one conversation through its shares of the audit and its rows."""

    def __init__(self):
        self.audit, self.at, self.state = "", 0, START

    def share(self, audit: str) -> None:
        self.audit, self.at = audit, 0

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            made = WANTED[self.state]
            self.state = NEXT[self.state, made]
            yield "I", ROLE[made], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        made = WANTED[self.state] if letter == "R" else {"s": S, "u": U, "a": A}[role[0]]
        self.state = NEXT[self.state, made]
        yield letter, ROLE[made] if letter == "R" else role, text


def _streamed(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Each conversation's rows in order in one task, each range's share of the audit in front of them; nothing is gathered."""
    shares = solved.select("conv_id", F.explode("shares").alias("s")).select("conv_id", F.col("s.rid").alias("rid"), F.lit(None).cast("string").alias("role"), F.col("s.audit").alias("text"), F.lit(0).alias("step"))
    both = rows.select("conv_id", "rid", "role", "text", F.lit(1).alias("step")).unionAll(shares)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "rid", "step")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str, str]], bool]]:
    """(conv_id, edits that the next row leads to, whether the conversation ends there)."""
    key, reader = object(), None
    for b in batches:
        for conv, role, text, step in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
            if reader is None or conv != key:
                if reader:
                    yield key, list(reader.inserts()), True
                key, reader = conv, _Reader()
            if step:
                yield key, list(reader.row(role, text)), False
            else:
                reader.share(text)
    if reader:
        yield key, list(reader.inserts()), True


def repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    conv_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def run(batches):
        out, position = [], 0
        for key, edits, ends in _walk(batches):
            for edit in edits:
                out.append((key, position, *edit))
                position += 1
            position = 0 if ends else position
            if len(out) >= 1000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "position", "edit", "role", "text"])

    return _streamed(rows, solved).mapInArrow(run, f"conv_id {kind}, position long, edit string, role string, text string")


def _digests(rows: DataFrame, solved: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    conv_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def run(batches):
        keys, found, digest, line = [], [], hashlib.sha256(), b""
        for key, edits, ends in _walk(batches):
            for _, role, text in edits:
                digest.update(line + f"{role}:{text}".encode())
                line = b"\n"
            if ends:
                keys.append(key)
                found.append(digest.hexdigest())
                digest, line = hashlib.sha256(), b""
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, conv_type), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])

    return _streamed(rows, solved).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def digest_repairs(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """Per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of its repaired rows.

    Null role and text are one space; a null turn comes first; null conv_ids
    are one conversation; other columns are dropped; rows that repeat are rows
    (the later ones duplicates); rows of one turn are in order of role and
    text.  A conversation without rows has zeros, an empty audit and the empty
    text's digest.  An empty table has no rows.
    """
    base = conversations.select("conv_id", "turn", "role", "text")
    rows = save(ordered(damaged(base) if damage else base), "turn-rows")
    solved = save(repairs(rows, base), "turn-repairs")
    digests = _digests(rows, solved).withColumnRenamed("conv_id", "_c")
    empty = F.lit(hashlib.sha256().hexdigest())
    return (solved.join(digests, F.col("conv_id").eqNullSafe(F.col("_c")), "left")
            .select("conv_id", *(c.split()[0] for c in FOUND.split(", ")), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")))
