"""BPE encoding and decoding: merge ranks in a priority queue over a linked symbol list."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 300_000  # words in each of a worker's two memory generations; results don't depend on it
#: str.split() also splits at these; the tokenizer's \s has only U+0085 of them.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves,
    the others follow from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def merge_symbols(ids: list[int], heap: list[int], shift: int, ranks: dict[int, int], joined: list[int]) -> list[int]:
    """Join neighbouring symbols, always the pair of lowest rank (leftmost on ties).

    ``ranks`` maps left << 16 | right to a rank, ``joined[rank]`` is the new id;
    ``heap`` holds rank << shift | place of the first pairs.  Symbols form a
    doubly linked list.  An entry of the queue is skipped when its left symbol
    is gone or its pair is no longer the one queued.
    """
    n = len(ids)
    get = ranks.get
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    place = (1 << shift) - 1
    while heap:
        entry = heappop(heap)
        i = entry & place
        j = after[i]
        a = ids[i]
        if a < 0 or j >= n or get(a << 16 | ids[j]) != entry >> shift:
            continue
        ids[i] = new = joined[entry >> shift]
        ids[j] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get(new << 16 | ids[k])) is not None:
                heappush(heap, r << shift | i)
        h = before[i]
        if h >= 0 and (r := get(ids[h] << 16 | new)) is not None:
            heappush(heap, r << shift | h)
    return [x for x in ids if x >= 0]


class WordBpe:
    """The word tokenizer of a ``tokenizers`` JSON file with word-end suffixes.

    Normalisation (NFC, spaces, lower case) and splitting never look past white
    space, so each blank-separated string is encoded once and remembered.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        if max(self.strings) > 0xFFFF or None in map(vocab.get, byte_symbols()):
            raise ValueError("needs all byte symbols and ids below 65536")
        self.ranks: dict[int, int] = {}
        self.joined = [vocab[a + b] for a, b in model["merges"]]
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault(vocab[a] << 16 | vocab[b], rank)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + self.suffix) for s in symbols]
        # A word's first pairs are byte pairs: their ranks, by both bytes.
        self.inner_rank = [self.ranks.get(a << 16 | b) for a in self.inner for b in self.inner]
        self.last_rank = [self.ranks.get(a << 16 | b) for a in self.inner for b in self.last]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def piece(self, p: str) -> list[int]:
        data = p.encode()
        n = len(data)
        ids = [*map(self.inner.__getitem__, data)]
        ids[-1] = self.last[data[-1]]
        if n == 1:
            return ids
        rank, shift = self.inner_rank, 8 if n < 256 else 40
        heap = [r << shift | i for i, (a, b) in enumerate(zip(data, data[1:-1])) if (r := rank[a << 8 | b]) is not None]
        if (r := self.last_rank[data[-2] << 8 | data[-1]]) is not None:
            heap.append(r << shift | n - 2)
        return merge_symbols(ids, heap, shift, self.ranks, self.joined) if heap else ids

    def word(self, w: str) -> bytes:
        """ids of a blank-separated string as little-endian 16-bit integers."""
        out = self.older.get(w)
        if out is None:
            norm = w if w.isascii() else unicodedata.normalize("NFC", w)
            low = norm.lower() if "Σ" not in norm else "".join([c.lower() for c in norm])
            if low.isascii() and low.isalpha():
                ids = self.piece(low)
            else:
                ids = [i for p in self.pieces(low) for i in self.piece(p)]
            out = array("H", ids).tobytes()
        if len(self.words) >= CACHE:
            self.older, self.words = self.words, {}
        self.words[w] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        """All ids of a whole text."""
        out = []
        for part in self.at_special(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(array("H", [self.special[part]]).tobytes())
                continue
            words = SPACE.split(part) if ODD_SPACE.search(part) else part.split()
            found = list(map(self.words.get, words))
            if None in found:
                get, word = self.words.get, self.word
                found = [x if x is not None else get(w) or word(w) for x, w in zip(found, words)]
            out += found
        return np.frombuffer(b"".join(out), "<u2")

    def decode(self, ids: np.ndarray) -> str:
        """The file has no decoder: the vocabulary strings of all ids, joined by one space."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text; null texts are empty."""
    def run(batches):
        bpe = load(path)
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = bpe.encode(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([bpe.decode(ids)])],
                    ["doc_id", "ids", "decoded"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens and digests of ids and decoded text of every whole text.

    One result row per row of ``docs``; the ids and the decoded text stay in
    the task.  Null and empty texts have no tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n, hashes, decoded = [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                hashes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
