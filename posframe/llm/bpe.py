"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A word is held as the ids of its parts and, beside them, the ranks of the adjacent pairs. The smallest rank is found by
scanning the array, its boundary is deleted, and the two neighbouring ranks are looked up again. The words of a batch that
are not yet known go through this together: their arrays are the rows of a matrix, and each step scans, deletes and
refreshes in all rows at once. A word longer than LONG_WORD bytes takes the same merges from a heap instead, so that a text
without white space stays near-linear. Encoded words are remembered in two generations of bounded size.

Defined results: null is the empty text, with no tokens; null ids, repeated rows and ties are encoded like any row; an
empty table gives an empty result; other columns are neither read nor in the way.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import lean, ship, text_of

LONG_WORD = 256
#: Most encoded words of a generation, and where the worker shares the executor with other stages (`token_ids`): fewer take
#: more time, not other results.
CACHED_WORDS, CACHED_BESIDE = 250_000, 50_000
#: Words whose arrays are merged together.
TOGETHER = 1 << 13
NONE = 1 << 62
#: How a byte-level BPE splits text before its merges: part of the vocabulary's definition.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of ASCII and Latin letters only, and the same splitting by plain classes, which is faster on them.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
SIMPLE = re.compile(rf"[\x00-\x7f{LATIN}]*")
SIMPLE_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+", re.ASCII)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: printable ones themselves, the rest from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)]


class PairTable:
    """Ranks of pairs of ids, looked up for whole arrays: an open-addressed table in numpy."""

    def __init__(self, pairs: dict[int, int]):
        keys, ranks = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter((v >> 32 for v in pairs.values()), np.int64, len(pairs))
        self.mask = (1 << (2 * len(pairs)).bit_length() + 1) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        waiting, at = np.arange(len(keys)), self._home(keys)
        while len(waiting):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[waiting[free]]  # of several for one place the last stays
            placed = self.keys[at] == keys[waiting]
            self.ranks[at[placed]] = ranks[waiting[placed]]
            waiting, at = waiting[~placed], (at[~placed] + 1) & self.mask
        self.none = int(ranks.max(initial=0)) + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x2545F4914F6CDD1D >> 20) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of the pairs; `none` for those that do not merge, and where an id is negative."""
        keys = left.astype(np.int64) << 32 | right
        out = np.full(len(keys), self.none, np.int32)
        waiting = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._home(keys[waiting])
        while len(waiting):
            found = self.keys[at]
            hit = found == keys[waiting]
            out[waiting[hit]] = self.ranks[at[hit]]
            on = ~hit & (found >= 0)
            waiting, at = waiting[on], (at[on] + 1) & self.mask
        return out


class RankBPE:
    """Encoder and decoder of a byte-level BPE given by a tokenizers .json file."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.byte_ids = [vocab[c] for c in letters]
        # rank in the high bits, the merged token's id in the low ones: the smallest value is the smallest rank
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[left] << 32 | vocab[right]] = rank << 32 | vocab[left + right]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = added
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces: dict[int, bytes] = {i: bytes(back[c] for c in token) for token, i in vocab.items() if token not in added}
        self.pieces |= {i: token.encode() for token, i in added.items()}
        self.split = regex.compile(PATTERN)
        self.table = PairTable(self.pairs)
        self.merged = np.zeros(self.table.none, np.int32)
        self.merged[[v >> 32 for v in self.pairs.values()]] = [v & 0xFFFFFFFF for v in self.pairs.values()]
        self.bytes = np.array(self.byte_ids, np.int32)
        self.words: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.cached = cached

    def encode_word(self, word: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._encode_long(ids)
        pair = self.pairs.get
        ranks = [pair(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) != NONE:
            at = ranks.index(least)
            ids[at : at + 2] = [least & 0xFFFFFFFF]
            del ranks[at]
            if at:
                ranks[at - 1] = pair(ids[at - 1] << 32 | ids[at], NONE)
            if at < len(ranks):
                ranks[at] = pair(ids[at] << 32 | ids[at + 1], NONE)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same merges, smallest rank and then leftmost first, from a heap over a linked list."""
        n, pair = len(ids), self.pairs.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := pair(ids[i] << 32 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or pair(ids[i] << 32 | ids[j], NONE) != rank:
                continue
            ids[i], ids[j], after[i] = rank & 0xFFFFFFFF, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := pair(ids[i] << 32 | ids[after[i]], NONE)) != NONE:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := pair(ids[h] << 32 | ids[i], NONE)) != NONE:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, LONG_WORD bytes at most, by merging in all of them at once."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), TOGETHER):
            rows = np.array(order[at : at + TOGETHER])
            lengths = np.array([len(words[i]) for i in rows])
            width = int(lengths[-1])
            letters = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
            columns = np.arange(width)
            ids = np.where(columns < lengths[:, None], self.bytes[letters], -1)
            ranks = np.full((len(rows), width), self.table.none, np.int32)
            ranks[:, :-1] = self.table(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), width - 1)
            while len(rows):
                best = ranks.argmin(axis=1)
                each = np.arange(len(rows))
                least = ranks[each, best]
                done = least == self.table.none
                for i in np.flatnonzero(done):
                    row = ids[i]
                    out[rows[i]] = row[row >= 0].tolist()
                on = ~done
                rows, ids, ranks, best, least = rows[on], ids[on], ranks[on], best[on], least[on]
                if not len(rows):
                    break
                each = np.arange(len(rows))
                # the part right of the boundary goes: what follows moves one to the left
                after = columns[None, :-1] > best[:, None]
                ids[:, :-1] = np.where(after, ids[:, 1:], ids[:, :-1])
                ids[:, -1] = -1
                ranks[:, :-1] = np.where(columns[None, :-1] >= best[:, None], ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = self.table.none
                ids[each, best] = self.merged[least]
                right = np.minimum(best + 1, width - 1)
                ranks[each, best] = self.table(ids[each, best], np.where(best + 1 < width, ids[each, right], -1))
                left = best > 0
                ranks[each[left], best[left] - 1] = self.table(ids[each[left], best[left] - 1], ids[each[left], best[left]])
        return out

    def _split(self, text: str) -> list[str]:
        return (SIMPLE_PATTERN if SIMPLE.fullmatch(text) else self.split).findall(text)

    def _learn(self, words: set[str]) -> list[str]:
        """Make the decimal forms of the words known; the long ones among them, to be forgotten after use."""
        if len(self.words) >= self.cached:
            self.words, self.old = {}, self.words
        missing = [w for w in words if w not in self.words]
        known = {w: f for w in missing if (f := self.old.get(w)) is not None}
        self.words |= known
        new = [w for w in missing if w not in known]
        raw = [w.encode() for w in new]
        short = [i for i, r in enumerate(raw) if len(r) <= LONG_WORD]
        for i, ids in zip(short, self.encode_words([raw[i] for i in short])):
            self.words[new[i]] = ",".join(map(str, ids))
        long = [i for i, r in enumerate(raw) if len(r) > LONG_WORD]
        for i in long:
            self.words[new[i]] = ",".join(map(str, self.encode_word(raw[i])))
        return [new[i] for i in long]

    def decimal(self, texts: list[str]) -> list[str]:
        """The ids of each text, in decimal, joined by commas; added tokens in a text are themselves."""
        pieces: list[list[str]] = []
        for text in texts:
            if self.added_split is not None and any(token in text for token in self.added):
                parts = [[p] if p in self.added else self._split(p) for p in self.added_split.split(text)]
                pieces.append(list(chain.from_iterable(parts)))
            else:
                pieces.append(self._split(text))
        marks = {token: self.words.pop(token, None) for token in self.added}
        long = self._learn(set(chain.from_iterable(pieces)) - self.added.keys())
        # a piece that is an added token's string can only be the token: the splitting never gives it otherwise
        self.words |= {token: str(i) for token, i in self.added.items()}
        out = [",".join(map(self.words.__getitem__, p)) for p in pieces]
        for word in [*long, *marks]:
            del self.words[word]
        return out

    def encode(self, text: str) -> list[int]:
        return ids_of(self.decimal([text])[0])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def ids_of(decimal: str) -> list[int]:
    return list(map(int, decimal.split(","))) if decimal else []


#: Texts that are encoded together.
AT_ONCE = 256


@lru_cache(maxsize=2)
def _coder(path: str, cached: int = CACHED_WORDS) -> RankBPE:
    return RankBPE(path, cached)


def token_ids(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) for each row: the token ids of the whole text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer, CACHED_BESIDE)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                ids = [ids_of(d) for d in coder.decimal(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(lean(run), "doc_id long, n_tokens long, ids array<int>")


def texts(encoded: DataFrame, tokenizer: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) for each row of token ids; null ids decode to null."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        for batch in batches:
            decoded = [None if x is None else coder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[doc_id].cast("long").alias("doc_id"), encoded[ids].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row, hashed where it is encoded: ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for at in range(0, batch.num_rows, AT_ONCE):
                for decimal in coder.decimal(batch.column(1).slice(at, AT_ONCE).to_pylist()):
                    ids = ids_of(decimal)
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(decimal.encode()).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs, text).alias("text")).mapInArrow(run, SCHEMA)
