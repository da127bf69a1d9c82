"""Byte-level BPE by replaying the merges over a whole block of the corpus at once."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that are encoded together, about, and token ids in a batch that leaves a task; ids decoded at once.
BLOCK, BATCH, PART = 12_000_000, 1_000_000, 400_000

_NONE = np.int32(2**31 - 1)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file's tokens."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Merges:
    """The vocabulary as arrays: ids of single bytes, bytes of ids, and what two neighbouring ids merge into."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.text = np.frombuffer(b"".join(tokens), np.uint8)
        pairs = [
            (left, right, rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None
        ]
        self.bits = max(8, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, _NONE, np.int32)
        left, right, rank = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ([], [], [])))
        key, todo = (left << 32) | right, np.arange(len(pairs))
        at = self._slot(key)
        while todo.size:  # open addressing, all keys at once: the last to write an empty slot gets it
            free = self.keys[at[todo]] == -1
            self.keys[at[todo[free]]] = key[todo[free]]
            won = self.keys[at[todo]] == key[todo]
            self.merged[at[todo[won]]] = rank[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of neighbouring ids; those that do not merge get the largest number."""
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.merged[at], _NONE)
        open_ = np.flatnonzero((there != key) & (there != -1))
        while open_.size:
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out

    def alone(self, word: bytes) -> list[int]:
        """One word, pair by pair: the least rank first, leftmost of equals."""
        ids = [int(self.byte[b]) for b in word]
        while len(ids) > 1:
            rank = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
            i = int(rank.argmin())
            if rank[i] == _NONE:
                break
            ids[i : i + 2] = [int(rank[i])]
        return ids

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each.

        The words lie side by side as linked positions. An index from a pair (by what it merges into) to its
        positions is built once; merges are applied in rank order, each to all its positions in all
        words, and after each only the pairs with the left and right neighbour are looked up
        and indexed anew. Overlapping places of one pair merge from the left. If a new pair should rank
        before the merge that made it, its word is encoded alone instead.
        """
        size = np.array([len(w) for w in words], np.int64)
        n = int(size.sum())
        token = self.byte[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(size)
        after[ends[size > 0] - 1] = -1
        before[(ends - size)[size > 0]] = -1
        pair = np.full(n, _NONE, np.int32)
        inner = np.flatnonzero(after >= 0).astype(np.int32)
        pair[inner] = self.rank(token[inner], token[inner + 1])
        live = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray) -> list[int]:
            """Add positions to the index by their pairs; ranks that are new in it."""
            rank = pair[at]
            known = rank != _NONE
            at, rank = at[known], rank[known]
            if not at.size:
                return []
            order = np.argsort(rank, kind="stable").astype(np.int32)
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            new = []
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                if (held := index.get(r)) is None:
                    index[r] = [part]
                    new.append(r)
                else:
                    held.append(part)
            return new

        due = enter(inner)
        heapq.heapify(due)
        odd: set[int] = set()
        while due:
            rank = heapq.heappop(due)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))
            at = at[pair[at] == rank]
            if not at.size:
                continue
            if at.size > 1:
                joined = after[at[:-1]] == at[1:]
                if joined.any():
                    place = np.arange(at.size)
                    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined]), place, 0))
                    at = at[(place - first) % 2 == 0]
            right = after[at]
            token[at] = rank
            live[right] = False
            pair[right] = _NONE
            nxt = after[right]
            after[at] = nxt
            has = nxt >= 0
            before[nxt[has]] = at[has]
            prev = before[at]
            pair[at] = _NONE
            to_right = at[has]
            if to_right.size:
                pair[to_right] = self.rank(token[to_right], token[after[to_right]])
            left = prev[prev >= 0]
            if left.size:
                pair[left] = self.rank(token[left], token[after[left]])
            # A merged place that is also another's left neighbour has the same pair twice; once is enough.
            touched = np.unique(np.concatenate([to_right, left])) if at.size > 1 else np.concatenate([left, to_right])
            early = pair[touched] < rank
            if early.any():
                odd.update(word[touched[early]].tolist())
            for r in enter(touched):
                heapq.heappush(due, r)
        ids, counts = token[live], np.bincount(word[live], minlength=len(words))
        if odd:
            starts = np.cumsum(counts) - counts
            each = [ids[s : s + c] for s, c in zip(starts, counts, strict=True)]
            for w in odd:
                each[w] = np.array(self.alone(words[w]), np.int32)
            ids, counts = np.concatenate(each), np.array([len(e) for e in each], np.int64)
        return ids, counts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after the other, and the length of each."""
        size, out = self.length[ids], []
        for low in range(0, len(ids), PART):
            n = size[low : low + PART]
            at = np.repeat(self.start[ids[low : low + PART]] - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            out.append(self.text[at])
        return np.concatenate(out) if out else self.text[:0], size


@cache
def _merges(data: bytes) -> Merges:
    return Merges(read_ranks(data))


def _shared(df: DataFrame, path: str):
    """The rank file's bytes, read on the driver and broadcast: its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace column `text` by `ids`, the token ids of every whole text.

    A task takes its rows in blocks of about BLOCK characters (a longer text is one block), gathers the block's distinct
    words (matches of `pattern`) once and replays the merges over all of them; a row is then the chain of its
    words' ids. Nothing is shuffled. Null and empty texts give empty lists; other columns stay as they are (one
    named `ids` is replaced).
    """
    data = _shared(docs, path)
    others = [c for c in docs.columns if c not in (text, ids)]
    spare = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in [*others, text]])
    kinds = spare.schema
    schema = T.StructType([*kinds.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, split = _merges(data.value), regex.compile(pattern)
        held, rows, numbers, chars = [], [], {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = [w.encode("utf-8", "surrogatepass") for w in numbers]
            flat, size = merges.replay(words) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            begin = np.cumsum(size) - size
            at = 0
            for batch in held:
                own = rows[at : at + batch.num_rows]
                at += batch.num_rows
                low = 0
                while low < len(own):
                    high, total = low, 0
                    while high < len(own) and (high == low or total < BATCH):
                        total += len(own[high]) * 3
                        high += 1
                    many = own[low:high]
                    which = np.concatenate(many)
                    n = size[which]
                    ends = np.cumsum(n)
                    take = np.repeat(begin[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
                    per_row = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum([len(m) for m in many])]])
                    lists = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.array(flat[take], pa.int32()))
                    part = batch.slice(low, high - low)
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*others, ids])
                    low = high

        for batch in batches:
            low = 0
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                found = split.findall(value.as_py() or "")
                rows.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int32, len(found)))
                chars += sum(map(len, found))
                if chars >= BLOCK:
                    held.append(batch.slice(low, i + 1 - low).select(range(len(others))))
                    yield from flush()
                    held, rows, numbers, chars, low = [], [], {}, 0, i + 1
            if low < batch.num_rows:
                held.append(batch.slice(low).select(range(len(others))))
        yield from flush()

    return spare.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add `decoded`, the bytes that a row's ids stand for; null ids give null. An id outside the vocabulary is an error."""
    data = _shared(docs, path)
    kept = docs.drop(text) if text in docs.columns else docs
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.BinaryType())])
    names, place = [*kept.columns, text], kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(data.value)
        for batch in batches:
            column = batch.column(place)
            flat = np.asarray(column.flatten())
            n = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
            raw, size = merges.decode(flat)
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
            parts = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]
            ).cast(pa.binary())
            if column.null_count:
                parts = pa.array([None if c is None else p for p, c in zip(parts.to_pylist(), column.to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], names=names)

    return kept.mapInArrow(run, schema)


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` of encoded rows."""
    decoded = decode(encoded.select("doc_id", "ids"), path)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
