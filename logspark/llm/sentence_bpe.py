"""SentencePiece BPE: all words of a block merge together, in vectorised rounds."""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm.common import named

#: Characters of text that are encoded together, about, and token ids in a batch that leaves a task.
BLOCK, BATCH = 4_000_000, 500_000
#: Symbols from which a word is merged pair by pair, with a heap, since rounds over it could be as many.
LONG = 256

# The blank's sign in pieces, what stands for an unknown piece, kinds of pieces in a model file.
BLANK, UNKNOWN = "▁", " ⁇ "
NORMAL, UNKNOWN_KIND, CONTROL, BYTE = 1, 2, 3, 6
#: Model type "BPE" in the trainer's settings.
BPE = 2

_NONE = np.int32(2**31 - 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        field, kind = divmod(number(), 8)
        if kind == 0:
            yield field, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield field, data[at : at + size]
            at += size


class Pieces:
    """A model file's pieces as arrays: which two symbols merge into which, and how early.

    Symbols are ids of pieces, and numbers beyond them for characters that stand in pieces only. Models that are not BPE,
    normalise characters, trim blanks, or hold pieces of other kinds than normal, unknown, control and byte raise ValueError.
    """

    def __init__(self, data: bytes):
        listed, settings = [], {}
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                listed.append((own[1].decode(), float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]), own.get(3, NORMAL)))
            elif field in (2, 3):
                settings[field] = dict(_fields(value))
        trainer, form = settings.get(2, {}), settings.get(3, {})
        if trainer.get(3) != BPE or form.get(2) or form.get(4, 1) or not form.get(5, 1):
            raise ValueError("only BPE models that leave characters and blanks as they are")
        if {kind for *_, kind in listed} - {NORMAL, UNKNOWN_KIND, CONTROL, BYTE}:
            raise ValueError("pieces of an unknown kind")
        self.size, self.prefix = len(listed), bool(form.get(3, 1))
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.unknown = trainer.get(40, 0)
        ids = {piece: i for i, (piece, _, kind) in enumerate(listed) if kind == NORMAL}
        self.byte = np.full(256, self.unknown, np.int32)
        for i, (piece, _, kind) in enumerate(listed):
            if kind == BYTE:
                self.byte[int(piece[3:-1], 16)] = i
        self.fallback = any(kind == BYTE for *_, kind in listed)
        letters = sorted({c for piece in ids for c in piece} - ids.keys())
        self.symbols = ids | {c: self.size + i for i, c in enumerate(letters)}
        self.letter = np.full(0x110000, -1, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.letter[ord(c)] = i
        scores = np.array([score for _, score, _ in listed])
        self.order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        pairs = [
            (left << 32 | right, i)
            for piece, i in ids.items()
            for k in range(1, len(piece))
            if (left := self.symbols.get(piece[:k])) is not None and (right := self.symbols.get(piece[k:])) is not None
        ]
        self._fill(np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int32))
        known = sorted({c for piece in self.symbols for c in piece} - {BLANK})
        some = "".join(map(re.escape, known))
        apart = not any(BLANK in piece.lstrip(BLANK) for piece in ids)
        run = (f"{BLANK}+[{some}]*|[{some}]+" if apart else f"[{BLANK}{some}]+") if known else f"{BLANK}+"
        self.word = re.compile(f"{run}|.", re.DOTALL)
        self.beside = np.unique(np.array([ord(p[k]) << 32 | ord(p[k + 1]) for p in ids for k in range(len(p) - 1)], np.int64))
        surface = []
        for piece, _, kind in listed:
            plain = {NORMAL: piece.replace(BLANK, " "), UNKNOWN_KIND: UNKNOWN}.get(kind, "").encode()
            surface.append(bytes([int(piece[3:-1], 16)]) if kind == BYTE else plain)
        self.length = np.array([len(s) for s in surface], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.kind = np.array([kind for *_, kind in listed])
        self.blank = np.array([piece.startswith(BLANK) and kind == NORMAL for piece, _, kind in listed], bool)

    def _fill(self, key: np.ndarray, merged: np.ndarray) -> None:
        """An open hash table of pairs; keys that meet in a slot go on to the next, the first of them stays."""
        self.bits = max(8, (4 * len(key)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.merged = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(key)), self._slot(key)
        while todo.size:
            slots, first = np.unique(at[todo], return_index=True)
            free = self.keys[slots] == -1
            put = todo[first[free]]
            self.keys[at[put]], self.merged[at[put]] = key[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What neighbouring symbols merge into; -1 where they do not."""
        key = (left.astype(np.int64) << 32) | right
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.merged[at], np.int32(-1))
        open_ = np.flatnonzero((there != key) & (there != -1))
        while open_.size:
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.merged[at[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return out

    def rank(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged >= 0, self.order[merged], _NONE)

    @cached_property
    def _pairs(self) -> dict[int, tuple[int, int]]:
        held = self.keys >= 0
        return {k: (int(self.order[m]), m) for k, m in zip(self.keys[held].tolist(), self.merged[held].tolist(), strict=True)}

    def alone(self, symbols: list[int]) -> list[int]:
        """One word, pair by pair: the best score first, leftmost of equals."""
        own, pairs, n = list(symbols), self._pairs, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [(*found, i, own[i], own[i + 1]) for i in range(n - 1) if (found := pairs.get(own[i] << 32 | own[i + 1]))]
        heapq.heapify(due)
        while due:
            _, merged, i, left, right = heapq.heappop(due)
            j = after[i]
            if own[i] != left or j >= n or own[j] != right:
                continue
            own[i], own[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get(merged << 32 | own[k]):
                    heapq.heappush(due, (*found, i, merged, own[k]))
            if (h := before[i]) >= 0 and (found := pairs.get(own[h] << 32 | merged)):
                heapq.heappush(due, (*found, h, own[h], merged))
        return [s for s in own if s >= 0]

    def _cut(self, word: str) -> list[str]:
        """A word in parts that no piece reaches across."""
        code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        cuts = np.flatnonzero(~np.isin(code[:-1] << 32 | code[1:], self.beside)) + 1
        ends = [0, *cuts.tolist(), len(word)]
        return [word[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _symbols(self, word: str) -> list[int]:
        return [self.symbols[c] for c in word]

    def _bytes(self, symbols: list[int]) -> list[int]:
        """Ids of a word's symbols; characters that are no piece become bytes, or the unknown piece."""
        if all(s < self.size for s in symbols):
            return symbols
        by_number, out = {s: c for c, s in self.symbols.items() if s >= self.size}, []
        for s in symbols:
            out += [s] if s < self.size else self._spelled(by_number[s])
        return out

    def _spelled(self, letter: str) -> list[int]:
        return self.byte[list(letter.encode("utf-8", "replace"))].tolist() if self.fallback else [self.unknown]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (as `word` finds them), one after the other, and the number of ids of each."""
        own: dict[int, list[int]] = {}
        short = []
        for i, word in enumerate(words):
            if word[0] not in self.symbols and word[0] != BLANK:
                own[i] = self._spelled(word)
            elif len(word) >= LONG:
                parts = self._cut(word)
                own[i] = [s for part in parts for s in self.alone(self._symbols(part))]
            else:
                short.append(i)
        flat = "".join(words[i] for i in short)
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = self.letter[code]
        size = np.array([len(words[i]) for i in short], np.int64)
        word = np.repeat(np.array(short, np.int64), size)
        for i in self._rounds(symbol, word, done := []):
            own[i] = self.alone(self._symbols(words[i]))
        extra = [(np.full(len(s), i, np.int64), np.array(s, np.int32)) for i, s in own.items()]
        word, symbol = (np.concatenate(x) for x in zip(*done, *extra, (np.zeros(0, np.int64), np.zeros(0, np.int32)), strict=True))
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        if symbol.size and symbol.max() >= self.size:
            counts = np.bincount(word, minlength=len(words))
            lists = [self._bytes(part.tolist()) for part in np.split(symbol, np.cumsum(counts)[:-1])]
            return np.array([s for one in lists for s in one], np.int32), np.array([len(one) for one in lists], np.int64)
        return symbol, np.bincount(word, minlength=len(words)).astype(np.int64)

    def _rounds(self, symbol: np.ndarray, word: np.ndarray, done: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
        """Merge all words at once, a round a merge; finished words go to `done`, the numbers of odd ones are returned.

        A round takes the least rank of each word and merges all its places in the word at once, overlapping ones
        from the left; words in which no pair remains leave the arrays. Should a pair that a merge makes rank no later
        than the merge itself, one by one would have gone another way, so that word is odd.
        """
        odd: list[int] = []
        if not symbol.size:
            return odd
        merged = np.full(symbol.size, -1, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        merged[inner] = self.merge(symbol[inner], symbol[inner + 1])
        rank = self.rank(merged)
        while symbol.size:
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, symbol.size))
            low = np.minimum.reduceat(rank, starts)
            if (low == _NONE).any():
                over = np.repeat(low == _NONE, sizes)
                done.append((word[over], symbol[over]))
                symbol, word, merged, rank = symbol[~over], word[~over], merged[~over], rank[~over]
                sizes, low = sizes[low != _NONE], low[low != _NONE]
                if not symbol.size:
                    break
            least = np.repeat(low, sizes)
            at = np.flatnonzero(rank == least)
            joined = np.diff(at) == 1
            if joined.any():
                place = np.arange(at.size)
                first = np.maximum.accumulate(np.where(np.concatenate([[True], ~joined]), place, 0))
                at = at[(place - first) % 2 == 0]
            now = least[at]
            strange = []
            near = np.flatnonzero(np.diff(at) == 2)
            near = near[word[at[near]] == word[at[near + 1]]]
            if near.size:
                between = self.rank(self.merge(merged[at[near]], symbol[at[near + 1]]))
                strange.append(word[at[near]][between <= now[near]])
            symbol[at] = merged[at]
            live = np.ones(symbol.size, bool)
            live[at + 1] = False
            new = (np.cumsum(live) - 1)[at]
            symbol, word, merged, rank = symbol[live], word[live], merged[live], rank[live]
            live_word = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]]))
            mark = np.zeros(symbol.size + 1, bool)
            mark[new] = mark[new - 1] = True  # the place before the first is the spare last one
            changed = np.flatnonzero(mark[:-1])
            merged[changed], rank[changed] = -1, _NONE
            changed = changed[changed < symbol.size - 1]
            changed = changed[word[changed] == word[changed + 1]]
            merged[changed] = self.merge(symbol[changed], symbol[changed + 1])
            rank[changed] = self.rank(merged[changed])
            strange.append(word[changed][rank[changed] <= low[live_word[changed]]])
            out = np.unique(np.concatenate(strange))
            if out.size:
                odd += out.tolist()
                keep = ~np.isin(word, out)
                symbol, word, merged, rank = symbol[keep], word[keep], merged[keep], rank[keep]
        return odd

    def decode(self, ids: np.ndarray) -> bytes:
        """The text, as UTF-8, of one list of ids. Runs of byte pieces that are not UTF-8 become one U+FFFD a bad byte."""
        if not ids.size:
            return b""
        n = self.length[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        out = self.surface[at].tobytes()
        kind = self.kind[ids]
        told = np.flatnonzero(kind != CONTROL)
        cut = int(self.prefix and told.size and self.blank[ids[told[0]]])
        try:
            out.decode("utf-8")
            parted = told.size and told[-1] - told[0] >= told.size and (kind == BYTE).any()
        except UnicodeDecodeError:
            parted = True
        return (self._mended(ids) if parted else out)[cut:]

    def _mended(self, ids: np.ndarray) -> bytes:
        spelled = self.kind[ids] == BYTE
        parts = []
        for run in np.split(ids, np.flatnonzero(np.diff(spelled.astype(np.int8))) + 1):
            raw = b"".join(self.surface[self.start[i] : self.start[i] + self.length[i]].tobytes() for i in run)
            while raw and self.kind[run[0]] == BYTE:
                try:
                    raw.decode("utf-8")
                    break
                except UnicodeDecodeError as bad:
                    parts.append(raw[: bad.start] + "�".encode())
                    raw = raw[bad.start + 1 :]
            parts.append(raw)
        return b"".join(parts)


@cache
def _pieces(data: bytes) -> Pieces:
    return Pieces(data)


def _shared(df: DataFrame, path: str):
    """The model file's bytes, read on the driver and broadcast: its size is that of the vocabulary."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace column `text` by `ids`, the piece ids of every whole text between the begin and end ids.

    A task takes its rows in blocks of about BLOCK characters (a longer text is one block). Blanks become the blank's sign, and
    a text is cut where no piece can reach across: before runs of blanks, and around characters that no piece holds. The block's
    distinct words are merged together in rounds; a row is then the chain of its words' ids. Nothing is shuffled.
    Null and empty texts give the begin and end ids alone; other columns stay as they are (one named `ids` is replaced).
    """
    data = _shared(docs, path)
    others = [c for c in docs.columns if c not in (text, ids)]
    spare = docs.select(*map(named, [*others, text]))
    schema = T.StructType([*spare.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(data.value)
        lead = BLANK if model.prefix else ""
        held, rows, chars = [], [], 0
        numbers: defaultdict[str, int] = defaultdict(lambda: len(numbers))

        def flush() -> Iterator[pa.RecordBatch]:
            flat, size = model.encode(list(numbers))
            flat = np.concatenate([flat, np.array([model.begin, model.end], np.int32)])
            size = np.concatenate([size, [1, 1]])
            begin, first, last = np.cumsum(size) - size, len(numbers), len(numbers) + 1
            at = 0
            for batch in held:
                own = rows[at : at + batch.num_rows]
                at += batch.num_rows
                low = 0
                while low < len(own):
                    high, total = low, 0
                    while high < len(own) and (high == low or total < BATCH):
                        total += 3 * len(own[high]) + 2
                        high += 1
                    which = np.concatenate([part for row in own[low:high] for part in ([first], row, [last])])
                    n = size[which]
                    ends = np.cumsum(n)
                    take = np.repeat(begin[which] - (ends - n), n) + np.arange(int(ends[-1]))
                    per_row = np.concatenate([[0], ends])[np.cumsum([0, *(len(row) + 2 for row in own[low:high])])]
                    lists = pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), pa.array(flat[take], pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, lists], names=[*others, ids])
                    low = high

        for batch in batches:
            low = 0
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                plain = value.as_py() or ""
                found = model.word.findall(lead + plain.replace(" ", BLANK)) if plain else []
                rows.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                chars += len(plain)
                if chars >= BLOCK:
                    held.append(batch.slice(low, i + 1 - low).select(range(len(others))))
                    yield from flush()
                    held, rows, chars, low = [], [], 0, i + 1
                    numbers.clear()
            if low < batch.num_rows:
                held.append(batch.slice(low).select(range(len(others))))
        yield from flush()

    return spare.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded", packed: str | None = None) -> DataFrame:
    """Add `decoded`, the text that a row's ids stand for; null ids give null. An id outside the vocabulary is an error.

    The begin and end ids stand for nothing, and the blank before the first piece goes. `packed` names a further column
    for the ids as little-endian unsigned 32-bit integers, as token files hold them.
    """
    data = _shared(docs, path)
    kept = docs.drop(*[c for c in (text, packed) if c in docs.columns])
    more = [T.StructField(text, T.StringType()), *([T.StructField(packed, T.BinaryType())] if packed else [])]
    schema = T.StructType([*kept.schema.fields, *more])
    place = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(data.value)
        for batch in batches:
            own = [None if x.values is None else np.asarray(x.values) for x in batch.column(place)]
            texts = pa.array([None if x is None else model.decode(x) for x in own], pa.binary()).cast(pa.string())
            tail = [texts]
            if packed:
                tail.append(pa.array([None if x is None else x.astype("<u4").tobytes() for x in own], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *tail], names=schema.names)

    return kept.mapInArrow(run, schema)


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` of encoded rows."""
    decoded = decode(encoded.select("doc_id", "ids"), path, packed="packed")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
