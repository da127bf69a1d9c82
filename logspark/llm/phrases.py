"""Phrase collocations from sorted count streams, merge-joined in prefix and suffix order."""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.byte_words import mix
from logspark.llm.common import written_table

#: Words of the longest phrase, and the least count of a phrase.
LONGEST, LEAST = 5, 100
#: Share, in hundredths, of a phrase's occurrences that a longer one must hold to take its place.
INSIDE = 100
#: Counters (as a power of two) that keep most rare pairs and triples out of the streams, and those of a part.
COUNTERS, PART = 27, 20
#: Characters of text that are counted together, about; a longer text is cut between two pieces.
BLOCK = 6_000_000
#: Groups a first ranking is dealt into, so that none holds all phrases of a language.
DEALT = 64

#: The language of rows without one.
UNKNOWN = "und"

_PIECE = re.compile(r"[.,;:!?\n\x0b\x0c\r]")
_TOKEN = re.compile(r"[.,;:!?\n\x0b\x0c\r]|[^ \t.,;:!?\n\x0b\x0c\r]+")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _packed(h: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A block's sums a counter, in counter order, by parts: steps from one counter to the next, and sums up to LEAST."""
    place, back = np.unique(_counter(h), return_inverse=True)
    sums = np.minimum(np.bincount(back, counts), LEAST).astype(np.uint32)
    cuts = np.flatnonzero(np.diff(place >> PART)) + 1
    for own, part in zip(np.split(place, cuts), np.split(sums, cuts), strict=True):
        if own.size:
            steps = np.diff(own & ((1 << PART) - 1), prepend=0).astype(np.uint32)
            yield int(own[0] >> PART), zstandard.compress(np.concatenate([steps, part]).tobytes(), 1)


def often_counted(packed: DataFrame) -> np.ndarray:
    """Which counters reach LEAST, as bits: `part, data` summed by tasks, each over parts of its own."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                steps, own = np.frombuffer(zstandard.decompress(data.as_py()), np.uint32).reshape(2, -1)
                at, total = np.cumsum(steps, dtype=np.int64), sums.setdefault(part, np.zeros(1 << PART, np.uint32))
                total[at] = np.minimum(total[at] + own, LEAST)
        bits = [np.packbits(total >= LEAST, bitorder="little").tobytes() for total in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["part", "bits"])

    out = np.zeros((1 << (COUNTERS - PART), 1 << (PART - 3)), np.uint8)
    for part, bits in packed.repartition("part").mapInArrow(add, "part int, bits binary").toLocalIterator():
        out[part] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = _counter(h)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


class Block:
    """Words of several texts side by side: `key` numbers them by language and word, -1 parts pieces."""

    def __init__(self, texts: list[tuple[str, str]]):
        count = itertools.count()
        numbers: dict[str, dict[str, int]] = {}
        parts, gap = [], np.full(1, -1, np.int64)
        for lang, text in texts:
            own = numbers.setdefault(lang, defaultdict(count.__next__))
            found = _TOKEN.findall(text)
            parts += [gap, np.fromiter(map(own.__getitem__, found), np.int64, len(found))]
        listed = sorted((i, lang, word) for lang, own in numbers.items() for word, i in own.items())
        self.langs, self.words = [lang for _, lang, _ in listed], [word for *_, word in listed]
        alias = np.append(np.where([bool(_PIECE.match(w)) for w in self.words], -1, np.arange(len(listed))), -1)
        self.key = alias[np.concatenate([*parts, np.full(LONGEST, -1, np.int64)])]

    @cached_property
    def hashes(self) -> np.ndarray:
        """A hash a key."""
        lang = {x: _hash(x) for x in set(self.langs)}
        return _chain(np.array([lang[x] for x in self.langs], np.uint64), np.array([_hash(w) for w in self.words], np.uint64))

    def rows(self, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """`lang, words, c` of phrases given as rows of keys."""
        words = pa.array(self.words, pa.string()).take(pa.array(keys.ravel()))
        offsets = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), words)
        langs = pa.array(self.langs, pa.string()).take(pa.array(keys[:, 0]))
        return pa.RecordBatch.from_arrays([langs, lists, pa.array(counts)], names=["lang", "words", "c"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """A task's texts in blocks; a text longer than one is cut after a piece, which no phrase crosses."""
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text, at = lang.as_py(), text.as_py(), 0
            while at < len(text):
                stop = _PIECE.search(text, at + BLOCK) if len(text) - at > BLOCK else None
                end = stop.end() if stop else len(text)
                held.append((lang, text[at:end]))
                size, at = size + end - at, end
                if size >= BLOCK:
                    yield Block(held)
                    held, size = [], 0
    if held:
        yield Block(held)


def _each_block(docs: DataFrame, count: Callable[[Block], Iterator[tuple]]) -> DataFrame:
    """`lang, words, c` of blocks' phrases, and in other rows `part, data` of their counters.

    `count` yields a block's phrases as rows of keys and their counts, and hashes of phrases with None and their counts.
    """
    kind = "lang string, words array<string>, c long, part int, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for keys, hashes, counts in count(block):
                if hashes is None:
                    for low in range(0, len(keys), 200_000):
                        own = block.rows(keys[low : low + 200_000], counts[low : low + 200_000])
                        none = [pa.nulls(own.num_rows, pa.int32()), pa.nulls(own.num_rows, pa.binary())]
                        yield pa.RecordBatch.from_arrays([*own.columns, *none], names=["lang", "words", "c", "part", "data"])
                else:
                    parts, data = zip(*_packed(hashes, counts), strict=True)
                    none = [pa.nulls(len(parts), k) for k in (pa.string(), pa.list_(pa.string()), pa.int64())]
                    tail = [pa.array(parts, pa.int32()), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*none, *tail], names=["lang", "words", "c", "part", "data"])

    return docs.mapInArrow(run, kind)


def _summed(stored: DataFrame) -> DataFrame:
    """`lang, words, c` over all blocks."""
    return stored.where("part IS NULL").groupBy("lang", "words").agg(F.sum("c").alias("c"))


def _lowered(docs: DataFrame) -> DataFrame:
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), low.alias("text"))


def _runs(rows: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, in sorted rows."""
    return np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))


def _beside(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places at which a pair of words starts, the number of each one's pair, the distinct pairs, their hashes and counts."""
    key = block.key
    at = np.flatnonzero((key[:-1] >= 0) & (key[1:] >= 0))
    own, place, counts = np.unique(key[at] << 32 | key[at + 1], return_inverse=True, return_counts=True)
    pairs = np.stack([own >> 32, own & 0xFFFFFFFF], axis=1)
    return at, place, pairs, _chain(block.hashes[pairs[:, 0]], block.hashes[pairs[:, 1]]), counts


def _triples(block: Block, at: np.ndarray, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the triples that start at those places of which the next also starts a pair, and these places."""
    start = at[:-1][np.diff(at) == 1]
    of = place[:-1][np.diff(at) == 1]
    return _chain(h[of], block.hashes[block.key[start + 2]]), start


def frequent(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to LONGEST words that occur LEAST times in a language, `lang, words, c`, and all words' number, `lang, n`.

    Three passes over the texts, each combined in blocks before its shuffle. The first counts words, and pairs by hashed
    counters; the second pairs whose counter reached LEAST, and triples of two such pairs by counters; the third phrases of three and
    more words, all of whose triples reached it, as prefixes of windows sorted in prefix order. A phrase occurs no more often
    than its parts and no more than its counter says, so this loses none, and what passes is counted exactly. The number of
    counters is fixed: the fuller they are, the more rare phrases pass into a shuffle, at most all of them.
    """
    spark, texts = docs.sparkSession, _lowered(docs)
    often = F.col("c") >= LEAST

    def first(block: Block) -> Iterator[tuple]:
        counts = np.bincount(block.key[block.key >= 0], minlength=len(block.words))
        keys = np.flatnonzero(counts)
        yield keys[:, None], None, counts[keys]
        _, _, pairs, h, counts = _beside(block)
        if len(pairs):
            yield None, h, counts

    stored = written_table(_each_block(texts, first), "words")
    sums = written_table(stored.where("part IS NULL").groupBy("lang").agg(F.sum("c").alias("n")), "word-sums")
    words = _summed(stored).where(often)

    def counters(stored: DataFrame):
        return spark.sparkContext.broadcast(often_counted(stored.where("part IS NOT NULL").select("part", "data")))

    coupled = counters(stored)

    def second(block: Block) -> Iterator[tuple]:
        at, place, pairs, h, counts = _beside(block)
        held = _held(coupled.value, h)
        yield pairs[held], None, counts[held]
        on = held[place]
        h, _ = _triples(block, at[on], place[on], h)
        if h.size:
            yield None, h, np.ones(h.size, np.int64)

    stored = written_table(_each_block(texts, second), "pairs")
    pairs = _summed(stored).where(often)
    tripled = counters(stored)

    def third(block: Block) -> Iterator[tuple]:
        at, place, _, h, _ = _beside(block)
        h, start = _triples(block, at, place, h)
        start = start[_held(tripled.value, h)]
        key, joined = block.key, np.zeros(block.key.size, bool)
        joined[start] = True
        rows = np.stack([key[start], key[start + 1], key[start + 2], *[np.full(start.size, -1)] * (LONGEST - 3)], axis=1)
        on = np.ones(start.size, bool)
        for i in range(3, LONGEST):
            on &= joined[start + i - 2]
            rows[on, i] = key[(start + i)[on]]
        rows = rows[np.lexsort(rows.T[::-1])]  # prefix order
        for size in range(3, LONGEST + 1):
            held = rows[rows[:, size - 1] >= 0, :size]
            if len(held):
                starts = _runs(held)
                yield held[starts], None, np.diff(np.append(starts, len(held)))

    longer = _summed(_each_block(texts, third)).where(often)
    found = written_table(words.unionByName(pairs).unionByName(longer), "phrases")
    for bits in (coupled, tripled):
        bits.unpersist()
    return found, sums


def collocations(docs: DataFrame, most: int = 2000) -> DataFrame:
    """The first `most` phrases of each language: `lang, rank, phrase, a, l, r, n, score`.

    `docs` has `lang, text`. Two streams of the frequent phrases' counts are kept: in prefix order, a phrase stands with the phrases
    that begin with all but its last word, in suffix order with those that end in all but its first. Sort-merge joins of
    neighbouring lengths walk them in lockstep and carry the counts of all left parts, of all right parts, and of the most frequent
    extension by one word on either side (a longer phrase that holds INSIDE hundredths of the occurrences goes through such an
    extension, since counts fall with length). Products are 38-digit decimals: exact while a language has fewer than
    10^17 words.

    Null texts are empty, null languages `und`. Each row counts, repeated ones too; other columns are ignored. Empty tables give no rows.
    """
    phrases, sums = frequent(docs)
    last, first = F.size("words"), F.get("words", F.lit(0))
    of_size = {m: phrases.where(last == m) for m in range(1, LONGEST + 1)}
    none = F.lit(None).cast("array<long>")
    held = of_size[1].select("lang", "words", F.col("c").alias("a"), none.alias("left"), none.alias("right"))
    out = []
    for m in range(2, LONGEST + 1):
        streams = of_size[m].select(
            "lang", "words", F.col("c").alias("a"), F.slice("words", 1, m - 1).alias("head"), F.slice("words", 2, m - 1).alias("tail")
        )
        # Prefix order: left parts' counts, and the best extension to the right.
        by_head = held.select("lang", F.col("words").alias("head"), F.concat(F.coalesce("left", F.array().cast("array<long>")), F.array("a")).alias("left"))
        by_tail = held.select("lang", F.col("words").alias("tail"), F.concat(F.array("a"), F.coalesce("right", F.array().cast("array<long>"))).alias("right"))
        grown = streams.join(by_head.hint("merge"), ["lang", "head"]).join(by_tail.hint("merge"), ["lang", "tail"])
        grown = written_table(grown.select("lang", "words", "a", "head", "tail", "left", "right"), f"phrases-{m}")
        right = grown.groupBy("lang", F.col("head").alias("words")).agg(F.max("a").alias("more_right"))
        left = grown.groupBy("lang", F.col("tail").alias("words")).agg(F.max("a").alias("more_left"))
        if m > 2:
            out.append(held.join(right.hint("merge"), ["lang", "words"], "left").join(left.hint("merge"), ["lang", "words"], "left"))
        held = grown.select("lang", "words", "a", "left", "right")
    out.append(held.withColumn("more_right", F.lit(None).cast("long")).withColumn("more_left", F.lit(None).cast("long")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    more = F.greatest(F.coalesce("more_right", F.lit(0)), F.coalesce("more_left", F.lit(0)))
    kept = whole.where(100 * more < INSIDE * F.col("a")).join(sums, "lang")
    big = lambda c: f"cast({c} AS decimal(17,0))"
    cut = (
        "transform(sequence(1, size(words) - 1), k -> struct("
        f"(cast(1000 AS decimal(4,0)) * ({big('a')} * {big('n')})) div ({big('left[k - 1]')} * {big('right[k - 1]')}) AS score, k AS k, left[k - 1] AS l, right[k - 1] AS r))"
    )
    kept = kept.withColumn("cut", F.array_min(F.expr(cut)))
    rows = kept.select(
        "lang", F.array_join("words", " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    dealt = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", dealt).orderBy(*order))).where(F.col("rank") <= most)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
