"""Ranked lexical search: compact item tiles times document impact tiles, as exact float64 matrix products."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import written_table

#: Documents of an impact tile, cells of an item tile, and columns that are multiplied at once.
DOCS, CELLS, COLUMNS = 1024, 1 << 19, 2048
#: Items and their distinct terms that one pass over the corpus serves, about; more are served by more passes.
ITEMS, TERMS = 4096, 500_000
#: Bytes of a text that are cut into terms at once, about.
PIECE = 1 << 22
#: Groups a first ranking is dealt into, so that none holds all candidates of an item.
DEALT = 64
#: An impact is at most this; a partial sum of products stays below 2^53.
IMPACT = 1_000_000
WEIGHT = (1 << 53) // IMPACT - 1

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def counted(raw: bytes | None) -> tuple[int, Counter]:
    """Number of a text's terms with repeats, and how often each occurs. Only A-Z are lower-cased."""
    n, times, at, raw = 0, Counter(), 0, raw or b""
    while at < len(raw):
        stop = _BREAK.search(raw, at + PIECE) if len(raw) - at > PIECE else None
        end = stop.start() if stop else len(raw)
        found = _TERM.findall(raw[at:end].lower())
        n, at = n + len(found), end
        times.update(found)
    return n, times


def item_terms(items: DataFrame) -> DataFrame:
    """`item_id, term, times` of `item_id, text`; rows equal in both are one, different texts of one id are taken together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, text in zip(frame["item_id"], frame["text"], strict=True):
                times = counted(text)[1]
                ids = pd.array([item] * len(times), "Int64")
                yield pd.DataFrame({"item_id": ids, "term": list(times), "times": list(times.values())})

    own = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).distinct()
    return own.mapInPandas(run, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """`doc_id, n, terms, times` of each text that holds a term at all: its length, and the given terms it holds by number."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(shared.value)}
        for batch in batches:
            rows, length, held, times = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                n, found = counted(text.as_py())
                if n:
                    own = found.keys() & number.keys()
                    rows.append(i)
                    length.append(n)
                    held.append([number[t] for t in own])
                    times.append([found[t] for t in own])
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            lists = [pa.array(held, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(length, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return own.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def _spread(held: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column(0).flatten()), minlength=size)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], names=["term", "df"])

    found = held.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["term"].to_numpy(np.int64)] = found["df"].to_numpy(np.int64)
    return out


class Tile:
    """A few items over the terms they hold: `weights` has a row an item and a column a term.

    A weight is a term's own times its occurrences in the item. `cuts` part the columns so that no item's weights
    in a part add up to more than WEIGHT; a weight above it takes several columns.
    """

    def __init__(self, items: list[int], entries: list[list[tuple[int, int]]]):
        self.items = np.array(items)
        cells = [
            (row, (copy, term), min(WEIGHT, weight - copy * WEIGHT))
            for row, own in enumerate(entries)
            for term, weight in own
            for copy in range(-(-weight // WEIGHT))
        ]
        place = {key: i for i, key in enumerate(sorted({key for _, key, _ in cells}))}
        self.terms = np.array([term for _, term in place], np.int64)
        self.weights = np.zeros((len(items), len(place)))
        for row, key, weight in cells:
            self.weights[row, place[key]] = weight
        self.cuts, sums = [0], np.zeros(len(items))
        for column in range(len(place)):
            sums += self.weights[:, column]
            if sums.max() > WEIGHT or column - self.cuts[-1] >= COLUMNS:
                self.cuts.append(column)
                sums = self.weights[:, column].copy()
        self.cuts.append(len(place))

    def scores(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, size: int) -> np.ndarray:
        """Scores of the tile's items (rows) and the documents (columns) whose impacts are given by row and term."""
        total = np.zeros((len(self.items), n_docs), np.int64)
        for low, high in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            local = np.full(size, -1, np.int64)
            local[self.terms[low:high]] = np.arange(high - low)  # a term's columns lie in different parts
            column = local[term]
            held = column >= 0
            impacts = np.zeros((n_docs, high - low))
            impacts[row[held], column[held]] = impact[held]
            total += (self.weights[:, low:high] @ impacts.T).astype(np.int64)
        return total


def tiles(entries: dict[int, list[tuple[int, int]]]) -> list[Tile]:
    """Items in tiles of at most CELLS cells, or of one item; items whose weights are all 0 take no part."""
    out, items, terms = [], [], set()
    for item, own in entries.items():
        own = [(t, w) for t, w in own if w]
        if not own:
            continue
        more = terms | {t for t, _ in own}
        if items and len(more) * (len(items) + 1) > CELLS:
            out.append(Tile(items, [entries[i] for i in items]))
            items, more = [], {t for t, _ in own}
        items, terms = [*items, item], more
    return [*out, Tile(items, [entries[i] for i in items])] if items else out


class Best:
    """The k best documents of each item so far: the highest scores, ties to the smallest ids, absent ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.held = tuple(np.zeros(0, np.int64) for _ in range(4))

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[items][:, None])
        if not item.size:
            return
        new = (items[item], scores[item, doc], ids[doc], absent[doc])
        item, score, ids, absent = (np.concatenate([a, b]) for a, b in zip(self.held, new, strict=True))
        order = np.lexsort((ids, absent, -score, item))
        item, score, ids, absent = item[order], score[order], ids[order], absent[order]
        starts = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        sizes = np.diff(np.append(starts, item.size))
        kept = np.arange(item.size) - np.repeat(starts, sizes) < self.k
        full = sizes >= self.k
        self.least[item[starts[full]]] = score[starts[full] + self.k - 1]
        self.held = item[kept], score[kept], ids[kept], absent[kept]


def _ranked(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Each item's k best documents a group of tasks: `item_id, doc_id, score`."""
    listed = terms.toPandas()
    words = sorted(set(listed["term"]))
    held = written_table(postings(docs, words), "postings")
    whole = held.agg(F.count("*"), F.sum("n")).first()
    n_docs, n_terms = int(whole[0]), int(whole[1] or 0)
    df = _spread(held, len(words))
    own = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df]
    number, items, entries = {w: i for i, w in enumerate(words)}, {}, {}
    for item, term, times in zip(listed["item_id"], listed["term"], listed["times"], strict=True):
        key = items.setdefault(None if pd.isna(item) else int(item), len(items))
        entries.setdefault(key, []).append((number[term], own[number[term]] * int(times)))
    shared = docs.sparkSession.sparkContext.broadcast((list(items), entries, len(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, entries, size = shared.value
        of_items, best = tiles(entries), Best(len(names), k)
        for whole in batches:
            for low in range(0, whole.num_rows, DOCS):
                batch = whole.slice(low, DOCS)
                held, times = batch.column(2), np.asarray(batch.column(3).flatten())
                m = [25 + 75 * n * n_docs // n_terms for n in batch.column(1).to_pylist()]
                row = np.repeat(np.arange(batch.num_rows), np.asarray(held.value_lengths()))
                impact = (1_000_000_000 * times) // (1000 * times + 8 * np.array(m, np.int64)[row])
                ids, absent = batch.column(0).fill_null(0), np.asarray(batch.column(0).is_null().cast(pa.int64()))
                for tile in of_items:
                    scores = tile.scores(row, np.asarray(held.flatten()), impact, batch.num_rows, size)
                    best.add(tile.items, scores, np.asarray(ids), absent)
        item, score, ids, absent = best.held
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in item], pa.int64()), pa.array(ids, mask=absent > 0), pa.array(score)], names=["item_id", "doc_id", "score"]
        )

    some = held.where(F.size("terms") > 0).mapInArrow(run, "item_id long, doc_id long, score long")
    return some.withColumn("dealt", F.spark_partition_id() % DEALT)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Each item's `k` best documents with a score above 0: `item_id, rank, doc_id, score`.

    `docs` has `doc_id, text`, `items` has `item_id, text`. A first pass stores, for every whole text, its length and the terms of
    the items that it holds; corpus counts come from that table. Tasks then multiply tiles of items (only over terms that these
    items hold) with tiles of documents' integer impacts. A product of float64 matrices is exact here, since the columns are
    parted where a sum could reach 2^53; parts are added as 64-bit integers. Every task keeps the k best documents of
    each item, ties to the smaller id, and two rankings (a group of tasks, all) make the result. Items are dealt
    into passes of about ITEMS items and TERMS terms, so what is broadcast does not grow with the input.

    Null and empty texts hold no term. Every row of `docs` is a document of its own, also where ids repeat; null ids rank
    last among equal scores. Rows of `items` equal in both columns are one, different texts of one id (null is an id) are
    one item. Other columns are ignored.
    """
    terms = written_table(item_terms(items), "item-terms")
    size = terms.agg(F.count("*"), F.count_distinct(F.coalesce(F.col("item_id"), F.lit(0)), F.col("item_id").isNull())).first()
    passes = max(1, math.ceil(size[0] / TERMS), math.ceil(size[1] / ITEMS))
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(passes))
    found = reduce(DataFrame.unionByName, [_ranked(docs, terms.where(dealt == p), k) for p in range(passes)])
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "dealt").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
