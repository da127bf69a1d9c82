"""Benchmark decontamination by template windows, in which numbers, names and units are typed slots, and by plain windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.byte_words import digits_only, hash_of, mix, word_hashes, words
from logspark.llm.common import named, written_table

#: Words of a window; share of an item's windows that make a leak; share of its slot pairs that must agree.
WINDOW, COVERED, AGREE = 8, 0.5, 0.9
#: Words that are no slots in a template window that counts; slots alone would fit any list of numbers or names.
LITERALS = 3
#: Bits of the filter that keeps most of the corpus's windows out of the join.
BLOOM = 24

# Number words and units.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
UNITS = (
    "km kilometers kilometres miles mile m meters metres meter cm centimeters mm inches inch feet ft yards kg kilograms kilogram g grams gram lbs "
    "pounds pound ounces oz tons liters litres liter ml gallons gallon hours hour minutes minute seconds second days day weeks week months month years "
    "year dollars dollar cents cent euros euro percent degrees mph kmh"
)

_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0xA5A5000000000001, 0xA5A5000000000002, 0xA5A5000000000003))
#: Keeps the hashes of plain windows apart from those of templates.
_PLAIN = np.uint64(0xA5A5000000000004)


@cache
def _lexicon() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.sort(np.array([hash_of(w) for w in text.split()], np.uint64)) for text in (NUMBERS, UNITS))


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def template(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical word hashes of a text, which words are slots, the bytes and ranges of the words, and their own hashes.

    Numbers (digits, number words), units and names are slots. A name is a capitalised word of two letters or
    more inside a sentence.
    """
    raw, starts, ends = words(text)
    if not starts.size:
        return np.zeros(0, np.uint64), np.zeros(0, bool), raw, starts, ends, np.zeros(0, np.uint64)
    own = word_hashes(raw, starts, ends)
    numbers, units = _lexicon()
    first = raw[starts]
    broken = np.concatenate([[0], np.cumsum(np.isin(raw, np.frombuffer(b".!?:;\n\r|\"(", np.uint8)))])
    inside = np.concatenate([[False], broken[starts[1:]] == broken[ends[:-1]]])
    capital = ((first >= 65) & (first <= 90)) & (ends - starts > 1)
    out = own.copy()
    out[capital & inside] = _NAME
    out[_within(own, units)] = _UNIT
    out[digits_only(raw, starts, ends) | _within(own, numbers)] = _NUM
    return out, out != own, raw, starts, ends, own


def windows(canon: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` canonical words."""
    n = len(canon) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size), np.uint64)
    for i in range(size):
        total += canon[i : i + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
    return mix(total)


def _both_windows(canon: np.ndarray, slot: np.ndarray, own: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of template windows with enough literal words, and of all plain ones (A-Z lower-cased); which are plain."""
    h = windows(canon, size)
    if not h.size:
        return h, np.zeros(0, np.int64), np.zeros(0, bool)
    slots = np.concatenate([[0], np.cumsum(slot)])
    at = np.flatnonzero(size - (slots[size:] - slots[:-size]) >= LITERALS)
    hashes = np.concatenate([h[at], mix(windows(own, size) ^ _PLAIN)])
    return hashes, np.concatenate([at, np.arange(h.size)]), np.arange(hashes.size) >= at.size


def _slots(raw, starts, ends, slot, at: int, size: int) -> list[str]:
    return [bytes(raw[starts[i] : ends[i]]).decode("utf-8", "replace").lower() for i in range(at, at + size) if slot[i]]


def _filter_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - BLOOM)).astype(np.int64), ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BLOOM)).astype(np.int64)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """`h, item_id, tpos, n_windows, size, plain, item_slots` of `item_id, text`; an item shorter than a window is one window."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, text in zip(frame["item_id"], frame["text"], strict=True):
                canon, slot, raw, starts, ends, own = template(text)
                size = min(WINDOW, len(canon))
                if size:
                    h, at, plain = _both_windows(canon, slot, own, size)
                    yield pd.DataFrame({
                        "h": h.view(np.int64), "item_id": item, "tpos": at, "n_windows": len(canon) - size + 1, "size": size, "plain": plain,
                        "item_slots": [[] if p else _slots(raw, starts, ends, slot, i, size) for i, p in zip(at.tolist(), plain, strict=True)],
                    })

    held = benchmark.where("item_id IS NOT NULL").select("item_id", "text")
    return held.mapInPandas(run, "h long, item_id long, tpos long, n_windows long, size long, plain boolean, item_slots array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items found in whole texts: `doc_id, text_hash, item_id, covered, n_windows, share, exact`.

    Both sides become templates, whose windows of WINDOW words are joined by their hashes; windows of fewer than LITERALS words besides
    slots prove nothing and take no part. Plain windows of the same words, A-Z lower-cased, are joined in the same pass, so that
    a copy in other capitals, or of an item made of numbers, is found by its very words. The corpus side is cut down inside its scan
    by a bit filter of fixed size over the item windows (2^BLOOM bits, also on the driver); the join itself is left to Spark: items
    of a size below the session's threshold are broadcast, others shuffled, with its splitting of hot windows. On each diagonal (place in the text minus place in the item) the slots
    must agree: a value of the item always stands for the same value in the text, but for 1 - AGREE of the pairs.
    An item is found when agreeing diagonals, or plain windows, hold COVERED of its places. `exact` tells whether all slot values that
    count are the item's own.

    Null and empty texts and items hold nothing. Rows with the same doc_id and text are one. Null doc_ids are reported with null.
    Repeated items are one item.
    """
    items = written_table(item_windows(benchmark), "item-windows")

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            place = np.unique(np.concatenate(_filter_places(frame["h"].to_numpy(np.int64).view(np.uint64))))
            yield pd.DataFrame({"word": place >> 5, "mask": np.int64(1) << (place & 31)})

    filled = items.mapInPandas(fill, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    bits = np.zeros(1 << (BLOOM - 5), np.uint32)
    for r in filled.collect():
        bits[r["word"]] = r["mask"]
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        held = lambda place: (bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1 != 0
        for frame in frames:
            for doc, text_hash, text in zip(frame["doc_id"], frame["text_hash"], frame["text"], strict=True):
                canon, slot, raw, starts, ends, own = template(text)
                for size in sizes:
                    h, pos, plain = _both_windows(canon, slot, own, size)
                    one, two = _filter_places(h)
                    at = np.flatnonzero(held(one))
                    at = at[held(two[at])]
                    if at.size:
                        yield pd.DataFrame({
                            "doc_id": pd.array([None if pd.isna(doc) else int(doc)] * at.size, "Int64"), "text_hash": text_hash,
                            "of_h": h[at].view(np.int64), "pos": pos[at],
                            "slots": [[] if p else _slots(raw, starts, ends, slot, i, size) for i, p in zip(pos[at].tolist(), plain[at], strict=True)],
                        })

    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = own.mapInPandas(hits, "doc_id long, text_hash long, of_h long, pos long, slots array<string>")
    both = found.join(items, found["of_h"] == items["h"])
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = both.select(
        "doc_id", "text_hash", "item_id", "n_windows", "plain", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos", pairs.alias("pairs")
    )
    lines = both.groupBy("doc_id", "text_hash", "item_id", "n_windows", "diagonal").agg(
        F.collect_set(F.when(F.col("plain"), F.col("tpos"))).alias("plain"), F.collect_set(F.when(~F.col("plain"), F.col("tpos"))).alias("tpos"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    agree = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) >= AGREE * F.size("pairs")
    same = F.forall("pairs", lambda p: p["a"] == p["b"])
    lines = lines.select(
        "doc_id", "text_hash", "item_id", "n_windows", F.when(agree, F.array_union("plain", "tpos")).otherwise(F.col("plain")).alias("tpos"),
        (same | ~agree).alias("same"),
    ).where(F.size("tpos") > 0)
    items_found = lines.groupBy("doc_id", "text_hash", "item_id", "n_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).cast("long").alias("covered"), F.every("same").alias("exact")
    )
    share = F.col("covered") / F.col("n_windows")
    return items_found.withColumn("share", share).where(F.col("share") >= COVERED).select(
        "doc_id", "text_hash", "item_id", "covered", "n_windows", "share", "exact"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` that hold no benchmark item, with their columns as they are."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).distinct()
    found = written_table(found, "leaking")
    held = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("of_id")) & (F.xxhash64("doc.text") == F.col("of_hash"))
    return held.join(found, same, "left_anti").select("doc.*")
