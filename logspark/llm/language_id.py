"""Language of a text by bit-sliced Bloom filters over character trigrams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import written_table

#: Labelled texts learned from, per language and about; size and hashes of the filters.
SAMPLE, BITS, HASHES = 3000, 18, 2
#: A trigram belongs to a language with at least so many uses there and so much of its largest share in any.
LEAST, SHARE = 3, 0.2

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_CHUNK = 1_000_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """Keys of a text's letter trigrams in bounded pieces; anything but letters is one border."""
    for at in range(0, len(text or ""), _CHUNK):
        part = text[max(0, at - 2) : at + _CHUNK].lower()
        points = np.frombuffer(f" {part} ".encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.where(_letters()[points], points, 32).astype(np.uint64)
        inner = points[1:-1] != 32
        keys = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
        if (keys := keys[inner]).size:
            yield keys


def slots(keys: np.ndarray, k: int, bits: int = BITS) -> np.ndarray:
    """Place of each key under the k-th hash."""
    mixed = keys * _MULTIPLIERS[k]
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MULTIPLIERS[-1 - k]) >> np.uint64(64 - bits)).astype(np.int64)


def learning_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows that may be learned from."""
    return docs.where("lang IS NOT NULL AND coalesce(crc32(cast(doc_id AS string)) % 4, 0) != 2")


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Learn the filters from `doc_id, text, lang`.

    About `sample` rows a language are counted, chosen by a hash, which bounds the work at any input
    size; every label is learned. Trigrams are counted in each task before their
    counts are shuffled. What reaches the driver is the filter itself: at most 2^BITS words a
    block of 64 languages, and the labels. Returns plain arrays that are broadcast for prediction.
    """
    spark = docs.sparkSession
    labelled = learning_rows(docs)
    listed = written_table(labelled.groupBy("lang").agg(F.count("*").alias("n_texts")), "languages")
    sizes = listed.orderBy(F.desc("n_texts"), "lang").collect()
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return {"names": [], "table": np.zeros((1, 1), np.uint64), "false": np.zeros(0), "usual": None}
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rates = listed.select(F.col("lang").alias("of_lang"), F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n_texts")).alias("rate"))
    some = labelled.select("text", "lang", chance.alias("chance")).join(F.broadcast(rates), F.col("lang") == F.col("of_lang"))
    chosen = some.where(F.col("chance") < F.col("rate")).select("text", "lang")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, part in frame.groupby("lang"):
                for text in part["text"].dropna():
                    for keys in trigrams(text):
                        gram, n = np.unique(keys, return_counts=True)
                        yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n})

    counts = chosen.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    # As many rows a trigram as languages hold it: small groups, no window needed over the table.
    held = shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share", "n")).alias("l"))
    held = held.select("gram", "most", F.explode("l").alias("l")).where((F.col("l.share") >= SHARE * F.col("most")) & (F.col("l.n") >= LEAST))
    place = {name: i for i, name in enumerate(names)}

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            index = frame["lang"].map(place).to_numpy(np.int64)
            keys = frame["gram"].to_numpy(np.int64).view(np.uint64)
            masks = (np.uint64(1) << (index % 64).astype(np.uint64)).view(np.int64)
            for k in range(HASHES):
                yield pd.DataFrame({"word": index // 64, "slot": slots(keys, k), "mask": masks})

    filled = held.select("gram", F.col("l.lang").alias("lang")).mapInPandas(fill, "word long, slot long, mask long")
    rows = filled.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).collect()
    table = np.zeros((-(-len(names) // 64), 1 << BITS), np.uint64)
    for r in rows:
        table[r["word"], r["slot"]] = np.uint64(r["mask"] & 0xFFFFFFFFFFFFFFFF)
    full = np.array([((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
    return {"names": names, "table": table, "false": full**HASHES, "usual": sizes[0]["lang"]}


def judge(text: str | None, model: dict) -> tuple[str, float]:
    """Language and score of one text: per-language popcounts of the masks, less their false positives."""
    names = model["names"]
    if not names or not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    hits, n = np.zeros(len(names)), 0
    for keys in trigrams(text):
        at = [slots(keys, k) for k in range(HASHES)]
        n += keys.size
        for word, row in enumerate(model["table"]):
            mask = row[at[0]]
            for other in at[1:]:
                mask &= row[other]
            for i in range(word * 64, min(len(names), word * 64 + 64)):
                hits[i] += np.count_nonzero(mask & np.uint64(1 << (i % 64)))
    if not n:
        return model["usual"], 0.0
    held = np.clip((hits / n - model["false"]) / np.maximum(1e-9, 1 - model["false"]), 0, 1)
    best = int(held.argmax())
    if held[best] <= 0:
        return model["usual"], 0.0
    return names[best], float(held[best] / held.sum())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` for every row of `docs`.

    Only the text decides. `und` with score 0 for null texts, texts without a letter, or when nothing
    was learned; texts none of whose trigrams is known get the most frequent label with score 0. Ties go to
    the label that sorts first. A null doc_id is not held out. The score is the winner's part
    of all corrected shares.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def tell(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t, shared.value) for t in texts], columns=["lang_pred", "score"])

    held_out = F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 4 = 2"), F.lit(False))
    told = docs.select("doc_id", held_out.alias("held_out"), tell("text").alias("told"))
    return told.select("doc_id", "held_out", "told.lang_pred", "told.score")
