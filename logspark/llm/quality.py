"""Quality classifier by importance resampling over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm.byte_words import mix, tokens, word_hashes
from logspark.llm.common import named, written_table

#: Labelled texts that the models are fitted on, about; every CHECK-th of them tells where to cut instead.
SAMPLE, CHECK = 16_000, 4
#: Buckets of n-grams; how many uses of the pooled model smooth each model; weight of a lost clean text at the cut.
BUCKETS, SMOOTH, LOSS = 1 << 17, 500.0, 10.0
#: Least G-squared statistic, over families of texts, with which a bucket tells two models apart; others weigh nothing.
EVIDENCE = 50.0
#: Label of a target text, and of raw texts by what is wrong with them: each kind has a model of its own.
TARGET, LOW, TOXIC = 0, 1, 2

_SAME = np.uint64(0x1234567)


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's hashed n-grams: tokens, pairs of neighbours, and whether a token repeats the one before."""
    raw, starts, ends = tokens(text)
    if not starts.size:
        return np.zeros(0, np.int64)
    one = word_hashes(raw, starts, ends)
    same = one[1:] == one[:-1]
    two = mix(one[:-1] * np.uint64(3) + one[1:])
    two[same] = _SAME
    marks = np.uint64(64 - (BUCKETS.bit_length() - 1))
    return (mix(np.concatenate([one, two])) >> marks).astype(np.int64)


def family(text: str | None) -> int:
    """The least hash among a text's pairs of neighbours, its only token, or 0: near copies mostly share it."""
    found = features(text)
    n = (found.size + 1) // 2
    pairs = found[n:] if found.size > 1 else found
    return int((mix(pairs.astype(np.uint64)) >> np.uint64(1)).min()) if pairs.size else 0


@F.pandas_udf(T.LongType())
def _families(texts: pd.Series) -> pd.Series:
    return pd.Series([family(t) for t in texts], dtype="int64")


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Uses of each bucket and texts that hold it, by kind of text: summed in each task, then over tasks."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uses, held = np.zeros((3, BUCKETS)), np.zeros((3, BUCKETS))
        for frame in frames:
            for kind, text in zip(frame["kind"], frame["text"], strict=True):
                n = np.bincount(features(text), minlength=BUCKETS)
                uses[int(kind)] += n
                held[int(kind)] += n > 0
        for side in range(3):
            full = np.flatnonzero(uses[side])
            yield pd.DataFrame({"side": side, "bucket": full, "n": uses[side, full], "d": held[side, full]})

    rows = docs.mapInPandas(count, "side int, bucket int, n double, d double")
    uses, held = np.zeros((3, BUCKETS)), np.zeros((3, BUCKETS))
    for side, bucket, n, d in rows.groupBy("side", "bucket").agg(F.sum("n"), F.sum("d")).collect():
        uses[side, bucket], held[side, bucket] = n, d
    return uses, held


def evidence(target: np.ndarray, raw: np.ndarray, n_target: int, n_raw: int) -> np.ndarray:
    """G-squared statistic of each bucket: texts that hold it, of the target's and of the raw ones."""
    share = (target + raw) / (n_target + n_raw)
    out = np.zeros(len(share))
    for held, n in ((target, n_target), (raw, n_raw)):
        for part, chance in ((held, share), (n - held, 1 - share)):
            some = part > 0
            out[some] += 2 * part[some] * np.log(part[some] / (n * chance[some]))
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log-ratio of two smoothed bag-of-n-gram models."""
    pooled = (target + raw) / (target.sum() + raw.sum())
    smooth = [(c + SMOOTH * pooled) / (c.sum() + SMOOTH) for c in (target, raw)]
    seen = pooled > 0
    out = np.zeros(BUCKETS)
    out[seen] = np.log(smooth[0][seen]) - np.log(smooth[1][seen])
    return out


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`text, kind, check` of about `sample` labelled texts, chosen by a hash of the id, which bounds their number.

    Target texts have quality 1 and are not toxic; raw texts are the other labelled ones, LOW where the quality is bad, else
    TOXIC. The chosen labels (a few bytes a row, `sample` rows about) are broadcast to the texts. Of labels that
    differ for one id a bad one holds; of texts that differ the least counts, so repeated ids add no text.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    n = known.count()
    rate = min(1.0, sample / max(1, n))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    kind = F.when(F.col("quality") != 1, F.lit(LOW)).when(F.coalesce("toxic", F.lit(0)) != 0, F.lit(TOXIC)).otherwise(F.lit(TARGET))
    known = known.where(chance < int(rate * (1 << 20)) + (rate >= 1)).select("doc_id", kind.alias("kind"))
    worst = F.min(F.when(F.col("kind") != TARGET, F.col("kind")))
    known = known.groupBy("doc_id").agg(F.coalesce(worst, F.lit(TARGET)).alias("kind"))
    check = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(CHECK)) == 0
    chosen = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "kind", check.alias("check"))
    # Equal rows are combined in their tasks; what is shuffled is a text an id and task.
    return chosen.groupBy("doc_id", "kind", "check").agg(F.min("text").alias("text")).select("text", "kind", "check")


def _ratios(learning: DataFrame) -> np.ndarray:
    """Log-ratios of the target's model over that of each kind of raw text, 0 for buckets that prove nothing."""
    uses, held = _frequencies(learning)
    n = {k: rows for k, rows in learning.groupBy("kind").count().collect()}
    kinds = [k for k in (LOW, TOXIC) if uses[TARGET].any() and uses[k].any()]
    out = np.zeros((len(kinds), BUCKETS))
    for ratio, k in zip(out, kinds, strict=True):
        proven = evidence(held[TARGET], held[k], n[TARGET], n[k]) >= EVIDENCE
        ratio[proven] = log_ratio(uses[TARGET], uses[k])[proven]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Log-ratios of n-gram models, target over each kind of raw text, and the weight to cut at.

    Near copies are one text to the models: of the learning texts of one kind and family, one is counted (every text, where
    families are too few to prove anything). The models are
    smoothed towards the pooled one, and buckets that do not tell two models apart by the number of texts that hold them
    weigh nothing, so that the many rare words of a long text, or of a text with many copies, do not drown what matters. The cut is the weight that
    parts the held-out labelled texts best when a lost target text counts LOSS times a kept other one. Without
    texts of both sides every weight is 0 and all are kept.
    """
    known = labelled(docs, labels, sample).withColumn("family", _families("text")).withColumn("row", F.monotonically_increasing_id())
    known = written_table(known, "labelled")
    learning = known.where("NOT check")
    one = learning.groupBy("kind", "family").agg(F.min("row").alias("row")).select("row")
    ratios = _ratios(learning.join(one, "row", "left_semi"))
    if not ratios.any():
        ratios = _ratios(learning)
    model = {"ratios": ratios, "cut": -1.0}
    if not len(ratios):
        return model
    checks = known.where("check").select(weight(known, model, "text").alias("w"), (F.col("kind") == TARGET).cast("int").alias("target")).toPandas()
    if checks["target"].nunique() == 2:
        checks = checks.sort_values("w", kind="stable")
        w = np.concatenate([[checks["w"].iloc[0] - 2.0], checks["w"].to_numpy(), [checks["w"].iloc[-1] + 2.0]])
        lost = np.concatenate([[0], np.cumsum(checks["target"])])
        other = np.concatenate([[0], np.cumsum(1 - checks["target"])])
        cost = np.where(w[1:] > w[:-1], LOSS * lost + other[-1] - other, np.inf)  # equal weights are not parted
        best = int(cost.argmin())
        model["cut"] = float((w[best] + w[best + 1]) / 2)
    return model


def weigh(text: str | None, ratios: np.ndarray) -> float:
    """Log importance weight of a text: target over an even mixture of the raw models, each taken over the whole text."""
    if not len(ratios):
        return 0.0
    found = features(text)
    return float(-np.logaddexp.reduce([-r[found].sum() for r in ratios]) + np.log(len(ratios)))


def weight(docs: DataFrame, model: dict, text: str = "text") -> Column:
    """`weigh` of a whole text column; 0 for null and empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model["ratios"])

    @F.pandas_udf("double")
    def total(texts: pd.Series) -> pd.Series:
        return pd.Series([weigh(t, shared.value) for t in texts], dtype="float64")

    return total(text)


def gumbel(seed: int = 17) -> Column:
    """Standard Gumbel noise that the doc_id determines; null ids share theirs."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value by narrowing histograms: each round is one small aggregate, nothing is sorted."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return None
    above, part = 0, df
    while low < high:
        width = (high - low) / bins
        number = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        rows = part.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["low"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        if (r["low"], r["high"]) == (low, high) and len(rows) == 1:
            return low
        low, high = r["low"], r["high"]
        part = df.where((F.col(column) >= low) & (F.col(column) <= high))
    return low


def select(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The resampled texts: rows of `docs` that stay, with `log_weight`, `score` (0 to 1) and `sample_key` added.

    Weights are taken over all rows; k is the number of rows whose weight reaches the model's cut, and the k rows with the
    largest weight plus Gumbel noise stay (Gumbel top-k: a draw without replacement in proportion to the
    weights). The k-th key is found by histograms over a written table of keys, so no order of all
    rows is needed, and texts are never shuffled: they are weighed once for the cut and once as they pass.
    Rows that tie with the k-th stay too, repeated rows among them. Null and empty texts weigh 0. An empty table gives no rows. Columns of
    these names in the input are replaced.
    """
    model = fit(docs, labels, sample)
    own = ("log_weight", "score", "sample_key")
    held = docs.select(F.struct(*[named(c) for c in docs.columns if c not in own]).alias("doc"), "doc_id", "text")
    held = held.withColumn("log_weight", weight(docs, model))
    held = held.withColumn("sample_key", F.col("log_weight") + gumbel())
    keys = written_table(held.select("log_weight", "sample_key"), "sample-keys")
    k = keys.where(F.col("log_weight") >= model["cut"]).count()
    edge = kth_largest(keys, "sample_key", k)
    kept = held.where(F.col("sample_key") >= F.lit(edge if edge is not None else float("inf")))
    score = 1 / (1 + F.exp(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), model["cut"] - F.col("log_weight")))))
    return kept.select("doc.*", "log_weight", score.alias("score"), "sample_key")


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows of `docs` that `select` keeps, with their columns as they are."""
    held = docs.select("doc_id", "text", F.struct(*[named(c) for c in docs.columns]).alias("kept"))
    return select(held, labels, sample).select("kept.*")
