"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import written_table

#: Hash tables, share of a table's buckets that a query probes, and candidates it should meet at least (all if fewer).
TABLES, PROBES, WANTED = 10, 0.08, 1000
#: Vectors and queries that meet in one group at most, about; larger buckets are split into such groups.
GROUP, QUERIES = 20_000, 4_000
#: Bands of length that an octave has.
STEPS = 4


def usable(table: DataFrame) -> DataFrame:
    """`vec_id, v` (doubles) of the vectors that take part: not null, not zero, all components finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    held = table.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    return held.where(finite & F.exists("v", lambda x: x != 0))


def by_size(frame: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, vec_ids and vectors of the rows of each dimension; rows that are repeated here come once."""
    for dim, own in frame.groupby(frame["v"].map(len)):
        v = np.array(own["v"].tolist(), dtype=np.float64).reshape(len(own), dim)
        once = ~pd.DataFrame({"vec_id": own["vec_id"].to_numpy(), "v": [r.tobytes() for r in v]}).duplicated().to_numpy()
        yield int(dim), own["vec_id"].to_numpy(np.int64)[once], v[once]


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """Pseudo-random rotation: three rounds of random signs and the fast Hadamard transform."""
    n = x.shape[1]
    for turn in range(3):
        x = x * np.random.default_rng([seed, table, turn]).choice([-1.0, 1.0], n)
        half = 1
        while half < n:
            x = x.reshape(len(x), -1, 2, half)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
            half *= 2
        x = x / np.sqrt(n)
    return x


def axes(x: np.ndarray, table: int, probes: int, seed: int) -> np.ndarray:
    """The nearest signed axes of each rotated vector, nearest first."""
    y = rotated(x, table, seed)
    signed = np.concatenate([y, -y], axis=1)
    if probes == 1:
        return signed.argmax(axis=1)[:, None]
    return np.argsort(-signed, axis=1, kind="stable")[:, :probes]


def directions(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of `width` components, and the bands of length they come from."""
    most = np.abs(v).max(axis=1, keepdims=True)
    unit = v / most
    length = np.sqrt((unit**2).sum(axis=1, keepdims=True))
    # Half a step aside, so that vectors of about unit length share a band.
    band = np.floor(STEPS * (np.log2(most) + np.log2(length)) + 0.5)[:, 0].astype(np.int64)
    return np.pad(unit / length, ((0, 0), (0, width - v.shape[1]))), band


def exact(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, summed component by component in double precision."""
    total = np.zeros(len(d))
    for i in range(d.shape[1]):
        total += q[:, i] * d[:, i]
    return total


def search(
    table: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, probe_share: float = PROBES, seed: int = 7
) -> DataFrame:
    """The k largest inner products for each row whose vec_id is divisible by `every`: `query_id, rank, vec_id, score`.

    Vectors are hashed by their directions, so that a vector's length does not move its bucket. What a short
    direction match loses, a greater length can win: vectors are counted by bands of nearly equal length, and only a
    band that is large enough for a share of it to hold WANTED vectors is hashed, or one that holds most of the vectors.
    Every query meets all vectors of the other bands.

    A hashed vector falls into one bucket a table, that of its nearest signed axis after a fast Hadamard
    pseudo-rotation; a query probes the buckets of its nearest axes. A bucket's vectors and queries
    meet in one group, where candidates are reranked by their exact products and the k best of a query leave it.
    Buckets are counted first (as many numbers as tables times axes); a large one is split by vectors
    and by queries, and the parts are paired, so no group grows with a hot bucket and no candidate is lost. The share of axes probed
    rises where few vectors are held, so that small tables are searched whole. Queries that end with fewer
    than k candidates meet every vector.

    Vectors that are null, zero or hold null or non-finite components take no part. Vectors of each dimension are
    searched among their own. Rows that repeat a vec_id are one candidate with its best product; a query never
    meets its own vec_id.
    Ties go to the smaller vec_id.
    """
    held = usable(table)

    def lengths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, _, v in by_size(frame):
                band, n = np.unique(directions(v, dim)[1], return_counts=True)
                yield pd.DataFrame({"dim": dim, "band": band, "n": n})

    # One row a dimension and band: a few numbers.
    kinds: dict[int, dict[int, int]] = {}
    for dim, band, n in held.mapInPandas(lengths, "dim int, band long, n long").groupBy("dim", "band").agg(F.sum("n").alias("n")).collect():
        kinds.setdefault(dim, {})[band] = n
    schema = "query_id long, rank int, vec_id long, score double"
    if not kinds:
        return table.sparkSession.createDataFrame([], schema)
    # By dimension: first bucket (of the vectors that all queries meet), width, probes, and the bands that are not hashed.
    plans, n_buckets = {}, 0
    for dim, bands in kinds.items():
        large = [n for n in bands.values() if n * probe_share >= WANTED or n > max(WANTED, sum(bands.values()) / 2)]
        width = 1 << max(1, (dim - 1).bit_length())
        probes = int(min(2 * width, max(1, round(2 * width * probe_share), -(-2 * width * WANTED // min(large))))) if large else 0
        plans[dim] = n_buckets, width, probes, [band for band, n in bands.items() if n not in large]
        n_buckets += 1 + (2 * width * tables if large else 0)

    def places(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Ids and vectors; the rows that fall into buckets, and those; the rows that ask, and the buckets they probe."""
        for at in range(0, len(frame), 2000):
            for dim, ids, v in by_size(frame.iloc[at : at + 2000]):
                start, width, probes, whole = plans[dim]
                unit, band = directions(v, width)
                near = ~np.isin(band, whole) & (probes > 0)
                asks, rows, rest = np.flatnonzero(ids % every == 0), np.flatnonzero(near), np.flatnonzero(~near)
                if whole:
                    yield ids, v, rest, np.full(len(rest), start), asks, np.full((len(asks), 1), start)
                for t in range(tables if probes else 0):
                    first = start + 1 + 2 * width * t
                    own = axes(unit[rows], t, 1, seed)[:, 0] if len(rows) else rows
                    yield ids, v, rows, first + own, asks, first + axes(unit[asks], t, probes, seed) if len(asks) else np.zeros((0, probes), int)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, n_buckets), np.int64)
        for frame in frames:
            for _, _, _, own, _, asked in places(frame):
                sums[0] += np.bincount(own, minlength=n_buckets)
                sums[1] += np.bincount(asked.ravel(), minlength=n_buckets)
        full = np.flatnonzero(sums.sum(axis=0))
        yield pd.DataFrame({"bucket": full, "n": sums[0, full], "asked": sums[1, full]})

    sizes = held.mapInPandas(count, "bucket long, n long, asked long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked"))
    splits = np.ones((2, n_buckets), np.int64)
    for bucket, n_data, n_asked in sizes.collect():
        splits[:, bucket] = max(1, -(-n_data // GROUP)), max(1, -(-n_asked // QUERIES))

    def deal(places, splits: np.ndarray):
        """Rows of cells (bucket, part of its vectors, part of its queries): each vector and each query where it is met."""

        def copies(rows: np.ndarray, buckets: np.ndarray, spread: np.ndarray, own: int) -> tuple[np.ndarray, ...]:
            """Row, bucket, its own part and every part of the other side."""
            n = splits[1 - own, buckets]
            rows, met = np.repeat(rows, n), np.repeat(buckets, n)
            other = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            return rows, met, (spread[rows] % splits[own, met].astype(np.uint64)).astype(np.int64), other

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for ids, v, held, own, asks, asked in places(frame):
                    raw = np.empty(len(v), dtype=object)
                    raw[:] = [r.tobytes() for r in v]
                    spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
                    d, d_bucket, d_a, d_b = copies(held, own, spread, 0)
                    q, q_bucket, q_b, q_a = copies(np.repeat(asks, asked.shape[1]), asked.ravel(), spread, 1)
                    rows = np.concatenate([d, q])
                    yield pd.DataFrame({
                        "bucket": np.concatenate([d_bucket, q_bucket]), "a": np.concatenate([d_a, q_a]), "b": np.concatenate([d_b, q_b]),
                        "asks": np.arange(len(rows)) >= len(d), "vec_id": ids[rows], "v": raw[rows],
                    })

        return run

    def rerank(frame: pd.DataFrame) -> pd.DataFrame:
        """The k best vec_ids of each query vector here; a vec_id counts once, with its best product."""
        frame = frame.drop_duplicates(["asks", "vec_id", "v"]).sort_values("vec_id", kind="stable")
        ids, asks = frame["vec_id"].to_numpy(np.int64), frame["asks"].to_numpy(bool)
        v = np.frombuffer(b"".join(frame["v"]), np.float64).reshape(len(frame), -1)
        d, d_ids, q, q_ids = v[~asks], ids[~asks], v[asks], ids[asks]
        longest = np.linalg.norm(d, axis=1).max(initial=0.0)
        own_ids, starts, of = np.unique(d_ids, return_index=True, return_inverse=True)
        n, out = len(own_ids), []
        for at in range(0, len(q) if len(d) else 0, 256):
            part, part_ids = q[at : at + 256], q_ids[at : at + 256]
            near = part @ d.T
            near[part_ids[:, None] == d_ids[None, :]] = -np.inf
            tops = near if n == len(d) else np.maximum.reduceat(near, starts, axis=1)
            edge = np.partition(tops, n - k, axis=1)[:, n - k] if n > k else np.full(len(part), -np.inf)
            # Products by matrix differ in the last digits; what is near the edge is computed anew, of each vec_id what is near its best.
            slack = 1e-9 * np.where(np.isfinite(edge), np.maximum(1.0, np.abs(edge)), 1.0) + 1e-13 * np.linalg.norm(part, axis=1) * longest
            some = (near > -np.inf) & ~(near < (edge - slack)[:, None])
            if n < len(d):
                some &= ~(near < tops[:, of] - slack[:, None])
            row, col = np.nonzero(some)
            if not len(row):
                continue
            # Columns stand by vec_id, so one vec_id of one query is a run.
            which = row * n + of[col]
            first = np.flatnonzero(np.diff(which, prepend=-1))
            score = np.maximum.reduceat(exact(part[row], d[col]), first)
            row, met = row[first], of[col[first]]
            order = np.lexsort((met, -score, row))
            row, met, score = row[order], met[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best = place < k
            out.append(pd.DataFrame({"query_id": part_ids[row[best]], "vec_id": own_ids[met[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    def nearest(rows: DataFrame, places, splits: np.ndarray) -> DataFrame:
        cells = rows.mapInPandas(deal(places, splits), "bucket long, a long, b long, asks boolean, vec_id long, v binary")
        found = cells.groupBy("bucket", "a", "b").applyInPandas(rerank, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return found.select("query_id", "rank", "vec_id", "score")

    found = nearest(held, places, splits)
    if not any(0 < probes < 2 * width for _, width, probes, _ in plans.values()):
        return found
    found = written_table(found, "neighbours")
    asking = held.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id")).distinct()
    few = written_table(asking.join(found.where(F.col("rank") == k), "query_id", "left_anti"), "few-neighbours")
    n_few = few.count()
    if not n_few:
        return found
    starts = {dim: i for i, dim in enumerate(plans)}

    def everywhere(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for asks in (False, True):
            for dim, ids, v in by_size(frame[frame["few"] == asks]):
                rows = np.arange(len(ids))
                yield ids, v, rows, np.full(len(ids), starts[dim]), rows[: len(rows) * asks], np.full((len(ids) * asks, 1), starts[dim])

    parts = np.array([[max(1, -(-sum(bands.values()) // GROUP)) for bands in kinds.values()], [-(-n_few // QUERIES)] * len(kinds)])
    marked = held.join(few.withColumn("few", F.lit(True)), F.col("vec_id") == F.col("query_id"), "left")
    marked = marked.select("vec_id", "v", F.coalesce("few", F.lit(False)).alias("few"))
    return found.join(few, "query_id", "left_anti").select(*found.columns).unionByName(nearest(marked, everywhere, parts))
