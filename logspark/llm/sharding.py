"""Shards by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import written_table

#: Cells that the ring is counted in, virtual nodes of a shard, rows of a cell that are ranked together (about, and in 16 parts at least).
CELLS, NODES, PART_ROWS, PARTS = 1 << 16, 64, 1 << 18, 16


def ring(shards: int, nodes: int = NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """Virtual nodes as sorted `(cell, shard)`."""
    def at(shard: int, node: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=8).digest()) % cells

    return sorted((at(s, v), s) for s in range(shards) for v in range(nodes))


def place(counts: np.ndarray, shards: int, limits: list[int], nodes: int = NODES) -> pd.DataFrame:
    """Deal counted cells out to shards with limited loads: `cell, low, high, shard, slot, home`.

    Round by round every cell offers what it has left to the next shard clockwise, in ring order, and a
    shard takes what its limit leaves. Rows low to high - 1 of a cell get slots from `slot` on.
    Works on counts alone: its size is that of the ring.
    """
    cells = len(counts)
    points = ring(shards, nodes, cells)
    owner_at = np.searchsorted([c for c, _ in points], np.arange(cells), side="left") % len(points)
    clockwise: dict[int, list[int]] = {}

    def turn(point: int) -> list[int]:
        if point not in clockwise:
            around = [points[(point + i) % len(points)][1] for i in range(len(points))]
            clockwise[point] = list(dict.fromkeys(around))
        return clockwise[point]

    used, out = [0] * shards, []
    left = [(int(c), int(owner_at[c]), 0, int(counts[c])) for c in np.flatnonzero(counts)]
    for step in range(shards):
        rest = []
        for cell, point, low, high in left:
            order = turn(point)
            shard = order[step]
            if (taken := min(limits[shard] - used[shard], high - low)) > 0:
                out.append((cell, low, low + taken, shard, used[shard], order[0]))
                used[shard] += taken
                low += taken
            if low < high:
                rest.append((cell, point, low, high))
        left = rest
    if left:
        raise ValueError("the shards' limits are below the number of rows")
    return pd.DataFrame(out, columns=["cell", "low", "high", "shard", "slot", "home"])


def assign(docs: DataFrame, shards: int = 40, nodes: int = NODES) -> DataFrame:
    """Put every row of `doc_id, text` into a shard whose row counts differ by one at most (law `rows`).

    A row's key is its doc_id; a cell of the ring is a range of the key's hash. Rows that a full shard
    cannot take go on clockwise. The loads are limited to n / shards, rounded down or (for the first
    n mod shards) up, so the limits add up to n and hold exactly. Cells are counted and dealt on
    their counts (at most CELLS numbers on the driver); a row then finds its shard by its rank in its cell.
    Ranks are taken in parts of a cell whose number follows from its count, so one doc_id on a third of all rows makes
    no large group at any size.

    `doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard`; one row per input row, repeated and null
    ids too. Null texts have size 16 and the checksum of an empty text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), crc.alias("text_crc32"))
    # Rows with the same doc_id and text differ by where they were read.
    read = F.floor(F.monotonically_increasing_id() / 4096)
    slim = slim.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(CELLS)).cast("int"))
    slim = written_table(slim.withColumn("spread", F.xxhash64("doc_id", "text_crc32", read)), "shard-keys")
    sizes = slim.groupBy("cell").agg(F.count("*").alias("n"))
    counts = np.zeros(CELLS, np.int64)
    for r in sizes.collect():
        counts[r["cell"]] = r["n"]
    large = np.flatnonzero(counts > PARTS * PART_ROWS)
    parts = F.lit(PARTS).cast("long")
    if len(large):
        more = pd.DataFrame({"cell": large, "parts": -(-counts[large] // PART_ROWS)})
        slim = slim.join(F.broadcast(spark.createDataFrame(more, "cell int, parts long")), "cell", "left")
        parts = F.coalesce("parts", parts)
    slim = slim.withColumn("part", F.pmod("spread", parts)).drop("spread", "parts")
    groups = slim.groupBy("cell", "part").agg(F.count("*").alias("n"))
    total = int(counts.sum())
    limits = [total // shards + (s < total % shards) for s in range(shards)]
    dealt = place(counts, shards, limits, nodes)
    kind = "cell int, low long, high long, shard int, slot long, home int"
    plan = spark.createDataFrame(dealt, kind) if len(dealt) else spark.createDataFrame([], kind)
    before = Window.partitionBy("cell").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = slim.join(groups, ["cell", "part"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    ranked = ranked.withColumnRenamed("cell", "of_cell")
    inside = (F.col("of_cell") == F.col("cell")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return ranked.join(F.broadcast(plan), inside).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("home").alias("home_shard"),
    )
