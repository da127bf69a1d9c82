"""Near copies by 64-bit SimHash, with pigeonring filtering of candidate pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.llm.common import named, written_table

#: Segments of a fingerprint on the ring, bits of each, and differing bits that still link.
SEGMENTS, WIDTH, DISTANCE = 4, 16, 2
#: Fingerprints of one key that are paired with each other; larger groups are linked through neighbours.
PAIRED = 64
SEED, SHINGLE = 42, 3


def fingerprint(text: str | None) -> int:
    """SimHash of a text's 3-word shingles, as a signed 64-bit number; 0 without words.

    A-Z is lower-cased, words are what ASCII white space parts, shingles count as often as they occur. Fewer
    words than a shingle make one. A bit is set when it is set in over half the shingle hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, sums, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), max(1, len(words) - SHINGLE + 1)
    for at in range(0, n, 65_536):
        part = words[at : at + 65_536 + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        h = np.array([digest(s, SEED) for s in shingles], "<u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def segment(f: Column, i: int) -> Column:
    """The i-th segment of the ring."""
    return F.shiftrightunsigned(f, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def pigeonring(a: Column, b: Column) -> Column:
    """Whether some chain of segments stays within its proportional budget at every length.

    With DISTANCE differing bits over SEGMENTS segments on a ring, there is a start from which the first l segments differ in at
    most l * DISTANCE / SEGMENTS bits, for every l.
    """
    differs = [F.bit_count(segment(a, i).bitwiseXOR(segment(b, i))) for i in range(SEGMENTS)]

    def chain(start: int) -> Column:
        sums = [reduce(lambda x, y: x + y, [differs[(start + j) % SEGMENTS] for j in range(n)]) for n in range(1, SEGMENTS + 1)]
        return reduce(lambda x, y: x & y, [s <= n * DISTANCE // SEGMENTS for n, s in enumerate(sums, 1)])

    return reduce(lambda x, y: x | y, [chain(i) for i in range(SEGMENTS)])


def keys(f: Column) -> Column:
    """Join keys `pair, key`: within DISTANCE = 2, the chain's budget leaves its first segment whole and one of the next two."""
    pairs = [(i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]
    return F.array(*[
        F.struct(F.lit(n).alias("pair"), (F.shiftleft(segment(f, i), WIDTH) + segment(f, j)).alias("key")) for n, (i, j) in enumerate(pairs)
    ])


def links(prints: DataFrame) -> DataFrame:
    """Links `a, b` (a < b) between distinct fingerprints `f`, enough to connect all within DISTANCE bits.

    Fingerprints that share two of four segments meet. Groups of at most PAIRED are paired, pass the pigeonring
    filter and then the full check. In larger groups each fingerprint names its neighbours at one bit or none in the other two segments,
    and those that name the same neighbour are tied to the least of them: two fingerprints
    within two bits share such a neighbour, and any that do are within two bits. So the rest is exact and no group is paired
    out in full.
    """
    meet = prints.select("f", F.explode(keys(F.col("f"))).alias("k")).select("f", "k.pair", "k.key")
    sizes = meet.groupBy("pair", "key").agg(F.count("*").alias("n")).where("n > 1")
    meet = written_table(meet.join(sizes, ["pair", "key"]), "simhash-meetings")
    few = meet.where(F.col("n") <= PAIRED)
    left, right = (few.select("pair", "key", F.col("f").alias(c)) for c in "ab")
    pairs = left.join(right, ["pair", "key"]).where(F.col("a") < F.col("b"))
    pairs = pairs.where(pigeonring(F.col("a"), F.col("b"))).select("a", "b")

    held = [(i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]
    flips = F.lit(None).cast("array<long>")
    for n, used in enumerate(held):
        free = [i for i in range(SEGMENTS) if i not in used]
        bits = [0, *((1 << (WIDTH * i + b)) for i in free for b in range(WIDTH))]
        signed = [x - (1 << 64) if x >= 1 << 63 else x for x in bits]
        flips = F.when(F.col("pair") == n, F.array(*[F.lit(x).cast("long") for x in signed])).otherwise(flips)
    many = meet.where(F.col("n") > PAIRED).select("pair", "f", F.explode(flips).alias("flip"))
    many = many.select("pair", "f", F.col("f").bitwiseXOR(F.col("flip")).alias("near"))
    least = many.groupBy("pair", "near").agg(F.min("f").alias("a"), F.count("*").alias("n")).where("n > 1")
    tied = many.join(least.drop("n"), ["pair", "near"]).where(F.col("a") < F.col("f")).select("a", F.col("f").alias("b"))
    full = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return pairs.unionByName(tied).where(full).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`f, root` for every end of `a, b` edges: the least end that can be reached.

    Each round ties the neighbours of a fingerprint to the least of them, first the larger, then the smaller ones, until nothing
    changes; rounds grow with the logarithm of the size. Each round is a written table.
    """
    edges = written_table(edges, "edges")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.where("a < b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(
            F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")
        ).select("e.a", "e.b").where("a < b").distinct()
        small = written_table(small, "edges")
        changed = small.exceptAll(edges).limit(1).count() or edges.exceptAll(small).limit(1).count()
        edges = small
        if not changed:
            break
    return edges.select(F.col("b").alias("f"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("f"), F.col("a").alias("root")).distinct()
    )


def linked(prints: DataFrame) -> DataFrame:
    """`f, component_id` for the fingerprints of `doc_id, f` that link to another one; copies count once from the start."""
    distinct = prints.groupBy("f").agg(F.min("doc_id").alias("doc_id"))
    distinct = written_table(distinct, "fingerprints")
    roots = components(links(distinct.select("f")))
    least = roots.join(distinct, "f").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    some = roots.join(least, "root").select("f", "component_id")
    every = distinct.select("f", F.col("doc_id").alias("own"))
    return every.join(some, "f", "left").select("f", F.coalesce("component_id", "own").alias("component_id"))


def near_copies(docs: DataFrame) -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row of `doc_id, text`.

    Fingerprints within DISTANCE bits link; a component is named by the smallest doc_id in it (null where all are null). Null texts
    and texts without words have fingerprint zero, which links like any other. Repeated rows each keep theirs.
    """
    prints = written_table(docs.select("doc_id", _fingerprints("text").alias("f")), "document-fingerprints")
    out = prints.join(linked(prints), "f")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


#: Bitmaps of dropped rows are broadcast up to these bytes (one bit a row where any of 32,768 neighbours goes).
BITMAP_BYTES = 256 << 20


def without(held: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of `held` whose number `row` is not in `dropped` (`row`, distinct).

    Dropped numbers become bitmaps of 32,768 numbers each. Up to BITMAP_BYTES, which some two billion rows need, they are sent to
    the rows, so that no text is shuffled; beyond, rows and bitmaps are joined by shuffle, with the same result.
    """
    maps = dropped.groupBy(F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("gone"))
    maps = written_table(maps, "dropped-rows")
    size = maps.agg(F.sum(F.octet_length("gone") + 16)).first()[0] or 0
    place = F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substring("gone", (place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(_place % 8 AS int)) & 1")
    both = held.withColumn("bucket", F.bitmap_bucket_number("row")).join(F.broadcast(maps) if size <= BITMAP_BYTES else maps, "bucket", "left")
    both = both.withColumn("_byte", F.coalesce(byte, F.lit(0))).withColumn("_place", place)
    return both.where(bit == 0).drop("bucket", "gone", "_byte", "_place")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component stays, that of the smallest doc_id (the first read of equal ones); columns stay as they are.

    Fingerprints are written with a number for every row, next to the row itself; only numbers are
    compared, and the rows to drop are taken out by bitmaps of their numbers.
    """
    held = docs.select(
        F.struct(*[named(c) for c in docs.columns]).alias("doc"), F.col("doc_id"), F.monotonically_increasing_id().alias("row"),
        _fingerprints("text").alias("f"),
    )
    held = written_table(held, "fingerprinted")
    prints = held.select("doc_id", "row", "f")
    named_by = linked(prints).withColumnRenamed("component_id", "c")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    # Copies of one fingerprint first, then the fingerprints of a component; null-named components are those without any doc_id.
    first = prints.groupBy("f").agg(least.alias("first")).join(named_by, "f")
    root = F.when(F.col("c").isNull(), F.col("f")).otherwise(F.lit(None).cast("long"))
    stay = first.groupBy("c", root.alias("r")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return without(held.select("doc", "row"), prints.select("row").join(stay, "row", "left_anti")).select("doc.*")
