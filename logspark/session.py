"""Session settings and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options the jobs rely on.

    UTC is the zone of every text rendering; LAST_WIN and duplicate JSON keys give "last value
    wins"; a fixed minimum split number makes a file scan cut its files the same way each time it
    is planned, also when executors come and go in between (line numbers depend on that). The last
    two are for speed: plain Java case mapping has an ASCII fast path, and a generated method
    above 8000 bytes would never be compiled by the JVM, so such stages run operator by operator.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.icu.caseMappings.enabled", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir`, or a temp folder in local mode."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = _scratch.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="logspark-")
        _scratch[sc.applicationId] = path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; all intermediate tables lie there."""
    return f"{shared_dir(spark)}/logspark-{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; results that still read them cannot be computed afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# A lookup side is broadcast up to this measured size; beyond it the join shuffles, and a file's rows
# go to this many keys.
MAX_BROADCAST_BYTES = 256 * 1024 * 1024
KEYS_A_FILE = 256


def keeps_scan_order(df: DataFrame) -> bool:
    """Whether rows still stand as their files hold them: no shuffle is planned, and a broadcast moves no row of `df`."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.search(r"(?<!Broadcast)Exchange\b", plan) is None


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Compute a table once and read it back from the shared folder.

    Cuts the lineage durably: nothing is computed again when executors are lost or a second action
    runs. Most such tables are small; entries to review and segments can be as big as the input. All stay until
    `remove_scratch`.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup_side(table: DataFrame, row_bytes: int = 64) -> DataFrame:
    """`table` marked for broadcast when its measured size allows, else as it is.

    Meant for written tables keyed by `file`; counts the bytes of the paths and of the other fields.
    """
    return F.broadcast(table) if fits_broadcast(table, row_bytes) else table


def fits_broadcast(table: DataFrame, row_bytes: int = 64) -> bool:
    """Whether a table keyed by `file` is small enough to be sent to every executor."""
    size = table.agg(F.sum(F.octet_length("file") + row_bytes)).first()[0] or 0
    return size <= MAX_BROADCAST_BYTES


def join_by_file(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Add to numbered lines the columns of a written table that has one row a file; NULL for files it does not name.

    A small table is broadcast. A larger one is shuffled with KEYS_A_FILE copies of each row, and a line
    takes the copy its number says, so that a big file is spread over tasks either way.
    """
    if fits_broadcast(table):
        return rows.join(F.broadcast(table), "file", "left")
    copies = table.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(KEYS_A_FILE - 1))))
    key = F.pmod(F.coalesce(F.col("line_no"), F.lit(0)), F.lit(KEYS_A_FILE)).cast("int")
    return rows.withColumn("_copy", key).join(copies, ["file", "_copy"], "left").drop("_copy")
