"""Where intermediate tables go, and how texts reach numpy."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch at most; a single larger row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Tables of counts are added up in so many slices, and so many tables at a time.
SLICES = 64
#: One text in so many is looked at for a sample.
THIN = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; without one a local master (as in tests) gets a temporary folder.

    On a cluster a local folder would be another one on each machine, so the setting is asked for.
    """
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(found)
        return found
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="paneweave-")
    sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/paneweave-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there, on any executor.

    The shuffle files of the steps before are not needed any more; the driver's collection of garbage
    lets Spark's cleaner drop them.
    """
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    df.sparkSession.sparkContext._jvm.System.gc()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that no later step reads."""
    if path := getattr(df, "_stored_at", None):
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def some_texts(docs: DataFrame, rows: int, each_bytes: int = 1 << 16) -> list[str | None]:
    """At most ``rows`` texts of at most ``each_bytes`` bytes, one in THIN by hash, so not just the first rows.

    For estimates and checks alone: no more of the table is read than it takes to find them.
    """
    thin = F.pmod(F.xxhash64("text"), F.lit(THIN)) == 0
    small = docs.select("text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= each_bytes)
    found = [r[0] for r in small.where(thin).limit(rows).collect()]
    return found or [r[0] for r in small.limit(rows).collect()]


#: Ids are marked in a bitmap of so many bits, pages of 32768 bits each.
MARK_BITS = 27


def marked(ids: DataFrame, column: str) -> DataFrame:
    """(page, bits) a bitmap in which the hashes of all ids are set; 16 MB at most, whatever their number."""
    at = F.shiftrightunsigned(F.xxhash64(F.col(column).cast("long")), 64 - MARK_BITS)
    return ids.select(at.alias("at")).groupBy(F.expr("at div 32768").alias("__page")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("__bits"))


def only_marked(rows: DataFrame, column: str, pages: DataFrame) -> DataFrame:
    """The rows whose id is marked, and a few whose hash is another marked id's."""
    at = F.shiftrightunsigned(F.xxhash64(F.col(column).cast("long")), 64 - MARK_BITS)
    byte = "cast(conv(hex(substring(__bits, cast((__at % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    joined = rows.withColumn("__at", at).join(F.broadcast(pages), F.expr("__at div 32768") == F.col("__page"))
    return joined.where(f"getbit({byte}, cast(__at % 8 as int)) = 1").select(*rows.columns)


def sum_counts(tables: DataFrame, parts: int) -> np.ndarray:
    """The sum of tables of 64-bit counts, one row (part, counts) for each task; empty without rows.

    The tables have one size, a multiple of SLICES entries.  Slices are added by steps, so no task
    adds more than SLICES slices and the driver gets one table, however many tasks there were.
    """

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("counts")], axis=0, dtype=np.uint64)
        return pa.table({"slice": table.column("slice")[:1], "part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, part int, counts binary"
    width = f"(length(counts) div {SLICES})"
    rows = tables.select(F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"), "part", "counts")
    rows = rows.withColumn("counts", F.expr(f"substring(counts, cast(slice * {width} as int) + 1, cast({width} as int))"))
    while parts > SLICES:
        rows = rows.withColumn("part", F.expr(f"cast(part div {SLICES} as int)")).groupBy("slice", "part").applyInArrow(add, schema)
        parts = -(-parts // SLICES)
    found = rows.groupBy("slice").applyInArrow(add, schema).collect()  # SLICES rows
    return np.concatenate([np.frombuffer(r["counts"], np.uint64) for r in sorted(found, key=lambda r: r["slice"])] or [np.zeros(0, np.uint64)])
