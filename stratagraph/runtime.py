"""Session helpers: local test sessions, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a table may have to be broadcast; beyond it the join is left to a shuffle.
BROADCAST_ROWS = 200_000
#: Tasks over which the rows of one key are spread in a salted join.
SALTS = 16


def local_session(app: str = "stratagraph", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller's own session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; a folder of our own only where none is set and all is one machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), f"stratagraph-checkpoint-{os.getuid()}")
        os.makedirs(shared, exist_ok=True)
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df reliably in the shared checkpoint folder, so that no executor's loss costs a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """df with the number (from 1) of each row in a total order, without sending all rows through one task.

    Rows are range-partitioned and numbered within their partition; the driver only adds up one count per partition.
    """
    at = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = {r["_p"]: r["n"] for r in at.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("lo")).collect()}
    starts = dict(zip(sorted(sizes), accumulate([0, *[sizes[p] for p in sorted(sizes)]]), strict=False))
    before = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("_p")) if starts else F.lit(0)
    # monotonically_increasing_id counts up from 0 within a partition in its lower 33 bits.
    return at.withColumn(name, (before + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_p", "_i")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan in at least as many partitions as there are cores.

    Only a small input, of few files, is moved; a large one already has more partitions. Use it before heavy Python work.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """left joined with right on keys, for a left side of which one key may hold a third of all rows.

    The rows of a key are spread over `salts` tasks by a hash of the columns `by`, and right, which has few rows of each key, is
    repeated as often. how: inner, left, left_semi or left_anti.
    """
    many = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    each = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(each, [*keys, "_salt"], how).drop("_salt")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, whatever share of left one key has: by broadcast if right is counted to be small, else salted.

    Use it only with a right side that is cheap to count: a small table, or one already cut. how as in salted_join().
    """
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right), keys, how) if few else salted_join(left, right, keys, by, how)


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df has been counted to be small enough, else df as it is.

    Use it only on a df that is cheap to count: a small table, or one already cut.
    """
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df
