"""Session settings and the few helpers that touch storage or partitioning."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}
_stages: dict[str, str] = {}  # the folder of the stage that each application is in

ROWS_PER_FILE = 100_000  # of a stored table whose rows are few and narrow


def build_session(app: str = "themeloom", cores: str | int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are tuned for.

    On a cluster the master, the shuffle width and ``spark.checkpoint.dir`` come from
    spark-submit; only ``cores`` (tests, benchmarks) selects local mode.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores is not None:
        width = os.cpu_count() if cores == "*" else int(cores)
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(width))
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Local sessions that name none get a temporary folder; a cluster must name one, since a
    folder on one machine is lost with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/themeloom/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="themeloom-")
    return _local_folders[app]


def forget(spark: SparkSession, path: str) -> None:
    """Delete a stored table or a folder of them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored_at(stored: DataFrame) -> str:
    """The folder of a table that ``materialise`` returned."""
    return stored.inputFiles()[0].rpartition("/")[0]


def read_stored(tables: list[DataFrame]) -> DataFrame:
    """The rows of tables of one schema that ``materialise`` returned, as one scan however many they are."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[stored_at(table) for table in tables])


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done: it does so for what the driver's JVM has collected."""
    gc.collect()
    spark._jvm.System.gc()


def begin_stage(spark: SparkSession, name: str) -> None:
    """Tables stored from now on belong to a stage of this name; those of the stage before are deleted.

    For jobs in steps that write a result each: nothing that reads the tables of a stage may be
    left when the next one begins. Tables stored outside any stage stay.
    """
    app = spark.sparkContext.applicationId
    if app in _stages:
        forget(spark, _stages[app])
    _stages[app] = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def end_stages(spark: SparkSession) -> None:
    """Delete the tables of the last stage and store what follows outside any."""
    path = _stages.pop(spark.sparkContext.applicationId, None)
    if path is not None:
        forget(spark, path)


def materialise(df: DataFrame, name: str, most: int | None = None, staged: bool = True, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back.

    Cuts lineage like a checkpoint does, and the table read back has a known size, so that
    later joins on it are planned from facts; columns not needed are not read. ``most`` is a
    bound of its rows if the caller knows one: few narrow rows go into few files, where a
    file for each shuffle partition would cost more than the rows. The table goes when the
    stage it belongs to ends (``begin_stage``), unless ``staged`` is False.
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(most // ROWS_PER_FILE + 1)
    folder = _stages.get(spark.sparkContext.applicationId) if staged else None
    path = f"{folder or scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, name: str, most: int | None = None) -> tuple[DataFrame, int]:
    """``materialise`` and the number of rows written, taken while writing."""
    seen = Observation()
    stored = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows")), name, most)
    return stored, seen.get["rows"]


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Hash a small scan over all cores by its key; leave a large one as it is.

    ``scan`` must be a plain file scan. One with at least as many splits as there are cores
    needs no shuffle; one with fewer is small by construction (splits are bounded by
    ``spark.sql.files.maxPartitionBytes``), so the exchange costs little.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def dense_ids(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name`` = 0, 1, 2, … in the given order, without sorting in one task.

    A range-partitioned sort is written once; the only global step runs over one row per
    partition. ``order`` must identify a row, else ties are numbered arbitrarily.
    """
    low_bits = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits
    numbered = materialise(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted"
    ).withColumn("_part", F.shiftright("_at", low_bits))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    in_part = F.col("_at").bitwiseAND(F.lit((1 << low_bits) - 1))
    return (
        numbered.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + in_part)
        .drop("_part", "_at", "_offset")
    )
