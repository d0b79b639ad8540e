"""Session helpers: shared checkpoint folder, table access and size checks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType
from pyspark.sql.window import Window

#: A side is broadcast only when its row count, counted first, is at most this.
BROADCAST_ROWS = 200_000


def build(app: str = "notewright", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.driver.memory", os.environ.get("NOTEWRIGHT_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that workers find it wherever the driver runs."""
    # a union of sides that are partitioned alike must still be shuffled: adaptive coalescing can part them
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    sc = spark.sparkContext
    if getattr(sc, "_notewright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="notewright-code-")) / "notewright.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._notewright_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. The cluster names it in spark.checkpoint.dir; where that is
    unset, as in tests, a local folder is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="notewright-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: ... and its strings, arrays and numbers take at most so many bytes.
BROADCAST_BYTES = 256 << 20


def _width(c, kind):
    """About how many bytes a column takes in a row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        inner = F.aggregate(c, F.lit(0), lambda acc, x: acc + _width(x, kind.elementType))
        return F.coalesce(inner, F.lit(0)) + 24
    return F.lit(16)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side only if its counted rows and bytes are within the bounds; else Spark picks a shuffle join."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= BROADCAST_BYTES else df


def latest(df: DataFrame, key: str, by: str, *ties: str) -> DataFrame:
    """One row per key: of keys delivered more than once the row with the largest `by`, ties by the other columns.
    Only keys are counted over all rows; only the rows of repeated keys are ranked. Rows without a key all stay."""
    twice = broadcast_if_small(df.groupBy(key).agg(F.count("*").alias("__n")).where("__n > 1").select(key))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(by), *ties)
    ranked = df.join(twice, key, "left_semi").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return df.join(twice, key, "left_anti").unionByName(ranked)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows shuffled by key into at least as many partitions as there are cores: text work is small in bytes, so
    it must not be coalesced by size. The explicit shuffle also keeps a union's partitionings from being reused."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def scattered(df: DataFrame, *keys: str) -> DataFrame:
    """A plain scan of fewer partitions than there are cores, spread by key; others as they are."""
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return spread(df, *keys) if parts < df.sparkSession.sparkContext.defaultParallelism else df
