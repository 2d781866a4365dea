"""Intermediate tables in the folder all executors share, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes as written, up to which a side may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cohortspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> list:
    """The folders in which the files of a table lie, with the file system."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = {jvm.org.apache.hadoop.fs.Path(f).getParent() for f in df.inputFiles()}
    return [(p, p.getFileSystem(conf)) for p in paths]


def fits_broadcast(table: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Whether a table that `written` made is within the bounds of a broadcast."""
    stored = sum(system.getContentSummary(path).getLength() for path, system in _folders(table))
    max_rows, max_bytes = max_rows or BROADCAST_ROWS, max_bytes or BROADCAST_BYTES
    return stored <= max_bytes and table.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """The rows of `df`, evaluated once and written; marked for broadcast within the bounds, else left to a shuffle join.

    Give aggregates or dimension tables only.
    """
    side = written(df, "side")
    return F.broadcast(side) if fits_broadcast(side, max_rows) else side


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and that nothing will read again; anything outside the shared folder stays."""
    for df in tables:
        shared = df.sparkSession._jvm.org.apache.hadoop.fs.Path(shared_dir(df.sparkSession)).toUri().getPath()
        for path, system in _folders(df):
            if path.getParent().toUri().getPath() == shared:
                system.delete(path, True)


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application, so that functions run where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_cohortspark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    if package.parent.is_dir():  # else the package itself came in an archive, which executors have
        archive = Path(tempfile.mkdtemp(prefix="cohortspark-code-")) / "cohortspark_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
    context._cohortspark_shipped = True
