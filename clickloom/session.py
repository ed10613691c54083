"""Session helper, size limits and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "clickloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session. On a cluster, leave ``master`` unset and let spark-submit name it."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Limits:
    """Row limits behind every physical choice this package makes itself.

    ``broadcast_rows``: a keyed aggregate is broadcast only if its counted rows stay within this.
    ``broadcast_bytes``: what the tables broadcast for one family of features may take together.
    ``hot_rows``: a join key with more rows than this is split over several tasks. At most
    ``rows / hot_rows`` keys can be hot, which bounds the broadcast list of hot keys.
    ``expand_bytes``: a log of at most this estimated size is expanded to all key sets in one pass, which
    takes fewer jobs; a larger one goes through a lattice of key sets, which moves fewer rows.
    """

    broadcast_rows: int = 250_000
    broadcast_bytes: int = 256 << 20
    hot_rows: int = 2_000_000
    expand_bytes: int = 256 << 20


def limits(spark: SparkSession) -> Limits:
    return Limits(
        broadcast_rows=int(spark.conf.get("spark.clickloom.broadcastRows", str(Limits.broadcast_rows))),
        broadcast_bytes=int(spark.conf.get("spark.clickloom.broadcastBytes", str(Limits.broadcast_bytes))),
        hot_rows=int(spark.conf.get("spark.clickloom.hotRows", str(Limits.hot_rows))),
        expand_bytes=int(spark.conf.get("spark.clickloom.expandBytes", str(Limits.expand_bytes))),
    )


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of a result; of files it is their size, of joins an upper bound."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates: the one the cluster names, else a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="clickloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the session's own readers and writers see them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _hadoop(spark, path)
    return files.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, if it is there."""
    files, at = _hadoop(spark, path)
    return [str(status.getPath()) for status in files.listStatus(at)] if files.exists(at) else []


def removed(table: DataFrame | str, spark: SparkSession | None = None) -> bool:
    """Remove a table that :func:`written` wrote, or a folder below the shared folder, once nothing reads it any more.

    Anything outside the shared folder stays, and so does a table with lineage of its own.
    """
    if isinstance(table, DataFrame):
        spark = table.sparkSession
        folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
        # the folders of a table partitioned by a column lie below its own
        folders = {folder if "=" not in folder.rsplit("/", 1)[1] else folder.rsplit("/", 1)[0] for folder in folders}
    else:
        folders = {table}
    own = shared_folder(spark).split(":", 1)[-1].lstrip("/") + "/clickloom/"
    gone = False
    for folder in folders:
        if own in folder:
            files, at = _hadoop(spark, folder)
            gone = files.delete(at, True) or gone
    return gone


def written(df: DataFrame, partition_by: str | None = None, sort_by: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (or ``path``) as Parquet and read it back.

    This cuts the lineage, outlives lost executors, and lets later readers prune columns, partitions
    and (where ``sort_by`` orders the rows of each file) row groups; an RDD checkpoint does not.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/clickloom/{uuid.uuid4().hex}"
    schema = df.schema
    if sort_by:
        df = df.sortWithinPartitions(sort_by)
    writer = df.write
    if partition_by:
        # gathers each folder's rows into few files; AQE splits a folder too large for one task
        writer = df.hint("rebalance", partition_by).write.partitionBy(partition_by)
        # the partition column comes last when read back
        fields = [f for f in schema.fields if f.name != partition_by] + [schema[partition_by]]
        schema = type(schema)(fields)
    writer.parquet(path)
    return spark.read.schema(schema).parquet(path)
