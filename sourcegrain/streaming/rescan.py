"""Source trees that are scanned again: only what changed is read, what is gone goes, by hand or as a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import files

SNAPSHOT = "path string, mtime timestamp, language string, text string, error string"
#: Snapshots that stay: the newest, and the one before it for those who still read it.
KEPT = 2


def _versions(spark: SparkSession, target: str) -> list[int]:
    """The complete snapshots in a folder, the oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    return [v for v in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}/_SUCCESS"))]


def latest(spark: SparkSession, target: str) -> DataFrame:
    """path, mtime, language, text, error as of the newest complete snapshot; before the first there are no rows."""
    found = _versions(spark, target)
    return spark.read.schema(SNAPSHOT).parquet(f"{target}/v={found[-1]}") if found else spark.createDataFrame([], SNAPSHOT)


def rescan(spark: SparkSession, root: str, target: str) -> dict[str, int]:
    """Write the next snapshot of a tree and tell how many files were read, kept and evicted. Files whose time is as before
    are taken from the last snapshot; those with an error are read again. A run that ends halfway leaves the last snapshot in place."""
    versions, before = _versions(spark, target), latest(spark, target)
    number = versions[-1] + 1 if versions else 0
    # The tree is walked once: what is read and what is kept rest on one listing.
    files.listing(spark, root).write.mode("overwrite").parquet(f"{target}/listing={number}")
    current = spark.read.schema(files.LISTED).parquet(f"{target}/listing={number}")
    good = before.filter("error IS NULL")
    fresh = files.contents(files.changed(current, good)).select("path", "mtime", files.language(F.col("path")).alias("language"), "text", "error").withColumn("fresh", F.lit(True))
    kept = good.join(current, ["path", "mtime"], "left_semi").withColumn("fresh", F.lit(False))
    seen = Observation("rescan")
    counted = fresh.unionByName(kept).observe(seen, F.count_if("fresh").alias("read"), F.count_if(~F.col("fresh")).alias("kept"))
    counted.drop("fresh").write.mode("overwrite").parquet(f"{target}/v={number}")
    evicted = before.join(current.select("path"), "path", "left_anti").count()
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(f"{target}/listing={number}"), True)
    for old in versions[: max(0, len(versions) + 1 - KEPT)]:
        fs.delete(path(f"{target}/v={old}"), True)
    return {**seen.get, "evicted": evicted}


def rescan_stream(spark: SparkSession, root: str, target: str, checkpoint: str):
    """A stream that rescans when files arrive, from its checkpoint on; it first rescans once, as files that only changed or went don't arrive.

    Each batch names the new files alone; what is written is the whole state of the tree, so a batch that is run again changes nothing."""
    rescan(spark, root, target)
    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(root).select("path")

    def upsert(batch: DataFrame, _: int) -> None:
        new = batch.filter(files.is_source(F.col("path"))).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
        if not new.join(latest(spark, target).select("path"), "path", "left_anti").isEmpty():
            rescan(spark, root, target)

    return arrived.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
