"""Source trees as DataFrames: scan, language, and what changed since the last scan."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of source files, and folders that are left out.
EXTENSIONS = ("cs", "cpp", "hpp", "h")
EXCLUDED = ("bin", "obj", ".git", "node_modules", "build", "__pycache__", ".vs")


def is_source(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:" + "|".join(EXTENSIONS) + r")$")


def is_excluded(path: Column) -> Column:
    """Whether a folder on the way is one of those left out, in any case."""
    return path.rlike(r"(?i)(?:^|/)(?:" + "|".join(e.replace(".", r"\.") for e in EXCLUDED) + r")/")


def language(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".cs"), "C#").when(is_source(path), "C++").otherwise("Unknown")


#: Folders that the driver lists by itself before the rest of a tree is walked by tasks, for each task.
FOLDERS_A_TASK = 4
#: Bytes of texts in one batch.
BATCH_BYTES = 8 << 20
LISTED, READ = "path string, mtime timestamp", "path string, mtime timestamp, text string, error string"


def _entries(folder: str) -> tuple[list[str], list[os.DirEntry]]:
    """The folders, without those left out and links, and the source files right in a folder; nothing where it can't be read."""
    folders, files = [], []
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    if entry.is_dir():
                        if entry.name.lower() not in EXCLUDED and not entry.is_symlink():
                            folders.append(entry.path)
                    elif entry.name.lower().endswith(tuple("." + e for e in EXTENSIONS)):
                        files.append(entry)
                except OSError:
                    continue  # costs this entry only
    except OSError:
        return [], []
    return sorted(folders), files


def _local(path: str) -> str | None:
    """The path in the local file system; None for one of another file system."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _micros(stat: os.stat_result) -> int:
    return stat.st_mtime_ns // 1000


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime of the source files under root. No root: no rows.

    Folders left out and links to folders are never entered; a folder or file that can't be read costs only itself. Spark's
    own listing hides names that begin with "_" or ".", so trees of a file system that all nodes mount are walked by tasks, each from
    folders of its own; trees elsewhere are listed by Spark, without such names.
    """
    if not root or not root.strip() or not _exists(spark, root):
        return spark.createDataFrame([], LISTED)
    local = _local(root)
    if local is None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(v for e in EXTENSIONS for v in {e, e.upper(), e.capitalize()}) + "}").load(root)
        return found.filter(~is_excluded(F.replace(F.col("path"), F.lit(root), F.lit("")))).select("path", F.col("modificationTime").alias("mtime"))
    tasks = spark.sparkContext.defaultParallelism
    shallow, deep = [], [local.rstrip("/") or "/"]
    while deep and len(deep) < tasks * FOLDERS_A_TASK:
        shallow += deep
        deep = [inner for folder in deep for inner in _entries(folder)[0]]
    rows = spark.createDataFrame([(f, False) for f in shallow] + [(f, True) for f in deep], "folder string, deep boolean").repartition(tasks)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, deep in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                todo = [folder]
                while todo:
                    folders, files = _entries(todo.pop())
                    if deep:
                        todo += folders
                    found = []
                    for entry in files:
                        try:
                            found.append((entry.path, _micros(entry.stat())))
                        except OSError:
                            continue
                    if found:
                        paths, times = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(times, pa.timestamp("us", "UTC"))], ["path", "mtime"])

    return rows.mapInArrow(walk, LISTED)


def contents(paths: DataFrame) -> DataFrame:
    """path, mtime, text, error of a table of paths: broken UTF-8 becomes replacement characters, a mark of byte order goes. What can't be
    read has an error: "File path is empty.", "File not found: ..." or that of the system. Paths of other file systems are read by Spark."""
    spark = paths.sparkSession
    asked = paths.select(F.coalesce(F.trim("path"), F.lit("")).alias("path"))
    remote = F.col("path").contains("://") & ~F.col("path").startswith("file:")

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string()), strict=True)], ["path", "mtime", "text", "error"])
            rows.clear()
            return batch

        for batch in batches:
            for path in batch.column("path").to_pylist():
                mtime = text = error = None
                if not path:
                    error = "File path is empty."
                else:
                    try:
                        with open(_local(path), "rb") as f:
                            mtime, text = _micros(os.fstat(f.fileno())), f.read().decode("utf-8", "replace").removeprefix("\ufeff")
                    except FileNotFoundError:
                        error = f"File not found: {path}"
                    except OSError as e:
                        error = f"{e.strerror}: {path}"
                rows.append((path, mtime, text, error))
                size += len(text or "")
                if size > BATCH_BYTES:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    # Files are dealt over all tasks, however they were listed.
    found = asked.filter(~remote).repartition(spark.sparkContext.defaultParallelism * FOLDERS_A_TASK, "path").mapInArrow(read_all, READ)
    elsewhere = asked.filter(remote)
    folders = [r.folder for r in elsewhere.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).distinct().limit(MOST_FOLDERS + 1).collect()]
    if not folders:
        return found
    if len(folders) > MOST_FOLDERS:
        raise ValueError(f"more than {MOST_FOLDERS} folders: scan their root instead")
    there = [f for f in folders if _exists(spark, f)]
    gone = F.concat(F.lit("File not found: "), "path")
    if not there:
        return found.unionByName(elsewhere.select("path", F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("string").alias("text"), gone.alias("error")))
    texts = spark.read.format("binaryFile").load(there).select("path", F.col("modificationTime").alias("mtime"), F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "").alias("text"))
    return found.unionByName(elsewhere.join(texts, "path", "left").withColumn("error", F.when(F.col("mtime").isNull(), gone)).select("path", "mtime", "text", "error"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, language, text of the source files under root; text is null where a file can't be read. No root: no rows."""
    return contents(listing(spark, root)).select("path", "mtime", language(F.col("path")).alias("language"), "text")


def changed(current: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files of current (path, mtime) that parsed doesn't hold as they are."""
    return current.join(parsed.select("path", "mtime"), ["path", "mtime"], "left_anti")


def still_there(parsed: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of parsed whose file still exists."""
    return parsed.join(current.select("path"), "path", "left_semi")


def read(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """path, mtime, language, text, error of a table of paths, as contents() reads them."""
    return contents(paths).select("path", "mtime", language(F.col("path")).alias("language"), "text", "error")


#: Folders of other file systems that contents() lists, at most; their names come to the driver.
MOST_FOLDERS = 10_000


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def load_cache(spark: SparkSession, path: str, version: int, model: str) -> DataFrame:
    """key, value, created of a saved cache (JSON lines: version, model, key, value, created). What is broken, blank, or of another
    version or model is left out; without a file there are no rows."""
    schema = "version int, model string, key string, value string, created long"
    if not _exists(spark, path):
        return spark.createDataFrame([], "key string, value string, created long")
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    kept = (F.col("version") == version) & (F.upper("model") == model.upper()) & (F.coalesce("key", F.lit("")) != "") & (F.coalesce("value", F.lit("")) != "")
    return rows.filter(kept).select("key", "value", "created")


def save_cache(entries: DataFrame, path: str, version: int, model: str) -> None:
    """Write key, value, created as load_cache() reads them."""
    entries.select(F.lit(version).alias("version"), F.lit(model).alias("model"), "key", "value", "created").write.mode("overwrite").json(path)
