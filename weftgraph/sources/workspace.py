"""Source trees as tables: a recursive scan, reading with a size limit, and snapshots."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.misc import scripts
from ..functions.paths import call_graph_language, in_skipped_directory, is_source_file, language, normalize, relative
from ..schema import SCHEMA_VERSION

MAX_BYTES = 5 * 1024 * 1024
CONFIG_FILE = r"/(tsconfig[^/]*\.json|package\.json|go\.mod)$"
TABLES = ("files", "symbols", "edges")


def listing(spark: SparkSession, root: str, exclude_node_modules: bool = True) -> DataFrame:
    """path, size, last_modified (epoch ms), lang of the source files below root, without reading them.

    Files in ignored directories and in those whose name begins with a point are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = root.split("://", 1)[-1].rstrip("/")
    path = normalize(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*(?=/))?", ""))
    rows = files.select(path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("last_modified"), F.col("path").alias("uri"))
    inside = relative(F.col("path"), plain)
    return rows.filter(is_source_file(F.col("path")) & ~in_skipped_directory(inside, exclude_node_modules)).withColumn("lang", language(F.col("path")))


def count_files(spark: SparkSession, root: str) -> int:
    return listing(spark, root).count()


def texts(spark: SparkSession, root: str, exclude_node_modules: bool = True, max_bytes: int = MAX_BYTES, only: DataFrame | None = None) -> DataFrame:
    """path, lang (of the call-graph rules), size, last_modified, text, error of the source files below root, or of those in `only` (column path).

    Files over max_bytes have no text and the error FILE_TOO_LARGE. Of .vue and
    .svelte files text is the scripts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = normalize(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*(?=/))?", ""))
    plain = root.split("://", 1)[-1].rstrip("/")
    if only is not None:
        # the reader leaves out files by time without opening them; the join then takes the exact ones
        since = listing(spark, root, exclude_node_modules).join(only, "path", "left_semi").agg(F.min("last_modified")).first()[0]
        files = files.filter(F.col("modificationTime") >= F.timestamp_millis(F.lit(since or 0))) if since is not None else files.limit(0)
    base = files.select(path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("last_modified"), "content")
    base = base if only is None else base.join(only, "path", "left_semi")
    base = base.filter(is_source_file(F.col("path")) & ~in_skipped_directory(relative(F.col("path"), plain), exclude_node_modules))
    raw = F.when(F.col("size") <= max_bytes, F.decode("content", "utf-8"))
    text = F.when(F.col("path").rlike(r"\.(vue|svelte)$"), scripts(raw)).otherwise(raw)
    return base.select("path", call_graph_language(F.col("path")).alias("lang"), "size", "last_modified", text.alias("text"), F.when(F.col("size") > max_bytes, "FILE_TOO_LARGE").alias("error"))


def configs(spark: SparkSession, root: str, exclude_node_modules: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, text of the tsconfig*.json, package.json and go.mod files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = normalize(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*(?=/))?", ""))
    plain = root.split("://", 1)[-1].rstrip("/")
    base = files.select(path.alias("path"), F.col("length").alias("size"), "content").filter(F.col("path").rlike(CONFIG_FILE) & ~in_skipped_directory(relative(F.col("path"), plain), exclude_node_modules))
    return base.filter(F.col("size") <= max_bytes).select("path", F.decode("content", "utf-8").alias("text"))


def save_snapshot(tables: dict[str, DataFrame], folder: str, name: str, root: str = "") -> None:
    """Writes all tables as one version below folder/name, its metadata last, then removes older versions.

    A version without metadata isn't there, so a crash leaves the version before
    it as it was, and never a mixture of two.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v{time.time_ns():020d}"
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/{version}/{t}")
    meta = json.dumps({"schema_version": SCHEMA_VERSION, "root": root, "tables": sorted(tables), "version": version})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}/{version}/metadata")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(path):
        if "v" < status.getPath().getName() < version:
            files.delete(status.getPath(), True)


def load_snapshot(spark: SparkSession, folder: str, name: str, root: str = "") -> dict[str, DataFrame] | None:
    """The tables of the last whole version; None if it is missing, unreadable, of another schema version or of another root."""
    try:
        found = [json.loads(r[0]) for r in spark.read.text(f"{folder}/{name}/v*/metadata").collect()]
        meta = max(found, key=lambda m: m["version"])
        if meta["schema_version"] != SCHEMA_VERSION or meta["root"] != root:
            return None
        return {t: spark.read.parquet(f"{folder}/{name}/{meta['version']}/{t}") for t in meta["tables"]}
    except Exception:  # a snapshot that can't be read is built again
        return None


def snapshot_mb(spark: SparkSession, folder: str, name: str) -> float:
    """Size of a snapshot's files, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/{name}")
    return (files.select("length").agg(F.sum("length")).first()[0] or 0) / (1 << 20)
