"""Integrity of model bundles: files against a manifest, by digest and as sets, and the published pointer."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of all files below a folder, hashed on the executors."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", r"^.*?" + folder.rstrip("/").replace(".", r"\.") + "/", "")
    return read.select(name.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest(lines: DataFrame) -> DataFrame:
    """(path, sha256) of a checksum index (``value`` holds ``digest  path`` lines); unsafe paths and repeats fail."""
    parts = lines.where(F.trim("value") != "").select(F.regexp_extract("value", r"^([0-9a-f]{64})  (.+)$", 1).alias("sha256"), F.regexp_extract("value", r"^([0-9a-f]{64})  (.+)$", 2).alias("path"))
    unsafe = (F.col("sha256") == "") | F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.?(/|$)") | F.col("path").contains("\\")
    checked = parts.withColumn("path", F.when(unsafe, F.raise_error(F.lit("unsafe or malformed checksum line"))).otherwise(F.col("path")))
    return checked.groupBy("path").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("a path is listed twice"))).otherwise(F.min("sha256")).alias("sha256"))


def differences(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, problem): missing, unexpected, and changed files; none if the bundle is whole."""
    both = wanted.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("have") != F.col("want"), "changed")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


POINTER = "version long, name string, path string"


def _pointers(spark: SparkSession, pointer: str) -> DataFrame | None:
    try:
        return spark.read.schema(POINTER).json(pointer)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def _created(spark: SparkSession, path: str, line: str) -> bool:
    """Whether a file of one line could be created; false if it is there. Of any number of callers one succeeds."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(at.getParent())
    if at.toUri().getScheme() in (None, "file") and fs.getUri().getScheme() == "file":
        # a link to a whole file under the new name: the file system refuses a second one
        target = at.toUri().getPath()
        draft = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as f:
            f.write(line)
        try:
            os.link(draft, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    try:
        out = fs.create(at, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or fs.exists(at):
            return False
        raise
    out.write(bytearray(line, "utf-8"))
    out.close()
    return True


def publish(df: DataFrame, folder: str, name: str, pointer: str, mode: str = "errorifexists") -> str:
    """Write a table to a folder of its own, then add its version to the pointer table, which only grows.

    A version is a file of that name, created only if it is not there: of publishers that race for one, the others take the next. It becomes visible
    with that file, so readers see the last whole version or the new one, never half a write.
    """
    spark, path = df.sparkSession, f"{folder.rstrip('/')}/{name}"
    df.write.mode(mode).parquet(path)
    before = _pointers(spark, pointer)
    version = ((before.agg(F.max("version")).first()[0] if before is not None else None) or 0) + 1
    while not _created(spark, f"{pointer.rstrip('/')}/version-{version:012d}.json", json.dumps({"version": version, "name": name, "path": path}) + "\n"):
        version += 1
    return path


def published(spark: SparkSession, pointer: str, schema: str | None = None) -> DataFrame:
    """The table that the newest version of the pointer names; with a ``schema``, an empty one if there is no version yet."""
    versions = _pointers(spark, pointer)
    newest = versions.orderBy(F.desc("version"), "name").first() if versions is not None else None
    if newest is None and schema is None:
        raise ValueError("nothing is published yet")
    return spark.read.parquet(newest["path"]) if newest else spark.createDataFrame([], schema)
