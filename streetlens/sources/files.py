"""Folders as tables: names, sizes and times of files, their digests, leftovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, length, modified) of all files below ``path``; contents aren't read. Empty files are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", F.substring_index("path", "/", -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256) of all files below ``path``, each below 2 GB, as one binary value must be."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


def leftovers(folders: DataFrame, jobs: DataFrame, now: Column, grace_s: int = 60) -> DataFrame:
    """Folders (id, modified) that no job (id) owns and that were not touched for ``grace_s`` seconds before ``now``."""
    old = folders.where(F.col("modified") < F.timestamp_add("SECOND", F.lit(-grace_s), now))
    return old.join(jobs.select("id"), "id", "left_anti")
