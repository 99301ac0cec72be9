"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes.

    Documents can be very long, so a batch is also bounded in bytes. Shuffle
    files go when the query that wrote them ends, not when the driver happens
    to collect its garbage: every later step reads written tables.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset and all
    runs on one machine (local runs and tests) is a folder of it used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="streetlens-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(lambda: __import__("shutil").rmtree(base[7:], ignore_errors=True))
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage and survives the loss of executors. The explicit
    schema spares a footer read and keeps an empty result readable.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def driver_table(spark: SparkSession, rows: list[tuple], schema: str, name: str) -> DataFrame:
    """A table of plain numbers that the driver knows, written to the shared folder and read by Spark's own reader: no Python worker is on its way."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, name)}/part.csv")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    for i in range(0, len(rows), 50_000):
        out.write("".join(",".join(map(str, r)) + "\n" for r in rows[i : i + 50_000]).encode())
    out.close()
    return spark.read.schema(schema).csv(path.toString())


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nobody reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard_path(df.sparkSession, parent)


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder that nobody reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, made longer where ``df`` has columns of these names (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(col, UPPER, UPPER.lower())


def slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under names of its own; a null text is empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
