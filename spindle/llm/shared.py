"""Tables in the shared folder, and connected components over them.

Lineage is cut by writing Parquet into the folder that the cluster names in
``spark.checkpoint.dir``, which the driver and all executors see, so a lost
executor loses nothing that was written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch sent to Python, and the session's settings of them.
BATCH_ROWS, BATCH_BYTES = 2000, 4_000_000
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
_before: dict[str, dict[str, str]] = {}


def folder(spark: SparkSession) -> str:
    """This application's own folder below spark.checkpoint.dir, deleted when its driver ends.

    Where that is unset a local folder serves a local master, as in tests; on a
    cluster it would be another one on each machine, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/spindle-shared"
    return f"{root.rstrip('/')}/spindle-{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def bound_batches(spark: SparkSession) -> None:
    """Has the session send texts to Python in batches of BATCH_ROWS and BATCH_BYTES at most, or fewer where it is set so.

    A batch is held several times over, in the JVM and in the worker, so
    batches of ten thousand long texts would take most of an executor's memory.
    Spark reads these settings when a result is asked for, so they stay set;
    ``restore_batches`` puts back what the session had.
    """
    for key, most in BATCHES.items():
        text = spark.conf.get(key)
        now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text)) if not text.lstrip("-").isdigit() else int(text)
        if not 0 < now <= most:
            _before.setdefault(spark.sparkContext.applicationId, {}).setdefault(key, text)
            spark.conf.set(key, str(most))


def restore_batches(spark: SparkSession) -> None:
    """Puts back the settings that bound_batches changed, once all results have been read."""
    for key, text in _before.pop(spark.sparkContext.applicationId, {}).items():
        spark.conf.set(key, text)


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame``, written to the shared folder and read again."""
    spark = frame.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    files, at = _file_system(spark, folder(spark))
    files.deleteOnExit(at)
    return spark.read.schema(frame.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Deletes tables given by ``written`` that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            if f"/spindle-{spark.sparkContext.applicationId}/" in path:
                files, at = _file_system(spark, path)
                files.delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application has written there; results not yet read need it."""
    files, at = _file_system(spark, folder(spark))
    files.delete(at, True)


def whole_numbers(values) -> Column:
    """An array literal, made from one string: a long one would be a call to the JVM for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``frame`` has no such column."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def make_room(frame: DataFrame, *names: str) -> DataFrame:
    """``frame`` with its own columns of these names renamed, as name_input, so that an operator's columns hide none."""
    for name in names:
        own = next((c for c in frame.columns if c.lower() == name.lower()), None)
        if own is not None:
            frame = frame.withColumnRenamed(own, fresh(frame, f"{name}_input"))
    return frame


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the root is its component's least node.

    Alternating large and small stars: each round every node is tied to the
    least of its neighbours, until nothing changes; the rounds grow with the
    logarithm of the longest path. Only edges move, never a component.
    """
    edges = written(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, edges = edges, written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
