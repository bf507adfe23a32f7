"""Session helpers shared by all operators: reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python finds it wherever it was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="matchloom-"), "matchloom.zip")  # staged on the driver, which serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path(root.name, file.relative_to(root)))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


_scratch: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Where the session names none, a local temporary folder is made, once per session, if the master is local as in tests;
    elsewhere each machine would write to a folder of its own, so this is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    if context.applicationId not in _scratch:
        folder = tempfile.mkdtemp(prefix="matchloom-")
        _scratch[context.applicationId] = "file://" + folder
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _scratch[context.applicationId]


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan behind it is cut, so that a lost executor costs a re-read rather than a recomputation, and the written
    size tells the optimizer whether a side is small enough to broadcast.  The table lies there until ``dropped`` or,
    if it was made within ``released``, until that ends; whatever is left goes when the program ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    for made in _made:
        made.append(path)
    _left.add(path)
    if len(_left) == 1:
        atexit.register(_clear, spark)
    relieved(spark)
    return spark.read.schema(df.schema).parquet(path)


def relieved(spark: SparkSession) -> None:
    """Give memory that the driver's JVM has freed back to the system.

    A query of many stored tables plans and compiles for each.  What that leaves stays with the driver otherwise: broadcasts
    and shuffles until the heap is full, and native memory in the arenas of its several hundred threads for good.
    Plans that Python's garbage still refers to would be kept with all they hold, so that goes first.
    """
    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    try:
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(command, "systemTrimNativeHeap", None, None)
    except Py4JError:  # a JVM without this command keeps its native memory
        return


_made: list[list[str]] = []
_left: set[str] = set()


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _left.discard(path)


def _clear(spark: SparkSession) -> None:
    for path in list(_left):
        try:
            deleted(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; its local folder goes on its own
            return


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("table-"):
            deleted(spark, next((p for p in _left if p.endswith(path.getName())), path.toString()))


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within it, results are to be consumed; at its end the tables that were stored meanwhile are deleted."""
    made: list[str] = []
    _made.append(made)
    try:
        yield
    finally:
        _made.remove(made)
        for path in made:
            if path in _left:
                deleted(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """A table made by ``stored``, which outlasts the innermost ``released`` around it."""
    paths = [Path(file).parent.name for file in df.inputFiles()[:1]]
    _made[-1][:] = [p for p in _made[-1] if paths and not p.endswith(paths[0])]
    return df


def parallel(spark: SparkSession) -> int:
    """Partitions for work that the size in bytes understates: as many as there are cores, or more where the session shuffles into more."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join by merging, for sides that grow with the input.

    The optimizer sizes a table by its compressed files, and what is exploded from it or comes out of Python as no larger.
    Left to itself it would send tables through the driver that are many times as large as it takes them for.
    """
    return left.join(right.hint("merge"), on, how)


def salted_join(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = 200_000) -> DataFrame:
    """Equi-join of ``large``, one key of which may hold any share of all rows, with ``small``, which has few rows for any key.

    The most frequent key is counted first; where it has more than ``rows`` rows, its rows go to that many more tasks
    and the rows of ``small`` with them.  Both should be tables that are cheap to read again.
    """
    most = large.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).head().n or 0
    relieved(large.sparkSession)  # else the shuffle of this count lies beside those of the join
    salts = -(-most // rows)
    if salts < 2:
        return large.join(small, on, how)
    left = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as there are cores, for work per row that outweighs moving the row.

    Meant for scans: to count the partitions of a plan with exchanges would run them.
    """
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
