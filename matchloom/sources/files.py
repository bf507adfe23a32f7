"""Reading and writing the tables, caches and result files of a matching run."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from pathlib import Path
from urllib.request import urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("manufacturer", T.StringType()), T.StructField("price", T.DoubleType())])
PAIRS = T.StructType([T.StructField("ltable_id", T.LongType()), T.StructField("rtable_id", T.LongType()), T.StructField("label", T.IntegerType())])

# Spellings that CSV files use for a missing value.
CSV_MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with header under a declared schema; quoted fields may hold line breaks, missing spellings become null.

    Columns are matched by name, so files may hold others or none of the optional ones.
    """
    text = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)

    def column(field: T.StructField) -> Column:
        if field.name not in text.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        c = F.col(f"`{field.name}`")
        return F.when(~c.isin(*CSV_MISSING), c).try_cast(field.dataType).alias(field.name)

    return text.select(*map(column, schema.fields))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, ENTITY)


def read_pairs(spark: SparkSession, path: str, split: str) -> DataFrame:
    return read_csv(spark, path, PAIRS).withColumn("split", F.lit(split))


def sha256(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            digest.update(block)
    return digest.hexdigest()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of files, worked out where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def ingest(source: str, target: str | Path, expected: str, force: bool = False, attempts: int = 3, timeout: float = 30) -> Path:
    """Copy a local file or URL to ``target`` unless it is there with the expected checksum.

    Connection failures are tried again, answers that are errors are not; a copy with another checksum is deleted and
    ``ValueError`` raised.
    """
    from urllib.error import HTTPError, URLError

    target = Path(target)
    if target.exists() and not force and sha256(target) == expected:
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    for attempt in range(1, attempts + 1):
        try:
            if "://" in source:
                with urlopen(source, timeout=timeout) as answer, open(target, "wb") as f:  # noqa: S310
                    shutil.copyfileobj(answer, f)
            else:
                shutil.copyfile(source, target)
            break
        except HTTPError:
            raise
        except (URLError, TimeoutError):
            if attempt == attempts:
                raise
    if sha256(target) != expected:
        target.unlink()
        raise ValueError(f"{target.name}: wrong checksum")
    return target


def cached_embeddings(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The table under ``folder/key``, made and written by ``make()`` if it is not there.

    ``key`` should name the encoder and what it encoded, so that a change of either misses the cache.
    """
    path = f"{folder}/embeddings-{hashlib.sha256(key.encode()).hexdigest()[:16]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def input_hash(df: DataFrame) -> str:
    """A fingerprint of a table's rows that does not depend on their order."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).head()
    return f"{r.n}-{r.h}"


def write_json(data: dict, path: str | Path) -> None:
    """A result file, replaced in one step."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=path.parent, suffix=".json")
    with os.fdopen(fd, "w") as f:
        json.dump(data, f, indent=2, sort_keys=True)
    os.replace(temporary, path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
