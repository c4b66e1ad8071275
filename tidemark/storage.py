"""Tables that rounds of a job leave for the next ones, in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on one machine (local master) a folder of its own if that is unset.

    On a cluster a folder of the driver's machine would be another one on each executor, so there the setting is needed.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: short lineage, safe from lost executors.

    All tables of an application lie in one folder named by its id, to be deleted when it has ended; those of rounds
    that are over go at once (``spent``).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._tidemark_path = path
    return made


def spent(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and merged, so never sent whole to the driver and to all executors.

    Spark guesses from files and shuffles, which are compressed: what it takes for 10 MB can be hundreds as a hash table.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all tasks of a shuffle, however few bytes it has.

    For work on a row that costs much more than its bytes tell: by bytes alone Spark would put it into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
