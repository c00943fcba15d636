"""Tables between steps, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share, spark.checkpoint.dir. Only a session of one machine that names none (tests) gets
    a local one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='inkwell-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/inkwell/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes a query's shuffle files as soon as it is done, instead of when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files. For queries whose result is kept elsewhere: a DataFrame that runs again shuffles again."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, lost executors cost no rerun, and no shuffle files
    stay, so that disk holds one step's shuffles however many there are."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that materialise() made and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        own = f"{shared_dir(spark)}/inkwell/".split("://")[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if own in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *order: Column | str, name: str = "number", start: int = 0) -> DataFrame:
    """df with a column of numbers start, start + 1, ... in an order that leaves no ties.

    Rows are sorted over all tasks and written; each task numbers its own, and the tasks' sizes, a row each,
    say where it begins. So no task holds all, and the numbers don't change when a part runs again.
    """
    at = f"at_{uuid.uuid4().hex}"
    rows = materialise(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright(at, 33).alias("part"), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(F.col("part").alias(f"{at}_part"), (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias(f"{at}_before"))
    own = rows.join(F.broadcast(before), F.shiftright(at, 33) == F.col(f"{at}_part"))
    return own.select(*df.columns, (F.col(f"{at}_before") + place + start).alias(name))


def ranked(df: DataFrame, keys: list[str], *order: Column | str, name: str = "rank") -> DataFrame:
    """df with each row's number, from 1, in its group's order, which leaves no ties. As numbered(): a group may fill many
    tasks, each with its part of the numbers. Nulls are values of the keys."""
    at = f"at_{uuid.uuid4().hex}"
    rows = materialise(df.orderBy(*keys, *order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn(f"{at}_part", F.shiftright(at, 33))
    own = rows.groupBy(*(F.col(k).alias(f"{at}_{k}") for k in keys), F.col(f"{at}_part").alias(f"{at}_of")).agg(F.min(at).alias(f"{at}_first"), F.count("*").alias(f"{at}_n"))
    # A row for each group and task, so a group has as many as it fills tasks.
    before = F.sum(f"{at}_n").over(Window.partitionBy(*(f"{at}_{k}" for k in keys)).orderBy(f"{at}_of")) - F.col(f"{at}_n")
    own = own.withColumn(f"{at}_before", before).hint("merge")
    same = rows[f"{at}_part"] == own[f"{at}_of"]
    for k in keys:
        same &= rows[k].eqNullSafe(own[f"{at}_{k}"])
    return rows.join(own, same).select(*(rows[c] for c in df.columns), (F.col(at) - F.col(f"{at}_first") + F.col(f"{at}_before") + 1).alias(name))
