"""Numbers for user keys: 1, 2, ... in the order of asking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources.shared import numbered


def current(mapping: DataFrame, ids: DataFrame) -> DataFrame:
    """(user_id, seq, max_seq) of the asked ids; seq is null where there is none, max_seq 0 in an empty table."""
    top = mapping.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("max_seq")).withColumn("one", F.lit(1))
    return ids.select("user_id").distinct().join(mapping, "user_id", "left").withColumn("one", F.lit(1)).join(F.broadcast(top), "one").select("user_id", "seq", "max_seq")


def acquire(mapping: DataFrame, ids: DataFrame) -> DataFrame:
    """(user_id, seq) of the asked ids (user_id, pos): what they have, or the next numbers by position."""
    asked = ids.groupBy("user_id").agg(F.min("pos").alias("pos"))
    known = asked.join(mapping, "user_id").select("user_id", "seq")
    top = mapping.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    fresh = numbered(asked.join(mapping, "user_id", "left_anti"), "pos", "user_id", name="seq", start=top + 1)
    return known.unionByName(fresh.select("user_id", F.col("seq").cast("long").alias("seq")))
