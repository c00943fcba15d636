"""Figures of requests: counters and timers of a search, and summaries of timings."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from inkwell.sources.shared import materialise


class Trace:
    """Counters that are filled when the DataFrames they were put into run, and timers of parts of a program."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}
        self.seconds: dict[str, float] = {}

    def count(self, df: DataFrame, name: str) -> DataFrame:
        """df, whose rows are counted as it runs."""
        self.seen[name] = Observation(name)
        return df.observe(self.seen[name], F.count("*").alias("rows"))

    def counters(self) -> dict[str, int]:
        """Rows by name; waits until what was counted has run."""
        return {name: seen.get["rows"] for name, seen in self.seen.items()}

    @contextmanager
    def timer(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began


def summary(df: DataFrame, column: str, *by: str, quantiles: tuple[float, ...] = (0.5, 0.8, 0.9)) -> DataFrame:
    """Count, least, most, mean, deviation and exact quantiles (interpolated) of a column, by groups.

    Values are counted before they are sorted over all tasks, and each task adds up its own, so
    no task holds a group, however large. Nulls are left out; a group with nothing else has no row.
    """
    c = F.col(column).cast("double")
    own = df.where(c.isNotNull()).select(*by, c.alias("x"))
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    counted = own.groupBy(*by, "x").agg(F.count("*").alias("n")).withColumn("group", group)
    rows = materialise(counted.orderBy("group", "x").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)), "quantile-counts")
    inner = Window.partitionBy("group", "part").orderBy("x")
    parts = rows.groupBy("group", "part").agg(F.sum("n").alias("size"))  # a row for each task a group is in
    offset = F.sum("size").over(Window.partitionBy("group").orderBy("part")) - F.col("size")
    parts = parts.select("group", "part", offset.alias("offset"))
    total = rows.groupBy("group").agg(F.sum("n").alias("total"))
    placed = rows.withColumn("upto", F.sum("n").over(inner)).join(parts, ["group", "part"]).join(total.hint("merge"), "group")
    placed = placed.withColumn("last", F.col("upto") + F.col("offset") - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    picks = []
    for q in quantiles:
        at = F.lit(float(q)) * (F.col("total") - 1)
        for rank in (F.floor(at), F.ceil(at)):
            picks.append(F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("x"))).alias(f"v{len(picks)}"))
    values = placed.groupBy("group").agg(F.first("total").alias("total"), *picks)
    named = []
    for k, q in enumerate(quantiles):
        at = F.lit(float(q)) * (F.col("total") - 1)
        low, high = F.col(f"v{2 * k}"), F.col(f"v{2 * k + 1}")
        named.append((low + (high - low) * (at - F.floor(at))).alias(f"p{round(q * 100)}"))
    plain = own.groupBy(*by).agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    plain = plain.withColumn("group", group)
    return plain.join(values.select("group", *named), "group").drop("group")


def histogram(df: DataFrame, column: str, growth: float = 1.5) -> DataFrame:
    """(low, n): values from 1 on by buckets whose bounds grow by a factor; smaller ones are in the bucket of 0."""
    c = F.col(column).cast("double")
    bucket = F.when(c < 1, -1).otherwise(F.floor(F.log(c) / F.log(F.lit(growth)) + 1e-9))
    return df.where(c.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).select(F.when(F.col("bucket") < 0, 0.0).otherwise(F.pow(F.lit(growth), "bucket")).alias("low"), "n")


def merged_histograms(*parts: DataFrame) -> DataFrame:
    """Histograms of one growth as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("low").agg(F.sum("n").alias("n"))


def histogram_quantile(own: DataFrame, share: float, growth: float = 1.5) -> DataFrame:
    """(value): the quantile of a histogram, linear inside its bucket. There are as many rows as buckets, some 1,750 at most."""
    w = Window.partitionBy(F.lit(0)).orderBy("low")
    rows = own.select("low", "n", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    goal = F.lit(float(share)) * F.col("total")
    high = F.when(F.col("low") == 0, 1.0).otherwise(F.col("low") * growth)
    inside = F.col("low") + (high - F.col("low")) * (goal - (F.col("upto") - F.col("n"))) / F.col("n")
    return rows.where(F.col("upto") >= goal).orderBy("low").limit(1).select(inside.alias("value"))
