"""Mixing sources to target weights: token weights raked to marginals, documents sampled by them."""

from __future__ import annotations

import logging
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lookup, materialise

log = logging.getLogger(__name__)

MARGINS = ("source", "lang", "topic")
#: Targets without a given share: the power of what there is; under 1 it lifts what is rare.
POWER = 0.7
#: Rounds at most, and how far a margin's shares may be off their targets when they end.
ROUNDS, CLOSE = 500, 1e-9
#: Up to so many cells (a few MB) are raked on the driver and broadcast; more are raked as a table.
CELLS = 50_000
#: Part of all tokens that is drawn.
FRACTION = 0.5
SEED = 17


def form_topic(text: Column) -> Column:
    """A topic that needs no model: what form a text has."""
    low = F.lower(text)
    return (
        F.when(low.contains("licensed under") | low.contains("copyright"), "legal")
        .when(text.contains(" | "), "tabular")
        .when(F.length(text) < 500, "note")
        .when(F.length(text) < 4000, "article")
        .when(text.isNotNull(), "longform")
        .otherwise("none")
    )


def word_count(text: Column) -> Column:
    """Runs of other characters than white space; one at least, so that an empty text has a weight."""
    return F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1))


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Weights of cells whose weighted tokens have the target share of each margin, by iterative proportional fitting:
    until all shares are `close` to their targets. Where no weights give all targets (cells are missing) that
    never comes, and what the last round gives, which has the last margin's targets, is taken."""
    w = np.ones(len(tokens))
    for _ in range(rounds):
        off = 0.0
        for code, target in zip(codes, targets, strict=True):
            share = np.bincount(code, weights=w * tokens, minlength=len(target)) / (w @ tokens)
            off = max(off, float(np.abs(share - target).max()))
            w *= np.where(share > 0, target / np.maximum(share, 1e-300), 0)[code]
        if off <= close:
            return w
    log.warning("raking: shares are still %.2g off their targets after %d rounds", off, rounds)
    return w


def factor(drawn, fraction: float, steps: int = 60) -> float:
    """The factor for which drawn(factor), which ascends, is the fraction: by halving."""
    low, high = 0.0, 1.0
    while drawn(high) < fraction and high < 1 << 16:
        low, high = high, high * 2
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if drawn(mid) < fraction else (low, mid)
    return high


def target_shares(shares: dict, given: dict | None) -> dict:
    """The target of each value there is: as given (0 if not named) or the power of its share; they sum to 1."""
    raw = {k: (given.get(k, 0.0) if given else v**POWER) for k, v in shares.items()}
    total = sum(raw.values())
    if not total:
        raise ValueError("no value of a margin has a target above 0")
    return {k: v / total for k, v in raw.items()}


def cell_weights(cells: DataFrame, targets: dict[str, dict] | None = None, most: int = CELLS, fraction: float = FRACTION) -> DataFrame:
    """(cell, weight, probability) for cells (cell, margins, tokens): raked weights, whose mean over tokens is 1,
    and the weights times the one factor, at most 1 each, that draws `fraction` of all tokens."""
    spark, targets = cells.sparkSession, targets or {}
    if cells.count() <= most:
        rows = cells.collect()
        if not rows:
            return cells.select("cell", F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability"))
        tokens, codes, shares = np.array([float(r.tokens) for r in rows]), [], []
        for m in MARGINS:
            values = sorted({r[m] for r in rows}, key=lambda x: (x is not None, x))
            place = {v: i for i, v in enumerate(values)}
            codes.append(np.array([place[r[m]] for r in rows]))
            own = np.bincount(codes[-1], weights=tokens) / tokens.sum()
            target = target_shares(dict(zip(values, own.tolist(), strict=True)), targets.get(m))
            shares.append(np.array([target[v] for v in values]))
        w = rake(tokens, codes, shares)
        w /= (w @ tokens) / tokens.sum()
        s = factor(lambda f: float(np.minimum(1, f * w) @ tokens) / tokens.sum(), fraction)
        return F.broadcast(spark.createDataFrame([(r.cell, float(x), float(min(1.0, s * x))) for r, x in zip(rows, w, strict=True)], "cell string, weight double, probability double"))
    w = cells.withColumn("w", F.lit(1.0))
    goal = {}
    for m in MARGINS:
        own = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("mass"))
        if given := targets.get(m):
            raw = F.coalesce(*(F.when(F.col(m).eqNullSafe(k), F.lit(float(v))) for k, v in given.items()), F.lit(0.0))
        else:
            raw = F.pow("mass", POWER)
        goal[m] = materialise(own.select(F.col(m).alias("value"), raw.alias("goal")), "mix-goal")
        sum_goal = goal[m].agg(F.sum("goal")).first()[0]
        goal[m] = goal[m].withColumn("goal", F.col("goal") / sum_goal)
    total = w.agg(F.sum("tokens").cast("double")).first()[0]
    for i in range(ROUNDS):
        off, last = 0.0, w
        for m in MARGINS:
            sums = materialise(w.groupBy(F.col(m).alias("value")).agg(F.sum(F.col("w") * F.col("tokens")).alias("mass")), "mix-sums")
            now = sums.join(goal[m], sums["value"].eqNullSafe(goal[m]["value"]))
            off = max(off, now.agg(F.max(F.abs(F.col("mass") / total - F.col("goal")))).first()[0])
            lift = sums.join(goal[m], sums["value"].eqNullSafe(goal[m]["value"])).select(sums["value"], F.when(F.col("mass") > 0, F.col("goal") * total / F.col("mass")).otherwise(0.0).alias("lift"))
            w = w.join(lift, w[m].eqNullSafe(lift["value"])).withColumn("w", F.col("w") * F.col("lift")).drop("value", "lift")
        w = materialise(w, "mix-weights")
        if i:
            discard(last)
        if off <= CLOSE:
            break
    else:
        log.warning("raking: shares are still %.2g off their targets after %d rounds", off, ROUNDS)
    mean = w.agg(F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).first()[0]
    w = w.withColumn("w", F.col("w") / mean)
    s = factor(lambda f: w.agg(F.sum(F.least(F.lit(1.0), F.col("w") * f) * F.col("tokens")) / F.sum("tokens")).first()[0], fraction, 32)
    return w.select("cell", F.col("w").alias("weight"), F.least(F.lit(1.0), F.col("w") * s).alias("probability"))


def mix(docs: DataFrame, topic: Column | None = None, targets: dict[str, dict] | None = None, seed: int = SEED, most: int = CELLS, tokens: Column | None = None) -> DataFrame:
    """docs with topic, n_tokens, weight, probability and sampled: each document is drawn on its own, by
    the raked weight of its cell of source, language and topic, so that FRACTION of the tokens is
    expected and they have the target marginals, but where a cell is drawn whole and has no more.

    topic: what the third margin is, or docs' column of that name, or form_topic(). tokens: a count, as of
    token_counts(), or the number of words; null counts as 1. Nulls are a value of each margin. Rows that
    repeat a doc_id are drawn together; null ids by their texts. Columns of these names are replaced.
    """
    cell = f"cell_{uuid.uuid4().hex}"  # a name that no column has
    count = F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1)) if tokens is not None else word_count(F.coalesce("text", F.lit("")))
    docs = docs.withColumn(cell, count.cast("long")).drop("n_tokens", "weight", "probability", "sampled", *([] if topic is None and "topic" in docs.columns else ["topic"])).withColumnRenamed(cell, "n_tokens")
    if "topic" not in docs.columns:
        docs = docs.withColumn("topic", form_topic(F.col("text")) if topic is None else topic)
    docs = docs.withColumn(cell, F.to_json(F.struct(*MARGINS)))
    cells = materialise(docs.groupBy(cell, *MARGINS).agg(F.sum("n_tokens").alias("tokens")).withColumnRenamed(cell, "cell"), "mix-cells")
    weights = cell_weights(cells, targets, most).withColumnRenamed("cell", cell)
    out = docs.join(weights, cell, "left") if cells.count() <= most else lookup(docs, weights, [cell])
    own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    drawn = F.shiftrightunsigned(own, 11) / F.lit(float(1 << 53))
    return out.withColumn("sampled", drawn < F.col("probability")).select(*docs.columns, "weight", "probability", "sampled").drop(cell)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled")
