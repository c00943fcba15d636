"""Quotation linking: conversations in reply order, without their quotes.

A line's quote level is its number of leading > signs. Consecutive lines of one level are a passage, of
which only the words count, so that rewrapping changes nothing. The hashes of its windows of WORDS words
(a shorter passage is one window) are joined to those at every word of the own texts of the conversation's
earlier messages. It comes from the message with the most of its windows in line, of equals the first. A passage
of fewer than FREE words needs to be a whole line there. A message replies to the latest of the messages its
outermost linked quotes come from.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_map, hold, lookup, materialise, may_hold, mix64

MARKS = r"^([ \t]*>)+"
WORDS, FREE = 8, 3
#: A line that announces a quote, in a message that has one.
ANNOUNCES = r"(?i)^\s*(on|am|le|el) .{1,200}(wrote|schrieb|écrit|escribió)\s?:\s*$"


def parsed(messages: DataFrame) -> DataFrame:
    """messages with lines: array<struct<level, body>>."""
    level = "length(translate(regexp_extract(l, '{0}', 0), ' \\t', ''))".format(MARKS.replace("\\", "\\\\"))
    body = "trim(BOTH ' \\t\\r' FROM regexp_replace(l, '{0}', ''))".format(MARKS.replace("\\", "\\\\"))
    return messages.withColumn("lines", F.expr(f"transform(split(coalesce(text, ''), '\\n'), l -> named_struct('level', {level}, 'body', IF({level} > 0, {body}, l)))"))


def codes(text: str) -> list[int]:
    """A hash for each word of a text, lower-cased."""
    return [int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little") for w in text.lower().split()]


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words."""
    n = len(words) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        h = mix64(h + words[j : j + n])
    return h.view(np.int64)


def passages(text: str) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """Of a text: level and words of each quoted passage; its own words; the places where its own lines begin."""
    quoted: list[tuple[int, list[int]]] = []
    own, starts, was = [], [0], 0
    for line in text.split("\n"):
        m = re.match(MARKS, line)
        level = m.group(0).count(">") if m else 0
        found = codes(line[m.end() :] if m else line)
        if not level:
            own += found
            starts.append(len(own))
        elif level == was:
            quoted[-1][1].extend(found)
        else:
            quoted.append((level, found))
        was = level
    return [(lv, np.array(w, np.uint64)) for lv, w in quoted if w], np.array(own, np.uint64), np.array(starts)


def quoted_windows(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, passage, k, at, hash) of the windows of k words of the quoted passages: one after the
    other, and the last."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for batch in batches:
            for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for level, own in passages(text)[0]:
                    k, passage = min(WORDS, len(own)), int(windows(own, len(own))[0])
                    h = windows(own, k)
                    at = np.unique(np.append(np.arange(0, len(h), k), len(h) - 1)).astype(np.int32)
                    h = h[at]
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(h), t) for v, t in ((conv, pa.int64()), (turn, pa.int64()), (level, pa.int32()), (passage, pa.int64()), (k, pa.int32()))] + [pa.array(at), pa.array(h)], ["conv_id", "turn", "level", "passage", "k", "at", "hash"])

    return messages.where("text LIKE '%>%'").select("conv_id", "turn", "text").mapInArrow(run, "conv_id long, turn long, level int, passage long, k int, at int, hash long")


def own_windows(messages: DataFrame, asked: np.ndarray) -> DataFrame:
    """(conv_id, origin, k, place, hash) of every window of the asked lengths ks of messages (conv_id, turn,
    text, ks) that isn't a quote and that the map of asked hashes lets through; those under FREE words only where they
    are a whole line."""
    sent = messages.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        bits = sent.value
        for batch in batches:
            for conv, turn, text, ks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, own, starts = passages(text or "")
                for k in ks:
                    h = windows(own, k)
                    place = np.arange(len(h))
                    if k < FREE:
                        ends = starts[1:][np.diff(starts) == k]
                        place = ends - k
                        h = h[place]
                    hit = may_hold(bits, h)
                    h, place = h[hit], place[hit]
                    if len(h):
                        yield pa.RecordBatch.from_arrays([pa.array([v] * len(h), t) for v, t in ((conv, pa.int64()), (turn, pa.int64()), (k, pa.int32()))] + [pa.array(place.astype(np.int32)), pa.array(h)], ["conv_id", "origin", "k", "place", "hash"])

    return messages.select("conv_id", "turn", "text", "ks").mapInArrow(run, "conv_id long, origin long, k int, place int, hash long")


def quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, origin) of every quoted passage; origin: the earlier turn it comes from, or null."""
    messages = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoted = materialise(quoted_windows(messages), "quotes")
    # Only conversations that hold quotes are cut to windows, and each passage of one is looked up once.
    asked = quoted.groupBy("conv_id").agg(F.collect_set("k").alias("ks"))
    own = own_windows(lookup(messages, asked, ["conv_id"], "inner"), bit_map(quoted, "hash"))
    each = quoted.select("conv_id", "passage", "k", "at", "hash").distinct()
    met = each.join(own.hint("merge"), ["conv_id", "k", "hash"])
    runs = met.groupBy("conv_id", "passage", "origin", (F.col("place") - F.col("at")).alias("line")).agg(F.countDistinct("at").alias("run"))
    # Of equal runs the first message counts: a passage has no more rows than windows, however many messages hold it.
    best = runs.groupBy("conv_id", "passage", "run").agg(F.min("origin").alias("origin"))
    uses = quoted.select("conv_id", "turn", "level", "passage").distinct()
    best = best.groupBy("conv_id", "passage").agg(F.collect_list(F.struct("run", (-F.col("origin")).alias("back"))).alias("found"))
    found = lookup(uses, best, ["conv_id", "passage"])
    earlier = F.filter("found", lambda x: -x["back"] < F.col("turn"))
    return found.select("conv_id", "turn", "level", (-F.array_max(earlier)["back"]).alias("origin"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, thread, depth) of (conv_id, turn, reply_to): thread is the turn a chain of
    replies begins with. Each round doubles how far a message sees, so long chains take few."""
    t = materialise(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).alias("depth")), "threads")
    while True:
        up = t.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("up"), F.col("depth").alias("more"))
        far = lookup(t, up, ["conv_id", "thread"])
        if far.where("up IS NOT NULL").isEmpty():
            return t
        t = materialise(far.select("conv_id", "turn", "reply_to", F.coalesce("up", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "threads")


def reply_order(messages: DataFrame) -> DataFrame:
    """Every row of messages (conv_id, turn, role, text), sorted by conversation, thread and turn: conv_id,
    turn, role, body (without quotes and the lines that announce them), reply_to, thread, depth,
    n_quotes, n_linked.

    Conversations and turns are integers. A reply stands after what it replies to. A message that quotes nothing known begins a thread.
    Rows that repeat a turn share its links. A null conversation or turn has no links; a null
    text is an empty one. Other columns are left out.
    """
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    found = materialise(quotations(messages), "quote-links")
    each = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.count("origin").alias("n_linked"), F.max(F.when(F.col("origin").isNotNull(), F.struct(-F.col("level"), F.col("origin").alias("origin")))).alias("best"))
    linked = threads(each.where("best IS NOT NULL").select("conv_id", "turn", F.col("best.origin").alias("reply_to")))
    about = each.select("conv_id", "turn", "n_quotes", "n_linked").join(linked, ["conv_id", "turn"], "left")
    quotes = F.exists("lines", lambda x: x["level"] > 0)
    kept = F.filter("lines", lambda x: (x["level"] == 0) & ~(quotes & x["body"].rlike(ANNOUNCES)))
    body = F.array_join(F.transform(kept, lambda x: x["body"]), "\n")
    out = lookup(parsed(messages), about, ["conv_id", "turn"])
    out = out.select("conv_id", "turn", "role", F.when(quotes, F.trim(body)).otherwise(body).alias("body"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    return out.orderBy("conv_id", "thread", "turn", "role", "body")


#: Characters of a line of a mail.
COLUMNS = 72


def as_mails(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) as mails: each quotes the one before it, wrapped anew, and as that one's quote the
    one before that, under a line that announces them. Turns that aren't there are not quoted."""
    said = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m"))

    def back(k: int) -> DataFrame:
        own = said.where("trim(BOTH ' \\t\\r\\n' FROM m.text) <> ''")
        lines = F.regexp_replace(F.regexp_replace("m.text", r"^\s+", ""), rf"(\S{{{COLUMNS},}}|.{{1,{COLUMNS}}})(?:\s+|$)", "> " * k + "$1\n")
        return own.select("conv_id", (F.col("turn") + k).alias("turn"), lines.alias(f"q{k}"), F.col("m.role").alias(f"by{k}"))

    for k in (1, 2):
        messages = messages.join(back(k).hint("merge"), ["conv_id", "turn"], "left")
    head = F.when(F.coalesce("q1", "q2").isNotNull(), F.concat(F.lit("On the turn before, "), F.coalesce("by1", "by2", F.lit("someone")), F.lit(" wrote:\n")))
    text = F.concat(F.coalesce(head, F.lit("")), F.coalesce("q2", F.lit("")), F.coalesce("q1", F.lit("")), F.coalesce("text", F.lit("")))
    return messages.select("conv_id", "turn", "role", text.alias("text"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no quotes, so their messages are made mails that quote one another, and the operator takes that back:
    bodies are the texts there were, and replies are found by the passages alone."""
    return reply_order(as_mails(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: A quoted text comes from the first earlier message that holds its words in line; of under three words, as a whole line.
OP9_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS w FROM conversations),
q AS (
  SELECT m.conv_id, m.turn, p.w, m.turn - p.turn AS level FROM m JOIN m p ON p.conv_id = m.conv_id AND m.turn - p.turn IN (1, 2) WHERE p.w <> ''),
f AS (
  SELECT q.conv_id, q.turn, q.level, min(o.turn) AS origin
  FROM q JOIN m o ON o.conv_id = q.conv_id AND o.turn < q.turn
   AND CASE WHEN len(string_split(q.w, ' ')) >= 3 THEN contains(' ' || o.w || ' ', ' ' || q.w || ' ')
            ELSE list_contains(list_transform(string_split(o.text, chr(10)), lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))), q.w) END
  GROUP BY ALL),
n AS (SELECT conv_id, turn, count(*) AS n_quotes FROM q GROUP BY ALL),
r AS (SELECT conv_id, turn, count(*) AS n_linked, arg_min(origin, level) AS reply_to FROM f GROUP BY ALL),
l AS (SELECT m.*, r.reply_to, coalesce(n.n_quotes, 0) AS n_quotes, coalesce(r.n_linked, 0) AS n_linked FROM m LEFT JOIN n USING (conv_id, turn) LEFT JOIN r USING (conv_id, turn)),
c AS (
  SELECT conv_id, turn, turn AS thread, 0 AS depth FROM l WHERE reply_to IS NULL
  UNION ALL SELECT l.conv_id, l.turn, c.thread, c.depth + 1 FROM l JOIN c ON l.conv_id = c.conv_id AND l.reply_to = c.turn)
SELECT conv_id, turn, role, CASE WHEN n_quotes > 0 THEN trim(text) ELSE text END AS body, reply_to, thread, depth, n_quotes, n_linked
FROM l JOIN c USING (conv_id, turn)
"""
