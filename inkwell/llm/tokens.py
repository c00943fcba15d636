"""BPE encoding and decoding, and token counts of prefixes, over columns of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import piece_bpe, word_bpe
from .common import small_batches


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, file: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded) of every row: ids as array<long>, decoded by the offset table.

    A null text is an empty one, which has no tokens; rows with equal or null keys stay as they
    are; other columns are left out, whatever their names. No row meets another: no shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path(file))
        for keys, texts in slices(batches):
            ids = [bpe.encode_bytes(t) for t in texts.to_pylist()]
            at = np.cumsum([0, *(len(x) // 4 for x in ids)])
            flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)), pa.array([bpe.decode_bytes(x).decode() for x in ids], pa.string())], ["key", "n_tokens", "ids", "decoded"])

    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids array<long>, decoded string").withColumnRenamed("key", key)


def decode(df: DataFrame, file: str = "word_bpe_49k.json", key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) of ids in array<long>; null ids give an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path(file))
        for batch in batches:
            out = [bpe.decode_bytes(np.array(x or [], dtype="<u4").tobytes()).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "decoded"])

    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[ids].alias("ids")).mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", key)


def digests(df: DataFrame, file: str = "word_bpe_49k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: what encode() gives, as digests made
    beside the texts, so that neither ids nor decoded texts leave the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path(file))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for keys, texts in slices(batches):
            ids = [bpe.encode_bytes(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(bpe.decode_bytes(x)) for x in ids])], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The first two columns, few rows at a time: whole texts, bounded memory."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part.column(0), part.column(1)


def token_counts(df: DataFrame, limit: int = 4096, file: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row: the last of its prefix counts.

    A null text has no bytes and no tokens. Rows with equal or null keys stay as they are.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(tokenizer_path(file))
        for keys, texts in slices(batches):
            own = texts.to_pylist()
            n = np.array([bpe.count(t) for t in own], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array([len((t or "").encode()) for t in own], pa.int64()), pa.array(n), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)


def prefix_counts(df: DataFrame, file: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts): counts[i] is the exact token count of the text's first i + 1 characters.

    Stored once, they answer any truncation or budget question; see fitting_chars.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = piece_bpe(tokenizer_path(file))
        for keys, texts in slices(batches, 16):
            yield pa.RecordBatch.from_arrays([keys, pa.array([bpe.prefixes(t) for t in texts.to_pylist()], pa.list_(pa.int32()))], ["key", "counts"])

    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(run, f"key {kind}, counts array<int>").withColumnRenamed("key", key)


def fitting_chars(counts: DataFrame, budget: int) -> DataFrame:
    """prefix_counts with fits: the length of the longest prefix of at most budget tokens. A
    longer prefix may have fewer tokens than a shorter one, so all are looked at."""
    return counts.selectExpr("*", f"coalesce(array_max(transform(counts, (c, i) -> if(c <= {int(budget)}, i + 1, 0))), 0) AS fits")


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
