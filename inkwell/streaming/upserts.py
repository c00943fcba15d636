"""Extension: documents from a stream, upserted into a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.operators.model import ID_ZERO, IndexSpec
from inkwell.sources.store import Store


def upsert_stream(stream: DataFrame, store: Store, table: str, spec: IndexSpec, checkpoint: str, newest: str | None = None) -> StreamingQuery:
    """Each micro-batch is a delta of the table, which store.documents() merges in; the table isn't rewritten.

    Of a micro-batch's rows of one id the last by `newest`, then by all fields, is taken. Rows whose id is null or not above 0
    go to the table {table}_rejected with their status, and nothing else of their batch is lost. A micro-batch that
    runs again writes the same delta once more.
    """
    names = [f.name for f in spec.fields]

    def write(batch: DataFrame, number: int) -> None:
        bad = F.coalesce("doc_id", F.lit(0)) <= 0
        last = Window.partitionBy("doc_id").orderBy(*([F.desc(newest)] if newest else []), *(F.desc(n) for n in names))
        batch.persist()
        try:
            own = batch.where(~bad).withColumn("place", F.row_number().over(last)).where("place = 1")
            store.write_delta(table, own.select("doc_id", *names), number)
            store.write_delta(f"{table}_rejected", batch.where(bad).select("doc_id", *names, F.lit(ID_ZERO).alias("status")), number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
