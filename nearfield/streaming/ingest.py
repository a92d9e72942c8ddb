"""Streams of vectors and deletions into an index, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import VectorIndex


def ingest(stream: DataFrame, index: VectorIndex, checkpoint: str, col: str = "embedding", id_col: str = "vec_id", op_col: str | None = None, order_col: str | None = None, compact_every: int = 0, once: bool = True, event_time: str | None = None, late: str = "10 minutes") -> StreamingQuery:
    """Applies each micro-batch to the index: inserts or replaces vectors, and deletes where op_col is 'delete'.

    In a batch the last row of an id counts (by order_col). With event_time,
    repeats of an id that come within `late` are dropped by watermark. A batch
    that runs again after a failure does no harm: the index knows which batch of
    the stream (told by its checkpoint) it took last, and deletions that come
    twice before it are the same as once.
    """
    if event_time:
        stream = stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([id_col])

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch
        if order_col:
            last = Window.partitionBy(id_col).orderBy(F.desc(order_col))
            rows = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
        if index.meta["streams"].get(checkpoint, -1) >= number:
            return
        if op_col:
            index.delete(rows.where(F.col(op_col) == "delete").select(id_col))
            rows = rows.where(F.coalesce(F.col(op_col), F.lit("")) != "delete")
        index.insert(rows, col, id_col, stream=(checkpoint, number))
        if compact_every and (number + 1) % compact_every == 0:
            index.compact()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
