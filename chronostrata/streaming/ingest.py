"""Continuous ingestion: each micro-batch of points becomes a revision. An addition; the query model has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..api import TimeSeries


def ingest(points: DataFrame, target: TimeSeries, author: str, checkpoint: str, tzaware: bool = True) -> StreamingQuery:
    """Starts a query that updates the series of a stream of (name, value_date, num).

    Of several values of a point in one micro-batch the largest counts. A batch that is delivered again
    changes nothing, as its points are known then.
    """

    def update(batch: DataFrame, _: int) -> None:
        target.update_many(batch.groupBy("name", "value_date").agg({"num": "max"}).withColumnRenamed("max(num)", "num"), author, tzaware=tzaware)

    return points.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
