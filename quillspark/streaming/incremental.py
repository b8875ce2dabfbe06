"""Extension: keep a keyword index current as notes come, change and go, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators import segments


def index_stream(units: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """units: a stream with unit_id and text, or of changes with also deleted (boolean) and seq (their order). Each
    micro-batch is one change of the index at path; one that is run again after a failure changes nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        if "seq" in batch.columns:
            new, gone = segments.latest_changes(batch)
            segments.change(new, path, gone, number)
        else:
            segments.change(batch, path, batch=number)

    return units.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
