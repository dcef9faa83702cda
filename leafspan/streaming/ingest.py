"""New documents from a stream, chunked and written by document as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from leafspan.sources.tables import write_by_document


def ingest(stream: DataFrame, to_rows: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the rows of its documents, so a repeated batch does no harm."""
    return stream.writeStream.foreachBatch(lambda batch, _: write_by_document(to_rows(batch), path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
