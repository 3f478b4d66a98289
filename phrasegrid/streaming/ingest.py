"""Incremental indexing of a stream of documents; an extension, as the index itself is a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.index import append


def append_batch(batch: DataFrame, path: str) -> None:
    """Indexes the documents of a batch whose content isn't in the index at ``path``, and adds them. A batch counts once it
    is complete, so running it again, after a crash too, adds nothing twice."""
    append(batch, path)


def index_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts indexing a streaming DataFrame (path, text) into ``path``, all that is there and then what comes."""
    return docs.writeStream.foreachBatch(lambda b, _: append_batch(b, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
