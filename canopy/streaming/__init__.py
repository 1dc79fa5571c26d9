"""Queries over trees that arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from canopy.engine import CompiledQuery
from canopy.sources.parse import parsed


def run_stream(spark: SparkSession, path: str, schema: StructType | str, query: CompiledQuery, sink: Callable[[DataFrame, int], None], checkpoint: str, language: str | None = None, format_: str = "parquet", once: bool = True) -> StreamingQuery:
    """Run a query over each micro-batch of new files and hand its results to `sink`.

    Files hold nodes, or (doc_id, text) rows that are parsed if `language` is given. A document's
    results depend on that document alone, so no state is kept between batches; a document has to
    come in one batch.
    """
    arriving = spark.readStream.format(format_).schema(schema).load(path)

    def batch(rows: DataFrame, number: int) -> None:
        nodes = parsed(rows, language) if language else rows
        sink(query.run_json(nodes), number)

    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
