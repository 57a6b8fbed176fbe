"""The registry over a stream of arriving inventory rows.

The operators are functions of DataFrames, so those that keep row order and grouping out also run on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from terrasift.operators.registry import file_registry, objects_by_class


def append_registry(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the registry rows of a stream of (file_id, region_folder, stem, ext) to a Parquet table; exactly once."""
    return file_registry(files).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_objects(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the annotation files with their classes."""
    return objects_by_class(files).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
