"""New files as a stream: what the batch stages skip by looking for outputs, a stream has never seen.

An extension of the library's own; offsets in the checkpoint take the place of existence checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C


def new_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below root as they arrive: path, name, stem, length, modified."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    name = C.basename(F.col("path"))
    return found.select("path", name.alias("name"), C.stem(name).alias("stem"), "length", F.col("modificationTime").alias("modified"))


def to_table(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table all that has arrived, then stop."""
    return files.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
