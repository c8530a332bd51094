"""The answer store fed by a stream of JSON files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from talkscale.sources import schemas, sinks


def follow(spark: SparkSession, landing: str, root: str, checkpoint: str, kind: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Append new answers as files land. A batch that is run again after a failure adds nothing twice, as stored keys are left out. One writer for each store."""
    stream = spark.readStream.schema(schemas.ANSWER).option("maxFilesPerTrigger", files_per_batch).json(landing)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: sinks.append_answers(batch, root, kind)).trigger(availableNow=True).start()
