"""A store that grows from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import Busy
from ..sources.store import Store

CORPUS = "source string, text string, metadata string, dedup_key string"


def documents(spark: SparkSession, folder: str, schema: str = CORPUS) -> DataFrame:
    """JSON lines files as they come into a folder."""
    return spark.readStream.schema(schema).json(folder)


def first_of_each_hash(stream: DataFrame, event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The stream without repeated texts: state holds the hashes, all of them or (with an event time) those within
    `late`."""
    hashed = stream.withColumn("content_hash", F.xxhash64(F.coalesce("dedup_key", "text")))
    if event_time is None:
        return hashed.dropDuplicates(["content_hash"])
    return hashed.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["content_hash"])


def ingest(stream: DataFrame, store: Store, checkpoint: str, retries: int = 3) -> StreamingQuery:
    """Each micro-batch becomes a segment. A batch that is played again adds nothing, as its texts are there already;
    a commit that another writer was faster than is tried anew on the newer generation."""

    def add(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        for left in reversed(range(retries)):
            try:
                store.writer().add(batch.filter("text is not null")).commit()
                return
            except Busy:
                if not left:
                    raise

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
