"""Incremental ingest: a stream of chunk files into a store that keeps the latest version of each chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.chunking import upserted

BUCKETS = 64


class ChunkStore:
    """An append-only log of chunk versions, one folder for each micro-batch and buckets of the key inside.

    A batch only adds files, whatever the size of the store, and writes its folder over if it is run again, so that every batch
    counts once. Readers take the latest version of each key; ``compacted`` gives the table to start a new log from.
    """

    def __init__(self, root: str, key: str = "chunk_id", version: str = "ingested_at"):
        self.root, self.key, self.version = root, key, version

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """The batch's latest version of each key, as folder ``batch=<id>``. Null keys are left out."""
        once = upserted(batch, batch.limit(0), self.key, self.version)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(BUCKETS))
        once.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/batch={batch_id}")

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.root).parquet(f"{self.root}/batch=*")

    def current(self, spark: SparkSession) -> DataFrame:
        """One row for each key: the latest version, of equal versions the one of the latest batch and then the greatest."""
        log = self.log(spark)
        plain = [c for c in log.columns if c not in (self.key, "bucket", "batch")]
        order = F.struct(self.version, "batch", F.to_json(F.struct(*plain)))
        best = log.groupBy(self.key, "bucket").agg(F.max_by(F.struct(*plain), order).alias("r"))
        return best.select(self.key, "r.*")

    def compacted(self, spark: SparkSession, root: str) -> ChunkStore:
        new = ChunkStore(root, self.key, self.version)
        new.add(self.current(spark), 0)
        return new


def start(spark: SparkSession, folder: str, schema: str, store: ChunkStore, state: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Stream the Parquet files that appear in ``folder`` into ``store``; takes what is there and stops (run it again for more)."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return files.writeStream.foreachBatch(lambda df, i: store.add(df, i)).option("checkpointLocation", state).trigger(availableNow=True).start()
