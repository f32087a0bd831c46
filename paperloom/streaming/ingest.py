"""Ingest as a stream: files of records arrive in a folder, accepted ones join the store, repeats go to the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import classify
from ..sources import records as store


def judged(batch: DataFrame, known: DataFrame) -> DataFrame:
    """A batch with its keys and `blocked`: whether the store, or an earlier record of the batch, has a record's text or certificate number.

    `known` are the store's keys (`store.keys`). Of them only those go further
    that the batch has too; no text of the store is read.
    """
    new = store.keyed(batch)

    def seen(key: str, first: str, stored: str) -> DataFrame:
        mine = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias(first))
        both = known.join(mine, key, "left_semi").select(key, F.lit(True).alias(stored)).distinct()
        return mine.join(both, key, "left")

    x = new.join(seen("text_sha256", "_t", "_ot"), "text_sha256").join(seen("certificate_key", "_c", "_oc"), "certificate_key", "left")
    no = F.lit(False)
    return x.withColumn("blocked", F.coalesce("_ot", no) | F.coalesce("_oc", no) | (F.col("id") != F.col("_t")) | F.coalesce(F.col("id") != F.col("_c"), no)).drop("_t", "_c", "_ot", "_oc")


def start(spark: SparkSession, inbox: str, store_path: str, log_path: str, checkpoint: str, schema=store.RECORD) -> StreamingQuery:
    """Classify and take in what arrives; the store and the log are Parquet folders. Available files are taken once, then the query ends.

    A batch is judged once for both of its outputs, against the keys that are
    stored with the records.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        batch = store.conform(batch.withColumn("document_type", classify(F.col("ocr_text"))[0]))
        try:
            # a batch that runs again doesn't meet itself
            known = store.keys(batch.sparkSession, store_path, but=epoch)
        except Exception as e:  # nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = batch.sparkSession.createDataFrame([], store.KEYS)
        x = judged(batch, known).persist()
        try:
            # the epoch names the files, so a batch that runs again overwrites its own
            x.filter("NOT blocked").select(*store.RECORD.names, *store.KEYS.names).write.mode("overwrite").parquet(f"{store_path}/epoch={epoch}")
            x.filter("blocked").select("id", "file_path", "certificate_number").write.mode("overwrite").parquet(f"{log_path}/epoch={epoch}")
        finally:
            x.unpersist()

    return spark.readStream.schema(schema).parquet(inbox).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
