"""Documents ingested as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.ingest import append_documents
from docloom.plans.tables import materialize
from docloom.sources.documents import parse_documents


def stream_ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Follow a folder of documents and append each new key once.

    A batch runs the same anti-join as batch ingest, so a batch that runs again
    adds nothing twice. Files that don't parse go to ``target``/rejected with
    their errors; of files that bring one key in a batch the first by path counts.
    """
    files = (
        spark.readStream.schema("value string")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.md")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .format("text")
        .load(source)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )

    def batch(df: DataFrame, number: int) -> None:
        parsed = materialize(parse_documents(df), "batch")
        bad = parsed.where("error IS NOT NULL").select("source_path", "error", F.lit(number).alias("batch"))
        if bad.limit(1).count():
            bad.write.mode("append").parquet(f"{target}/rejected")
        good = parsed.where("error IS NULL")
        first = good.groupBy("doc_key").agg(F.min("source_path").alias("source_path"))
        append_documents(df.sparkSession, good.join(first, ["doc_key", "source_path"], "left_semi"), target)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
