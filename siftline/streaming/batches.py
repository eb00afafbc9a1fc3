"""Index the micro-batches of a stream: each batch is an index of its own, written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siftline.operators.database import SearchDatabase
from siftline.sources import index as tables


def index_stream(stream: DataFrame, root: str, checkpoint: str, id: str = "id", text: str = "text", metadata: list[str] | None = None, data: list[str] | None = None, **trigger: object) -> StreamingQuery:
    """Write an index for every micro-batch under ``root``; a batch that is run again is overwritten."""

    def add(batch: DataFrame, number: int) -> None:
        made = SearchDatabase.builder(batch.sparkSession).add_documents(batch, id, text, metadata, data)
        made.build(f"{root.rstrip('/')}/batch-{number:08d}", mode="overwrite")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def load_batches(spark: SparkSession, root: str) -> SearchDatabase:
    """One database of all batches under ``root`` that are complete; an id in two batches is an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/batch-*/manifest/_SUCCESS")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    paths = sorted(str(f.getPath().getParent().getParent()) for f in found or [])
    if not paths:
        raise ValueError("no batch is complete")
    made = tables.union([tables.read(spark, p) for p in paths])
    if not made.documents.groupBy("doc_id").count().where("count > 1").isEmpty():
        raise ValueError("a document id occurs in two batches")
    return SearchDatabase(made)
