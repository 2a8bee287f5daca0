"""Incremental indexing: batches of a document stream become index generations; readers merge them.

Each micro-batch writes its own postings and documents under its batch id, so a batch that is run again
after a failure replaces what it wrote. compact() merges the generations into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrid.operators.index import Index, build_postings, collection_properties, term_statistics, with_size
from lexigrid.operators.ranks import dense_ids
from lexigrid.sources.store import written


def index_stream(docs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index a stream of docs(doc_id, title, terms), whose ids are unique over the stream, into `path`."""

    def add(batch: DataFrame, batch_id: int) -> None:
        generation = f"generation={batch_id}"
        build_postings(batch).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/{generation}")
        with_size(batch).write.mode("overwrite").parquet(f"{path}/documents/{generation}")

    w = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def open_generations(spark: SparkSession, path: str) -> Index:
    """All generations as one index: term statistics and properties are those of the union."""
    postings = spark.read.parquet(f"{path}/postings").drop("generation")
    documents = spark.read.parquet(f"{path}/documents").drop("generation")
    lexicon = dense_ids(term_statistics(postings), ["term"], "term_id").select("term_id", "term", "df", "cf")
    return Index(postings.select("term", "doc_id", "tf", "len"), lexicon, documents, collection_properties(documents))


def compact(index: Index) -> Index:
    """The same index from tables of its own, sorted for look-ups."""
    postings = written(index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), "compacted")
    return Index(postings, written(index.lexicon, "lexicon"), written(index.documents, "documents"), written(index.properties, "properties"))


def term_counts_stream(docs: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Windowed counts of terms over a stream of (ts, terms), with a watermark for late documents."""
    tokens = docs.withWatermark(time, late).select(time, F.explode("terms").alias("term"))
    return tokens.groupBy(F.window(time, width), "term").agg(F.count("*").alias("n"))
