"""Incremental ingestion as a stream of document files: clean, chunk, embed, upsert. Exactly once by document."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..functions.udfs import embedder
from ..operators import chunking, corpus, extraction
from ..sources import sinks, tables


def ingest_batch(docs: DataFrame, path: str, model=None) -> None:
    """IEX9: one batch of documents (doc_id, text, source): chunks with vectors into the index, document by document replaced."""
    rows = docs.select(F.col("doc_id").alias("doc"), t.collapse_whitespace(F.coalesce("text", F.lit(""))).alias("text"))
    chunks = chunking.chunk_fixed(rows).withColumn("vec", embedder(model)("text")).withColumn("source_file", F.col("doc").cast("string"))
    sinks.upsert_chunks(chunks, path)


def ingest_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, schema: str = "doc_id bigint, text string, lang string, source string, n_chars bigint") -> StreamingQuery:
    """A file stream into the index. A batch that is repeated after a failure replaces the same partitions."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: ingest_batch(batch, path)).start()


def extract_pending(docs: DataFrame, manifest_path: str, triples_path: str, extractor: str = "domain", model: Callable | None = None, blocks: int = 8) -> DataFrame:
    """IEX8, IEX10: triples of all documents (doc_id string, text) that the manifest has as pending for the extractor; returns the manifest.

    Resumable by blocks of documents: a block's triples are saved, and then its documents marked, before the next one is
    begun, so that a run that was broken off goes on with the blocks that are left. A block that fails is marked as failed.
    """
    spark = docs.sparkSession
    for b in range(blocks):
        known = tables.manifest(spark, manifest_path)
        todo = corpus.pending(known, extractor).filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == b).select("doc_id")
        own = docs.join(todo, "doc_id", "left_semi")
        if todo.isEmpty():
            continue
        try:
            pages = own.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text")
            found = extraction.extract_triples(extraction.sentences_of(pages), model)
            sinks.save_triples(found.withColumn("doc_id", F.col("source_file")), triples_path, todo)
            counts = tables.triples(spark, triples_path).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_found"))
            done = corpus.mark_extractor(known, todo, extractor).join(todo.withColumn("mine", F.lit(True)), "doc_id", "left").join(counts, "doc_id", "left")
            done = done.withColumn("n_triples", F.when(F.col("mine"), F.coalesce("n_found", F.lit(0))).otherwise(F.col("n_triples"))).withColumn("status", F.when(F.col("mine"), "processed").otherwise(F.col("status")))
        except Exception as e:  # noqa: BLE001  one block must not end the run
            told = next((x for x in str(e).splitlines() if re.match(r"\w*(Error|Exception): ", x)), str(e))[:300]
            done = known.join(todo.withColumn("mine", F.lit(True)), "doc_id", "left").withColumn("status", F.when(F.col("mine"), "failed").otherwise(F.col("status"))).withColumn("error", F.when(F.col("mine"), told).otherwise(F.col("error")))
        sinks.save_manifest(done.select(*known.columns), manifest_path)
    return tables.manifest(spark, manifest_path)
