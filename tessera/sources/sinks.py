"""Writers. Tables lie in a fixed number of hash buckets of their key, so that an upsert or a removal rewrites the buckets
it touches, and the number of folders doesn't grow with the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import exists

#: Buckets of a table; a table keeps the number that it was made with.
BUCKETS = 64


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def replace_rows(rows: DataFrame, path: str, key: str, keys: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """All rows of some keys (by default, of those in rows) replaced by rows: idempotent, and no orphans stay. Only buckets with such keys are read and written."""
    spark, given = rows.sparkSession, keys is not None
    keys = (rows if keys is None else keys).select(key).distinct()
    new = rows.withColumn("bucket", _bucket(key, buckets))
    touched = [r[0] for r in keys.select(_bucket(key, buckets).alias("b")).distinct().collect()]  # `buckets` numbers at most
    if exists(spark, path):
        old = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).join(keys, key, "left_anti")
        new = old.select(*new.columns).unionByName(new)
    # buckets that are to be empty have no rows to overwrite them; without `keys`, each touched one has
    left = {r[0] for r in new.select("bucket").distinct().collect()} if given else set(touched)
    # a bucket of many rows (one key may have most of them) is written by several tasks, small ones by one
    new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in set(touched) - left:
        _delete(spark, f"{path}/bucket={b}")


def upsert_chunks(chunks: DataFrame, path: str, key: str = "source_file") -> None:
    """SNK1, SNK2: each document's chunks are replaced whole."""
    replace_rows(chunks.dropDuplicates(["chunk_id"]), path, key)


def delete_source(spark: SparkSession, path: str, source: str, key: str = "source_file") -> int:
    """SNK2: rows deleted; nothing but the source's bucket is read."""
    if not exists(spark, path):
        return 0
    kept = spark.read.parquet(path)
    gone = spark.createDataFrame([(source,)], f"{key} string")
    n = kept.filter((F.col("bucket") == gone.select(_bucket(key, BUCKETS)).first()[0]) & (F.col(key) == source)).count()
    replace_rows(kept.drop("bucket").limit(0), path, key, gone)
    return n


def reset(spark: SparkSession, path: str) -> None:
    """SNK3, SNK11."""
    _delete(spark, path)


def save_triples(triples: DataFrame, path: str, docs: DataFrame | None = None) -> None:
    """SNK4, SNK5: each document's triples replaced whole; docs: the documents that were extracted, if some gave none."""
    replace_rows(triples, path, "doc_id", docs)


def not_extracted(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """SNK5: documents without saved triples: where a broken-off run goes on."""
    return docs.join(spark.read.parquet(path).select("doc_id").distinct(), "doc_id", "left_anti") if exists(spark, path) else docs


def save_manifest(manifest: DataFrame, path: str) -> None:
    """SNK6: JSON lines, made beside the old ones and then put in their place, so that a manifest may be made from the one that it replaces. A small manifest is one file; no task writes all of a large one."""
    spark = manifest.sparkSession
    manifest.hint("rebalance").write.mode("overwrite").json(f"{path}.next")
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.next", path))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(old, True)
    files.rename(new, old)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """SNK7: edges clustered by their source, for frontier joins."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartition("src").sortWithinPartitions("src", "ord").write.mode("overwrite").parquet(f"{path}/edges")


def save_chats(messages: DataFrame, path: str) -> None:
    """SNK9."""
    messages.write.mode("append").json(path)


def save_evaluation(rows: DataFrame, path: str) -> None:
    """SNK10."""
    rows.coalesce(1).write.mode("overwrite").json(path)
