"""The collection's manifest and chats, as tables: identity by content, set-wise updates, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t

MANIFEST = "doc_id string, filename string, original_name string, sha256 string, n_bytes bigint, n_pages int, n_chunks int, n_triples int, extractors_run array<string>, status string, error string, added_at timestamp"


def identified(uploads: DataFrame) -> DataFrame:
    """WSP1, WSP5, DED5: doc_id (first 12 hex digits of the payload's SHA-256), sha256, n_bytes of uploads (payload, original_name, ord); equal bytes once, the first."""
    sha = F.sha2("payload", 256)
    rows = uploads.withColumn("sha256", sha)
    first = rows.groupBy("sha256").agg(F.min("ord").alias("ord"))
    return rows.join(first, ["sha256", "ord"], "left_semi").select(F.substring("sha256", 1, 12).alias("doc_id"), "sha256", "original_name", F.octet_length("payload").cast("long").alias("n_bytes"), "ord")


def with_filenames(new: DataFrame, manifest: DataFrame) -> DataFrame:
    """WSP1, WSP2: safe filenames; taken ones get -2, -3, ... in order of arrival."""
    named = new.withColumn("base", t.safe_filename(F.col("original_name")))
    taken = manifest.select(F.regexp_replace("filename", r"(-[0-9]+)?\.pdf$", ".pdf").alias("base")).groupBy("base").agg(F.count("*").alias("taken"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("ord")) + F.coalesce("taken", F.lit(0))
    numbered = named.join(taken, "base", "left").withColumn("n", n)
    name = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat(F.regexp_replace("base", r"(?i)\.pdf$", ""), F.lit("-"), F.col("n").cast("string"), F.lit(".pdf")))
    return numbered.withColumn("filename", name).drop("base", "taken", "n")


def add_documents(uploads: DataFrame, manifest: DataFrame) -> DataFrame:
    """WSP1, JOIN14: manifest rows of uploads whose bytes it doesn't have yet."""
    fresh = identified(uploads).join(manifest.select("doc_id"), "doc_id", "left_anti")
    zero = lambda name: F.lit(0).alias(name)
    return with_filenames(fresh, manifest).select("doc_id", "filename", "original_name", "sha256", "n_bytes", zero("n_pages"), zero("n_chunks"), zero("n_triples"), F.array().cast("array<string>").alias("extractors_run"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("added_at"))


def pending(manifest: DataFrame, extractor: str | None = None) -> DataFrame:
    """FLT17: not processed, or processed without the extractor."""
    open_ = F.col("status") != "processed"
    return manifest.filter(open_ if extractor is None else open_ | ~F.array_contains("extractors_run", extractor))


def mark_extractor(manifest: DataFrame, doc_ids: DataFrame, extractor: str) -> DataFrame:
    """WSP3: set semantics."""
    hit = doc_ids.select("doc_id", F.lit(True).alias("hit")).distinct()
    return manifest.join(hit, "doc_id", "left").withColumn("extractors_run", F.when(F.col("hit"), F.array_sort(F.array_union("extractors_run", F.array(F.lit(extractor))))).otherwise(F.col("extractors_run"))).drop("hit")


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """AGG10."""
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_pages", "n_chunks", "n_triples")]
    return manifest.agg(F.count("*").alias("n_docs"), *total, F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "pending").alias("n_pending"))


def removed(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """WSP4: every table without the documents."""
    return {name: df.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti") for name, df in tables.items()}


def reconcile(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """SRC5: files (filename, payload, original_name, ord) that the manifest knows neither by name nor by content."""
    unknown = found.join(manifest.select("filename"), "filename", "left_anti")
    return add_documents(unknown, manifest)


def chat_titles(messages: DataFrame, most: int = 48) -> DataFrame:
    """CHT2: chat_id, title: the first user message, cut."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn")))
    cut = F.when(F.length("f") > most, F.concat(F.rtrim(F.substring("f", 1, most)), F.lit("..."))).otherwise(F.col("f"))
    return messages.groupBy("chat_id").agg(first.alias("f")).select("chat_id", F.coalesce(cut, F.lit("New chat")).alias("title"))


def history(messages: DataFrame, last: int = 6) -> DataFrame:
    """WIN8, CHT3: the last turns of each chat, in order; only role and content."""
    n = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("turn")))
    return messages.withColumn("n", n).filter(F.col("n") <= last).select("chat_id", "turn", "role", "content")


def chat_list(messages: DataFrame) -> DataFrame:
    """CHT1, SRT1: chats by their last message, latest first."""
    by = messages.groupBy("chat_id").agg(F.count("*").alias("n_messages"), F.max("ts").alias("updated_at"), F.min("ts").alias("created_at"))
    return by.join(chat_titles(messages), "chat_id").orderBy(F.desc("updated_at"), "chat_id")


def append_message(messages: DataFrame, new: DataFrame) -> DataFrame:
    """CHT2: new messages (chat_id, role, content, ts) get the turns after the chat's last."""
    last = messages.groupBy("chat_id").agg(F.max("turn").alias("last"))
    turn = F.row_number().over(Window.partitionBy("chat_id").orderBy("ts")) + F.coalesce("last", F.lit(-1))
    return new.join(last, "chat_id", "left").withColumn("turn", turn.cast("int")).select("chat_id", "turn", "role", "content", "ts")


def merged_timings(left: Column, right: Column) -> Column:
    """TIM1: two maps in one; on equal keys the right one wins."""
    keep = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(keep, right)
