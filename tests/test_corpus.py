import datetime

from pyspark.sql import functions as F

from tessera.operators import corpus
from tessera.sources import sinks, tables
from tessera.streaming import ingest

UPLOAD = "payload binary, original_name string, ord int"


def test_manifest_identity(spark, tmp_path):
    empty = spark.createDataFrame([], corpus.MANIFEST)
    ups = spark.createDataFrame([(b"one", "a b?.pdf", 0), (b"one", "other.pdf", 1), (b"two", "x/a b?.pdf", 2)], UPLOAD)
    first = corpus.add_documents(ups, empty)
    names = sorted(r["filename"] for r in first.collect())
    assert names == ["a b-2.pdf", "a b_.pdf"] or len(set(names)) == 2
    sinks.save_manifest(first, f"file://{tmp_path}/m")
    again = tables.manifest(spark, f"file://{tmp_path}/m")
    assert corpus.add_documents(ups, again).count() == 0 and tables.manifest(spark, f"file://{tmp_path}/none").count() == 0
    marked = corpus.mark_extractor(again, again.limit(1), "domain")
    assert corpus.pending(marked.withColumn("status", F.lit("processed")), "domain").count() == 1
    left = corpus.removed({"m": again}, again.limit(1))
    assert left["m"].count() == 1


def test_chats(spark):
    at = datetime.datetime(2024, 1, 1)
    rows = [("a", i, "user" if i % 2 else "assistant", f"message {i} " + "x" * 60, at + datetime.timedelta(minutes=i)) for i in range(10)] + [("b", 0, "system", "s", at)]
    m = spark.createDataFrame(rows, "chat_id string, turn int, role string, content string, ts timestamp")
    titles = {r["chat_id"]: r["title"] for r in corpus.chat_titles(m).collect()}
    assert titles["b"] == "New chat" and titles["a"].startswith("message 1") and titles["a"].endswith("...") and len(titles["a"]) == 51
    assert [r["turn"] for r in corpus.history(m).filter("chat_id = 'a'").orderBy("turn").collect()] == list(range(4, 10))
    assert [r["chat_id"] for r in corpus.chat_list(m).collect()] == ["a", "b"]
    assert corpus.append_message(m, spark.createDataFrame([("a", "user", "more", at)], "chat_id string, role string, content string, ts timestamp")).first()["turn"] == 10


def test_upserts_are_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    chunks = spark.createDataFrame([("a::0", "x", "a"), ("a::1", "y", "a"), ("b::0", "z", "b")], "chunk_id string, text string, source_file string")
    sinks.upsert_chunks(chunks, path)
    sinks.upsert_chunks(chunks, path)
    assert tables.index(spark, path).count() == 3
    sinks.upsert_chunks(chunks.filter("chunk_id = 'a::0'"), path)
    assert tables.index(spark, path).count() == 2
    assert sinks.delete_source(spark, path, "b") == 1 and spark.read.parquet(path).count() == 1


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "slow stars " * 100, "en", "s", 1), (2, None, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.ingest_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() == 3 and rows.select(F.size("vec")).first()[0] == 64


def test_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name, data in (("a.pdf", b"%PDF one\x0ctwo"), ("b.pdf", b"no"), ("c.txt", b"%PDF"), ("d.pdf", b"%PDF bad")):
        (tmp_path / "f" / name).write_bytes(data)

    def parse(raw):
        if b"bad" in raw:
            raise ValueError("unreadable")
        return raw.decode().split("\x0c")

    files = tables.corpus(spark, str(tmp_path / "f"))
    assert sorted(r["filename"] for r in files.collect()) == ["a.pdf", "d.pdf"]
    assert [(r["page"], r["text"]) for r in tables.pages_of_files(files, parse).orderBy("page").collect()] == [(1, "%PDF one"), (2, "two")]


def test_pending_extraction_resumes(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"Orion{i} outperforms Vega on the public benchmark of the year." if i != 3 else "Nothing.") for i in range(8)], "doc_id string, text string")
    manifest, triples = f"file://{tmp_path}/m", f"file://{tmp_path}/t"
    rows = docs.selectExpr("doc_id", "doc_id as filename", "doc_id as original_name", "doc_id as sha256", "1L as n_bytes", "1 as n_pages", "0 as n_chunks", "0 as n_triples", "cast(array() as array<string>) as extractors_run", "'pending' as status", "cast(null as string) as error", "timestamp'2024-01-01 00:00:00' as added_at")
    known = tables.manifest(spark, manifest)
    sinks.save_manifest(rows.select(*[F.col(f.name).cast(f.dataType) for f in known.schema]), manifest)

    def broken(sentences):
        raise RuntimeError("no such model")

    first = ingest.extract_pending(docs, manifest, triples, model=broken).collect()
    assert {r["status"] for r in first} == {"failed"} and "no such model" in first[0]["error"]
    done = {r["doc_id"]: r for r in ingest.extract_pending(docs, manifest, triples).collect()}
    assert {r["status"] for r in done.values()} == {"processed"} and {i: r["n_triples"] for i, r in done.items()} == {str(i): int(i != 3) for i in range(8)}
    assert {r["subject"] for r in tables.triples(spark, triples).collect()} == {f"Orion{i}" for i in range(8) if i != 3}
    again = ingest.extract_pending(docs.withColumn("text", F.lit("Lyra outperforms Vega on the public benchmark of the year.")), manifest, triples)
    assert again.filter("n_triples = 1").count() == 7 and tables.triples(spark, triples).filter("subject = 'Lyra'").count() == 0


def test_a_table_in_parts_is_one_file(spark, tmp_path):
    """Folders of parts count once, by their own name, and no file's whole content is read."""
    for name, data in (("a.parquet", b"PAR1 one"), ("b.parquet/part-0.parquet", b"PAR1 two"), ("b.parquet/part-1.parquet", b"PAR1"), ("c.parquet", b"no"), ("d.parquet/_SUCCESS", b"PAR1"), ("e.parquet/x.parquet", b"PA"), ("f.txt", b"PAR1")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert sorted(r["filename"] for r in tables.file_names(spark, str(tmp_path)).collect()) == ["a.parquet", "b.parquet"]


def test_one_key_with_most_rows_is_written_by_several_tasks(spark, tmp_path):
    """Neither a bucket nor a manifest is one task's work, and small ones stay one file."""
    path = tmp_path / "t"
    rows = spark.range(400_000).select(F.lit("big").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("subject"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        sinks.save_triples(rows.unionByName(spark.createDataFrame([("small", "x")], "doc_id string, subject string")), f"file://{path}")
        sinks.save_manifest(rows, f"file://{tmp_path}/m")
        sinks.save_manifest(rows.limit(3), f"file://{tmp_path}/n")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert max(len(list(b.glob("*.parquet"))) for b in path.glob("bucket=*")) > 1 and spark.read.parquet(f"file://{path}").count() == 400_001
    assert len(list((tmp_path / "m").glob("*.json"))) > 1 and len(list((tmp_path / "n").glob("*.json"))) == 1
