"""WARC archives with revisit records, and a two-level capture index over them.

Archives: each write task makes one .warc.gz of gzip members, one per record, so any record can be read by itself from
(file, offset, length). Of captures with equal payloads the one with the smallest page_id is a response; the others
are revisit records that name it and carry no payload.

Index: one line per record, keyed by the URL with its host reversed (`org,example,www)/path`), then page_id. Lines are
range-partitioned and sorted by key, and every BLOCK_LINES of them are one compressed block of a shard file. The block
directory, one row per block with its first key, is sparse: it is a small table itself, sorted by shard. A lookup binary-searches
the directory for the block, the block for the line, and range-reads the record.

Roles are found from digests alone, by aggregation with salted keys, so a payload shared by a third of the pages
is no hot group. Reading back takes as many tasks as the archives' bytes ask for. A lost or repeated task leaves at most an archive that no index line names: files carry the task's
attempt, and only the lines of committed attempts enter the index.

Defined cases: null html is an empty payload, null url an empty URL (key `)`); empty payloads revisit each other as any;
rows that repeat a page_id: each has its record, and a response's page_id is the smallest with that payload; page_ids of
any type (the archive has them as strings); a row without page_id has a record without one, a revisit if a row with
one has the same payload and a response otherwise; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, new_folder, own_columns, ship

BLOCK_LINES = 3000
SALTS = 32
LEVEL = 4
#: Bytes of archives that a task reads back.
STRETCH = 64 << 20
LINE = "surt string, page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, file string, offset long, length long"
_COLUMNS = [c.strip().split(" ")[0] for c in LINE.split(",")]


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    local = re.sub("^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri if "://" in local else "file://" + local)


def surt(url: Column) -> Column:
    """Sort key: labels of the lower-cased host (without its port) reversed, `)`, then path and query."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)), r":\d*$", "")
    rest = F.regexp_extract(u, r"(?s)^(?:.*?://[^/?#]*)?([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _urn(page_id: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _one_line(x: str) -> str:
    return x.encode("unicode_escape").decode() if "\n" in x or "\r" in x else x


def _header(url: str, page_id: str | None, kind: str, digest: str, n: int, refers: str | None, length: int) -> bytes:
    own = _urn(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {_one_line(page_id)}")
    if refers is not None:
        lines += [f"WARC-Refers-To: {_urn(refers)}", f"X-Refers-To-Page: {_one_line(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html", f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One archive for this task; a batch of index lines for each batch of rows."""
        from pyspark import TaskContext

        fs, path = _fs(folder)
        out, name, at = None, "", 0
        for batch in batches:
            lines = []
            for page_id, url, html, key, sha, size, refers in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                if out is None:
                    fs.create_dir(path, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                kind = "response" if refers is None else "revisit"
                body = (html or "").encode() if refers is None else b""
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                record = z.compress(_header(url or "", page_id, kind, digest, size, refers, len(body)) + body + b"\r\n\r\n") + z.flush()
                out.write(record)
                lines.append((key, page_id, url or "", kind, digest, size, refers, name, at, len(record)))
                at += len(record)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines) if lines else [[]] * 10, [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()])], _COLUMNS)
        if out is not None:
            out.close()

    return run


def parse_record(raw: bytes) -> dict:
    """Headers and payload of one gzip member."""
    head, _, rest = zlib.decompress(raw, 31).partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    headers["payload"] = rest[: int(headers["Content-Length"])]
    return headers


def _reader(folder: str, payload: bool):
    """Records by (file, offset, length), in the order given, which is that of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        name, f = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    name, f = file, fs.open_input_file(f"{path}/{file}")
                h = parse_record(f.read_at(length, offset))
                digest, n, refers = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]), h.get("X-Refers-To-Page")
                if h["WARC-Type"] == "response" and (len(h["payload"]) != n or base64.b32encode(hashlib.sha1(h["payload"]).digest()).decode() != digest):
                    raise ValueError(f"payload of {h.get('X-Page-Id')} in {file} at {offset} doesn't match its digest")
                rows.append((h.get("X-Page-Id"), n, digest, h["WARC-Type"], refers, h["payload"].decode() if payload else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()])], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return run


def _shards(folder: str, block_lines: int):
    """Sorted lines of one key range to a file of compressed blocks; a directory row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        fs, path = _fs(folder)
        out, name, at = None, "", 0
        pending: list[list] = []
        made: list[tuple] = []

        def flush() -> None:
            nonlocal at, out, name
            if out is None:
                fs.create_dir(path, recursive=True)
                name = f"shard-{uuid.uuid4().hex}.cdx.gz"
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = z.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in pending).encode()) + z.flush()
            out.write(raw)
            made.append((pending[0][0], pending[0][1], pending[-1][0], len(pending), sum(x[9] for x in pending), name, at, len(raw)))
            at += len(raw)
            pending.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                pending.append(list(row))
                if len(pending) == block_lines:
                    flush()
        if pending:
            flush()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 8, [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], ["first", "first_page", "last", "n", "bytes", "file", "offset", "length"])

    return run


def read_block(folder: str, file: str, offset: int, length: int) -> list[list]:
    import json

    fs, path = _fs(folder)
    with fs.open_input_file(f"{path}/{file}") as f:
        text = zlib.decompress(f.read_at(length, offset), 31).decode()
    return [json.loads(x) for x in text.split("\n")]


def _blocks(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                lines = list(zip(*read_block(folder, file, offset, length)))
                yield pa.RecordBatch.from_arrays([pa.array(lines[7]), pa.array(lines[8], pa.int64()), pa.array(lines[9], pa.int64())], ["file", "offset", "length"])

    return run


ship(__name__)


class Archive:
    """Archives and index in one folder of the shared file system."""

    def __init__(self, spark: SparkSession, folder: str, page_type: str = "bigint"):
        self.spark, self.folder, self.page_type = spark, folder, page_type

    def directory(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/directory")

    def records(self, payload: bool = True) -> DataFrame:
        """All records (payload null unless asked for), by way of the index: every block is read, and archives are read front to back."""
        blocks = self.directory()
        size = blocks.agg(F.sum("bytes")).first()[0] or 0
        cores = self.spark.sparkContext.defaultParallelism
        lines = blocks.select("file", "offset", "length").repartition(cores).mapInArrow(_blocks(f"{self.folder}/index"), "file string, offset long, length long")
        # files, and stretches of large files, are spread over tasks, a number that isn't up to the lines' own size; each task reads its stretches in order
        stretch = min(STRETCH, max(1 << 20, -(-size // cores)))
        tasks = max(cores, -(-size // STRETCH))
        ordered = lines.repartition(tasks, "file", F.floor(F.col("offset") / stretch)).sortWithinPartitions("file", "offset")
        found = ordered.mapInArrow(_reader(f"{self.folder}/archives", payload), "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload string")
        return found.withColumn("page_id", F.col("page_id").cast(self.page_type)).withColumn("refers_to", F.col("refers_to").cast(self.page_type))

    def lookup(self, url: str) -> list[dict]:
        """Records of a URL: binary search of the directory (which a filter on its sorted keys prunes), then of the block, then range reads."""
        key = self.spark.range(1).select(surt(F.lit(url))).first()[0]
        fs, path = _fs(f"{self.folder}/archives")
        found = []
        for b in self.directory().filter((F.col("first") <= key) & (F.col("last") >= key)).toLocalIterator():
            lines = read_block(f"{self.folder}/index", b["file"], b["offset"], b["length"])
            keys = [x[0] for x in lines]
            for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                with fs.open_input_file(f"{path}/{x[7]}") as f:
                    found.append(parse_record(f.read_at(x[9], x[8])))
        return found


def write_archive(pages: DataFrame, folder: str | None = None, block_lines: int = BLOCK_LINES, shards: int | None = None) -> Archive:
    """Archives, index and directory of all rows of pages."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = own_columns(pages, "page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    html = F.coalesce("html", F.lit(""))
    digests = materialise(rows.select("page_id", F.sha1(F.encode(html, "UTF-8")).alias("sha")), "digests")
    salted = digests.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    partial = salted.groupBy("sha", "salt").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    least = partial.groupBy("sha").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).filter("n > 1 and least is not null").select("sha", "least", F.explode("salts").alias("salt"))
    roles = salted.join(least, ["sha", "salt"]).filter(F.col("page_id").isNull() | (F.col("least") < F.col("page_id"))).select(F.col("page_id").alias("id"), F.col("sha").alias("own"), F.col("least").cast("string").alias("refers_to")).distinct()
    # only pages that revisit have a role to be joined; the payload's hash is part of the key, as a page_id may be repeated
    keyed = rows.select("page_id", "url", "html", surt(F.col("url")).alias("surt"), F.sha1(F.encode(html, "UTF-8")).alias("sha"), F.octet_length(html).cast("long").alias("size"))
    keyed = keyed.join(roles, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("own")), "left")
    written = keyed.select(F.col("page_id").cast("string").alias("page_id"), "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "surt", "sha", "size", "refers_to").mapInArrow(_writer(f"{folder}/archives"), LINE)
    lines = materialise(written, "lines")
    ordered = lines.repartitionByRange(shards or max(1, spark.sparkContext.defaultParallelism), "surt", "page_id").sortWithinPartitions("surt", "page_id")
    directory = ordered.select(*_COLUMNS).mapInArrow(_shards(f"{folder}/index", block_lines), "first string, first_page string, last string, n long, bytes long, file string, offset long, length long")
    directory.write.parquet(f"{folder}/directory-unsorted")
    # the directory has a row for every BLOCK_LINES records; sorted, its own statistics prune it
    spark.read.parquet(f"{folder}/directory-unsorted").orderBy("first", "first_page").write.parquet(f"{folder}/directory")
    return Archive(spark, folder, kind)
