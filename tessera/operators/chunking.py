"""Chunks of documents: fixed windows, boundary snapping, semantic packing, sentences. Offsets count characters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import HEADINGS
from ..functions.udfs import sentence_spans, ship, snapped

ship(__name__)

SIZE, OVERLAP, SLIVER = 500, 100, 50


def _number(chunks: DataFrame, strategy: str) -> DataFrame:
    """FLT14, WIN12: slivers take no index; ids are dense from 0."""
    body = chunks.filter(F.length(F.trim("text")) >= SLIVER)
    index = (F.row_number().over(Window.partitionBy("doc").orderBy("start", "end")) - 1).cast("int")
    return body.withColumn("chunk_index", index).withColumn("strategy", F.lit(strategy)).withColumn("chunk_id", F.concat_ws("::", F.col("doc").cast("string"), F.lit(strategy), F.lpad(F.col("chunk_index").cast("string"), 4, "0"))).withColumn("n_chars", F.length("text"))


def chunk_fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, snap: bool = False) -> DataFrame:
    """CHK2, CHK3: doc, chunk_id, chunk_index, start, end, text of windows of `size` characters that overlap; ends may snap to a boundary."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    n = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int") * step
    if snap:
        rows = _by_document(docs.filter(n > 0), _snapped_windows(size, step), [("start", T.IntegerType()), ("end", T.IntegerType()), ("done", T.BooleanType()), ("text", T.StringType())])
        # the reference loop stops at the first end that reaches the end of the text
        first = F.min(F.when(F.col("done"), F.col("start"))).over(Window.partitionBy("doc"))
        cut = rows.withColumn("first", first).filter(F.col("first").isNull() | (F.col("start") <= F.col("first"))).select("doc", "start", "end", "text")
        return _number(cut, "fixed").select("doc", "chunk_id", "chunk_index", "start", "end", "n_chars", "strategy", "text")
    rows = docs.filter(n > 0).select("doc", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), last, F.lit(step))).alias("start"))
    rows = rows.withColumn("end", F.least(F.col("start") + size, F.col("n")))
    cut = rows.select("doc", F.col("start").cast("int"), F.col("end").cast("int"), F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))
    return _number(cut, "fixed").select("doc", "chunk_id", "chunk_index", "start", "end", "n_chars", "strategy", "text")


#: Documents whose rows a Python worker makes at once.
AT_ONCE = 64


def _by_document(docs: DataFrame, make: Callable[[str], Iterable[tuple]], columns: list[tuple[str, T.DataType]]) -> DataFrame:
    """doc and the columns of the rows that `make` gives for a text: a few documents at a time, so that a worker's memory depends on these
    and not on how many lie in a batch; only the rows travel, not the text with each."""
    schema = T.StructType([docs.schema["doc"], *[T.StructField(c, k) for c, k in columns]])
    kinds = [to_arrow_type(k) for _, k in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                piece = batch.slice(i, AT_ONCE)
                found = [(n, *row) for n, text in enumerate(piece.column("text").to_pylist()) for row in make(text or "")]
                if found:
                    at, *values = zip(*found)
                    yield pa.RecordBatch.from_arrays([piece.column("doc").take(pa.array(at)), *[pa.array(v, k) for v, k in zip(values, kinds)]], names=schema.names)

    return docs.select("doc", "text").mapInArrow(run, schema)


def _snapped_windows(size: int, step: int) -> Callable[[str], Iterator[tuple[int, int, bool, str]]]:
    """CHK3: start, end, whether it ends the text, text of a document's windows, up to the first that does."""

    def windows(text: str) -> Iterator[tuple[int, int, bool, str]]:
        n = len(text)
        for start in range(0, max(0, -(-(n - size) // step)) * step + 1, step):
            end = snapped(text, min(start + size, n))
            yield start, end, end >= n, text[start:end]
            if end >= n:
                return

    return windows


def page_of(offset: Column, spans: Column) -> Column:
    """JOIN1: the page whose span holds the offset; else (between pages, past the end) the last page; else 1."""
    inside = F.filter(spans, lambda s: (s["start"] <= offset) & (offset < s["end"]))
    return F.coalesce(F.get(inside, F.lit(0))["page"], F.try_element_at(spans, F.lit(-1))["page"], F.lit(1))


_SENTENCE_ENDS = re.compile(r"(?<=[!?.])\s+")


def last_sentence(text: str, most: int = 250) -> str:
    """CHK5: the last sentence, its last `most` characters at most, not from within a word."""
    tail = _SENTENCE_ENDS.split(text.strip())[-1]
    if len(tail) > most:
        tail = tail[-most:]
        tail = tail[tail.find(" ") + 1 :]
    return tail


def _is_heading(line: str) -> bool:
    line = line.strip()
    if not 3 <= len(line) <= 70 or (line[-1] in ".,;:" and not line[0].isdigit()):
        return False
    bare = re.sub(r"^[0-9.]*[0-9][.]?\s+", "", line)
    return bare.lower().strip(" .:") in HEADINGS or (bare != line and bare[:1].isupper() and len(line.split()) <= 8)


def pack(text: str, size: int = 900, overlap: int = 100) -> Iterator[tuple[int, int, str, str]]:
    """CHK4: (start, end, section, text): paragraphs packed up to `size`; a heading closes the chunk and names the next; a longer paragraph is cut into fixed windows; the last sentence is carried over."""
    buffer: list[str] = []
    tail, section, start, at = "", "", 0, 0

    def close() -> Iterator[tuple[int, int, str, str]]:
        nonlocal buffer, tail
        body = "\n\n".join(([tail] if tail else []) + buffer)
        if buffer and body.strip():
            yield start, start + len(body), section, body
            tail = last_sentence(body)
        buffer = []

    for para in re.split(r"\n\s*\n", text):
        begin, at = text.find(para, at), at + len(para)
        body = para.strip()
        if not body:
            continue
        if _is_heading(body):
            yield from close()
            tail, section = "", body
        elif len(body) > size:
            yield from close()
            tail = ""
            for i in range(0, max(1, len(body) - overlap), size - overlap):
                yield begin + i, begin + min(i + size, len(body)), section, body[i : i + size]
        else:
            if buffer and len(tail) + sum(len(b) + 2 for b in buffer) + len(body) > size:
                yield from close()
            if not buffer:
                start = begin
            buffer.append(body)
    yield from close()


def chunk_semantic(docs: DataFrame, size: int = 900) -> DataFrame:
    """CHK4 for every document: a fold over its paragraphs, document by document in Arrow batches (no shuffle)."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, a, b, s, x) for d, t in zip(pdf["doc"], pdf["text"]) for a, b, s, x in pack(t or "", size)]
            yield pd.DataFrame(rows, columns=["doc", "start", "end", "section", "text"])

    return _number(docs.select("doc", "text").mapInPandas(run, f"doc {kind}, start int, end int, section string, text string"), "semantic").select("doc", "chunk_id", "chunk_index", "start", "end", "n_chars", "section", "strategy", "text")


def chunk_corpus(docs: DataFrame, strategy: str = "fixed") -> DataFrame:
    """CHK6."""
    return chunk_fixed(docs) if strategy == "fixed" else chunk_semantic(docs)


def _sentences(text: str) -> Iterator[tuple[int, int, int, str]]:
    for i, (a, b) in enumerate(sentence_spans(text)):
        yield i, a, b, text[a:b].strip()


def sentences(docs: DataFrame) -> DataFrame:
    """CHK7: doc, sent_index, start, end, sentence."""
    whole = T.IntegerType()
    return _by_document(docs.filter("text is not null"), _sentences, [("sent_index", whole), ("start", whole), ("end", whole), ("sentence", T.StringType())])
