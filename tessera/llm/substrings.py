"""Substring dedup: relative Lempel-Ziv parsing of every document against all documents with smaller ids.

The references are cut into blocks, and each block goes into a hash index. Cuts depend on content only: every window
of WIDTH words has an anchor, the least of its GRAM-word hashes, and a block is a maximal run of windows with the
same anchor, stretched over all their words (at most 2 * WIDTH - GRAM words between cuts). A document's parse replaces
each block that the index holds for a smaller doc_id by a copy: a greedy factor is a run of such blocks, so all
windows inside factors are known from one entry per block (about one per 20 words), not one per word. Where a factor
ends, a window may straddle equal and unequal words. Its anchor then occurs in both documents, but in unequal blocks:
only such blocks, at factor boundaries, are opened, and their windows are compared one by one. So the result is exact
(factors() lists the parse itself, each factor with the document and place that it copies from):
a word goes if and only if a window of WIDTH words that covers it starts in a document with a smaller doc_id.

Documents with equal word sequences are parsed once; the others among them are one factor. All comparisons are
aggregations (minimum doc_id by hash, 64 bits) with map-side combining, so a passage that a third of all documents
share costs no more than any other; no pairs of documents are formed.

Defined cases: null and wordless texts have no words and lose none; texts shorter than WIDTH words lose none;
rows that share a doc_id don't count as smaller than each other; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as k
from .shared import materialise, own_columns, ship

WIDTH = 50
GRAM = 10
NOTHING = hashlib.sha256(b"").digest()
ship(k.__name__)
ship(__name__)


def _blocks(w: k.Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, one past the last window, anchor, hash of all words) of each block; windows stay within their texts."""
    grams, _ = w.windows(gram)
    least = k.sliding_min(grams, width - gram + 1)[: max(0, len(grams) - width + 1)]
    n = len(least)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    doc = w.doc()
    fits = doc[:n] == doc[width - 1 : width - 1 + n]
    cut = np.ones(n, bool)
    cut[1:] = (least[1:] != least[:-1]) | (doc[1:n] != doc[: n - 1]) | (fits[1:] != fits[:-1])
    start = np.flatnonzero(cut)
    stop = np.append(start[1:], n)
    start, stop = start[fits[start]], stop[fits[start]]
    p, inverse = k.powers(k._WORD_BASE, len(w.h))
    sums = np.zeros(len(w.h) + 1, np.uint64)
    np.cumsum(w.h * p[: len(w.h)], dtype=np.uint64, out=sums[1:])
    whole = k.mix((sums[stop + width - 1] - sums[start]) * inverse[start] + (stop - start).astype(np.uint64))
    return start, stop, least[start], whole


def _parse(width: int, gram: int):
    """Of each text: n_words, two hashes of its words, SHA-256 of its words joined, and its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in k.slices(batch.column(2)):
                w = k.Words(data, offsets, k.BLANK_WORDS)
                start, _, anchor, whole = _blocks(w, width, gram)
                doc = np.searchsorted(w.first, start, "right") - 1
                counts = np.bincount(doc, minlength=hi - lo)
                raw = data.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(w.n.astype(np.int64)), pa.array(k.signed(k.fold(w.h, w.first))), pa.array(k.signed(k.fold(k.mix(w.h ^ np.uint64(0x5DEECE66D)), w.first))), pa.array(sha, pa.binary()), k.lists(k.signed(anchor), counts), k.lists(k.signed(whole), counts)],
                    ["doc_id", "key", "n_words", "h1", "h2", "sha", "anchors", "blocks"],
                )

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list<int64> column; null counts as empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def _in_text(values: np.ndarray, doc: np.ndarray, listed: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of values (each in text doc) are among the values listed for that text."""
    if not len(listed) or not len(values):
        return np.zeros(len(values), bool)
    salt = lambda d: k.mix(d.astype(np.uint64) + np.uint64(1))
    keys = np.unique(k.mix(listed.view(np.uint64) ^ salt(owner)))
    x = k.mix(values.view(np.uint64) ^ salt(doc))
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x


def _open(width: int, gram: int):
    """Windows of the blocks listed in column `open`: the boundary check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, lengths = _flat(batch.column(3))
            edges = np.concatenate(([0], np.cumsum(lengths)))
            for lo, hi, data, offsets in k.slices(batch.column(2)):
                w = k.Words(data, offsets, k.BLANK_WORDS)
                start, stop, _, whole = _blocks(w, width, gram)
                doc = np.searchsorted(w.first, start, "right") - 1
                own = slice(edges[lo], edges[hi])
                yes = _in_text(whole, doc, listed[own], np.repeat(np.arange(hi - lo), lengths[lo:hi]))
                h, _ = w.windows(width)
                size = (stop - start)[yes]
                at = np.repeat(start[yes] - np.concatenate(([0], np.cumsum(size)[:-1])) if yes.any() else np.zeros(0, np.int64), size) + np.arange(size.sum())
                counts = np.bincount(doc[yes], weights=size, minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), k.lists(k.signed(h[at]), counts)], ["doc_id", "key", "windows"])

    return run


def _cut(width: int, gram: int, whole_texts: bool):
    """Texts without the words of the listed blocks and windows: how many are gone, the hash of what is left and, if asked for, that itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, n_blocks = _flat(batch.column(3))
            alone, n_alone = _flat(batch.column(4))
            eb, ea = np.concatenate(([0], np.cumsum(n_blocks))), np.concatenate(([0], np.cumsum(n_alone)))
            for lo, hi, data, offsets in k.slices(batch.column(2)):
                w = k.Words(data, offsets, k.BLANK_WORDS)
                start, stop, _, whole = _blocks(w, width, gram)
                doc = np.searchsorted(w.first, start, "right") - 1
                texts = np.arange(hi - lo)
                yes = _in_text(whole, doc, blocks[eb[lo] : eb[hi]], np.repeat(texts, n_blocks[lo:hi]))
                n = len(w.h)
                d = np.bincount(start[yes], minlength=n + 1) - np.bincount(stop[yes] + width - 1, minlength=n + 1)
                gone = np.cumsum(d[:n]) > 0
                h, fits = w.windows(width)
                at = np.flatnonzero(fits)
                wd = np.searchsorted(w.first, at, "right") - 1
                dup = at[_in_text(h[at], wd, alone[ea[lo] : ea[hi]], np.repeat(texts, n_alone[lo:hi]))]
                gone |= k.covered(n, dup, width)
                raw, sha, kept = data.tobytes(), [], []
                keep = ~gone
                s, e = w.starts.tolist(), w.ends.tolist()
                for i in range(hi - lo):
                    left = (np.flatnonzero(keep[w.first[i] : w.first[i + 1]]) + w.first[i]).tolist()
                    joined = b" ".join([raw[s[j] : e[j]] for j in left])
                    sha.append(hashlib.sha256(joined).digest())
                    if whole_texts:
                        kept.append(joined.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(k.sums_by_text(gone, w.first)), pa.array(sha, pa.binary()), *[pa.array(kept, pa.string())] * whole_texts], ["doc_id", "key", "n_removed", "sha", *["kept"] * whole_texts])

    return run


def _places(width: int, gram: int):
    """Of each text: its blocks' hashes, with the places of their first words and their numbers of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in k.slices(batch.column(2)):
                w = k.Words(data, offsets, k.BLANK_WORDS)
                start, stop, _, whole = _blocks(w, width, gram)
                doc = np.searchsorted(w.first, start, "right") - 1
                counts = np.bincount(doc, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), k.lists(k.signed(whole), counts), k.lists(start - w.first[doc], counts), k.lists(stop - start + width - 1, counts)], ["doc_id", "key", "blocks", "at", "words"])

    return run


def factors(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """The parse itself: doc_id, key, at, words, ref_doc, ref_at of every factor, a stretch of words of a document that is in the reference document too.

    Each block copies from its first place in the document with the smallest id; consecutive blocks that copy from
    consecutive places are one factor. Words of factors are all removed by repeated_words(), which also opens the
    blocks at their boundaries and so finds windows that straddle two blocks; a shared passage in which no whole block
    lies has such windows only, and no factor here.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = own_columns(docs, "doc_id", "text").filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), "text")
    found = materialise(text.mapInArrow(_places(width, gram), f"doc_id {kind}, key long, blocks array<long>, at array<long>, words array<long>"), "places")
    entries = found.select("doc_id", "key", F.posexplode(F.arrays_zip("blocks", "at", "words")).alias("i", "x")).select("doc_id", "key", "i", F.col("x.blocks").alias("block"), F.col("x.at").alias("at"), F.col("x.words").alias("words"))
    index = entries.groupBy("block").agg(F.min(F.struct("doc_id", "at")).alias("ref"), F.max("doc_id").alias("hi")).filter("ref.doc_id < hi").select("block", F.col("ref.doc_id").alias("ref_doc"), F.col("ref.at").alias("ref_at"))
    copied = entries.join(index, "block").filter("doc_id > ref_doc").distinct()
    # runs of neighbours: number in the document less number in the run's own order stays the same
    same = ["doc_id", "key", "ref_doc", "shift"]
    rows = copied.withColumn("shift", F.col("ref_at") - F.col("at"))
    rows = rows.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*same).orderBy("i")))
    by = rows.groupBy(*same, "run").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("words")).alias("stop"))
    return by.select("doc_id", "key", "at", (F.col("stop") - F.col("at")).alias("words"), "ref_doc", (F.col("at") + F.col("shift")).alias("ref_at"))


def repeated_words(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with texts=True also `kept`, the words left, joined by a space (null: all or none of them were left)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = own_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("key"), "text")
    head = f"doc_id {kind}, key long, "
    parsed = materialise(text.mapInArrow(_parse(width, gram), head + "n_words long, h1 long, h2 long, sha binary, anchors array<long>, blocks array<long>"), "parse")
    # texts that repeat a smaller document's whole word sequence
    first = parsed.filter(F.col("n_words") >= width).groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = materialise(parsed.select("doc_id", "key", "n_words", "h1", "h2", "sha").join(first, ["h1", "h2"], "left").select("doc_id", "key", "n_words", "sha", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)).alias("whole")), "rows")
    twins = rows.filter("whole").select("doc_id", "key").distinct()
    entries = parsed.select("doc_id", "key", F.explode(F.arrays_zip("anchors", "blocks")).alias("x")).select("doc_id", "key", F.col("x.anchors").alias("anchor"), F.col("x.blocks").alias("block"))
    index = entries.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("block").alias("b0"), F.max("block").alias("b1")).filter("lo < hi").select("anchor", "lo", (F.col("b0") != F.col("b1")).alias("edge"))
    shared = materialise(entries.join(index, "anchor"), "shared")
    by_block = shared.filter("edge").groupBy("anchor", "block").agg(F.min("doc_id").alias("lo_block"))
    marked = shared.filter("edge").drop("lo").join(by_block, ["anchor", "block"]).select("doc_id", "key", "block", (F.col("doc_id") > F.col("lo_block")).alias("copy"), F.lit(True).alias("edge"))
    marked = marked.unionByName(shared.filter("not edge").select("doc_id", "key", "block", (F.col("doc_id") > F.col("lo")).alias("copy"), F.lit(False).alias("edge"))).filter("copy or edge")
    lists = marked.groupBy("doc_id", "key").agg(F.collect_set(F.when(F.col("copy"), F.col("block"))).alias("copies"), F.collect_set(F.when(~F.col("copy"), F.col("block"))).alias("open")).join(twins, ["doc_id", "key"], "left_anti")
    needed = materialise(lists.join(text, ["doc_id", "key"]).select("doc_id", "key", "text", "copies", "open"), "needed")
    opened = needed.filter(F.size("open") > 0).select("doc_id", "key", "text", "open").mapInArrow(_open(width, gram), head + "windows array<long>")
    windows = materialise(opened.select("doc_id", "key", F.explode(F.array_distinct("windows")).alias("h")), "windows")
    least = windows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi")
    alone = windows.join(least, "h").filter("doc_id > lo").groupBy("doc_id", "key").agg(F.collect_set("h").alias("alone"))
    work = needed.drop("open").join(alone, ["doc_id", "key"], "left").filter(F.col("alone").isNotNull() | (F.size("copies") > 0))
    cut = work.select("doc_id", "key", "text", "copies", "alone").mapInArrow(_cut(width, gram, texts), head + "n_removed long, sha binary" + ", kept string" * texts)
    cut = cut.select("doc_id", "key", F.col("n_removed").alias("gone"), F.col("sha").alias("cut_sha"), *["kept"] * texts).dropDuplicates(["doc_id", "key"])
    out = rows.join(cut, ["doc_id", "key"], "left")
    sha = F.when(F.col("whole"), F.lit(NOTHING)).otherwise(F.coalesce("cut_sha", "sha"))
    return out.select("doc_id", "n_words", F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"), F.lower(F.hex(sha)).alias("kept_sha256"), *["kept"] * texts)
