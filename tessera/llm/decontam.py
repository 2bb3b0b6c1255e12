"""Benchmark decontamination by winnowing.

A window is WIDTH consecutive words. Of the GRAM-word hashes in a window the least is its fingerprint, so two
equal windows have equal fingerprints and every shared span of WIDTH words is found; consecutive windows mostly
share theirs, which makes them few. Documents are scanned once: fingerprints that also occur in the benchmark
point to windows, whose full hashes are looked up in the benchmark's, and hits are extended over all their words.
An item of fewer words than WIDTH is one window, looked up by its own length, without winnowing.

The benchmark goes to the executors in blocks of about BLOCK_WINDOWS windows (some 24 bytes each), one scan of the
documents a block, and each block's hits are written out before the next block is collected: what is held by the driver
and broadcast at any time is one block, whatever the benchmark's size. Windows are compared by 64-bit hashes of their words.

Defined cases: null or wordless text has no words, no hits and no items; wordless items occur nowhere; repeated
rows are judged one by one; an item_id that occurs twice counts once; empty tables give no rows or no hits; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .shared import materialise, own_columns, ship

WIDTH = 13
GRAM = 5
BLOCK_WINDOWS = 2_000_000
ship(k.__name__)
ship(__name__)


def _item_windows(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in k.slices(batch.column(1)):
                w = k.Words(data, offsets, k.ALNUM_WORDS, lower=True)
                doc = w.doc()
                whole, fits = w.windows(width)
                grams, _ = w.windows(gram)
                least = k.sliding_min(grams, width - gram + 1)
                at = np.flatnonzero(fits)
                out = [(doc[at], np.full(len(at), width), whole[at], least[at])]
                short = np.flatnonzero((w.n > 0) & (w.n < width))
                for n in np.unique(w.n[short]):
                    own = short[w.n[short] == n]
                    h = w.windows(int(n))[0][w.first[own]]
                    out.append((own, np.full(len(own), n), h, np.zeros(len(own), np.uint64)))
                d, n, h, f = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(d)), pa.array(n.astype(np.int32)), pa.array(k.signed(h)), pa.array(k.signed(f))], ["item", "width", "h", "print"])

    return run


def _block_index(rows: pa.Table, width: int) -> dict:
    """The benchmark's windows by width as sorted hash arrays, with the items of each; and its sorted fingerprints."""
    index: dict = {"items": [], "by": {}}
    items = rows.column("item").to_pylist()
    names = sorted(set(items))
    number = {x: i for i, x in enumerate(names)}
    item = np.array([number[x] for x in items], np.int64)
    index["items"] = names
    widths, h, prints = (rows.column(c).to_numpy() for c in ("width", "h", "print"))
    h, prints = h.view(np.uint64), prints.view(np.uint64)
    for n in np.unique(widths):
        of = np.flatnonzero(widths == n)
        order = of[np.lexsort((item[of], h[of]))]
        keys, first = np.unique(h[order], return_index=True)
        index["by"][int(n)] = (keys, np.append(first, len(order)), item[order])
    index["prints"] = np.unique(prints[widths == width])
    return index


def _found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are in the sorted keys, and where."""
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return (keys[at] == x) if len(keys) else np.zeros(len(x), bool), at


def _scan(index, width: int, gram: int, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        names = pa.array(ix["items"], pa.string())
        for batch in batches:
            for lo, hi, data, offsets in k.slices(batch.column(2)):
                w = k.Words(data, offsets, k.ALNUM_WORDS, lower=True)
                hits: list[tuple[np.ndarray, int]] = []
                owner, which = [], []
                doc = w.doc()
                for n, (keys, first, item) in ix["by"].items():
                    if n == width:
                        grams, _ = w.windows(gram)
                        least = k.sliding_min(grams, width - gram + 1)
                        turn = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1]))) if len(least) else np.zeros(0, np.int64)
                        near = np.flatnonzero(np.repeat(_found(ix["prints"], least[turn])[0], np.diff(np.append(turn, len(least)))))
                        if not len(near):
                            continue
                        h, fits = w.windows(width)
                        near = near[fits[near]]
                    else:
                        h, fits = w.windows(n)
                        near = np.flatnonzero(fits)
                    yes, at = _found(keys, h[near])
                    near, at = near[yes], at[yes]
                    hits.append((near, n))
                    many = first[at + 1] - first[at]
                    owner.append(np.repeat(doc[near], many))
                    run_at = np.repeat(first[at] - np.concatenate(([0], np.cumsum(many)[:-1])) if len(at) else np.zeros(0, np.int64), many)
                    which.append(item[run_at + np.arange(many.sum())])
                cover = np.zeros(len(w.h), bool)
                for near, n in hits:
                    cover |= k.covered(len(w.h), near, n)
                pairs = np.unique(np.concatenate(owner).astype(np.int64) * (len(names) + 1) + np.concatenate(which)) if owner else np.zeros(0, np.int64)
                of, it = pairs // (len(names) + 1), pairs % (len(names) + 1)
                counts = np.bincount(of, minlength=hi - lo)
                items = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), names.take(pa.array(it)))
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(w.n.astype(np.int64)), pa.array(k.sums_by_text(cover, w.first)), items]
                out = ["doc_id", "key", "n_words", "n_hit", "items"]
                if spans:
                    at = np.flatnonzero(cover)
                    columns.append(k.lists(at - w.first[doc[at]], np.bincount(doc[at], minlength=hi - lo)))
                    out.append("at")
                yield pa.RecordBatch.from_arrays(columns, out)

    return run


def contaminated_words(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, gram: int = GRAM, block_windows: int = BLOCK_WINDOWS, spans: bool = False) -> DataFrame:
    """doc_id, key (hash of the text), n_words, n_hit, items (array of item ids as strings), and with spans=True also `at`, the hit words' places."""
    spark = docs.sparkSession
    items = own_columns(benchmark, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), "text").filter("item is not null")
    rows = materialise(items.mapInArrow(_item_windows(width, gram), "item string, width int, h long, print long"), "benchmark-windows")
    blocks = max(1, -(-rows.count() // block_windows))
    text = own_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, key long, n_words long, n_hit long, items array<string>"
    if blocks == 1:
        index = spark.sparkContext.broadcast(_block_index(rows.toArrow(), width))
        return text.mapInArrow(_scan(index, width, gram, spans), out + (", at array<long>" if spans else ""))
    hits = words = None
    for b in range(blocks):  # an item's windows are spread over blocks by their hashes
        index = spark.sparkContext.broadcast(_block_index(rows.filter(F.pmod(F.col("h"), F.lit(blocks)) == b).toArrow(), width))
        found = text.mapInArrow(_scan(index, width, gram, True), out + ", at array<long>")
        found = materialise(found if words is None else found.filter("n_hit > 0"), f"hits-{b}")
        index.destroy()
        if words is None:
            words = found.select("doc_id", "key", "n_words")
        found = found.filter("n_hit > 0").drop("n_words")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    none = F.array().cast("array<string>")
    got = words.alias("a").join(hits.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.key").eqNullSafe(F.col("b.key")), "left")
    at = F.coalesce(F.col("at"), F.array().cast("array<long>"))
    return got.select("a.doc_id", "a.key", "n_words", F.size(at).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), *[F.array_sort(at).alias("at")] * spans)
