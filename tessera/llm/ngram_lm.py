"""Modified Kneser-Ney models over byte n-grams, counted by Spark and kept in sorted hash arrays.

An n-gram is ORDER bytes of UTF-8 packed into a long, under a 20-bit group hash (a language, or nothing): 60 bits that
are their own collision-free hash. Counting is one scan: each task sorts and counts its n-grams, Spark adds up the
tasks' counts. Only the highest order is counted; the lower orders' continuation counts are numbers of distinct
n-grams one order up, so they are aggregations of that table. Smoothing is joins and aggregations of the tables, too.

The model is exported as arrays sorted by hash, in range shards of at most SHARD_ROWS entries, into the shared folder.
Scoring tasks look up the distinct n-grams of a batch, in order, by binary search. Where the folder is a local or
mounted path they map the shards into memory (pages of the file cache, not of the heap); from a remote store they
hold at most HELD_SHARDS shards at once and reread others when they are needed. Nothing of the model passes through
the driver but the list of shards.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .shared import materialise, new_folder, ship

ORDER = 5
PAD = 10  # a newline: texts begin as lines do
GRAM_BITS = 8 * ORDER
SHARD_ROWS = 4_000_000
#: Distinct n-grams that a counting task holds before it passes them on.
HELD = 2_000_000
#: Shards (48 MB each) that a scoring task holds at once where it can't map them.
HELD_SHARDS = 12


def group_code(col: Column) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(1 << 20))


def grams(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The packed n-gram that ends at each byte of each text; texts are preceded by ORDER - 1 pads."""
    n, texts = len(data), len(offsets) - 1
    padded = np.full(n + (ORDER - 1) * texts, PAD, np.uint8)
    keep = np.ones(len(padded), bool)
    begin = offsets[:-1] + (ORDER - 1) * np.arange(texts)
    keep[(begin[:, None] + np.arange(ORDER - 1)).ravel()] = False
    padded[keep] = data
    out = np.zeros(len(padded), np.uint64)
    for j in range(ORDER):
        out[j:] |= padded[: len(padded) - j].astype(np.uint64) << np.uint64(8 * j)
    out = out[keep]
    if group.any():
        out |= np.repeat(group.astype(np.uint64) << np.uint64(GRAM_BITS), np.diff(offsets))
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


Counted = Iterator[tuple[np.ndarray, np.ndarray]]


def counted_grams(batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray) -> Counted:
    """All n-grams under their text's group; the bits above them, if the group has any, become the tag."""
    yield np.unique(grams(data, offsets, batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)), return_counts=True)


def counter(keys: Callable[[pa.RecordBatch, int, int, np.ndarray, np.ndarray], Counted] = counted_grams):
    """Task: (..., text) rows to (tag, gram, n): counts of what `keys` gives for a run of texts, keys of 60 bits under tags of 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = _merge(held)
            for i in range(0, len(keys), 200_000):
                own = keys[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array((own >> np.uint64(60)).astype(np.int32)), pa.array(k.signed(own & np.uint64((1 << 60) - 1))), pa.array(counts[i : i + 200_000])], ["tag", "gram", "n"])

        for batch in batches:
            for lo, hi, data, offsets in k.slices(batch.column(batch.num_columns - 1)):
                for got in keys(batch, lo, hi, data, offsets):
                    held.append(got)
                    size += len(got[0])
                if size > HELD:
                    held[:] = [_merge(held)]
                    size = len(held[0][0])
                    if size > HELD * 2 // 3:
                        yield from out()
                        held, size = [], 0
        if held:
            yield from out()

    return run


def discounts(n: list[int]) -> list[float]:
    """d1, d2, d3 of counts of counts n1 to n4: what _discounts() does by group."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] and n[i] else 0.5 * i for i in (1, 2, 3)]
    return [min(max(x, 0.05), i - 0.05) for i, x in zip((1, 2, 3), d)]


def single_discounts(rows: DataFrame, *names: str) -> dict[str, list[float]]:
    """Discounts of each named column of counts, over all rows."""
    got = rows.agg(*[F.count_if(F.col(c) == i).alias(f"{c}_{i}") for c in names for i in (1, 2, 3, 4)]).first()
    return {c: discounts([got[f"{c}_{i}"] for i in (1, 2, 3, 4)]) for c in names}


def discount_of(n: Column, d: list[float]) -> Column:
    return F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _discounts(level: DataFrame) -> DataFrame:
    """grp, d1, d2, d3: the modified discounts of each group from its counts of counts."""
    n = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    d = [F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), i - (i + 1) * F.col("y") * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(0.5 * i) for i in (1, 2, 3)]
    return level.groupBy("grp").agg(*n).withColumn("y", y).select("grp", *[F.least(F.greatest(x, F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}") for i, x in zip((1, 2, 3), d)])


def _discount() -> Column:
    return F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))


def interpolate(level: DataFrame, lower: DataFrame | None, context: Column, suffix: Column, single: bool = False) -> DataFrame:
    """grp, gram, p: discounted relative frequency of each n-gram in its context, plus the context's freed mass by the lower order's probability.

    level: grp, gram, n (0 where only the lower order is wanted). lower: grp, gram, p; None stands for 1 / 256.
    single: all rows are of one group, whose discounts are three numbers on the driver.
    """
    level = level.withColumn("ctx", context).withColumn("suf", suffix)
    if single:
        d = single_discounts(level, "n")["n"]
        level = level.withColumns({f"d{i}": F.lit(x) for i, x in zip((1, 2, 3), d)})
    else:
        level = level.join(_discounts(level.filter("n > 0")), "grp", "left").na.fill({"d1": 0.5, "d2": 1.0, "d3": 1.5})
    mass = level.groupBy("grp", "ctx").agg(F.sum("n").alias("total"), F.sum(_discount()).alias("freed"))
    rows = level.join(mass, ["grp", "ctx"])
    if lower is None:
        rows = rows.withColumn("low", F.lit(1 / 256))
    else:
        rows = rows.join(lower.select("grp", F.col("gram").alias("suf"), F.col("p").alias("low")), ["grp", "suf"])
    p = F.when(F.col("total") > 0, (F.col("n") - _discount() + F.col("freed") * F.col("low")) / F.col("total")).otherwise(F.col("low"))
    return rows.select("grp", "gram", p.alias("p"))


def kneser_ney(counts: DataFrame, single: bool = False) -> DataFrame:
    """grp, gram, p of every n-gram in counts (gram: with its group's bits, n: 0 where only its probability is wanted). single: as in interpolate()."""
    low = F.lit((1 << GRAM_BITS) - 1)
    levels = [counts.select(F.shiftright("gram", GRAM_BITS).alias("grp"), F.col("gram").bitwiseAND(low).alias("gram"), "n")]
    for order in range(ORDER - 1, 0, -1):
        levels.append(materialise(levels[-1].groupBy("grp", F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")).agg(F.count_if(F.col("n") > 0).alias("n")), f"level{order}"))
    p = None
    for order, level in zip(range(1, ORDER + 1), reversed(levels)):
        p = materialise(interpolate(level, p, F.shiftright("gram", 8), F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1)), single), f"p{order}")
    return p


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    local = re.sub("^file:/+", "/", uri)
    return pafs.FileSystem.from_uri(uri if "://" in local else "file://" + local)


def _save(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        keys, values = (np.concatenate(x) for x in zip(*parts))
        fs, path = _fs(folder)
        fs.create_dir(path, recursive=True)
        name = uuid.uuid4().hex
        for what, x in (("keys", keys), ("values", values)):
            raw = io.BytesIO()
            np.save(raw, x)
            with fs.open_output_stream(f"{path}/{name}-{what}.npy", compression=None) as f:
                f.write(raw.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([int(keys[0])], pa.int64()), pa.array([name])], ["first", "name"])

    return run


def save_arrays(table: DataFrame, name: str) -> tuple[str, list[tuple[int, str]]]:
    """Write (key long, value float) sorted by key; returns the folder and its shards' first keys and names."""
    folder = new_folder(table.sparkSession, name)
    table = materialise(table.select(F.col("key").cast("long"), F.col("value").cast("float")), f"{name}-table")
    shards = max(1, -(-table.count() // SHARD_ROWS))
    made = table.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(_save(folder), "first long, name string")
    return folder, sorted((r["first"], r["name"]) for r in made.collect())


class Arrays:
    """Worker side of save_arrays()."""

    def __init__(self, folder: str, shards: list[tuple[int, str]]):
        self.fs, self.path = _fs(folder)
        self.first = np.array([f for f, _ in shards], np.int64)
        self.names = [n for _, n in shards]
        self.mapped = isinstance(self.fs, pafs.LocalFileSystem)
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _load(self, path: str) -> np.ndarray:
        if self.mapped:
            return np.load(path, mmap_mode="r")
        with self.fs.open_input_file(path) as f:
            return np.load(io.BytesIO(f.read()))

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        got = self.held.pop(i, None)
        if got is None:
            if not self.mapped and len(self.held) >= HELD_SHARDS:
                self.held.pop(next(iter(self.held)))  # the one used longest ago
            got = tuple(self._load(f"{self.path}/{self.names[i]}-{what}.npy") for what in ("keys", "values"))
        self.held[i] = got
        return got

    def get(self, x: np.ndarray, default: float) -> np.ndarray:
        """Values of the keys x (non-negative longs)."""
        distinct, back = np.unique(x, return_inverse=True)
        return self.of(distinct, default)[back]

    def of(self, distinct: np.ndarray, default: float) -> np.ndarray:
        """Values of sorted distinct keys."""
        out = np.full(len(distinct), default, np.float32)
        if not self.names or not len(distinct):
            return out
        edge = np.append(np.searchsorted(distinct, self.first[1:]), len(distinct))
        lo = int(np.searchsorted(distinct, self.first[0]))
        for i, hi in enumerate(edge.tolist()):
            if hi > lo:
                keys, values = self.shard(i)
                own = distinct[lo:hi]
                at = np.searchsorted(keys, own)
                at[at == len(keys)] = 0
                out[lo:hi] = np.where(keys[at] == own, values[at], np.float32(default))
            lo = max(lo, hi)
        return out


_opened: dict[str, Arrays] = k.Cache()


def opened(folder: str, shards: list[tuple[int, str]]) -> Arrays:
    if folder not in _opened:
        if len(_opened) > 1:
            _opened.clear()
        _opened[folder] = Arrays(folder, shards)
    return _opened[folder]


ship(__name__)
ship(k.__name__)
