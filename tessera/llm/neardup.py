"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

A text's signature has COMPONENTS minimum hashes of its shingles, LANE bits of each. It is split into CHUNKS chunks
of four components. Two signatures that differ in at most 2 * CHUNKS - 1 components have, by pigeonhole, a chunk in
which at most one differs; so each chunk is entered under its four keys that leave one component out (the allowed
chunk errors, enumerated), and every pair within that signature distance meets under some key. For texts of Jaccard
similarity 0.85 (0.8) the probability to meet under no key is 2e-8 (1e-6). Every pair that meets and whose sizes allow
the threshold is then settled on the full shingle sets, by 64-bit hashes of all shingles: no pair is dropped by
its signatures.

Equal shingle sets form one node, under a number of its own. Candidates under one key are not paired with each other,
as their pairs grow with the square of a family of texts that resemble each other. Each is tied to the smallest node
among those of its key and bucket of sizes, and these to that of the next bucket; the components of these ties, the
families, hold all pairs that meet and whose sizes allow the threshold. All sets of a family, in blocks, are compared
with each other in memory by products of matrices, and only one row per set and block comes back: a set that its links
lead to, and how many links it has there. So classes and counts of links are those of all pairs of a family.

Defined cases: null, empty and wordless texts have the empty set and are linked with nothing; a text of fewer words
than a shingle has its whole word sequence as its one shingle; repeated rows are in one class; rows that share a doc_id
but not a text are judged each by its text; ids of any type; rows without doc_id are linked as others are, and kept if
no row of their class has one; an empty table gives no rows; other columns are ignored. Component ids are the smallest
doc_id of the class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from .graph import components
from .shared import materialise, own_columns, ship

CHUNKS = 8
PER_CHUNK = 4
LANE = 16
COMPONENTS = CHUNKS * PER_CHUNK
#: Shingles (8 bytes each) and sets in a block of sets to be compared.
BLOCK = 500_000
ROWS = 2000
#: Cells of a matrix at most. A hash is dense if it is in more than one of SPARSE pairs of sets.
CELLS = 1 << 21
SPARSE = 256
#: Parts of a set in its group: of the first or second block of two, of one compared with itself, of small families.
FIRST, SECOND, BOTH, PACKED = range(4)
_seed = np.random.default_rng(811)
XOR = _seed.integers(0, 2**63, COMPONENTS, dtype=np.uint64)
ODD = _seed.integers(0, 2**63, COMPONENTS, dtype=np.uint64) | np.uint64(1)
SIGNATURE = [f"s{i}" for i in range(CHUNKS)]
ship(k.__name__)
ship(__name__)


def _shingles(w: k.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles (with repeats), and where each text's begin; a short text has one."""
    h, fits = w.windows(width)
    n = np.where(w.n == 0, 0, np.maximum(w.n - width + 1, 1))
    first = np.concatenate(([0], np.cumsum(n)))
    short = np.flatnonzero((w.n > 0) & (w.n < width))
    at = np.flatnonzero(fits)
    out = np.zeros(first[-1], np.uint64)
    place = np.ones(first[-1], bool)
    place[first[short]] = False
    out[place] = h[at]
    if len(short):
        out[first[short]] = k.fold(w.h, w.first)[short]
    return out, first


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in k.slices(batch.column(2)):
                w = k.Words(data, offsets, k.BLANK_WORDS, lower=True)
                h, first = _shingles(w, width)
                n = np.diff(first)
                full = np.flatnonzero(n)
                signature = np.zeros((hi - lo, COMPONENTS), np.uint64)
                distinct, h1, h2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                if len(full):
                    at = first[:-1][full]
                    for c in range(COMPONENTS):
                        signature[full, c] = np.minimum.reduceat((h ^ XOR[c]) * ODD[c], at)
                    for i in full.tolist():
                        own = np.sort(h[first[i] : first[i + 1]])
                        own = own[np.concatenate(([True], own[1:] != own[:-1]))]
                        distinct[i] = len(own)
                        h1[i] = own.sum(dtype=np.uint64)
                        h2[i] = k.mix(own ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
                lanes = (k.mix(signature) & np.uint64(0xFFFF)).reshape(hi - lo, CHUNKS, PER_CHUNK)
                packed = lanes[:, :, 0] | lanes[:, :, 1] << np.uint64(16) | lanes[:, :, 2] << np.uint64(32) | lanes[:, :, 3] << np.uint64(48)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(distinct), pa.array(k.signed(h1)), pa.array(k.signed(h2)), *[pa.array(k.signed(np.ascontiguousarray(packed[:, c]))) for c in range(CHUNKS)]],
                    ["doc_id", "key", "n", "h1", "h2", *SIGNATURE],
                )

    return run


def _sets(width: int):
    """Distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in k.slices(batch.column(3)):
                w = k.Words(data, offsets, k.BLANK_WORDS, lower=True)
                h, first = _shingles(w, width)
                own = [np.unique(h[first[i] : first[i + 1]]) for i in range(hi - lo)]
                values = np.concatenate(own) if own else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in range(3)], k.lists(k.signed(values), np.array([len(x) for x in own]))], ["id", "family", "codes", "hashes"])

    return run


def _common(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, rows: int, columns: int, itself: bool) -> np.ndarray:
    """How many hashes each set of a shares with each set of b; of_a and of_b say of which set a hash is.

    Hashes of few sets are counted pair by pair, those of many as a product of matrices; both are exact.
    """
    u, t = np.unique(np.concatenate((a, b)), return_inverse=True)
    ta, tb = t[: len(a)], t[len(a) :]
    in_a, in_b = np.bincount(ta, minlength=len(u)), np.bincount(tb, minlength=len(u))
    useful = in_a > 1 if itself else (in_a > 0) & (in_b > 0)
    dense = useful & (in_a * in_b * SPARSE > rows * columns)
    met = np.zeros((rows, columns), np.int64)
    number = np.cumsum(dense) - 1
    sides = []
    for of, at in ((of_a, ta), (of_b, tb)):
        own = np.flatnonzero(dense[at])
        own = own[np.argsort(number[at[own]], kind="stable")]
        sides.append((of[own], number[at[own]]))
    wanted = int(dense.sum())
    width = max(1, min(wanted, CELLS // max(rows, columns)))
    for lo in range(0, wanted, width):
        x, y = (np.zeros((n, width), np.float32) for n in (rows, columns))
        for m, (of, at) in zip((x, y), sides):
            i, j = np.searchsorted(at, (lo, lo + width))
            m[of[i:j], at[i:j] - lo] = 1
        met += (x @ y.T).astype(np.int64)  # whole numbers up to CELLS, which single precision holds
    few = useful & ~dense
    number = np.cumsum(few) - 1
    own = np.flatnonzero(few[tb])
    partners = of_b[own[np.argsort(tb[own], kind="stable")]]
    n = in_b[few]
    first = np.cumsum(n) - n
    own = np.flatnonzero(few[ta])
    at, of = number[ta[own]], of_a[own]
    total = np.cumsum(n[at])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CELLS)))
        times = n[at[lo:hi]]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        met += np.bincount(np.repeat(of[lo:hi] * columns, times) + partners[np.repeat(first[at[lo:hi]], times) + step], minlength=rows * columns).reshape(rows, columns)
        lo = hi
    return met


def _trees(good: np.ndarray, itself: bool) -> tuple[np.ndarray, np.ndarray]:
    """The row from which each row, and each column, is reached by links; -1 without any."""
    left, right = np.full(good.shape[0], -1), np.full(good.shape[1], -1)
    for i in np.flatnonzero(good.any(axis=1)).tolist():
        rows = np.array([i] if left[i] < 0 else [], np.int64)
        while len(rows):
            left[rows] = i
            columns = np.flatnonzero(good[rows].any(axis=0) & (right < 0))
            right[columns] = i
            rows = columns[left[columns] < 0] if itself else np.flatnonzero(good[:, columns].any(axis=1) & (left < 0))
    return left, right


def _linked(percent: int):
    """Of a group's sets, those that reach the threshold with another: b, a set a that links of this group lead to, and n, how many links it has here."""

    def run(group: pa.Table) -> pa.Table:
        hashes = group.column("hashes").combine_chunks()
        values, edge = hashes.values.to_numpy(), hashes.offsets.to_numpy()
        ids, part, family = (group.column(c).to_numpy() for c in ("id", "part", "family"))
        order = np.argsort(family, kind="stable")
        turn = np.flatnonzero(np.concatenate(([True], family[order][1:] != family[order][:-1])))
        out = [(np.zeros(0, np.int64),) * 3]
        for own in np.split(order, turn[1:]):
            a, b = own[part[own] != SECOND], own[part[own] != FIRST]
            itself = len(a) == len(own) == len(b)
            if not len(a) or not len(b) or itself and len(own) < 2:
                continue
            size_a, size_b = edge[a + 1] - edge[a], edge[b + 1] - edge[b]
            shown = [np.concatenate([values[edge[i] : edge[i + 1]] for i in x]) for x in (a, b)]
            met = _common(*shown, np.repeat(np.arange(len(a)), size_a), np.repeat(np.arange(len(b)), size_b), len(a), len(b), itself)
            good = met * (100 + percent) >= percent * (size_a[:, None].astype(np.int64) + size_b)
            if itself:
                np.fill_diagonal(good, False)
            left, right = _trees(good, itself)
            for x, tree, n in ((a, left, good.sum(axis=1)), *([] if itself else [(b, right, good.sum(axis=0))])):
                has = np.flatnonzero(tree >= 0)
                out.append((ids[a[tree[has]]], ids[x[has]], n[has]))
        return pa.table({c: pa.array(np.concatenate(x).astype(np.int64)) for c, x in zip("abn", zip(*out))})

    return run


def _families(entered: DataFrame) -> DataFrame:
    """id, component: nodes that share a key, and whose sizes are in the same or in neighbouring buckets, are in one."""
    several = entered.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).filter("lead < last").select("key")
    members = materialise(entered.join(several, "key"), "members")
    leads = members.groupBy("key", "bucket").agg(F.min("id").alias("lead"))
    inside = members.join(leads, ["key", "bucket"]).filter("lead <> id").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    beside = leads.withColumnRenamed("lead", "a").join(leads.select("key", (F.col("bucket") - 1).alias("bucket"), F.col("lead").alias("b")), ["key", "bucket"]).select("a", "b")
    return components(inside.unionByName(beside).distinct())


def _places(families: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, family, codes: the groups in which a node's set is compared, and its part there, as one number each.

    Small families share a group. The members of a larger one are dealt, by buckets of size, into blocks of about BLOCK
    shingles and ROWS members, and each two blocks of the same or of neighbouring buckets are a group: so a set travels
    once per block that its size can be linked with, and no pair does.
    """
    member = materialise(families.join(sizes, "id"), "families")
    whole = member.groupBy("component").agg(F.sum("n").alias("w"), ((F.sum("n") > BLOCK) | (F.count("*") > ROWS)).alias("large"))
    small = whole.filter("not large").agg(F.sum("w")).first()[0] or 0
    member = member.join(whole.drop("w"), "component")
    pack = F.pmod(F.xxhash64("component"), F.lit(max(1, int(small // BLOCK))))
    packed = member.filter("not large").select("id", F.col("component").alias("family"), F.array(pack * 4 + PACKED).alias("codes"))
    large = member.filter("large")
    dealt = large.groupBy("component", "bucket").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / ROWS)).cast("int").alias("blocks"))
    block = dealt.select("component", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    other = block.select("component", F.col("bucket").alias("to_bucket"), F.col("block").alias("to_block"))
    met = block.join(other, "component").filter("bucket = to_bucket and block <= to_block or bucket + 1 = to_bucket")
    met = materialise(met.withColumn("g", F.monotonically_increasing_id()), "blocks")
    same = (F.col("bucket") == F.col("to_bucket")) & (F.col("block") == F.col("to_block"))
    parts = met.select("component", "bucket", "block", (F.col("g") * 4 + F.when(same, BOTH).otherwise(FIRST)).alias("code"))
    parts = parts.unionByName(met.filter(~same).select("component", F.col("to_bucket").alias("bucket"), F.col("to_block").alias("block"), (F.col("g") * 4 + SECOND).alias("code")))
    large = large.join(dealt, ["component", "bucket"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    large = large.join(parts, ["component", "bucket", "block"]).groupBy("id", F.col("component").alias("family")).agg(F.collect_list("code").alias("codes"))
    return packed.unionByName(large)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, class (null for the empty set), component_id, kept and n_links (the row's set's links to others, if they are to be counted) of every row."""
    texts = own_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"{s} long" for s in SIGNATURE)
    signed = materialise(texts.mapInArrow(_sign(width), f"doc_id {kind}, key long, n long, h1 long, h2 long, {columns}"), "signatures")
    # equal sets are one node; the numbers are kept by writing them out
    nodes = signed.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "key")).alias("rep"), *[F.first(s).alias(s) for s in SIGNATURE])
    # sizes that the threshold allows to be linked are in the same bucket or in neighbouring ones; a little wider, for rounding
    bucket = F.floor(F.log("n") / (math.log(100 / percent) * 1.001 + 0.001)).cast("int")
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()).withColumn("bucket", bucket), "nodes")
    masks = [~(0xFFFF << (16 * lane)) & ((1 << 64) - 1) for lane in range(PER_CHUNK)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(c * PER_CHUNK + lane), F.col(s).bitwiseAND(F.lit(m))) for c, s in enumerate(SIGNATURE) for lane, m in enumerate(masks)])
    families = _families(nodes.select("id", "bucket", F.explode(keys).alias("key")))
    places = _places(families, nodes.select("id", "n", "bucket"))
    # the sets of all that share a key with another: the only time that texts are shuffled
    named = lambda d: F.coalesce(F.col(d).cast("string"), F.lit("")).alias("d")  # noqa: E731  a set is its text's, whichever id '' stands for
    own = places.join(nodes.select("id", "rep.doc_id", "rep.key"), "id").select(named("doc_id"), "key", "id", "family", "codes")
    # repeated rows go where the join has brought them together
    own = own.join(texts.select(named("doc_id"), "key", "text"), ["d", "key"]).dropDuplicates(["d", "key"]).select("id", "family", "codes", "text")
    sets = own.mapInArrow(_sets(width), "id long, family long, codes array<long>, hashes array<long>").select("id", "family", "hashes", F.explode("codes").alias("code"))
    part, g = F.col("code").bitwiseAND(3), F.shiftright("code", 2)
    sent = sets.select(F.when(part == PACKED, -1 - g).otherwise(g).alias("g"), part.cast("int").alias("part"), "id", "family", "hashes")
    links = materialise(sent.groupBy("g").applyInArrow(_linked(percent), "a long, b long, n long"), "links")
    final = components(links.filter("a <> b").select("a", "b"))
    named = final.join(nodes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("first"))
    node_of = nodes.select("n", "h1", "h2", "id", "least").join(final, "id", "left").join(named, "component", "left")
    rows = signed.select("doc_id", "key", "n", "h1", "h2").join(node_of, ["n", "h1", "h2"], "left")
    component = F.coalesce("first", "least", "doc_id")
    columns = ["doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("class"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept")]
    if not count_links:
        return rows.select(*columns)
    degree = links.groupBy(F.col("b").alias("id")).agg(F.sum("n").alias("links"))
    return rows.join(degree, "id", "left").select(*columns, F.coalesce("links", F.lit(0)).alias("n_links"))
