"""Toxicity by class-conditional Kneser-Ney models.

One scan counts the words and the byte n-grams of all texts, and those of labelled texts also by class, each once a
text, so that no text that repeats itself speaks for many. The whole corpus gives one modified Kneser-Ney model, the
shared backoff; each class's model discounts its own counts and gives the freed mass to the shared model, so an
expression that a class has seen rarely or never keeps the odds of the language at large. Evidence is the difference
of the log-likelihoods (bits) under both class models, shrunk by how surely the classes differ: that of a word where it
is sure, else that of its byte n-grams, the rest taken from the next shorter n-gram; what a text repeats counts once.
A text has two length-normalised statistics: the mean of its bytes' evidence, and the largest mean over PASSAGE
consecutive bytes, by which a few words stand out of a text of any length. A logistic curve, fitted on labelled texts
that the counts have not seen, turns both into a score.

Labels are a sample of at most LABELS rows, those with the least hashes of their ids; every fifth of them (by crc32)
is held back from the counts to fit the curve. Everything else, counts of the shared model included, covers all rows.

Defined cases: null or empty text has statistics 0, hence the score of a text without evidence; texts without a label
or with a null label or doc_id only count for the shared model; an id labelled twice is toxic if any label says so;
without labels of both classes all scores are 0; ids of any type; repeated rows are scored one by one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from . import ngram_lm as lm
from .shared import materialise, own_columns, ship

#: Most labels learnt from (16 bytes each in the broadcast).
LABELS = 500_000
#: A log-ratio is shrunk by 1 - (KAPPA / its standard score) ** 2, to nothing below KAPPA: chance differences of the
#: many ordinary n-grams would else outweigh the few telling ones of a long text.
KAPPA = 5.0
#: The same for words, which are fewer; words that keep less than half of their log-ratio leave the decision to their bytes.
WORD_KAPPA = 3.0
LEAST_SURE = 0.5
#: Orders (bytes) of n-grams whose class ratios are used, the longest that is sure first.
ORDERS = (5, 4, 3)
#: Bytes of the passages whose evidence is compared.
PASSAGE = 48


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def _id_hash(doc_id: Column) -> Column:
    """Null for null: ids of any type are matched by hash."""
    return F.when(doc_id.isNotNull(), F.xxhash64(doc_id.cast("string")))


def _tagger(known):
    """Class tags of rows by their id's hash: 0 unlabelled, 1 ordinary, 2 toxic."""

    def tag(batch: pa.RecordBatch) -> np.ndarray:
        ids, labels = known.value
        x = batch.column(0)
        none = x.is_null().to_numpy(zero_copy_only=False)
        x = x.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(ids):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
        return np.where((ids[at] == x) & ~none, labels[at] + 1, 0)

    return tag


WORD_BITS = np.uint64((1 << 60) - 1)


def _keys(tag):
    """All byte n-grams under tag 0 and words under tag 4; those of labelled texts also under 1 or 2, and 5 or 6, once a text."""

    def keys(batch: pa.RecordBatch, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray) -> lm.Counted:
        g = lm.grams(data, offsets, np.zeros(hi - lo, np.int64))
        w = k.Words(data, offsets, k.ALNUM_WORDS, lower=True)
        h = (w.h & WORD_BITS) | np.uint64(4 << 60)
        yield np.unique(g, return_counts=True)
        yield np.unique(h, return_counts=True)
        tags = tag(batch.slice(lo, hi - lo))
        for i in np.flatnonzero(tags).tolist():
            own = np.concatenate([np.unique(g[offsets[i] : offsets[i + 1]]), np.unique(h[w.first[i] : w.first[i + 1]])])
            yield own | np.uint64(int(tags[i]) << 60), np.ones(len(own), np.int64)

    return keys


def _first(kinds: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which places are the first of their kind (a small number) in their text: by one sort of kind, text and place packed together."""
    out = np.zeros(len(kinds), bool)
    if len(kinds):
        place = np.uint64(len(kinds).bit_length())
        text = np.uint64(int(owner.max()).bit_length())
        packed = np.sort((kinds.astype(np.uint64) << (place + text)) | (owner.astype(np.uint64) << place) | np.arange(len(kinds), dtype=np.uint64))
        head = packed >> place
        at = packed[np.concatenate(([True], head[1:] != head[:-1]))] & ((np.uint64(1) << place) - np.uint64(1))
        out[at.astype(np.int64)] = True
    return out


def evidence_of(data: np.ndarray, offsets: np.ndarray, grams: lm.Arrays, words: lm.Arrays) -> np.ndarray:
    """Evidence (bits) at each byte."""
    distinct, back = np.unique(k.signed(lm.grams(data, offsets, np.zeros(len(offsets) - 1, np.int64))), return_inverse=True)
    out = grams.of(distinct, 0.0)[back]
    some = np.flatnonzero(out)
    out[some[~_first(back[some], np.searchsorted(offsets, some, "right"))]] = 0.0
    w = k.Words(data, offsets, k.ALNUM_WORDS, lower=True)
    distinct, back = np.unique(k.signed(w.h & WORD_BITS), return_inverse=True)
    value = words.of(distinct, np.nan)[back]
    known = np.flatnonzero(~np.isnan(value))
    if len(known):
        size = w.ends[known] - w.starts[known]
        share = np.where(_first(back[known], np.searchsorted(w.first, known, "right")), value[known] / size, 0.0)
        places = np.repeat(w.starts[known] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        out[places] = np.repeat(share, size)
    return out


def _means(x: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the mean of x, and the greatest sum over `width` consecutive places (or all, if fewer) by width."""
    sums = np.zeros(len(x) + 1)
    np.cumsum(x, dtype=np.float64, out=sums[1:])
    n = np.diff(offsets)
    total = sums[offsets[1:]] - sums[offsets[:-1]]
    best = total / width
    long = np.flatnonzero(n > width)
    if len(long):
        part = np.full(len(x) + 1, -np.inf)
        part[: len(x) - width + 1] = sums[width:] - sums[: len(x) - width + 1]
        # a text's passages begin at its places up to `width` before its end
        edges = np.stack([offsets[:-1][long], offsets[1:][long] - width + 1], 1).ravel()
        best[long] = np.maximum.reduceat(part, edges)[::2] / width
    return total / np.maximum(n, 1), best


def _score(models: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = (lm.opened(*m) for m in models)
        for batch in batches:
            for lo, hi, data, offsets in k.slices(batch.column(3)):
                mean, best = _means(evidence_of(data, offsets, grams, words), offsets, PASSAGE)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, hi - lo) for c in (0, 1, 2)], pa.array(mean), pa.array(best)], ["doc_id", "key", "id_hash", "z", "passage"])

    return run


ship(__name__)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes (none below 0: evidence never speaks for its opposite) and intercept by Newton's method, with a little ridge; columns are scaled for it."""
    scale = x.std(axis=0)
    scale[scale == 0] = 1.0
    use = np.arange(x.shape[1])
    while True:
        own, w = np.column_stack([x[:, use] / scale[use], np.ones(len(x))]), np.zeros(len(use) + 1)
        ridge = np.append(np.full(len(use), 1e-2), 1e-9)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            hess = (own * (p * (1 - p))[:, None]).T @ own + np.diag(ridge)
            step = np.linalg.solve(hess, own.T @ (p - y) + ridge * w)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        if not len(use) or w[:-1].min() >= 0:
            slopes = np.zeros(x.shape[1])
            slopes[use] = w[:-1] / scale[use]
            return slopes, float(w[-1])
        use = np.delete(use, w[:-1].argmin())


def _sure(z2: Column, kappa: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - kappa**2 / F.greatest(z2, F.lit(1e-9)))


def _evidence(counts: DataFrame, shared: DataFrame) -> DataFrame:
    """gram, p (log2 of the classes' probabilities' ratio in its context, times sure), sure (0 to 1), of the n-grams (counts gram, n0, n1) that a class has."""
    own = counts.filter("n0 + n1 > 0").withColumn("ctx", F.shiftright("gram", 8))
    d = lm.single_discounts(own, "n0", "n1")
    cut = {c: lm.discount_of(F.col(c), d[c]) for c in d}
    mass = own.groupBy("ctx").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.sum(cut["n0"]).alias("f0"), F.sum(cut["n1"]).alias("f1"))
    rows = own.join(mass, "ctx").join(shared.select("gram", F.col("p").alias("low")), "gram")
    p = [F.when(F.col(f"t{i}") > 0, (F.col(c) - cut[c] + F.col(f"f{i}") * F.col("low")) / F.col(f"t{i}")).otherwise(F.col("low")) for i, c in enumerate(cut)]
    # how surely the classes differ in this n-gram, given its context: the squared standard score of the toxic count
    both = F.greatest(F.col("t0") + F.col("t1"), F.lit(1))
    pool = (F.col("n0") + F.col("n1")) / both
    variance = F.col("t0") * F.col("t1") / both * pool * (1 - pool)
    z2 = F.when(variance > 0, F.pow(F.col("n1") - F.col("t1") * pool, 2) / variance).otherwise(0.0)
    # written out: small plans keep the driver small
    return materialise(rows.select("gram", (_sure(z2, KAPPA) * F.log2(p[1] / p[0])).alias("p"), _sure(z2, KAPPA).alias("sure")).filter("sure > 0"), "evidence")


def _word_evidence(counts: DataFrame, docs: tuple[int, int]) -> DataFrame:
    """key, value of the words that are sure: as _evidence(), in the empty context; the totals are a few numbers on the driver."""
    n = ("n0", "n1")
    d = lm.single_discounts(counts, *n)
    cut = {c: lm.discount_of(F.col(c), d[c]) for c in n}
    total = counts.agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in n], *[F.sum(cut[c]).alias(f"f_{c}") for c in n]).first()
    common = F.col("n") / F.lit(total["n"])
    p = [(F.col(c) - cut[c] + F.lit(total[f"f_{c}"]) * common) / F.lit(total[c]) if total[c] else common for c in n]
    pool = (F.col("n0") + F.col("n1")) / max(sum(docs), 1)
    variance = docs[0] * docs[1] / max(sum(docs), 1) * pool * (1 - pool)
    sure = _sure(F.when(variance > 0, F.pow(F.col("n1") - docs[1] * pool, 2) / variance).otherwise(0.0), WORD_KAPPA)
    rows = counts.filter("n0 + n1 > 0").select(F.col("gram").alias("key"), sure.alias("sure"), F.log2(p[1] / p[0]).alias("llr"))
    return rows.filter(F.col("sure") >= LEAST_SURE).select("key", (F.col("sure") * F.col("llr")).alias("value"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """doc_id, key (hash of the text), z, passage (the statistics) and score of every row of docs. train: which labels may be learnt from."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = own_columns(labels, "doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)")
    if train is not None:
        known = known.filter(train)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELS)
    known = known.select(_id_hash(F.col("doc_id")).alias("id_hash"), "toxic", (fold_of(F.col("doc_id"), 5) == 4).alias("held")).toArrow().sort_by("id_hash")
    ids, toxic, held = (known.column(c).to_numpy() for c in ("id_hash", "toxic", "held"))
    held = held.astype(bool)
    if not held.any() or len(set(toxic[held])) < 2 or len(set(toxic[~held])) < 2:
        held = np.zeros(len(ids), bool)  # too few labels to hold any back
    shown = spark.sparkContext.broadcast((ids[~held], toxic[~held].astype(np.int64)))
    texts = own_columns(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("key"), _id_hash(F.col("doc_id")).alias("id_hash"), "text")
    counted = texts.select("id_hash", "text").mapInArrow(lm.counter(_keys(_tagger(shown))), "tag int, gram long, n long")
    of = lambda c: F.sum(F.when(F.col("tag") % 4 == c, F.col("n")).otherwise(0))
    every = materialise(counted.groupBy((F.col("tag") >= 4).alias("word"), "gram").agg(of(0).alias("n"), of(1).alias("n0"), of(2).alias("n1")), "gram-counts")
    words = _word_evidence(every.filter("word"), (int((toxic[~held] == 0).sum()), int((toxic[~held] == 1).sum())))
    counts = every.filter("not word").drop("word")
    ratio = counts.select("gram", F.lit(0.0).alias("p"), F.lit(0.0).alias("sure"))
    for order in ORDERS:
        # where the longer context leaves the classes' difference open, the shorter one's word counts, as far as that is sure itself
        if order == lm.ORDER:
            own, common = counts, lm.kneser_ney(counts.select("gram", "n"), single=True)
        else:
            own = materialise(counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1)).alias("gram")).agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")]), f"counts{order}")
            all_ = own.groupBy(F.shiftright("gram", 8).alias("ctx")).agg(F.sum("n").alias("t"))
            common = own.filter("n0 + n1 > 0").withColumn("ctx", F.shiftright("gram", 8)).join(all_, "ctx").select("gram", (F.col("n") / F.col("t")).alias("p"))
        lower = _evidence(own, common).select(F.col("gram").alias("suf"), F.col("p").alias("p_low"), F.col("sure").alias("sure_low"))
        ratio = ratio.withColumn("suf", F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))).join(lower, "suf", "left").na.fill(0.0, ["p_low", "sure_low"])
        share = F.lit(1.0) if order == lm.ORDER else F.col("sure_low")
        ratio = ratio.select("gram", (F.col("p") + (1 - F.col("sure")) * share * F.col("p_low")).alias("p"), (F.col("sure") + (1 - F.col("sure")) * F.col("sure_low")).alias("sure"))
    ratio = ratio.select(F.col("gram").alias("key"), F.col("p").alias("value")).filter("value <> 0")
    models = lm.save_arrays(ratio, "toxicity-model"), lm.save_arrays(words, "toxicity-words")
    scored = materialise(texts.mapInArrow(_score(models), f"doc_id {kind}, key long, id_hash long, z double, passage double"), "toxicity")
    fit = held if held.any() else np.ones(len(ids), bool)
    if len(set(toxic[fit])) < 2:
        return scored.select("doc_id", "key", "z", "passage", F.lit(0.0).alias("score"))
    # the held-back labels' statistics: a few numbers for each of at most LABELS ids
    sample = spark.createDataFrame(pa.table({"id_hash": ids[fit], "y": toxic[fit].astype(np.float64)}))
    rows = scored.join(sample, "id_hash").groupBy("id_hash", "y").agg(F.max("z").alias("z"), F.max("passage").alias("passage")).toArrow()
    y = rows.column("y").to_numpy()
    if len(set(y)) < 2:  # the labelled texts aren't in docs
        return scored.select("doc_id", "key", "z", "passage", F.lit(0.0).alias("score"))
    slopes, intercept = logistic(np.column_stack([rows.column(c).to_numpy() for c in ("z", "passage")]), y)
    total = F.col("z") * float(slopes[0]) + F.col("passage") * float(slopes[1]) + intercept
    return scored.select("doc_id", "key", "z", "passage", (1 / (1 + F.exp(-total))).alias("score"))
