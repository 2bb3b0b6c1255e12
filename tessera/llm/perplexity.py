"""Quality rules: base counts, and bands of n-gram perplexity for each language.

Every text is scored by a modified Kneser-Ney model of its language that has not seen it: texts are dealt into two
folds by the hash of their bytes (copies share a fold), each fold is scored by the model of the other, and the
whole table is counted. A text's perplexity is that of a byte, 2 ** (mean bits a byte). Bands are a language's median
of the bits a byte, MAD_WIDTH scaled median absolute deviations to either side, over the texts that pass the base
rules, by mergeable quantile sketches. As the mean of a short text scatters more, deviations are measured in units of
sqrt(1 + SHORT_BYTES / bytes of the text), and bands are wider for short texts by the same factor.
What is outside (too odd above; too predictable below) is rejected.

Defined cases: null or empty text has no words and fails the base rules; a null language is a language of its own;
a text without bytes has no perplexity (null); where the other fold has no text of a language, all bytes are equally
likely; repeated rows are judged one by one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from . import ngram_lm as lm
from .shared import materialise, own_columns, ship

WINDOW = 8
MAD_WIDTH = 3.5
#: Bytes of text at which the scatter of a text's own mean is that between texts.
SHORT_BYTES = 3000
#: Where a group has its fold: above the language's bits, the n-gram's highest.
FOLD_BIT = 20
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _repeats(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of the hashes occur twice or more in their text."""
    key = k.mix(h ^ k.mix(owner.astype(np.uint64) + np.uint64(1)))
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    return twice[at] == key


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[k.Words, list[np.ndarray]]:
    w = k.Words(data, offsets, k.BLANK_WORDS)
    texts = len(offsets) - 1
    chars = k.sums_by_text(w.inside & ((data & 0xC0) != 0x80), offsets)
    symbols = k.sums_by_text(_SYMBOLS[data], offsets)
    # lines: hash of all their bytes, where they have a word
    lines = k.Words(data, offsets, _NOT_NEWLINE)
    words_in = np.searchsorted(w.starts, lines.ends) - np.searchsorted(w.starts, lines.starts) > 0
    h, owner = lines.h[words_in], lines.doc()[words_in]
    key = k.mix(h ^ k.mix(owner.astype(np.uint64) + np.uint64(1)))
    distinct, at = np.unique(key, return_index=True)
    dup_lines = np.bincount(owner, minlength=texts) - np.bincount(owner[at], minlength=texts)
    wh, fits = w.windows(WINDOW)
    at = np.flatnonzero(fits)
    doc = w.doc()
    again = at[_repeats(wh[at], doc[at])]
    repeat_words = k.sums_by_text(k.covered(len(w.h), again, WINDOW), w.first)
    return w, [w.n.astype(np.int64), chars, symbols, dup_lines.astype(np.int64), repeat_words]


_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False


def _score(folder: str, shards: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = lm.opened(folder, shards)
        for batch in batches:
            group = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in k.slices(batch.column(2)):
                _, counts = base_counts(data, offsets)
                bits = arrays.get(k.signed(lm.grams(data, offsets, group[lo:hi])), 20.0)
                n = np.diff(offsets)
                sums = np.zeros(len(bits) + 1)
                np.cumsum(bits, dtype=np.float64, out=sums[1:])
                mean = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *[pa.array(c) for c in counts], pa.array(mean, pa.float64(), mask=n == 0), pa.array(n)], ["doc_id", "grp", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bits", "n_bytes"])

    return run


ship(__name__)


def perplexity_bands(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, perplexity, its band (low, high) and kept, of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fold = F.shiftleft(F.pmod(F.xxhash64("text"), F.lit(2)), FOLD_BIT)
    texts = own_columns(docs, "doc_id", "lang", "text").select("doc_id", (lm.group_code(F.col("lang")) + fold).alias("grp"), "text")
    # the fold's bit is the one that is told apart as tag
    counted = texts.select("grp", "text").mapInArrow(lm.counter(), "tag int, gram long, n long")
    of = lambda c: F.sum(F.when(F.col("tag") == c, F.col("n")).otherwise(0)).alias(f"n{c}")
    counts = materialise(counted.groupBy("gram").agg(of(0), of(1)), "gram-counts")
    # a fold's model: the other fold's counts, its own n-grams with none where only it has them
    folds = [F.struct((F.col("gram") + F.lit(f << FOLD_BIT + lm.GRAM_BITS)).alias("gram"), F.col(f"n{1 - f}").alias("n")) for f in (0, 1)]
    model = lm.kneser_ney(counts.select(F.inline(F.array(*folds))))
    folder, shards = lm.save_arrays(model.select(F.expr(f"(grp << {lm.GRAM_BITS}) | gram").alias("key"), (-F.log2("p")).alias("value")), "perplexity-model")
    scored = materialise(texts.mapInArrow(_score(folder, shards), f"doc_id {kind}, grp long, {BASE}, bits double, n_bytes long"), "perplexity")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("grp", F.col("grp").bitwiseAND(F.lit((1 << FOLD_BIT) - 1)))
    sound = scored.filter("not base_failed")
    middle = sound.groupBy("grp").agg(F.percentile_approx("bits", 0.5, 10000).alias("mid"))
    unit = F.sqrt(1 + SHORT_BYTES / F.greatest("n_bytes", F.lit(1)))
    spread = sound.join(middle, "grp").withColumn("away", F.abs(F.col("bits") - F.col("mid")) / unit)
    bands = spread.groupBy("grp", "mid").agg(F.percentile_approx("away", 0.5, 10000).alias("mad"))
    half = MAD_WIDTH * 1.4826 * F.col("mad") * unit
    out = scored.join(bands, "grp", "left").withColumn("low", F.col("mid") - half).withColumn("high", F.col("mid") + half)
    kept = ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", *[c.split(" ")[0] for c in BASE.split(", ")], "base_failed", kept.alias("kept"), F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "low").alias("low"), F.pow(F.lit(2.0), "high").alias("high"))
