"""Mixing sources to target weights by entropy balancing, with native functions only.

Each source gets a target in words. Among all document rates r_i in [0, 2] that meet their source's target, the
ones nearest to "one copy each" in (two-sided) entropy are

    r_i = 2 / (1 + exp(-lambda_s * t_i)),    t_i = size_i / mean size of the source,

exponentially tilted by the document's words; lambda_s maximises the concave dual, whose gradient is the target
minus the words that the rates take. Newton's method finds it: the gradient is concave in lambda above 0 and
convex below, so from 0 it runs monotonically to the root. The dual separates by source, and documents of a source
matter only through (size cell, count, words), so each Newton iteration runs over a bounded histogram, all
sources side by side, within one aggregation: what is distributed is the histogram's making, once, and not a job for
each step. Cells are single sizes up to 1023 words and narrower than 1/512 of the size above, where a cell's
documents share the rate of their mean size. A target of twice the source's words is the limit rate 2.

Rates become copies (0, 1 or 2) by systematic rounding along the source's size cells: copies_i = floor(C_i + u) -
floor(C_{i-1} + u) with C the running sum of the rates. Neighbours in size make up for each other, so a source's
words miss the target by about one document's; of OFFSETS values of u the best is taken, by the words they give.

Defined cases: null or wordless text has size 0 and takes 0 words; a null source is a source of its own, last in
the order; repeated rows are mixed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, own_columns

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Sub-cells by which one (source, size) cell is split; a cell of a third of 3e10 rows gives windows of some 1e7 rows.
SUBCELLS = 1024
OFFSETS = 16
NEWTON_STEPS = 60


def n_words(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def size_cell(size: Column) -> Column:
    """The size itself up to 1023, above that its ten leading bits: at most 512 cells for every doubling."""
    drop = F.greatest(F.length(F.bin(size)) - 10, F.lit(0))
    return F.when(size < 1024, size).otherwise(F.call_function("shiftleft", F.call_function("shiftright", size, drop), drop))


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> target: shares by weight; what lies above cap times a source's size is shared anew by weight.

    Water-filling in closed form: with sources ordered by size / weight, those up to some place in the order are
    full, and the rest share what is left by weight. (One row a source: the windows are as small as their list.)
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    step = totals.withColumn("weight", weight).withColumn("budget", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    step = step.withColumn("level", (F.col("budget") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    # the level of the first source in the order that it does not fill is the level of all the later ones
    step = step.withColumn("open", F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.col("level")))
    step = step.withColumn("final", F.first("open", ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return step.select("source", "source_size", F.coalesce(F.least(F.col("final") * F.col("weight"), cap * F.col("source_size")), cap * F.col("source_size")).cast("double").alias("target"))


def _tilts(hist: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """source -> lambda. Each source's histogram is one bounded array; all Newton steps of all sources run in one job."""
    cells = hist.groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_list(F.struct("t", "words"))).alias("cells"))
    step = f"""
        aggregate(sequence(1, {NEWTON_STEPS}), named_struct('l', 0D, 'go', true), (a, k) -> if(not a.go, a,
          aggregate(cells, named_struct('f', 0D, 'd', 0D),
            (s, c) -> named_struct('f', s.f + {cap} * c.words / (1 + exp(-a.l * c.t)),
                                   'd', s.d + {cap} * c.words * c.t * exp(-abs(a.l * c.t)) / pow(1 + exp(-abs(a.l * c.t)), 2)),
            s -> if(s.d <= 1e-12 * (1 + abs(target)) or abs(target - s.f) <= 1e-9 * target,
                    named_struct('l', a.l, 'go', false),
                    named_struct('l', a.l + (target - s.f) / s.d, 'go', true)))), a -> a.l)"""
    return goal.join(cells, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", F.expr(f"case when target >= {cap} * source_size then null else {step} end").alias("tilt"))


def entropy_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = 2) -> DataFrame:
    """doc_id, key (hash of the text), source, size, source_size, target, rate, copies, taken of every row of docs."""
    facts = own_columns(docs, "doc_id", "text", "source").select("doc_id", F.xxhash64("text").alias("key"), "source", n_words(F.col("text")).alias("size"))
    facts = facts.withColumn("cell", size_cell(F.col("size"))).withColumn("sub", F.pmod(F.xxhash64("doc_id"), F.lit(SUBCELLS)).cast("int"))
    facts = materialise(facts, "mix-facts")
    counts = materialise(facts.groupBy("source", "cell", "sub").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-counts")
    totals = counts.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("docs"))
    goal = targets(totals.drop("docs"), weights, share, float(cap))
    # t: words of the cell's mean document over those of the source's
    hist = counts.groupBy("source", "cell").agg(F.sum("words").alias("words"), F.sum("n").alias("n"))
    mean = totals.select(F.col("source").alias("s"), (F.greatest(F.col("source_size"), F.lit(1)) / F.col("docs")).alias("mean"))
    hist = hist.join(mean, F.col("source").eqNullSafe(F.col("s"))).withColumn("t", F.col("words") / F.col("n") / F.col("mean"))
    tilt = materialise(_tilts(hist.select("source", "t", F.col("words").cast("double").alias("words")), goal, float(cap)), "mix-tilts")
    k = tilt.select(F.col("source").alias("s"), "source_size", "target", "tilt")
    rates = hist.drop("s", "words", "n", "mean").join(k, F.col("source").eqNullSafe(F.col("s"))).select("source", "cell", F.coalesce(cap / (1 + F.exp(-F.col("tilt") * F.col("t"))), F.lit(float(cap))).alias("rate"))
    c = counts.alias("c").join(rates.alias("r"), F.col("c.source").eqNullSafe(F.col("r.source")) & (F.col("c.cell") == F.col("r.cell"))).select("c.source", "c.cell", "c.sub", "n", "words", "rate")
    run = Window.partitionBy("source").orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(c.withColumn("start", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(run), F.lit(0.0))), "mix-runs")
    # of OFFSETS roundings of each source, the one whose words come nearest; a sub-cell's documents count with its mean size
    offset = lambda u: (F.floor(F.col("start") + F.col("n") * F.col("rate") + u) - F.floor(F.col("start") + u)) * F.floor(F.col("words") / F.col("n"))
    sums = runs.groupBy("source").agg(*[F.sum(offset((i + 0.5) / OFFSETS)).alias(f"o{i}") for i in range(OFFSETS)])
    best = sums.join(k, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", F.array_min(F.array(*[F.struct(F.abs(F.col(f"o{i}") - F.col("target")).alias("miss"), F.lit((i + 0.5) / OFFSETS).alias("u")) for i in range(OFFSETS)]))["u"].alias("u"))
    first = runs.alias("r").join(best, F.col("r.source").eqNullSafe(F.col("s"))).select(F.col("r.source").alias("s"), F.col("cell").alias("ce"), F.col("sub").alias("su"), "rate", "start", "u", "source_size", "target")
    within = Window.partitionBy("source", "cell", "sub").orderBy("doc_id", "size", "key")
    ranked = facts.withColumn("rn", F.row_number().over(within))
    joined = ranked.join(first, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("ce")) & (F.col("sub") == F.col("su")))
    at = lambda rn: F.floor(F.col("start") + rn * F.col("rate") + F.col("u"))
    copies = F.when(F.col("rate") >= cap, F.lit(cap)).otherwise(F.least(at(F.col("rn")) - at(F.col("rn") - 1), F.lit(cap))).cast("int")
    return joined.select("doc_id", "key", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
