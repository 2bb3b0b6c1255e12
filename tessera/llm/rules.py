"""Quality classifier: a sparse ensemble of rules over text statistics.

One scan turns each text into a row of statistics. A random forest of shallow trees is grown on the labelled rows;
every path from a root to a leaf is a conjunctive rule, and a lasso logistic regression over the rules' indicators
keeps few of them. The ensemble is compiled into one Spark column expression over the statistics, so scoring is plain
SQL; `describe` lists it. Growing and fitting are Spark ML's, distributed over the labelled rows' statistics (no texts).

Defined cases: null or empty text has all statistics 0, and is scored like any other; texts without a label or with a
null label aren't learnt from; with labels of one class only, the score is that class; without labels, 0; repeated
rows are scored one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as k
from . import perplexity
from .shared import materialise, own_columns, ship

TREES = 15
DEPTH = 4
LASSO = 0.0005
STATISTICS = ["n_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "shouts", "bars", "adjacent", "distinct", "line_words", "non_ascii", "punctuation"]
_CLASS = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"upper": bytes(range(65, 91)), "digits": b"0123456789", "shouts": b"!?", "bars": b"|<>{}[]", "non_ascii": bytes(range(128, 256)), "punctuation": b".,;:"}.items()}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts by STATISTICS; counts are per word or per byte, so that they compare across lengths."""
    w, (n, chars, symbols, dup_lines, repeats) = perplexity.base_counts(data, offsets)
    texts = len(offsets) - 1
    per_word, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    counts = {name: k.sums_by_text(table[data], offsets) for name, table in _CLASS.items()}
    lines = k.sums_by_text(data == 10, offsets) + 1
    same = np.zeros(len(w.h), bool)
    same[1:] = w.h[1:] == w.h[:-1]
    same[w.first[:-1][w.first[:-1] < len(same)]] = False
    owner = w.doc()
    _, first = np.unique(k.mix(w.h ^ k.mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True)
    distinct = np.bincount(owner[first], minlength=texts)
    out = [n, chars / per_word, symbols / per_word, dup_lines / lines, repeats / per_word, counts["upper"] / size, counts["digits"] / size, counts["shouts"] / per_word, counts["bars"] / per_word, k.sums_by_text(same, w.first) / per_word, distinct / per_word, n / lines, counts["non_ascii"] / size, counts["punctuation"] / per_word]
    return np.stack([x.astype(np.float64) for x in out], 1)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in k.slices(batch.column(1)):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(STATISTICS))]], ["doc_id", *STATISTICS])


ship(__name__)
ship(perplexity.__name__)
ship(k.__name__)

Rule = tuple[tuple[int, str, float], ...]


def paths(tree: str) -> list[Rule]:
    """Rules of a tree's printed form: its paths from the root to the leaves, with bounds on a statistic merged."""
    out, stack = [], []
    for line in tree.split("\n"):
        depth = len(line) - len(line.lstrip())
        if m := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line):
            stack = [x for x in stack if x[0] < depth] + [(depth, (int(m[1]), m[2], float(m[3])))]
        elif "Predict" in line:
            bounds: dict[tuple[int, str], float] = {}
            for _, (i, op, v) in (x for x in stack if x[0] < depth):
                bounds[i, op] = v if (i, op) not in bounds else (min if op == "<=" else max)(v, bounds[i, op])
            if bounds:
                out.append(tuple((i, op, v) for (i, op), v in sorted(bounds.items())))
    return out


def condition(rule: Rule) -> Column:
    c = F.lit(True)
    for i, op, v in rule:
        c = c & (F.col(STATISTICS[i]) <= v if op == "<=" else F.col(STATISTICS[i]) > v)
    return c


class Ensemble:
    """Weighted rules and an intercept."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self) -> Column:
        """The compiled expression: a number from 0 to 1."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[i]} {op} {v:.4g}" for i, op, v in r) for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit(rows: DataFrame, label: str = "y") -> Ensemble:
    """rows: STATISTICS and a label of 0 or 1."""
    seen = {r["y"]: r["n"] for r in rows.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return Ensemble([], 30.0 if 1.0 in seen else -30.0)
    data = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows).select("features", F.col(label).cast("double").alias("label"), *STATISTICS)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=0.7, featureSubsetStrategy="onethird", maxMemoryInMB=64).fit(data)
    rules = sorted({r for t in forest.trees for r in paths(t.toDebugString)})
    if not rules:
        p = seen.get(1.0, 0) / sum(seen.values())
        return Ensemble([], float(np.log(p / (1 - p))))
    indicators = F.array(*[F.when(condition(r), 1.0).otherwise(0.0) for r in rules])
    from pyspark.ml.functions import array_to_vector

    shown = materialise(data.select(array_to_vector(indicators).alias("features"), "label"), "rule-rows")
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=100).fit(shown)
    return Ensemble([(r, float(w)) for r, w in zip(rules, model.coefficients) if abs(w) > 1e-6], float(model.intercept))


def quality_scores(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> tuple[DataFrame, Ensemble]:
    """(doc_id, the statistics and score of every row of docs; the ensemble). train: which labels may be learnt from."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    facts = materialise(own_columns(docs, "doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in STATISTICS)), "statistics")
    known = own_columns(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)")
    if train is not None:
        known = known.filter(train)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    rows = materialise(facts.join(known, "doc_id").select("y", *STATISTICS), "labelled")
    ensemble = fit(rows)
    return facts.withColumn("score", ensemble.score()), ensemble
