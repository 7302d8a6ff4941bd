"""Quality classifier: a sparse ensemble of rules over text statistics.

A random forest over the statistics of labelled texts gives candidate rules: every path from a root
to a node is a conjunction of thresholds. A lasso logistic regression over the rules keeps few of
them, and the kept rules with their weights are compiled to one Spark column expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import bounded_batches
from tickloom.plans.staging import stage

FEATURES = ("log_words", "word_length", "upper", "digit", "symbol", "stop", "non_ascii", "distinct_words",
            "distinct_lines", "line_words", "longest_word", "loose_words")
#: Labelled rows a fit uses, about; chosen by a hash of the id.
SAMPLE_ROWS = 20_000
_LOOSE = re.compile(rb"(?<!\S)[!-/:-@\[-`{-~]+(?!\S)")
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~!"


def text_statistics(text: str) -> tuple[float, ...]:
    """The statistics of one whole text, in the order of FEATURES; all 0 for an empty one."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return (0.0,) * len(FEATURES)
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    size = len(raw) - int(by_byte[9:14].sum()) - int(by_byte[32])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (float(np.log1p(len(words))), size / len(words), by_byte[65:91].sum() / size, by_byte[48:58].sum() / size,
            sum(int(by_byte[c]) for c in _SYMBOLS) / size, sum(int(by_byte[c]) for c in b".,;:?") / size,
            by_byte[128:].sum() / size, len(set(words)) / len(words), len(set(lines)) / len(lines),
            len(words) / len(lines), float(max(map(len, words))), len(_LOOSE.findall(raw)) / len(words))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pa.Array) -> pa.Array:
    rows = [text_statistics(x or "") for x in texts.to_pylist()]
    flat = pa.array(np.asarray(rows, dtype=np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), flat)


@dataclass(frozen=True)
class RuleModel:
    """Rules are tuples of (feature index, at_most, threshold); score = logistic(intercept + sum of weights)."""

    rules: tuple[tuple[tuple[int, bool, float], ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, statistics: str) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(rule_column(rule, statistics), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def rule_column(rule: tuple[tuple[int, bool, float], ...], statistics: str) -> Column:
    out = F.lit(True)
    for index, at_most, threshold in rule:
        value = F.col(statistics)[index]
        out = out & (value <= threshold if at_most else value > threshold)
    return out


def tree_rules(root) -> list[tuple[tuple[int, bool, float], ...]]:
    """Paths from the root to every other node, each feature kept with its tightest bounds."""
    out = []
    todo = [(root, {})]
    while todo:
        node, bounds = todo.pop()
        if bounds:
            out.append(tuple((i, m, t) for (i, m), t in sorted(bounds.items())))
        if node.numDescendants() == 0:
            continue
        split = node.split()
        index, threshold = split.featureIndex(), split.threshold()
        for at_most, child in ((True, node.leftChild()), (False, node.rightChild())):
            tightest = min if at_most else max
            todo.append((child, bounds | {(index, at_most): tightest(threshold, bounds.get((index, at_most), threshold))}))
    return out


def fit_rules(labelled: DataFrame, trees: int = 16, depth: int = 3, penalty: float = 0.0005, seed: int = 5) -> RuleModel:
    """``labelled``: statistics (array), label (0.0 or 1.0). One label only, or no rows: a constant score."""
    rows = labelled.select("statistics", "label", array_to_vector("statistics").alias("features"))
    shares = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return RuleModel((), (), {0.0: -4.0, 1.0: 4.0}.get(next(iter(shares), None), 0.0))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed,
                                    featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(rows)
    rules = sorted({r for t in forest.trees for r in tree_rules(t._call_java("rootNode"))})
    if not rules:
        return RuleModel((), (), float(np.log(shares[1.0] / shares[0.0])))
    fired = F.array(*[rule_column(r, "statistics").cast("double") for r in rules])
    fired = stage(rows.select("label", fired.alias("fired")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, tol=1e-4, standardization=False)
    model = lasso.fit(fired.select("label", array_to_vector("fired").alias("features")))
    kept = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if w != 0.0]
    return RuleModel(tuple(r for r, _ in kept), tuple(w for _, w in kept), float(model.intercept))


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on about ``sample_rows`` labelled rows. ``docs``: doc_id, text; ``labels``: doc_id, quality.

    Null labels and ids do not count. An id with several labels takes the majority, 0 at a tie.
    """
    bounded_batches(docs.sparkSession)
    known = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg((F.avg(F.col("quality").cast("double")) > 0.5).cast("double").alias("label")))
    rows = known.count()
    if rows > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / rows))
    labelled = stage(known.join(docs.select("doc_id", "text"), "doc_id")
                     .select(_statistics("text").alias("statistics"), "label"))
    return fit_rules(labelled)


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null text counts as empty; empty texts are scored on their zero statistics. Whole texts are read,
    every row is scored by itself, and input columns named like a result are replaced.
    """
    bounded_batches(docs.sparkSession)
    return (docs.withColumn("__statistics", _statistics(text)).withColumn("score", model.score("__statistics"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("__statistics"))
