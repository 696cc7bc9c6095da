"""A quality classifier as a sparse ensemble of rules.

Statistics of each whole text are measured in one pass. Paths of small trees, fitted by Spark's RandomForestClassifier
on a bounded sample of labelled rows, are conjunctions of bounds on statistics. A logistic regression with an L1 penalty
weighs them, most with 0. The rules left are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import WHITE, WordHasher, groups, kept

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digit", "point", "mark", "symbol", "bar", "space",
    "beyond_ascii", "log_lines", "line_bytes", "repeated_lines", "distinct_words", "commonest_word", "signed_words",
]


@dataclass(frozen=True)
class Settings:
    """sample: about so many labelled rows are fitted on, drawn by a hash of the id. trees, depth: of the forest whose
    paths are the rules. penalty: of the logistic regression."""

    sample: int = 12_000
    trees: int = 12
    depth: int = 3
    penalty: float = 0.001
    rounds: int = 40


@dataclass(frozen=True)
class Rule:
    """bounds: (statistic, above, value) that hold together: value < statistic if above, else statistic <= value."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        parts = [F.col(s) > v if above else F.col(s) <= v for s, above, v in self.bounds]
        return reduce(lambda a, b: a & b, parts)


@dataclass
class Model:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The probability of label 1."""
        terms = [F.when(rule.column(), weight).otherwise(0.0) for rule, weight in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.bias))))


def _among(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_CLASSES = np.stack(
    [
        _among("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _among("0123456789"), _among(".,;:"), _among("!?"), _among("#$%&*@^~<>{}[]\\+=_"), _among("|"), _among(" \t\n\r\f\v"),
        np.arange(256) >= 128,
    ]
).astype(np.float64)
_SIGN = _among("!?#$%&*@^~<>{}[]\\+=_|")


def statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a double for each of STATISTICS instead of the text. Null is measured like ''; very long
    texts are measured whole; repeated rows get a row each; an empty table gives none. Other columns of docs are not
    looked at and not returned, so names that clash do no harm."""

    def measure(batches):
        hasher = WordHasher(WHITE)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, to in groups(texts):
                h, offsets, start, end, first, joined = hasher.words(texts[at:to], places=True)
                data = np.frombuffer(joined, np.uint8)
                long = end - start
                signed = _SIGN[data[end - 1]] if len(h) else np.empty(0, bool)
                out = np.zeros((to - at, len(STATISTICS)))
                for k in range(to - at):
                    raw = data[first[k] : max(first[k], first[k + 1] - 1)]
                    own = slice(offsets[k], offsets[k + 1])
                    n, words = len(raw), offsets[k + 1] - offsets[k]
                    classes = _CLASSES @ np.bincount(raw, minlength=256) / max(1, n)
                    lines = [x for x in texts[at + k].split("\n") if x.strip()]
                    counts = np.unique(h[own], return_counts=True)[1] if words else np.zeros(1)
                    upper, digit, point, mark, symbol, bar, space, beyond = classes
                    out[k] = (
                        np.log1p(n), np.log1p(words), long[own].sum() / max(1, words), long[own].max() if words else 0, upper, digit, point, mark, symbol, bar, space,
                        beyond, np.log1p(len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(counts) / max(1, words) if words else 0, counts.max() / max(1, words), signed[own].sum() / max(1, words),
                    )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *[pa.array(np.ascontiguousarray(c)) for c in out.T]], ["doc_id", *STATISTICS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


def paths(forest) -> list[Rule]:
    """All distinct paths from the roots of a fitted forest, each as the tightest bounds it sets."""
    found: dict[tuple, Rule] = {}

    def walk(node, low: dict[str, float], high: dict[str, float]) -> None:
        if low or high:
            bounds = tuple(sorted([(s, True, v) for s, v in low.items()] + [(s, False, v) for s, v in high.items()]))
            found.setdefault(bounds, Rule(bounds))
        if node.subtreeDepth() == 0:
            return
        name, value = STATISTICS[node.split().featureIndex()], float(node.split().threshold())
        walk(node.leftChild(), low, high | {name: min(value, high.get(name, value))})
        walk(node.rightChild(), low | {name: max(value, low.get(name, value))}, high)

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {}, {})
    return list(found.values())


def fit(measured: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from measured (statistics()) and labels (doc_id, label 0/1), whose rows for one id count as their largest."""
    s = settings
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("double").alias("label"))
    n, good = labels.agg(F.count("*"), F.sum("label")).first()
    if not n or good in (0, n):
        return Model(10.0 if n and good else -10.0 if n else 0.0)
    drawn = labels.where((F.xxhash64("doc_id", F.lit(31)).bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)) < min(1.0, s.sample / n))
    # rows that share an id are one row of the sample, so an id that fills much of the table does no harm
    once = measured.join(drawn, "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", *STATISTICS)).alias("r"))
    sample = kept(once.select("r.*")).coalesce(4).cache()
    if sample.select("label").distinct().count() < 2:
        sample.unpersist()
        return Model(float(np.log((good + 0.5) / (n - good + 0.5))))
    vectors = sample.select("label", array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(numTrees=s.trees, maxDepth=s.depth, seed=1, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(vectors)
    rules = paths(forest)
    if not rules:
        sample.unpersist()
        return Model(float(np.log((good + 0.5) / (n - good + 0.5))))
    held = sample.select("label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=s.penalty, maxIter=s.rounds, standardization=False).fit(held)
    sample.unpersist()
    weights = lasso.coefficients.toArray()
    return Model(float(lasso.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w])


def score(measured: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for each row of statistics(). Empty and null texts are scored by their statistics, all
    of which are 0; repeated rows get the same score."""
    scored = measured.select("doc_id", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
