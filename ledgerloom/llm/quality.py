"""Quality scores by a sparse ensemble of rules.

Shallow trees are grown over statistics of the texts; every path from a root to a node is a rule, a
conjunction of a few comparisons. Logistic regression with a lasso penalty gives most rules the weight zero, and
the rest are compiled into one Spark column over the statistics, which are themselves Spark columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.labelled import held_out, training_labels
from ledgerloom.llm.shared import numbered, saved

TREES = 16
DEPTH = 3
PENALTY = 0.0005
ITERATIONS = 60
SEED = 11
HELD_PARTS, HELD_PART = 5, 0
PREDICTED_FROM = 0.3
NODE = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name, none of them null; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    chars = F.char_length(text)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.split(text, "\n")
    n_words = F.size(words)

    def share(amount: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(amount.cast("double"), whole.cast("double")), F.lit(0.0))

    def letters(outside: str) -> Column:
        """How many characters are left when runs of those in `outside` are taken out."""
        return F.char_length(F.regexp_replace(text, outside, ""))

    return {
        "log_chars": F.log1p(chars), "log_words": F.log1p(n_words),
        "word_chars": share(chars, n_words + 1),
        "upper": share(letters(r"\P{Lu}+"), chars), "digits": share(letters(r"\P{Nd}+"), chars),
        "symbols": share(letters(r"[^#$%&*|@~^<>{}\[\]\\=+_/]+"), chars),
        "exclaims": share(letters(r"[^!?]+"), chars), "stops": share(letters(r"[^.,;:]+"), chars),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": share(n_words, F.size(lines)),
        "short_words": share(F.size(F.filter(words, lambda w: F.char_length(w) <= 3)), n_words),
        "long_words": share(F.size(F.filter(words, lambda w: F.char_length(w) > 14)), n_words),
        "same_next": share(F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(n_words, F.lit(1))),
                                                      lambda a, b: a.eqNullSafe(b)), lambda same: same)), n_words),
    }


FEATURES = [
    "log_chars", "log_words", "word_chars", "upper", "digits", "symbols", "exclaims", "stops", "distinct_words",
    "distinct_lines", "line_words", "short_words", "long_words", "same_next"]

Condition = tuple[int, str, float]
Rule = tuple[Condition, ...]


@dataclass
class RuleModel:
    """Weighted rules over statistics; `features` names the statistic of each number."""

    rules: list[Rule]
    weights: list[float]
    intercept: float

    def column(self) -> Column:
        """The score, 0 to 1, over columns named like the statistics. Rules of weight zero are left out."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            if weight:
                total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    found = F.lit(True)
    for feature, sign, value in rule:
        column = F.col(FEATURES[feature])
        found = found & (column <= value if sign == "<=" else column > value)
    return found


def rules_of(tree: str) -> list[Rule]:
    """The paths from the root to every other node, read from a tree's printed form."""
    path: list[Condition] = []
    found = []
    base = None
    for line in tree.splitlines():
        met = NODE.match(line)
        if not met:
            continue
        depth = len(met[1])
        base = depth if base is None else base
        path[depth - base:] = [(int(met[3]), met[4], float(met[5]))]
        found.append(tuple(path))
    return found


def fit(stats: DataFrame, labels: DataFrame) -> RuleModel:
    """Learn from all labelled rows that are not held out; `stats` has doc_id and the statistics.

    With no rows, or a single class, the score is the smoothed share of label 1.
    """
    rows = saved(stats.join(training_labels(labels, "quality", HELD_PARTS, HELD_PART), "doc_id")
                 .select("label", *FEATURES).orderBy("label", *FEATURES), "labelled")
    count, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < count:
        share = (ones + 0.5) / (count + 1)
        return RuleModel([], [], float(_logit(share)))
    laid = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5,
                                    featureSubsetStrategy="0.5", seed=SEED).fit(laid.select("features", "label"))
    rules = sorted({rule for tree in forest.trees for rule in rules_of(tree.toDebugString)})
    named = [f"r{i}" for i in range(len(rules))]
    held = rows.select("label", *[holds(rule).cast("double").alias(name) for rule, name in zip(rules, named)])
    laid = saved(VectorAssembler(inputCols=named, outputCol="features").transform(held).select("features", "label"), "rules")
    lasso = LogisticRegression(regParam=PENALTY, elasticNetParam=1.0, standardization=False, maxIter=ITERATIONS).fit(laid)
    return RuleModel(rules, [float(w) for w in lasso.coefficients], float(lasso.intercept))


def _logit(share: float) -> float:
    from math import log

    return log(share / (1 - share))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row, worked out once and written."""
    rows = numbered(docs, ["doc_id", "text"])
    return saved(rows.select("row_no", "doc_id", *[c.alias(name) for name, c in statistics(F.col("text")).items()]), "statistics")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (score of 0.3 or more).

    The score comes from the text alone. Null and empty texts get the score of their statistics, all zero.
    """
    stats = with_statistics(docs)
    score = fit(stats, labels).column()
    return stats.select(
        "doc_id", held_out(F.col("doc_id"), HELD_PARTS, HELD_PART).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= PREDICTED_FROM).cast("int"))
