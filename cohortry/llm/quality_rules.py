"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every whole text are made in one pass and staged. A random forest of
shallow trees is fitted on the labelled rows; every path from a root to a node is a
rule, a conjunction of bounds on statistics. Lasso logistic regression over the rules
leaves few with a weight, and these are compiled into one Spark column expression, which
scores all rows inside generated code. Both fits are distributed Spark jobs over all
labelled rows; the driver holds trees and weights only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.arrow_rows import add_columns, pack, texts_of, unpacked
from cohortry.llm.registry import documents, query
from cohortry.llm.text_stats import STATISTICS, statistics
from cohortry.session import staged

TREES, DEPTH, LASSO, STEPS, SEED = 16, 3, 5e-4, 60, 11
THRESHOLD = 0.3
PREFIX = "stat_"

#: A rule: statistic -> (above, at most); either bound may be None.
Rule = tuple[tuple[str, float | None, float | None], ...]


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules and an intercept; without rules every text has the same score."""

    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self, of) -> Column:
        """The probability of quality 1, where ``of`` gives the column of a statistic."""
        total = reduce(add, [F.when(condition(r, of), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules],
                       F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def condition(rule: Rule, of) -> Column:
    parts = []
    for name, above, most in rule:
        if above is not None:
            parts.append(of(name) > F.lit(above))
        if most is not None:
            parts.append(of(name) <= F.lit(most))
    return reduce(Column.__and__, parts)


def paths(tree: str, names: list[str]) -> set[Rule]:
    """The rules of one tree, from Spark's description of it."""
    found, bounds = set(), []
    for line in tree.splitlines():
        step = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if step:
            depth = len(step[1])
            bounds = [b for b in bounds if b[0] < depth] + [(depth, names[int(step[2])], step[3], float(step[4]))]
            rule = {}
            for _, name, sign, at in bounds:
                above, most = rule.get(name, (None, None))
                if sign == ">":
                    above = at if above is None else max(above, at)
                else:
                    most = at if most is None else min(most, at)
                rule[name] = above, most
            found.add(tuple((n, *rule[n]) for n in sorted(rule)))
    return found


def text_statistics(docs: DataFrame, text: str = "text", prefix: str = PREFIX) -> DataFrame:
    """``docs`` without its text, with the statistics of each whole text in double columns; null is empty, and zero throughout."""
    def start():
        def compute(batch):
            made = [statistics(t) for t in texts_of(batch, text)]
            return [[m[k] for m in made] for k in range(len(STATISTICS))]
        return compute

    return add_columns(docs, [T.StructField(prefix + s, T.DoubleType()) for s in STATISTICS], start, [text], keep_inputs=False)


def fit(rows: DataFrame, label: str = "quality", prefix: str = PREFIX) -> RuleModel:
    """Fit on rows with statistics and a 0/1 label; rows without one are left out.

    With one kind of label only, the model scores every text alike, below 0.01 or above 0.99; without labels, 0.5.
    """
    names = [prefix + s for s in STATISTICS]
    data = staged(rows.filter(F.col(label).isin(0, 1)).select(*names, F.col(label).cast("double").alias("_label")), "training")
    n, ones = data.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    if ones in (0, n):
        return RuleModel([], 0.0 if not n else (5.0 if ones else -5.0))
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                    featureSubsetStrategy="onethird", subsamplingRate=0.7)
    trees = forest.fit(VectorAssembler(inputCols=names, outputCol="_features").transform(data)).trees
    rules = sorted(set().union(*[paths(t.toDebugString, STATISTICS) for t in trees]),
                   key=lambda r: tuple((name, above is None, above or 0.0, most is None, most or 0.0) for name, above, most in r))
    if not rules:
        return RuleModel([], 0.0)

    def of(name):
        return F.col(prefix + name)

    held = data.select("_label", array_to_vector(F.array(*[condition(r, of).cast("double") for r in rules])).alias("_rules"))
    lasso = LogisticRegression(featuresCol="_rules", labelCol="_label", elasticNetParam=1.0, regParam=LASSO, maxIter=STEPS,
                               standardization=False).fit(held)
    weights = lasso.coefficients.toArray().tolist()
    return RuleModel([(r, w) for r, w in zip(rules, weights, strict=True) if w], float(lasso.intercept))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``held_out``, ``score`` and ``predicted``.

    Learns from ``labels`` (``doc_id``, ``quality``; several labels of an id count as the lowest) but
    those of held-out rows. Empty and null texts are scored as texts without words, texts of any
    length whole. Texts with equal statistics have equal scores. Repeated rows are each scored; an empty
    table stays empty; columns of ``docs`` with a name of the result are replaced, all other names are free.
    """
    result = ["held_out", "score", "predicted"]
    rows = staged(text_statistics(pack(docs, doc_id, text, result), "_text"), "statistics")
    known = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min("quality").alias("_quality"))
    numbers = rows.drop("_others").filter(~held_out("_id"))
    model = fit(numbers.join(known, "_id"), "_quality")
    score = model.score(lambda name: F.col(PREFIX + name))
    return rows.select(*unpacked(docs, doc_id, text, result), held_out("_id").alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


@query("op6_quality_rules")
def _(spark, d):
    return classify(documents(spark, d).select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))
