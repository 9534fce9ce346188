"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, is_held_out, sampled

STATISTICS = ("n_chars", "n_words", "word_length", "exclamations", "bars", "signs", "capitals", "digits", "repeats", "distinct_words", "distinct_lines")


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs (with a text column) with the columns of STATISTICS, all doubles; a null or empty text has 0 in each.

    exclamations, bars, signs: per word. capitals, digits: per character. repeats: words equal to the one before, per word.
    distinct_words, distinct_lines: share of different words and lines.
    """
    text = F.col("_t")
    chars, words = F.length(text), F.size("_words")
    again = F.filter("_words", lambda w, i: (i > 0) & (w == F.get("_words", i - 1)))

    def share(n: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(n, of), F.lit(0)).cast("double")

    found = {
        "n_chars": chars.cast("double"), "n_words": words.cast("double"), "word_length": share(chars, words),
        "exclamations": share(chars - F.length(F.replace(text, F.lit("!"), F.lit(""))), words), "bars": share(chars - F.length(F.replace(text, F.lit("|"), F.lit(""))), words),
        "signs": share(F.regexp_count(text, F.lit(r"[*$%&#@^~=+<>{}\[\]\\]")), words), "capitals": share(F.regexp_count(text, F.lit(r"\p{Lu}")), chars),
        "digits": share(F.regexp_count(text, F.lit("[0-9]")), chars), "repeats": share(F.size(again), words), "distinct_words": share(F.size(F.array_distinct("_words")), words),
        "distinct_lines": share(F.size(F.array_distinct("_lines")), F.size("_lines")),
    }
    split = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumns({"_words": F.array_remove(F.split("_t", r"\s+"), ""), "_lines": F.split("_t", "\n")})
    return split.withColumns(found).drop("_t", "_words", "_lines")


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    bound: float

    def column(self) -> Column:
        return F.col(self.statistic) > self.bound if self.above else F.col(self.statistic) <= self.bound


@dataclass
class Rules:
    """Score 1 / (1 + exp(-(start + sum of the weights of rules that hold)))."""

    start: float
    weights: dict[tuple[Condition, ...], float]

    def column(self) -> Column:
        logit = F.lit(self.start)
        for rule, w in self.weights.items():
            logit = logit + F.when(_all(rule), w).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def _all(rule: tuple[Condition, ...]) -> Column:
    found = rule[0].column()
    for c in rule[1:]:
        found = found & c.column()
    return found


def tree_paths(printed: str) -> set[tuple[Condition, ...]]:
    """All paths from a root to a node below it, as conjunctions, in the printed form of an ensemble's trees."""
    found, path = set(), []
    for depth, number, op, bound in re.findall(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", printed, re.M):
        path = [p for p in path if p[0] < len(depth)] + [(len(depth), Condition(STATISTICS[int(number)], op == ">", float(bound)))]
        tightest: dict[tuple[str, bool], float] = {}
        for _, c in path:
            old = tightest.get((c.statistic, c.above), c.bound)
            tightest[c.statistic, c.above] = max(old, c.bound) if c.above else min(old, c.bound)
        found.add(tuple(Condition(s, a, b) for (s, a), b in sorted(tightest.items())))
    return found


def learn(docs: DataFrame, labels: DataFrame, rows: int = 12_000, trees: int = 6, depth: int = 3, lasso: float = 5e-4) -> Rules:
    """Rules from about `rows` labelled documents that are not held out (a bounded sample, chosen by a hash of the id).

    Boosted trees over the statistics give the candidate rules, a lasso logistic regression over them the weights; rules
    of weight 0 go. With labels of one kind only, or none, there are no rules and the score is that kind's, or 0.5.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    told = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    texts = docs.select("doc_id", "text").join(F.broadcast(sampled(told, rows)), "doc_id")
    train = cut(with_statistics(texts).select("label", *STATISTICS)).coalesce(4)  # the written sample's rows, not the scan
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Rules({0.0: -5.0, 1.0: 5.0}.get(next(iter(counts), None), 0.0), {})
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(train)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.5, seed=1).fit(vectors)
    rules = sorted(tree_paths(model.toDebugString), key=str)
    if not rules:
        return Rules(math.log(counts[1.0] / counts[0.0]), {})
    holds = train.select("label", *[_all(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    holds = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(holds).select("label", "features")
    fit = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(cut(holds))
    return Rules(float(fit.intercept), {r: float(w) for r, w in zip(rules, fit.coefficients) if w})


def score(docs: DataFrame, rules: Rules) -> DataFrame:
    """docs with a score of each whole text, 0 to 1; no column but text is looked at.

    Null and empty texts have statistics of 0 and score by them; other columns pass through, and a score column of docs is
    replaced; no statistic needs more than its own row.
    """
    own = F.struct(*[F.col(c) for c in docs.columns if c != "score"]).alias("_row")
    return with_statistics(docs.select(own, "text")).select("_row.*", rules.column().alias("score"))
