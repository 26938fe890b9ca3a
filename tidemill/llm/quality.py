"""Quality classifier: a sparse rule ensemble compiled into Spark columns (operator 4).

Statistics of a text are built-in column expressions. A small random forest is grown on a bounded sample of labelled
rows; each path of its trees, whole or cut short, is a rule, a conjunction of comparisons of statistics. A logistic
model with a lasso penalty picks and weighs the rules, and those with a weight become one column expression, so
scoring a corpus is a projection without Python and without a shuffle.

Defined results: a null or empty text has statistics of 0 and is scored like others; labels that are null are not
learnt from; if the labels learnt from are of one kind, or none, the score is their mean (1 if none). Scores use
nothing but the text. Rows that share a key are scored each and learnt from each, within the bound; null keys are
scored and not learnt from; other columns stay; an empty table gives no row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import WHITE, cut, text_or_empty

#: At most so many labelled rows are learnt from, the first by a hash of their key.
SAMPLE = 20_000
TREES, DEPTH, PENALTY, LEAST_SCORE = 12, 4, 0.0005, 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Counts of a text; ratios are made of them in a second projection, so each text is read once for each."""
    return {
        "chars": F.length(text),
        "bytes": F.octet_length(text),
        "words": F.filter(F.split(text, WHITE), lambda w: w != ""),
        "upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "digits": F.regexp_count(text, F.lit(r"[0-9]")),
        "symbols": F.regexp_count(text, F.lit(r"[#$%&*|!{}<>=@~^\\]")),
        "stops": F.regexp_count(text, F.lit(r"[.,;:?]")),
        "lines": F.regexp_count(text, F.lit(r"\n")) + 1,
    }


def features(stats: str = "stats") -> dict[str, Column]:
    """Ratios of statistics, doubles of limited precision so that equal texts get equal values on every cluster."""
    s = {k: F.col(f"{stats}.{k}") for k in statistics(F.lit(""))}
    n, words = F.greatest(s["chars"], F.lit(1)), F.greatest(F.size(s["words"]), F.lit(1))
    made = {
        "length": F.log1p(s["chars"]),
        "word_length": s["chars"] / words,
        "fresh_words": F.size(F.array_distinct(s["words"])) / words,
        "upper_share": s["upper"] / n,
        "digit_share": s["digits"] / n,
        "symbol_share": s["symbols"] / n,
        "stop_share": s["stops"] / n,
        "wide_share": (s["bytes"] - s["chars"]) / n,
        "line_words": words / s["lines"],
        "symbols_per_word": s["symbols"] / words,
    }
    return {k: F.round(v.cast("double"), 6) for k, v in made.items()}


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the struct columns `stats` and `features`; columns of these names are replaced."""
    stats = F.struct(*[v.alias(k) for k, v in statistics(text_or_empty(text)).items()])
    out = df.withColumn("stats", stats)
    return out.withColumn("features", F.struct(*[v.alias(k) for k, v in features().items()]))


@dataclass(frozen=True)
class Rule:
    """A conjunction: each part is (feature, whether at most, threshold)."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self, features: str = "features") -> Column:
        whole = F.lit(True)
        for name, below, at in self.parts:
            c = F.col(f"{features}.{name}")
            whole = whole & ((c <= at) if below else (c > at))
        return whole

    def simplified(self) -> Rule:
        """One bound for each feature and side, in fixed order, so that equal rules are equal objects."""
        bounds: dict[tuple[str, bool], float] = {}
        for name, below, at in self.parts:
            old = bounds.get((name, below), at)
            bounds[name, below] = min(old, at) if below else max(old, at)
        return Rule(tuple((n, b, at) for (n, b), at in sorted(bounds.items())))


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: dict[Rule, float] = field(default_factory=dict)
    constant: float | None = None

    def score(self, features: str = "features") -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(rule.column(features), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def tree_paths(description: str, names: list[str]) -> list[Rule]:
    """The paths of a forest, from the text that Spark prints of it: one rule for each branch, whole or cut short."""
    rules, path = [], []
    for line in description.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee]+)\)", line)
        if not m:
            if re.match(r"\s*Tree \d+", line):
                path = []
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, (names[int(m[3])], m[4] == "<=", float(m[5])))]
        rules.append(Rule(tuple(p[1] for p in path)).simplified())
    return list(dict.fromkeys(rules))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", key: str = "doc_id", text: str = "text") -> RuleModel:
    """Learn from labels (key, label 0/1) joined to docs; what is learnt from is bounded by `sample`, whatever the input."""
    given = labels.select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label")).dropna()
    chosen = given.orderBy(F.md5(F.col("_key").cast("string")), "_label").limit(sample)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text"))  # no other column of docs can clash
    rows = texts.join(F.broadcast(chosen), F.col("_id") == F.col("_key"))  # at most `sample` rows of two numbers
    # where rows share a key, the sample is cut again: the bound holds for what is learnt from, too
    rows = rows.select("text", "_label", "_key").orderBy(F.md5(F.col("_key").cast("string")), "_label", F.xxhash64("text")).limit(sample)
    names = list(features())
    rows = with_features(rows).select("_key", "_label", "features.*")
    # one ordered partition of the bounded sample: what is learnt does not depend on how documents were dealt out
    rows = cut(rows.repartition(1).sortWithinPartitions("_key", "_label", *names), "quality-sample")
    seen = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}  # two labels
    if len(seen) < 2:
        return RuleModel(0.0, constant=float(next(iter(seen), 1.0)))
    rows = VectorAssembler(inputCols=names, outputCol="vector").transform(rows).select("_label", "vector", F.struct(*names).alias("features"))
    forest = RandomForestClassifier(labelCol="_label", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, seed=7)
    rules = tree_paths(forest.fit(rows).toDebugString, names)
    if not rules:
        return RuleModel(0.0, constant=seen.get(1.0, 0) / sum(seen.values()))
    flags = rows.select("_label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    flags = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="flags").transform(flags).select("_label", "flags").cache()
    lasso = LogisticRegression(labelCol="_label", featuresCol="flags", elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=80)
    model = lasso.fit(flags)
    flags.unpersist()
    weights = {r: round(float(w), 6) for r, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-4}
    return RuleModel(round(float(model.intercept), 6), weights)


def score(docs: DataFrame, model: RuleModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out`, the probability that a text is good."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    made = with_features(docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text")))
    return made.select("row.*", model.score().alias(out))


def held_out(key: Column) -> Column:
    """The rows that are kept from learning."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def learnt(docs: DataFrame, labels: DataFrame) -> RuleModel:
    return fit(docs, labels.where(~held_out(F.col("doc_id"))))


def quality_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), learnt(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject."""
    name = "_quality"
    return score(docs, learnt(docs, labels), out=name).where(F.col(name) >= LEAST_SCORE).drop(name)
