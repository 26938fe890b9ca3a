"""Editorial review as data: verdicts of a council, running means of audits, rules for finished texts, salvaged JSON, set metrics."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)
LEAST_MEAN, LEAST_SCORE, MOST_SCORE = 3.5, 2.0, 5.0


def approves(answer: Column) -> Column:
    """Whether an editor's answer starts with a yes; an answer that asks for changes is none."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    return low.rlike(r"^s[ií](?![\p{L}\p{N}_])") & ~low.contains("requiere cambios")


def council_verdicts(answers: DataFrame, scores: DataFrame, key: str, answer: str, score: str) -> DataFrame:
    """key, average, approved: the mean must reach 3.5, no score may be below 2, and the editor must say yes.

    A key without scores has the average 0. Scores are aggregated before they meet the answers.
    """
    per = scores.groupBy(key).agg(F.avg(score).alias("average"), F.min(score).alias("least"))
    average, least = F.coalesce("average", F.lit(0.0)), F.least(F.coalesce("least", F.lit(MOST_SCORE)), F.lit(MOST_SCORE))
    approved = (average >= LEAST_MEAN) & (least >= LEAST_SCORE) & approves(F.col(answer))
    return answers.join(per, key, "left").select(key, average.alias("average"), approved.alias("approved"))


def rolling_means(df: DataFrame, key: str, order: list[str], value: str, digits: int = 4) -> DataFrame:
    """key, n, mean: a running mean that is rounded at each step, so the order counts. A null value counts as 0.

    Rows of a key stream in order through one task, which holds one number for it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, mean = None, 0, 0.0
        for frame in frames:
            done = []
            for k, v in zip(frame["k"].tolist(), frame["v"].fillna(0.0).tolist()):
                if k != now:
                    if n:
                        done.append((now, n, mean))
                    now, n, mean = k, 0, 0.0
                n += 1
                mean = round(mean + (v - mean) / n, digits)
            yield pd.DataFrame(done, columns=["k", "n", "mean"])
        if n:
            yield pd.DataFrame([(now, n, mean)], columns=["k", "n", "mean"])

    rows = df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    kind = df.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).mapInPandas(run, f"k {kind}, n long, mean double").withColumnRenamed("k", key)


def text_faults(text: Column, source_chars: Column, sections: list[str], phrases: list[str], least_chars: int, most_ratio: float) -> Column:
    """The rules that a finished text breaks, as an array of names; an empty one passes."""
    text = F.coalesce(text, F.lit(""))
    low, n = F.lower(text), F.length(text)
    rules = [F.when(~text.contains(s), F.lit(f"section:{s}")) for s in sections]
    rules += [F.when(low.contains(p.lower()), F.lit(f"phrase:{p}")) for p in phrases]
    rules += [F.when(n < least_chars, F.lit("short")), F.when((source_chars > 0) & (n > source_chars * most_ratio), F.lit("long"))]
    return F.array_compact(F.array(*rules))


def salvage(text: str | None, name: str) -> str:
    """The list that a reply holds, as JSON: the reply itself, a fenced block, or the first object or list in it."""
    text = (text or "").strip()
    tries = [text, *(x for x in FENCE.findall(text) if x.strip())]
    read = json.JSONDecoder().raw_decode
    for start, candidate in [(0, t) for t in tries] + [(text.find(c), text) for c in "{[" if c in text]:
        try:
            found, end = read(candidate.strip() if start == 0 else candidate, start)
        except ValueError:
            continue
        if start == 0 and candidate.strip()[0] not in "{[":
            continue
        if isinstance(found, dict):
            found = found.get(name, [])
        if isinstance(found, list):
            return json.dumps(found, separators=(",", ":"))
    return "[]"


def salvaged(text: Column, name: str) -> Column:
    """salvage of each text, in Arrow batches; parsing that looks for the end of a value is beyond Spark's functions."""

    @F.pandas_udf(StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: salvage(x, name))

    return run(text)


def set_metrics(df: DataFrame, predicted: Column, gold: Column, group: str) -> DataFrame:
    """Macro and micro precision, recall and F1 of predicted sets for each group, rounded to four digits.

    A row without predictions has precision 1, one without gold recall 1; F1 is 0 where both are 0.
    """
    p, g = F.array_distinct(F.coalesce(predicted, F.array())), F.array_distinct(F.coalesce(gold, F.array()))
    rows = df.select(group, F.size(F.array_intersect(p, g)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"))

    def rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
        precision, recall = (F.coalesce(F.try_divide(tp, tp + x), F.lit(1.0)) for x in (fp, fn))
        return precision, recall, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))

    names = ("precision", "recall", "f1")
    own = rates(*map(F.col, ("tp", "fp", "fn")))
    sums = rows.withColumns(dict(zip(names, own))).groupBy(group).agg(*[F.round(F.avg(x), 4).alias(x) for x in names], *[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    micro = rates(*map(F.col, ("tp", "fp", "fn")))
    return sums.select(group, *names, *[F.round(c, 4).alias(f"micro_{x}") for x, c in zip(names, micro)])


def top_false_hits(df: DataFrame, predicted: Column, gold: Column, k: int = 5) -> DataFrame:
    """The k values that are most often predicted without being gold."""
    false = df.select(F.explode(F.array_except(predicted, gold)).alias("value"))
    return false.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
