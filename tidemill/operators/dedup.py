"""Exact and near duplicates of articles by content hash and SimHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemill.functions.text import collapse_space
from tidemill.session import new_path

BITS, NEAR = 64, 10
#: ASCII white space and the space separators of Unicode.
SPACES = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def content_hash(text: Column) -> Column:
    return F.sha2(collapse_space(F.coalesce(text, F.lit(""))), 256)


def exact_groups(df: DataFrame, key: str, text: Column) -> DataFrame:
    """The first row and the size of each group of equal texts."""
    return df.groupBy(content_hash(text).alias("content_hash")).agg(F.min(key).alias("first_id"), F.count("*").alias("n"))


class TokenBits:
    """The low 64 bits of the MD5 of tokens, as rows of zeros and ones. Words repeat, so few are hashed twice; a full table is begun anew."""

    def __init__(self, size: int = 1 << 17) -> None:
        self.size, self.known, self.rows = size, {}, np.zeros((size, BITS), np.uint8)

    def ones(self, tokens: list[bytes]) -> np.ndarray:
        """How many of the tokens have each bit."""
        total = np.zeros(BITS, np.int64)
        for at in range(0, len(tokens), self.size):
            some = tokens[at : at + self.size]
            new = list(set(some).difference(self.known))
            if len(self.known) + len(new) > self.size:
                self.known, new = {}, list(set(some))
            if new:
                n = len(self.known)
                low = b"".join([hashlib.md5(t).digest()[8:] for t in new])
                self.rows[n : n + len(new)] = np.unpackbits(np.frombuffer(low, np.uint8).reshape(-1, 8), axis=1)
                self.known.update(zip(new, range(n, n + len(new)), strict=True))
            total += self.rows[list(map(self.known.__getitem__, some))].sum(axis=0, dtype=np.int64)
        return total


@F.pandas_udf(LongType())
def _votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SimHashes of texts: MD5 has no fast form as a number in the JVM, and 64 sums for each token fit a matrix well."""
    bits = TokenBits()
    for texts in batches:
        out = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            tokens = text.strip(SPACES).encode().split()  # bytes are parted by ASCII white space
            if tokens:
                out[i] = np.packbits(2 * bits.ones(tokens) >= len(tokens)).view(">i8")[0]
        yield pd.Series(out)


def simhash_of(text: Column) -> Column:
    """The 64-bit SimHash of a text: each token (repeats count) votes with the low 64 bits of its MD5, a bit is set where
    the votes for it are not outnumbered, and a text without tokens has 0. Tokens stand between ASCII white space; space
    separators at the ends of a text are no part of them."""
    return _votes(F.coalesce(text, F.lit("")))


def simhash(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key and the SimHash of its text, within the row: nothing is shuffled."""
    return df.select(F.col(key), simhash_of(text).alias("simhash"))


def hash_classes(df: DataFrame, key: str) -> DataFrame:
    """id, simhash, n: the least key and the size of each group of equal SimHashes; rows without tokens (0) are left out."""
    return df.where("simhash <> 0").groupBy("simhash").agg(F.min(key).alias("id"), F.count("*").alias("n"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def confidence(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / BITS)


def near_pairs(df: DataFrame, key: str, most: int = NEAR) -> DataFrame:
    """Pairs of rows with neighbouring 16-bit prefixes and at most `most` differing bits: an equi-join on the prefix."""
    rows = df.select(F.col(key).alias("id"), "simhash", F.shiftrightunsigned("simhash", 48).cast("int").alias("prefix"))
    probes = rows.select("id", "simhash", F.explode(F.array(F.col("prefix") - 1, F.col("prefix"), F.col("prefix") + 1)).alias("prefix"))
    other = rows.select(F.col("id").alias("other"), F.col("simhash").alias("other_hash"), "prefix")
    pairs = probes.join(other, "prefix").where(F.col("id") < F.col("other")).withColumn("distance", hamming(F.col("simhash"), F.col("other_hash")))
    return pairs.where(F.col("distance") <= most).select("id", "other", "distance", confidence(F.col("distance")).alias("confidence"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder: the lineage of a loop ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counting(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """df as written, and how many of its rows meet a condition, counted while they are written."""
    seen = Observation()
    made = written(df.observe(seen, F.count_if(condition).alias("n")), name)
    return made, seen.get["n"]


def clusters(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id and label, the least id of its connected component. Labels are written after each round, until none changes.

    A row takes the least label among its own and its neighbours', then that label's label, and that one's; so the way that a
    label has come grows threefold in a round, and chains of any length take few of them.
    """
    both = written(pairs.select("id", "other").union(pairs.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct(), "edges")
    labels = nodes.select("id", F.col("id").alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        for _ in range(2):
            step = step.join(labels.select(F.col("id").alias("next"), F.col("label").alias("up")), "next").select("id", "label", F.least("next", "up").alias("next"))
        step, changed = written_counting(step, "labels", F.col("label") != F.col("next"))
        labels = step.select("id", F.col("next").alias("label"))
        if not changed:
            return labels


def new_rows(candidates: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not stored."""
    return candidates.join(stored.select(key), key, "left_anti")


def repeated_keys(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys with more than one member and how many there are."""
    return df.groupBy(key).agg(F.count_distinct(member).alias("n")).where("n > 1")


def threshold_table(pairs: DataFrame, distance: str, label: str, thresholds: tuple[int, int] = (4, 16)) -> DataFrame:
    """Confusion counts, precision, recall and F1 of `distance <= threshold` for each threshold, in one pass."""
    rows = pairs.select(F.col(distance).alias("d"), (F.col(label) == 1).alias("same"), F.explode(F.sequence(F.lit(thresholds[0]), F.lit(thresholds[1]))).alias("threshold"))
    hit = F.col("d") <= F.col("threshold")
    out = rows.groupBy("threshold").agg(F.count_if(hit & F.col("same")).alias("tp"), F.count_if(hit & ~F.col("same")).alias("fp"), F.count_if(~hit & F.col("same")).alias("fn"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def first_in_batch(df: DataFrame, url: str, digest: str, order: str) -> DataFrame:
    """Rows kept by the greedy rule: neither their url nor their digest was claimed by an earlier kept row.

    Of each (url, digest) only the least row can be kept, so that is all that the rounds see. In each round an undecided
    row that is first for its url and for its digest is kept, and the rows that share either with it are dropped. Each
    round is joins on both keys with minima combined before the shuffle; the first undecided row is always decided.
    """
    least = df.groupBy(url, digest).agg(F.min(order).alias("id")).select(F.col(url).alias("u"), F.col(digest).alias("d"), "id")
    (open_, left), kept = written_counting(least, "batch", F.lit(True)), None
    while left:
        by = {k: open_.groupBy(k).agg(F.min("id").alias(f"first_{k}")) for k in ("u", "d")}
        marked = open_
        for k, firsts in by.items():
            marked = marked.alias("m").join(firsts.alias("f"), F.expr(f"m.{k} <=> f.{k}")).select("m.*", f"first_{k}")
        chosen = written(marked.where("id = first_u AND id = first_d").select("u", "d", "id"), "batch-kept")
        kept = chosen if kept is None else kept.unionByName(chosen)
        rest = open_
        for k in ("u", "d"):
            rest = rest.alias("r").join(chosen.select(k).distinct().alias("c"), F.expr(f"r.{k} <=> c.{k}"), "left_anti")
        open_, left = written_counting(rest, "batch", F.lit(True))
    return df.limit(0) if kept is None else df.join(kept.select(F.col("id").alias(order)), order, "left_semi")
