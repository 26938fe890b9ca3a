"""Mixing sources to target weights along a time-varying curriculum (operator 10).

Each source gets a share of the words of the mix; a share stops at `most` times the source and the excess is shared
again. Within a source, documents stand in the order of a hash, and their words before them, taken against the
source's demand, say when they are trained: the source's weight schedule w(t) is integrated over the training time
t in [0, 1] and the cumulative demand is inverted at the document's words. A mix is range-sorted by that time.

Scale: sizes and keys are shuffled, not texts. Running sums are taken over range partitions of the order, which may cut
anywhere, also among rows of one document, so a source or a document with a third of all rows is summed by many tasks; one more
window sees one row for each source and partition, and one sees one row for each source. op10 writes the order of its takes (keys and positions) and adds it up by document.

Defined results: a null text has size 0; null sources form one source, the last; rows that repeat are each taken; a
source of size 0 has target 0; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import WORD, cut, free_name

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
#: Weight at the start and at the end of training, relative to the mean, for each place in WEIGHTS.
SCHEDULE = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
BUCKETS = 4096
#: Columns of a mix; those of a mix that is mixed again are replaced.
ADDED = ("mix_epoch", "mix_words", "mix_position")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, place (in weights), target; sizes has source and size.

    The targets are least(most * size, level * weight) at the one level at which they add up to the mix: sources are
    ordered by the level at which they stop, and the first that does not stop fixes it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("place", F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") + 1))
    per = per.withColumn("stop", most * F.col("source_size") / F.col("weight"))
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    stopped = F.coalesce(F.sum(most * F.col("source_size")).over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    everyone = Window.partitionBy()
    per = per.withColumn("level", (share * F.sum("source_size").over(everyone) - stopped) / left)
    level = F.min_by(F.when(F.col("level") <= F.col("stop"), F.col("level")), F.when(F.col("level") <= F.col("stop"), F.col("stop")))
    per = per.withColumn("level", level.over(everyone))
    target = F.least((most * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "place", target.alias("target"))


def allot(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, buckets: int = BUCKETS, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, place, target, before, taken: what the mix takes of each document.

    before counts the source's words in front of the document. The target is taken from the source's documents in
    order, again from the first one after the last, so the last document taken may be cut. row names a column that is unique, if there is one; it is carried along
    as `row`, and rows of one doc_id and size then stand in the order of their texts' hashes.
    """
    own = [F.col(row).alias("row"), F.xxhash64("text").alias("mark")] if row else []
    # rows without an id are ranked by their texts, so they do not meet in one bucket
    name = F.when(F.col("doc_id").isNull(), F.concat(F.lit("text "), F.coalesce(F.xxhash64("text").cast("string"), F.lit("")))).alias("name")
    rows = docs.select(*own, "doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), name)
    rows = rows.withColumn("rank", F.md5(F.coalesce(F.col("doc_id").cast("string"), "name"))).drop("name")
    rows = rows.withColumn("bucket", F.pmod(F.conv(F.substring("rank", 1, 6), 16, 10).cast("int"), F.lit(buckets)))
    tie = "row" if row else "tie"
    rows = cut(rows if row else rows.withColumn(tie, F.monotonically_increasing_id()), "mix-sizes")  # texts are read once, for their sizes
    order = ["bucket", "rank", "doc_id", "size", *(["mark"] if row else []), tie]
    rows = rows.repartitionByRange("source", *order).sortWithinPartitions("source", *order).withColumn("part", F.spark_partition_id())
    rows = cut(rows, "mix-parts")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    targets = source_targets(parts.select("source", F.col("part_size").alias("size")), weights, share, most)
    parts = parts.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select("p.*", "source_size", "place", "target")
    # rows that agree in all but the tie are alike, so it does not matter which of them comes first
    inside = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = rows.alias("r").join(parts.alias("p"), F.expr("r.source <=> p.source AND r.part = p.part"))
    placed = placed.select("r.*", "source_size", "place", "target", (F.col("base") + F.col("inner")).alias("before")).drop(*([] if row else [tie]))
    words = F.round("target").cast("long")
    takes = [F.greatest(F.lit(0), F.least("size", words - k * F.col("source_size") - F.col("before"))) for k in range(most)]
    return placed.withColumn("takes", F.array(*takes)).withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, b: a + b)).drop("rank", "bucket", "part", "inner", "mark")


def position(words: Column, target: Column, start: Column, end: Column) -> Column:
    """The time at which a source has given `words` of its target, if its weight goes from start to end in a line.

    The demand is target * (start * t + (end - start) * t * t / 2), with start and end of mean 1; this is its inverse.
    """
    share, bend = words / target, end - start
    curved = (F.sqrt(start * start + 2 * bend * share) - start) / F.when(bend != 0, bend)
    return F.when(bend == 0, share / start).otherwise(curved)


def takes_placed(given: DataFrame, keys: list[str], schedule: tuple = SCHEDULE) -> DataFrame:
    """keys, size, mix_epoch, mix_words and mix_position of each take of what allot gives."""
    ends = [F.element_at(F.array(*[F.lit(float(x[k])) for x in schedule]), F.col("place") + 1) for k in (0, 1)]
    takes = given.select(*keys, "size", "before", "source_size", "target", "place", F.posexplode("takes").alias("mix_epoch", "mix_words")).where("mix_words > 0")
    middle = F.col("mix_epoch") * F.col("source_size") + F.col("before") + F.col("mix_words") / 2
    takes = takes.withColumn("mix_position", position(middle, F.greatest("target", F.lit(1.0)), *ends))
    return takes.select(*keys, "size", "mix_epoch", "mix_words", "mix_position")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, schedule: tuple = SCHEDULE) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position of each document: its takes in the training order, added up.

    The order is written first. How much is taken follows from the targets, when it is trained from the schedule, so
    only first_position (null where nothing is taken) tells schedules apart.
    """
    given = allot(docs, weights, share, most).withColumn("row", F.monotonically_increasing_id())
    given = cut(given.select("row", "doc_id", "size", "source_size", "place", "target", "before", "takes"), "mix-given")
    order = takes_placed(given, ["row"], schedule).repartitionByRange("mix_position", "row")
    order = cut(order.sortWithinPartitions("mix_position", "row"), "mix-order")
    sums = order.groupBy("row").agg(F.sum("mix_words").alias("taken"), F.min("mix_position").alias("first_position"))
    taken = F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    return given.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", taken, "first_position")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, schedule: tuple = SCHEDULE) -> DataFrame:
    """The mix itself: the columns of docs, one row for each time that a document is taken, and the columns
    mix_epoch, mix_words (those taken of it, its first) and mix_position, range-sorted by position. Columns of docs with
    these names are left out.

    The text of a cut document ends after its last taken word. Where doc_ids repeat or are null, rows are written with
    numbers of their own, so each has its own takes; else the doc_id is the number, and texts are not written for it.
    """
    docs = docs.drop(*ADDED)
    row = free_name(docs, "row")
    unique = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").limit(1).count()
    docs = docs.withColumn(row, F.col("doc_id")) if unique else cut(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    given = allot(docs, weights, share, most, row=row).where("taken > 0")
    size = free_name(docs, "size")
    takes = takes_placed(given, ["row"], schedule).select(F.col("row").alias(row), F.col("size").alias(size), "mix_epoch", "mix_words", "mix_position")
    joined = docs.join(takes, row)
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("mix_words") < F.col(size), F.array_join(F.slice(words, F.lit(1), F.col("mix_words").cast("int")), "")).otherwise(F.col("text"))
    return joined.withColumn("text", text).drop(row, size).repartitionByRange("mix_position").sortWithinPartitions("mix_position")
