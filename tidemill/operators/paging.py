"""Pages of a table that changes while it is read: a cycle that takes each row once, and ranked lists that are read page by page."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.dedup import written
from tidemill.operators.ranking import after_cursor, oldest_page
from tidemill.session import new_path


class Cycle(NamedTuple):
    """rows: what was taken, with page and the name of its listing; pages and fetched: what was read; stopped: why, if it was."""

    rows: DataFrame
    pages: int
    fetched: int
    stopped: str | None


def paged_cycle(spark: SparkSession, listings: Iterable[tuple[str, Callable[[], DataFrame]]], process: Callable[[DataFrame], None], size: int, budget: int | None = None, time: str = "collected", key: str = "id") -> Cycle:
    """Read listings (name, current rows) one after the other in pages by (time, key), and hand each row to `process` once.

    A listing is read anew for each page, so rows may come, go or move to another listing meanwhile; what has been taken is
    written down and kept out of later pages by an anti-join. Rows that were seen count against the budget, which is checked
    before a page. A page is bounded, and so is what reaches the driver of it: its count and its last row.
    """
    seen, fetched, pages = new_path(spark, "seen"), 0, 0
    schema, stopped = None, None
    for name, current in listings:
        after = None
        while stopped is None:
            if budget is not None and fetched >= budget:
                stopped = "budget_reached"
                break
            rows = current()
            page = written(rows.orderBy(time, key).limit(size) if after is None else oldest_page(rows, time, key, after, size), "page")
            about = page.agg(F.count("*").alias("n"), F.max(F.struct(time, key)).alias("last")).first()
            if not about["n"]:
                break
            fetched += about["n"]
            if schema is None:
                schema = page.withColumn("page", F.lit(0)).withColumn("listing", F.lit("")).schema
                spark.createDataFrame([], schema).write.parquet(f"{seen}/n=none")
            before = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(seen)
            fresh = page.join(before.select(key), key, "left_anti").select(*page.columns).withColumn("page", F.lit(pages)).withColumn("listing", F.lit(name))
            fresh.write.parquet(f"{seen}/n={pages}")
            process(spark.read.schema(schema).parquet(f"{seen}/n={pages}"))
            pages += 1
            after = tuple(about["last"])
        if stopped:
            break
    if schema is None:
        empty = next(iter(listings))[1]().limit(0).withColumn("page", F.lit(0)).withColumn("listing", F.lit(""))
        return Cycle(empty, 0, 0, stopped)
    return Cycle(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(seen), pages, fetched, stopped)


class RankedTable:
    """A list kept in files of falling (score, key), so that a page deep in it reads the files it stands in and no others.

    Beside the rows stands an index with one row for each file: its greatest and least score and how many rows it has. Null scores
    count as 0 when the list is written, so that comparisons with a cursor reach the scan as they are.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id") -> None:
        self.spark, self.path, self.key = spark, path, key

    def write(self, df: DataFrame, score: str = "score", files: int | None = None) -> RankedTable:
        rows = df.withColumn("rank_score", F.coalesce(F.col(score), F.lit(0.0)))
        order = [F.desc("rank_score"), F.desc(self.key)]
        dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
        dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{self.path}/rows")
        stored = self.spark.read.parquet(f"{self.path}/rows").select("rank_score", F.col("_metadata.file_path").alias("file"))
        about = stored.groupBy("file").agg(F.max("rank_score").alias("high"), F.min("rank_score").alias("low"), F.count("*").alias("n"))
        about.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index")
        return self

    def files_for(self, size: int, cursor: tuple[float, int] | None) -> list[str]:
        """The files that hold the next size + 1 rows behind a cursor: a few rows of the index, never of the list.

        A file of which the cursor's score is part may have all of its rows before the cursor, so only those below it are counted on.
        """
        index = self.spark.read.parquet(f"{self.path}/index")
        index = index if cursor is None else index.where(F.col("low") <= cursor[0])
        found, sure = [], 0
        for r in index.orderBy(F.desc("high"), F.desc("low"), "file").toLocalIterator():
            if sure > size and r["high"] < floor:
                break
            found.append(r["file"])
            sure += r["n"] if cursor is None or r["high"] < cursor[0] else 0
            floor = r["low"]
        return found

    def page(self, size: int, cursor: tuple[float, int] | None = None) -> DataFrame:
        """A page and one row more, which says whether there is another page."""
        files = self.files_for(size, cursor)
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        if not files:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*files)
        if cursor is not None:
            rows = rows.where((F.col("rank_score") <= cursor[0]) & after_cursor(F.col("rank_score"), F.col(self.key), *cursor))
        return rows.orderBy(F.desc("rank_score"), F.desc(self.key)).limit(size + 1)
