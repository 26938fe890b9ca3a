"""Saving articles from a stream: each micro-batch is a batch of the store, kept as Parquet that is only added to.

A store is a folder: `articles` has the rows as they were saved, `merges` the clusters that have become part of another
(label, root), `raises` confidences that later rows have raised, and `commits` one row for each batch that is complete. Each
batch writes its own partition of the first three and commits last. A batch that was committed is not saved again, and one that
was not is written anew, so a replay after a failure changes nothing; readers see committed batches only.

Clusters are never relabelled in place: a batch adds the roots that its own links have changed, and the labels that pointed to
them. Reading joins each row's label with its newest root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.storing import save_batch

ARTICLES = "id long, url string, content_hash string, simhash long, published timestamp, collected timestamp, cluster_id long, duplication_confidence double"
MERGES = "label long, root long"
RAISES = "id long, duplication_confidence double"
TABLES = {"articles": ARTICLES, "merges": MERGES, "raises": RAISES, "commits": "done boolean"}
FIRST = -1


class ArticleStore:
    """The store in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def create(self) -> ArticleStore:
        for name, schema in TABLES.items():
            self._put(self.spark.createDataFrame([(True,)] if name == "commits" else [], schema), name, FIRST)
        return self

    def _put(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.select(*[x.split(" ")[0] for x in TABLES[name].split(", ")]).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _all(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{TABLES[name]}, batch long").option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def committed(self) -> int:
        """The last complete batch; one row for each batch is looked at."""
        return self._all("commits").agg(F.max("batch")).first()[0]

    def roots(self, upto: int) -> DataFrame:
        return self._all("merges").where(F.col("batch") <= upto).groupBy("label").agg(F.max_by("root", "batch").alias("root"))

    def read(self, upto: int | None = None) -> DataFrame:
        """The articles with the clusters and confidences of now."""
        upto = self.committed() if upto is None else upto
        rows = self._all("articles").where(F.col("batch") <= upto).drop("batch")
        raised = self._all("raises").where(F.col("batch") <= upto).groupBy("id").agg(F.max("duplication_confidence").alias("raised"))
        rows = rows.join(self.roots(upto), F.col("cluster_id") == F.col("label"), "left").withColumn("cluster_id", F.coalesce("root", "cluster_id")).drop("root", "label")
        raise_ = F.greatest("duplication_confidence", F.coalesce("raised", F.lit(0.0)))
        return rows.join(raised, "id", "left").withColumn("duplication_confidence", raise_).drop("raised")

    def save(self, batch: DataFrame, number: int, **how: int) -> None:
        """Save the rows of batch `number`, unless that has been done."""
        before = self.committed()
        if number <= before:
            return
        saved = save_batch(batch, self.read(before), order="id", time="published", collected="collected", **how)
        self._put(saved.rows, "articles", number)
        moved = saved.moved.select(F.col("cluster_id").alias("label"), F.col("label").alias("root"))
        behind = self.roots(before).withColumnRenamed("root", "by").join(moved.select(F.col("label").alias("by"), "root"), "by").select("label", "root")
        self._put(moved.unionByName(behind), "merges", number)
        self._put(saved.raised, "raises", number)
        self._put(self.spark.createDataFrame([(True,)], TABLES["commits"]), "commits", number)


def save_stream(articles: DataFrame, store: ArticleStore, checkpoint: str, **how: int) -> None:
    """Save what a stream of prepared articles has now, from where its checkpoint stands."""
    run = articles.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, n: store.save(rows, n, **how)).start()
    run.awaitTermination()
