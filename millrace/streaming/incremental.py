"""New pages as a stream: each micro-batch is extracted and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import extract
from millrace.operators import relational as R
from millrace.sources.store import Store

PAGES = "target_id string, url string, detail_spec string, title string, html string, fetched_at timestamp"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Files of pages as they arrive."""
    return spark.readStream.schema(PAGES).parquet(path)


def ingest(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Saves the details of arriving pages whose address is new; stops when all that is there is done.

    A batch that is repeated after a failure finds its addresses known and adds nothing.
    """

    def save(batch: DataFrame, _: int) -> None:
        one = R.one_per_url(batch.withColumnRenamed("url", "detail_url"), order=("fetched_at",))
        fresh = store.new_articles(one)
        store.save_articles(extract.details(fresh).where("error is null").withColumn("group_id", F.lit("stream")))

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Pages a board and window, late ones up to ``late`` behind counted in theirs."""
    return stream.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", window), "target_id").agg(F.count("*").alias("n_pages"))
