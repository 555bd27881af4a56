"""Repositories on files: appended tables, upserts as a log by hash bucket, and claims that make starts and issues single.

What must be whole or not at all is written first and claimed last: an issue and the articles that it used carry a token, and readers
see the rows whose token the issue's claim holds.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from millrace.operators import relational as R
from millrace.sources.claims import Claims
from millrace.sources.keyed import Filters, KeyedLog, bucket_of, unknown

SCHEMAS = {
    "articles": "detail_url string, uniq_id string, title string, date string, date_type string, detail_content string, has_attached_file boolean, has_attached_image boolean, task_id long, target_id string, target_url string, group_id string, bucket int",
    "analysis": "detail_url string, tags array<string>, image_context string, score int, analysed_at timestamp",
    "newsletters": "id string, issue_order int, title string, html string, token string",
    "newsletter_articles": "issue_order int, detail_url string, token string",
    "failures": "task_id long, source string, error string",
    "tasks": "task_id long, started_at timestamp, completed_at timestamp",
}


#: Buckets of articles and analyses by address.
BUCKETS = 16


def scratch_root(spark: SparkSession) -> str:
    """A new folder below the shared one that ``spark.checkpoint.dir`` names; in a local session without it, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='millrace-')).rstrip('/')}/millrace/{uuid.uuid4().hex}"


class TaskRunning(RuntimeError):
    """A task is under way already, or none is."""


@dataclass
class Store:
    """Tables below ``root``; articles are laid out by bucket of their address, which is what they are sought by."""

    spark: SparkSession
    root: str

    @property
    def _analyses(self) -> KeyedLog:
        return KeyedLog(self.spark, f"{self.root}/analysis", SCHEMAS["analysis"], "detail_url", "analysed_at", BUCKETS)

    @property
    def _known(self) -> Filters:
        return Filters(self.spark, f"{self.root}/known", BUCKETS)

    def _claims(self, name: str) -> Claims:
        return Claims(self.spark, f"{self.root}/claims/{name}")

    def read(self, name: str) -> DataFrame:
        """A table as it stands: the newest analyses, and of issues and their articles those that are claimed."""
        if name == "analysis":
            return self._analyses.read()
        rows = self._raw(name)
        if name in ("newsletters", "newsletter_articles"):
            issues = self._claims("issues")
            tokens = [issues.text(n) for n in issues.names()]  # one an issue
            rows = rows.where(F.col("token").isin(tokens)).drop("token")
        return rows

    def _raw(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def append(self, name: str, rows: DataFrame) -> int:
        """Appends rows and says how many."""
        if name == "analysis":
            return self._analyses.append(rows)
        schema = self.spark.createDataFrame([], SCHEMAS[name]).schema
        rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        from pyspark.sql import Observation

        seen = Observation()
        writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append")
        (writer.partitionBy("bucket") if name == "articles" else writer).parquet(f"{self.root}/{name}")
        return seen.get["n"]

    def scratch(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` written below the store and read again, so that what made them runs once."""
        path = f"{self.root}/scratch/{uuid.uuid4().hex}/{name}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def find_by_urls(self, urls: DataFrame) -> DataFrame:
        return R.existing_articles(self.read("articles"), urls)

    def new_articles(self, rows: DataFrame) -> DataFrame:
        """``rows`` whose address isn't known. Known articles are only read where a filter can't rule an address out."""
        return unknown(rows, self._known, self._raw("articles"), "detail_url")

    def save_articles(self, rows: DataFrame) -> int:
        """Appends those whose address isn't known, one of each."""
        new = self.scratch(self.new_articles(R.one_per_url(rows)).withColumn("bucket", bucket_of(F.col("detail_url"), BUCKETS)), "new")
        # The filters first: what stops in between leaves addresses that pass a filter and aren't there, which costs a look.
        self._known.add(new, "detail_url")
        return self.append("articles", new.repartition("bucket"))

    def analysis(self) -> DataFrame:
        return self.read("analysis")

    def find_unscored(self) -> DataFrame:
        return R.unscored(self.read("articles"), self.analysis())

    def find_tags(self) -> DataFrame:
        return R.tag_vocabulary(self.analysis())

    def find_candidates(self, floors: DataFrame) -> DataFrame:
        scored = self.read("articles").join(self.analysis(), "detail_url")
        return R.candidates(R.effective_score(scored, floors), self.read("newsletter_articles"))

    def next_issue(self) -> int:
        return R.next_issue(self.read("newsletters")).first()[0]

    def save_newsletter(self, newsletter: DataFrame, used: DataFrame) -> str:
        """Saves an issue and the articles that it used, both or neither; an issue that is there already stays as it is."""
        row, token = newsletter.first(), uuid.uuid4().hex
        issues, number = self._claims("issues"), str(row["issue_order"])
        if number not in issues.names():
            self.append("newsletter_articles", used.select(F.lit(row["issue_order"]).alias("issue_order"), "detail_url", F.lit(token).alias("token")))
            self.append("newsletters", newsletter.withColumn("token", F.lit(token)))
            if issues.claim(number, token):
                return row["id"]
        return self.read("newsletters").where(F.col("issue_order") == row["issue_order"]).first()["id"]

    def create_task(self) -> int:
        """The number of a task that starts now; of starts at the same time one is let through."""
        tasks = self._claims("tasks")
        last = max(tasks.numbers(), default=0)
        if (last and f"{last}.done" not in tasks.names()) or not tasks.claim(str(last + 1)):
            raise TaskRunning("a task is running")
        self.append("tasks", self.spark.range(1).select(F.lit(last + 1).alias("task_id"), F.current_timestamp().alias("started_at")))
        return last + 1

    def complete_task(self, task_id: int) -> None:
        tasks = self._claims("tasks")
        if task_id not in tasks.numbers() or not tasks.claim(f"{task_id}.done"):
            raise TaskRunning(f"task {task_id} isn't running")
        started = self.read("tasks").where(F.col("task_id") == task_id).agg(F.min("started_at")).first()[0]
        self.append("tasks", self.spark.range(1).select(F.lit(task_id).alias("task_id"), F.lit(started).cast("timestamp").alias("started_at"), F.current_timestamp().alias("completed_at")))
