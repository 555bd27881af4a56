"""The relational core: what is new, what is scored, what is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An issue appears with more articles than this, or with one of this score.
ARTICLES, PRIORITY = 5, 8


def one_per_url(crawled: DataFrame, key: str = "detail_url", order: tuple[str, ...] = ("crawled_at", "page_id", "pos")) -> DataFrame:
    """The first row of each address, in a total order. Rows meet as an aggregate, so each task sends one row of an address."""
    rest = [c for c in sorted(crawled.columns) if c not in order and c != key and crawled.schema[c].dataType.typeName() in ("string", "long", "integer")]
    by = F.struct(F.lit(0), *[F.col(c) for c in order if c in crawled.columns], *rest)
    return crawled.groupBy(F.col(key).alias("millrace_key")).agg(F.min_by(F.struct(*crawled.columns), by).alias("r")).select("r.*")


def new_articles(crawled: DataFrame, existing: DataFrame, key: str = "detail_url") -> DataFrame:
    """Rows whose key isn't known. Catalyst broadcasts the known keys only if they are small."""
    return crawled.join(existing.select(key).distinct(), key, "left_anti")


def existing_articles(existing: DataFrame, wanted: DataFrame, key: str = "detail_url") -> DataFrame:
    """Known rows whose key is asked for."""
    return existing.join(wanted.select(key).distinct(), key, "left_semi")


def unscored(articles: DataFrame, analysis: DataFrame, key: str = "detail_url") -> DataFrame:
    """Articles that no analysis has given a score yet."""
    return articles.join(analysis.where("score is not null").select(key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: str | list[str], newest: Column) -> DataFrame:
    """The newest row of each key: an upsert as it is read, by an aggregate. Ties go to the largest row by its text."""
    keys = [key] if isinstance(key, str) else key
    rest = F.to_json(F.struct(*[c for c in rows.columns if c not in keys]))
    newest_of = F.max_by(F.struct(*rows.columns), F.struct(newest.alias("a"), rest.alias("b")))
    return rows.groupBy(*[F.col(k).alias(f"millrace_{i}") for i, k in enumerate(keys)]).agg(newest_of.alias("r")).select("r.*")


def with_details(items: DataFrame, details: DataFrame, key: str = "detail_url", how: str = "inner") -> DataFrame:
    """List rows with what their pages say."""
    return items.join(details, key, how)


def with_context(items: DataFrame, targets: DataFrame, task_id: int | None = None) -> DataFrame:
    """Rows with their board's group, name and address. Boards are a catalogue of a few dozen rows."""
    own = targets.select("target_id", "group_id", F.col("url").alias("target_url"))
    return items.join(own, "target_id").withColumn("task_id", F.lit(task_id).cast("long"))


def effective_score(scored: DataFrame, floors: DataFrame, url: str = "target_url", score: str = "score") -> DataFrame:
    """``scored`` with ``effective_score``: the score, at least its board's floor; null where there is no score.

    ``floors (target_url, min_score)`` may repeat addresses; the highest floor counts.
    """
    one = floors.groupBy(F.col("target_url").alias("millrace_url")).agg(F.max("min_score").alias("min_score"))
    joined = scored.join(one, F.col(url) == F.col("millrace_url"), "left").drop("millrace_url")
    return joined.withColumn("effective_score", F.when(F.col(score).isNotNull(), F.greatest(F.col(score), F.col("min_score")))).drop("min_score")


def candidates(scored: DataFrame, used: DataFrame, key: str = "detail_url") -> DataFrame:
    """Scored articles that no issue has used."""
    return scored.where("effective_score is not null").join(used.select(key).distinct(), key, "left_anti")


def publication_gate(rows: DataFrame, by: list[str], articles: int = ARTICLES, priority: int = PRIORITY) -> DataFrame:
    """For each group its articles, best score, and whether it is published."""
    agg = rows.groupBy(*by).agg(F.count("*").alias("n_articles"), F.max("effective_score").alias("max_score"))
    return agg.withColumn("publish", (F.col("n_articles") > articles) | F.coalesce(F.col("max_score") >= priority, F.lit(False)))


def carry_over(rows: DataFrame, gate: DataFrame, by: list[str]) -> DataFrame:
    """Candidates of groups that aren't published; they stay candidates."""
    return rows.join(gate.where("publish").select(*by), by, "left_anti")


def top_articles(rows: DataFrame, k: int, key: str = "detail_url", by: list[str] | None = None) -> DataFrame:
    """The best ``k`` by effective score, then key; of each group if ``by`` is given."""
    if not by:
        return rows.orderBy(F.col("effective_score").desc(), key).limit(k)
    order = Window.partitionBy(*by).orderBy(F.col("effective_score").desc(), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def next_issue(newsletters: DataFrame, column: str = "issue_order") -> DataFrame:
    """One row: the number after the highest, 1 if there is none."""
    return newsletters.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_issue"))


def tag_vocabulary(tagged: DataFrame, column: str = "tags") -> DataFrame:
    """The distinct tags of all rows."""
    return tagged.select(F.explode(column).alias("tag")).where("tag is not null").distinct()


def rolled_up(rows: DataFrame, by: str, order: str, text: Column, separator: str = "\n\n") -> DataFrame:
    """One text of each group's rows, in order."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(held, lambda x: x["t"]), separator).alias("text"))
