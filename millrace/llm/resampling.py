"""Target-distribution importance resampling: hashed n-gram weights, a bisected cutoff, range-partitioned ranks.

1. Runs of one to three words are hashed to ``BUCKETS`` buckets. Each task counts its rows' buckets in one array; the arrays
   are summed by bucket, for the corpus and for the target, and give each bucket's gain: the log ratio of its shares.
2. The gains, an array of fixed size, are sent to all tasks, where a document's weight is the sum over its features. Adding
   Gumbel noise from a hash of its id makes the best k of all scores a draw of k without replacement by weight.
   Scores are stored with a number for each row, so all that follows reads narrow columns of fixed content.
3. The cutoff is found by bisection: exact counts of rows below thresholds, in repeated jobs that each halve what is left
   ``HALVINGS`` times; first of the score, then of the ids that tie there, last of the numbers of rows that share both.
4. The drawn rows are partitioned by range and sorted; a row's rank is its place in its partition after the rows of all earlier ones.

Neither a sort of all rows nor their scores reach one task or the driver.

Defined results: a null text has no words; a text without words has weight 0; a row without id is hashed as the empty id and comes last
among equal scores; repeated rows are rows of their own, of which any are drawn if the cutoff runs through them; an empty table, or one
without texts of ``least`` words, gives no ranks; an empty target has no features; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import alnum_words, stored

#: Buckets of features, words of the longest feature, and how often a counting job halves a range.
BUCKETS, LONGEST, HALVINGS = 10_000, 3, 5
SEED = 42


def feature_buckets(words: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words, repeats included."""
    joined, crc = b" ".join(words), zlib.crc32
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends.tolist()
    runs = [[crc(joined[a:b]) for a, b in zip(starts, ends[n:], strict=False)] for n in range(min(longest, len(words)))]
    return np.concatenate([np.array(r, np.int64) for r in runs]) % buckets if runs else np.zeros(0, np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket in all texts; what comes to the driver is one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(feature_buckets(alnum_words(text.as_py()), buckets), minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for r in texts.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r["bucket"]] = r["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target and in the source."""
    all_source, all_target = (float(x.sum() + len(x)) for x in (source, target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel number from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                words = alnum_words(text.as_py())
                held = feature_buckets(words, len(own))
                weight = int(own[held].sum())
                rows.append((len(words), len(held), weight, weight + noise(doc_id, seed)))
            numbers = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(numbers[:, i]) for i in range(4)]], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def cutoff(rows: DataFrame, keys: list[str], k: int, halvings: int = HALVINGS) -> list[int]:
    """The ``k``-th smallest tuple, from 1, of the whole numbers ``keys``, of rows that are ``k`` at least.

    Each job counts rows below 2 ** ``halvings`` - 1 thresholds and returns these counts alone.
    """
    found = []
    for c in keys:
        low, high = rows.agg(F.min(c), F.max(c)).first()
        before = 0
        while low < high:
            at = sorted({low + ((high + 1 - low) * i >> halvings) for i in range(1, 1 << halvings)} - {low})
            counts = rows.agg(*[F.count_if(F.col(c) < F.lit(t)) for t in at]).first()
            lower = [(t, n) for t, n in zip(at, counts, strict=True) if n < k]
            high = next((t - 1 for t, n in zip(at, counts, strict=True) if n >= k), high)
            low, before = lower[-1] if lower else (low, before)
        found.append(low)
        k -= before
        rows = rows.where(F.col(c) == low)
    return found


def _upto(keys: list[str], values: list[int]) -> Column:
    """Whether a row's tuple is at most ``values``."""
    either = lambda rest, kv: (F.col(kv[0]) < kv[1]) | ((F.col(kv[0]) == kv[1]) & rest)
    return reduce(either, reversed(list(zip(keys, values, strict=True))), F.lit(True))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of ``keys``, which no two rows share.

    Rows are dealt by range, sorted, and stored with their place in their partition; one count a partition comes to the driver.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftrightunsigned("place", 33)  # that function's numbers are a partition's number and, below 33 bits, a row's
    counts = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *[n for _, n in counts]]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "part long, before long")
    own = placed.withColumn("part", part).join(F.broadcast(starts), "part")  # a row a partition
    return own.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row; ``rank`` null for those that aren't drawn.

    Drawn are ``percent`` percent, rounded down, of the documents with ``least`` words or more, those of the highest scores.
    """
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    order = {"k_score": -F.col("score"), "k_none": F.col("doc_id").isNull().cast("long"), "k_id": F.coalesce("doc_id", F.lit(0).cast("long")), "k_row": F.monotonically_increasing_id()}
    rows = stored(scores(docs, gain, id_col, text_col, seed).withColumns(order), "scores")
    fit = rows.where(F.col("n_words") >= least)
    k = percent * fit.count() // 100
    keys = list(order)
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long")).drop(*keys)
    drawn = (F.col("n_words") >= least) & _upto(keys, cutoff(fit, keys, k))
    chosen = ranked(rows.where(drawn), keys)
    return chosen.unionByName(rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))).drop(*keys)
