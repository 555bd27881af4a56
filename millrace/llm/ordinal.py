"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k | text) = sigmoid(theta_k - w . x), thresholds increasing, one weight vector shared by all grades.
x: hashed words of the text and their prefixes of 5 to 8 bytes, which stand for stems (each distinct one once,
scaled to unit length), beside a few measured shares, cut into bins. The model gives the expected grade and tail probabilities P(grade >= k); selection keeps texts whose
tail probability at ``keep_from`` reaches ``keep``.

Ratings come from the labels: 0 for toxic texts, 1 for texts of low quality, 2 for the others. The model is fitted
on at most ``SAMPLE`` labelled texts, those with the smallest hashes of their ids; features are made by the
executors and the fit is a bounded piece of work. Scoring is a map over all texts.

Defined results: a null text is empty and scored by its shares alone; texts without label are scored like others; a
label without text is ignored, null ratings count as clean; repeated labels of a text each weigh; without
labels every text gets the top grade; repeated rows each get a row; an id that stands in several rows is learnt from the text of the
smallest hash; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER

#: Hashed word features, and bins of the measured shares after them.
BUCKETS = 1 << 18
SHARES, BINS = 7, 12
SIZE = BUCKETS + SHARES * BINS
#: The most labelled texts that a model is fitted on.
SAMPLE = 12_000
GRADES = 3

_SYMBOLS = re.compile(rb"[^\w\s.,;:'\"()?\x80-\xff-]")
_EDGES = b".,;:!?\"'()[]{}<>*#$%&|"


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of a text's features."""
    data = (text or "").encode()
    words = data.split()
    lower = {w.strip(_EDGES) for w in data.translate(LOWER).split()}
    lower.discard(b"")
    stems = {w[:k] + b"\0" for w in lower if len(w) > 5 for k in range(5, min(9, len(w)))}
    lower |= stems
    places = np.unique(np.fromiter(map(zlib.crc32, lower), np.int64, len(lower)) & (BUCKETS - 1))
    n, size = max(1, len(words)), max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    capitals = len(data) - len(data.translate(None, bytes(range(65, 91))))
    shares = [
        math.log2(n) / 16,
        len(_SYMBOLS.findall(data)) / n,
        4 * capitals / size,
        1 - len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        (size / n) / 16,
        4 * sum(data.count(x) for x in (b"!", b"|", b"?")) / n,
    ]
    bins = [BUCKETS + k * BINS + min(BINS - 1, int(s * BINS)) for k, s in enumerate(shares)]
    values = np.full(len(places), 1 / math.sqrt(max(1, len(places))))
    return np.concatenate([places, bins]), np.concatenate([values, np.full(SHARES, 0.5)])


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


#: Texts whose features are looked at together, which bounds the fit's memory beside the features themselves.
CHUNK = 500


def fit(places: np.ndarray, ends: np.ndarray, grades: np.ndarray, rounds: int = 120, rate: float = 0.3, ridge: float = 2e-5) -> Model:
    """Full-batch Adam on the mean log likelihood with a ridge; thresholds are kept apart as log gaps.

    ``places``: all texts' places, one text after another; ``ends``: where each text's end. Grades weigh as the
    square roots of their counts, so that rare ones are learnt.
    """
    n = len(grades)
    if not n:
        return Model(np.zeros(SIZE), np.full(GRADES - 1, -20.0))
    first = np.concatenate([[0], ends[:-1]])

    def chunks():
        for i in range(0, n, CHUNK):
            own = slice(i, min(n, i + CHUNK))
            size = ends[own] - first[own]
            value = np.repeat(1 / np.sqrt(np.maximum(size - SHARES, 1)), size)
            value[(np.cumsum(size)[:, None] - 1 - np.arange(SHARES)).ravel()] = 0.5
            yield own, size, value, places[first[i] : ends[own.stop - 1]]

    counts = np.bincount(grades, minlength=GRADES)
    weight = 1 / np.sqrt(np.maximum(counts, 1)[grades])
    weight /= weight.sum()
    params = np.concatenate([np.zeros(SIZE), [-1.0], np.zeros(GRADES - 2)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    top, bottom = grades == GRADES - 1, grades == 0
    score = np.empty(n)
    for t in range(1, rounds + 1):
        w, least, gaps = params[:SIZE], params[SIZE], np.exp(params[SIZE + 1 :])
        theta = least + np.concatenate([[0.0], np.cumsum(gaps)])
        for own, size, value, place in chunks():
            score[own] = np.add.reduceat(value * w[place], np.cumsum(size) - size)
        cdf = 1 / (1 + np.exp(np.clip(score[:, None] - theta[None, :], -500, 500)))
        upper = np.where(top, 1.0, cdf[np.arange(n), np.minimum(grades, GRADES - 2)])
        lower = np.where(bottom, 0.0, cdf[np.arange(n), np.maximum(grades - 1, 0)])
        p = np.maximum(upper - lower, 1e-12)
        up, low = np.where(top, 0.0, upper * (1 - upper)), np.where(bottom, 0.0, lower * (1 - lower))
        d_score = weight * (up - low) / p  # of minus the log likelihood
        d_theta = np.zeros(GRADES - 1)
        np.add.at(d_theta, np.minimum(grades, GRADES - 2)[~top], -(weight * up / p)[~top])
        np.add.at(d_theta, np.maximum(grades - 1, 0)[~bottom], (weight * low / p)[~bottom])
        grad = np.concatenate([ridge * w, [d_theta.sum()], gaps * np.cumsum(d_theta[::-1])[::-1][1:]])
        for own, size, value, place in chunks():
            grad[:SIZE] += np.bincount(place, value * np.repeat(d_score[own], size), SIZE)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model(params[:SIZE], params[SIZE] + np.concatenate([[0.0], np.cumsum(np.exp(params[SIZE + 1 :]))]))


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)``: 0 toxic, 1 of low quality, 2 neither."""
    toxic, low = F.coalesce(F.col("toxic"), F.lit(0)) != 0, F.coalesce(F.col("quality"), F.lit(1)) == 0
    return labels.select("doc_id", F.when(toxic, 0).when(low, 1).otherwise(2).alias("grade"))


def _featuriser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t)[0].astype(np.int32) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=["grade", "places"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model fitted on at most ``sample`` labelled texts, chosen by the hash of their ids."""
    known = graded(labels).where("doc_id is not null")
    least = known.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = known.where(F.xxhash64("doc_id") <= F.lit(least if least is not None else 0)).limit(sample) if least is not None else known
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # ``chosen`` has at most ``sample`` rows of two numbers, so sending it costs less than moving texts. One text of each id is left.
    own = texts.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("t"))
    held = own.join(F.broadcast(chosen), "doc_id").select("grade", "t.text").mapInArrow(_featuriser, "grade int, places array<int>").toArrow().combine_chunks()
    if not held.num_rows:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    lists = held.column("places").chunk(0)
    flat, ends = lists.flatten().to_numpy(), np.cumsum(np.diff(lists.offsets.to_numpy().astype(np.int64)))
    return fit(flat, ends, held.column("grade").to_numpy().astype(np.int64))


def _scorer(model_of: Callable[[], Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for i, value in enumerate(batch.column(batch.num_columns - 1)):
                places, values = features(value.as_py())
                scores[i] = model.weights[places] @ values
            tails = model.tails(scores)
            out = [*batch.columns[:-1], pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1])]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:-1], "expected_grade", "p_from_1", "p_from_2"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, p_from_1, p_from_2`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(lambda: sent.value), "doc_id long, expected_grade double, p_from_1 double, p_from_2 double")


def select(docs: DataFrame, model: Model, keep: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`kept` keeps."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_names.index(text_col)
        for batch in batches:
            scores = np.array([sent.value.weights[p] @ v for p, v in (features(x.as_py()) for x in batch.column(at))])
            if batch.num_rows:
                yield batch.filter(pa.array(sent.value.tails(scores)[:, 1] >= keep))

    docs_names = docs.columns
    return docs.mapInArrow(run, docs.schema)


def kept(p_from_2: Column, keep: float = 0.5) -> Column:
    """Whether a text is selected: it is more likely than not of the top grade."""
    return p_from_2 >= keep
