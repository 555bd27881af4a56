"""Ranked lexical search: accumulator-limited, term at a time, over document-partitioned postings.

1. The corpus is cut into segments of bounded size. A segment's postings are one row of a stored index: for every term
   the documents that hold it and how often, with the largest count and the shortest document of the list, from which
   a bound of what the term can add to a score follows once the corpus' totals are known.
2. The items' distinct terms are dealt to blocks of ``BLOCK_TERMS``; one block at a time is sent to the executors.
   Document frequencies are summed from the index's list lengths, N and L from its documents.
3. In a segment each item's terms are taken rarest first. Every list opens accumulators for its documents until the
   bounds of the lists that are left add up to less than the k-th best partial score: a document without accumulator
   can't reach the best k any more. From then on lists only update the accumulators that are there, exactly; those
   whose score and remaining bounds stay below the k-th best go. A task keeps the best k of each item from segment
   to segment, and so its bar.
4. The best k of each task are cut to the best k in two steps, so that no window holds more than a share of all tasks' rows.

No step shuffles by term, so a frequent term makes no hot key, and what leaves a task is k rows an item.

Defined results: a null text or one without terms is no document (it counts neither in N nor in L); rows that share an
item id are one item with the terms of all; an item without terms has no rows; repeated documents each count and each
get a rank, a document without id comes last among equal scores; extra columns are ignored; results don't depend on
segments or blocks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import alnum_words, packed, stored, unpacked
from millrace.llm.decontaminate import _known, frequencies

#: Distinct terms of items that are looked up together, and so the bound of what is sent to executors, but for one item with more.
BLOCK_TERMS = 500_000
#: Words of a segment after which it is closed; a longer document is a segment of its own.
SEGMENT_WORDS = 1_500_000
#: Groups in which the tasks' best rows are cut before they meet.
SPREAD = 64

#: ``terms``: a segment's distinct words; ``lengths``: documents of each; ``steps``: the lists, one after another, each document as its distance from the
#: one before it; ``times``: how often each holds the term; ``most``, ``least``: the largest count and the shortest document of each list.
INDEX_DDL = "doc_ids array<long>, n_words array<long>, terms binary, lengths binary, steps binary, times binary, most binary, least binary"
_NAMES = [c.split()[0] for c in INDEX_DDL.split(", ")]
_TYPES = [pa.list_(pa.int64())] * 2 + [pa.binary()] * 6


def _close(ids: list, codes: list[np.ndarray], vocabulary: dict) -> pa.RecordBatch:
    """A segment's row, of documents with words; ``codes``: each document's words by number."""
    sizes = np.array([len(c) for c in codes], np.int64)
    key = np.sort(np.concatenate(codes).astype(np.int64) * len(codes) + np.repeat(np.arange(len(codes)), sizes))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(first, len(key)))
    term, doc = np.divmod(key[first], len(codes))
    lengths = np.bincount(term, minlength=len(vocabulary))
    border = np.cumsum(lengths) - lengths
    steps = np.diff(doc, prepend=0)
    steps[border] = doc[border]
    terms = zstandard.ZstdCompressor(level=1).compress(b" ".join(vocabulary))
    numbers = [lengths.astype(np.int32), steps.astype(np.int32), times.astype(np.int32), np.maximum.reduceat(times, border).astype(np.int32), np.minimum.reduceat(sizes[doc], border).astype(np.int32)]
    cells = [ids, sizes, terms, *map(packed, numbers)]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, _TYPES, strict=True)], names=_NAMES)


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, codes, vocabulary, total = [], [], defaultdict(count().__next__), 0
    for batch in batches:
        for doc_id, text in zip(*batch.columns, strict=True):
            words = alnum_words(text.as_py())
            if not words:
                continue
            ids.append(doc_id.as_py())
            codes.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            total += len(words)
            if total >= SEGMENT_WORDS:
                yield _close(ids, codes, vocabulary)
                ids, codes, vocabulary, total = [], [], defaultdict(count().__next__), 0
    if ids:
        yield _close(ids, codes, vocabulary)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row per segment, with the postings of all its terms. It serves any items."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_indexer, INDEX_DDL), "postings")


def terms_of(items: DataFrame) -> DataFrame:
    """``(item_id, terms)``: the distinct terms of each id of ``items (item_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                terms = {w.decode() for w in alnum_words(text.as_py())}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array([0] * len(terms), pa.int32())), pa.array(terms, pa.string())], names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    own = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term string").distinct()
    return own.groupBy("item_id").agg(F.collect_list("term").alias("terms"))


@dataclass
class Block:
    """Items of a block: each with its terms' numbers, rarest first. ``weights``: of every number."""

    vocabulary: dict[bytes, int]
    items: list[np.ndarray]
    weights: np.ndarray
    n_docs: int
    n_words: int


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _block(items: list[list[str]], index: DataFrame, n_docs: int, n_words: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    numbers = [np.array([vocabulary.setdefault(t.encode(), len(vocabulary)) for t in terms], np.int64) for terms in items]
    df = frequencies(index, vocabulary)
    return Block(vocabulary, [n[np.lexsort((n, df[n]))] for n in numbers], weights(df, n_docs), n_docs, n_words)


@dataclass
class Lists:
    """A segment's lists of a block's terms: of number t those at ``first[t]`` up to ``end[t]``; ``bound[t]``: the most that it adds."""

    docs: np.ndarray
    times: np.ndarray
    first: np.ndarray
    end: np.ndarray
    bound: np.ndarray
    norm: np.ndarray


def _part(times: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * times) // (1000 * times + 8 * norm)


def _lists(row: dict, block: Block) -> Lists:
    lengths, steps, times, most, least = (x.astype(np.int64) for x in unpacked([row[c] for c in ("lengths", "steps", "times", "most", "least")], np.int32))
    sums, border = np.cumsum(steps), np.cumsum(lengths)
    docs = sums - np.repeat(np.concatenate([[0], sums])[border - lengths], lengths)
    number = _known(row["terms"], block.vocabulary)
    kept = np.flatnonzero(number >= 0)
    first, end, bound = (np.zeros(len(block.vocabulary), np.int64) for _ in range(3))
    norm = lambda n: 10 + (90 * n * block.n_docs) // block.n_words
    first[number[kept]], end[number[kept]] = (border - lengths)[kept], border[kept]
    bound[number[kept]] = block.weights[number[kept]] * _part(most[kept], norm(least[kept]))
    return Lists(docs, times, first, end, bound, norm(np.array(row["n_words"], np.int64)))


def best_of_segment(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int, bar: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents, by place, and whole scores above 0 of all that can be among the best ``k``.

    ``terms``: of an item, rarest first. ``bar``: a score that ``k`` documents elsewhere reach. ``score``: zeros, one a document, and left so.
    """
    terms = terms[lists.end[terms] > lists.first[terms]]
    left = np.append(np.cumsum(lists.bound[terms][::-1])[::-1], 0).tolist()
    opened, at = np.zeros(0, np.int64), 0
    while at < len(terms) and (left[at] >= bar or not bar):
        t = terms[at]
        own = slice(lists.first[t], lists.end[t])
        docs = lists.docs[own]
        fresh = docs[score[docs] == 0]
        score[docs] += weights[t] * _part(lists.times[own], lists.norm[docs])
        opened = np.concatenate([opened, fresh[score[fresh] > 0]])
        at += 1
        if len(opened) >= k:
            bar = max(bar, int(np.partition(score[opened], len(opened) - k)[len(opened) - k]))
    sums = score[opened]
    score[opened] = 0
    opened, sums = (x[np.argsort(opened)] for x in (opened, sums))
    while at < len(terms):
        alive = sums + left[at] >= bar
        opened, sums = opened[alive], sums[alive]
        t = terms[at]
        own = slice(lists.first[t], lists.end[t])
        docs = lists.docs[own]
        place = np.minimum(np.searchsorted(docs, opened), len(docs) - 1)
        there = docs[place] == opened
        sums[there] += weights[t] * _part(lists.times[own][place[there]], lists.norm[opened[there]])
        at += 1
        if len(opened) >= k:
            bar = max(bar, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
    return opened, sums


RESULT_DDL = "item int, task int, doc_id long, score long"


def _seeker(block_of: Callable[[], Block], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best ``k`` documents of each item in all segments of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, context = block_of(), TaskContext.get()
        none = np.zeros(0, np.int64)
        best = [(none, none, np.zeros(0, bool))] * len(block.items)
        for batch in batches:
            for row in batch.to_pylist():
                lists = _lists(row, block)
                no_id = np.array([x is None for x in row["doc_ids"]], bool)
                ids = np.array([0 if x is None else x for x in row["doc_ids"]], np.int64)
                score = np.zeros(len(ids), np.int64)
                for i, terms in enumerate(block.items):
                    bar = int(best[i][0][-1]) if len(best[i][0]) == k else 0
                    docs, sums = best_of_segment(lists, terms, block.weights, k, bar, score)
                    if len(docs):
                        s, d, n = (np.concatenate(x) for x in zip(best[i], (sums, ids[docs], no_id[docs]), strict=True))
                        order = np.lexsort((d, n, -s))[:k]
                        best[i] = s[order], d[order], n[order]
        task = context.partitionId() if context else 0
        s, d, n = (np.concatenate([b[j] for b in best] or [none]) for j in range(3))
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b[0]) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.full(len(item), task, np.int32)), pa.array(d, pa.int64(), mask=n.astype(bool)), pa.array(s)], names=["item", "task", "doc_id", "score"])

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of the index for each item, scores above 0, equal ones by id."""
    spark = index.sparkSession
    own = stored(terms_of(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))), "items")
    totals = index.agg(F.sum(F.size("doc_ids")).alias("docs"), F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words")).first()
    n_terms = own.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, found = 1 + n_terms // block_terms, None
    for b in range(blocks):
        mine = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else own
        rows = mine.collect()  # at most some block_terms of terms
        sent = spark.sparkContext.broadcast(_block([r["terms"] for r in rows], index, totals["docs"] or 0, totals["words"] or 1))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {own.schema['item_id'].dataType.simpleString()}")
        part = index.mapInArrow(_seeker(lambda sent=sent: sent.value, k), RESULT_DDL)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for by in (["item", F.col("task") % SPREAD], ["item"]):
            part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
        part = part.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # one row an item of the block
        found = part if found is None else found.unionByName(part)
    return found
