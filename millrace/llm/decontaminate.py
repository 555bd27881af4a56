"""Benchmark decontamination over a distributed positional inverted index.

1. The corpus is cut into segments of bounded size, and each segment's positional postings are stored as one row of
   an index table: for every term of its documents the sorted list of token positions, beside the documents' borders.
   The index knows nothing of a benchmark; any number of them are looked up in it without reading texts again.
2. The benchmark's distinct windows, with the items that hold them, are dealt to blocks of ``BLOCK_WORDS`` words; only
   one block at a time is sent to the executors, whatever the benchmark's size.
3. How often a block's terms stand in the corpus is summed from the index's list lengths.
4. Each window is looked up from its rarest term: that term's list, shifted by its offset in the window, is
   intersected with the shifted list of the next rarer term, and so on to the last. What remains are exact phrase
   matches. Windows whose three rarest terms stand within ``slop`` words of their places without an exact match there
   are proximity matches.

Lists are only ever intersected within a segment, which holds whole documents, so no step shuffles by term
and frequent terms or passages make no hot key.

Defined results: a null text has no words; an item without words has no window; an item of fewer than
``window`` words is one window; an item without id marks words but isn't named; repeated rows each get a row, also
those that share an id or have none; extra columns are ignored; results don't depend on the number of blocks.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import alnum_words, packed, stored, unpacked

#: Words of windows, and names of their items, that are looked up together, and so the bound of what is sent to executors.
BLOCK_WORDS = 2_000_000
#: Words of a segment after which it is closed; a longer document is a segment of its own.
SEGMENT_WORDS = 1_500_000
#: Candidate positions that are held at once.
CANDIDATES = 2_000_000

#: ``terms``: a segment's distinct words; ``lengths``: of their lists; ``steps``: the lists, one after another, each position as its distance from the
#: one before it in its list.
INDEX = pa.schema(
    [
        ("segment", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int64())),
        ("text_hash", pa.list_(pa.int64())),
        ("terms", pa.binary()),
        ("lengths", pa.binary()),
        ("steps", pa.binary()),
    ]
)
INDEX_DDL = "segment string, doc_ids array<long>, n_words array<long>, text_hash array<long>, terms binary, lengths binary, steps binary"


@dataclass
class Phrases:
    """The windows of a block of items. Window w has the terms ``terms[first[w]:first[w] + size[w]]``."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    first: np.ndarray
    size: np.ndarray
    items: list[list[str]]


def phrases(windows: list[tuple[str, list[str]]]) -> Phrases:
    """From windows, as words with single spaces, and the names of their items."""
    vocabulary: dict[bytes, int] = {}
    coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in words.encode().split(b" ")] for words, _ in windows]
    size = np.array([len(k) for k in coded], np.int64)
    return Phrases(vocabulary, np.array([t for k in coded for t in k], np.int64), np.cumsum(size) - size, size, [sorted(names) for _, names in windows])


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """``(words, names)``: the distinct windows of ``items (item_id, text)`` and the items that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = alnum_words(text)
                grams = {b" ".join(words[i : i + window]).decode() for i in range(max(1, len(words) - window + 1))} if words else set()
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([name] * len(grams), pa.string())], names=["words", "name"])

    own = items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "words string, name string")
    return own.groupBy("words").agg(F.collect_set("name").alias("names"))


# --- building the index -------------------------------------------------------------------------------


def _indexer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    part, number = context.partitionId() if context else 0, 0

    def close(ids: list, sizes: list, hashes: list, codes: list, vocabulary: defaultdict) -> pa.RecordBatch:
        code = np.concatenate(codes)
        places = np.argsort(code, kind="stable").astype(np.int32)
        lengths = np.bincount(code, minlength=len(vocabulary)).astype(np.int32)
        steps = np.diff(places, prepend=np.int32(0))
        first = np.cumsum(lengths) - lengths
        steps[first] = places[first]
        terms = zstandard.ZstdCompressor(level=1).compress(b" ".join(vocabulary))
        cells = [f"{part}-{number}", ids, sizes, hashes, terms, packed(lengths), packed(steps)]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, INDEX, strict=True)], schema=INDEX)

    # A text's words are held only until they are numbered: four bytes a word, beside the segment's distinct words.
    ids, sizes, hashes, codes, vocabulary, total = [], [], [], [], defaultdict(count().__next__), 0
    for batch in batches:
        for doc_id, text, text_hash in zip(*batch.columns, strict=True):
            words = alnum_words(text.as_py())
            ids.append(doc_id.as_py())
            sizes.append(len(words))
            hashes.append(text_hash.as_py())
            codes.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
            total += len(words)
            if total >= SEGMENT_WORDS:
                yield close(ids, sizes, hashes, codes, vocabulary)
                ids, sizes, hashes, codes, vocabulary, total, number = [], [], [], [], defaultdict(count().__next__), 0, number + 1
    if ids:
        yield close(ids, sizes, hashes, codes, vocabulary)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row per segment, with the postings of all its terms."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_indexer, INDEX_DDL), "postings")


def _terms(cell: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(cell).split(b" ") if zstandard.frame_content_size(cell) else []


def _known(cell: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The vocabulary's number of each of a segment's terms, -1 for others."""
    find = vocabulary.get
    return np.array([find(w, -1) for w in _terms(cell)], np.int64)


def frequencies(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """How often each term stands in the corpus; at most a row per term of the block comes to the driver."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, lengths in zip(batch.column(0).to_pylist(), unpacked(batch.column(1).to_pylist(), np.int32), strict=True):
                number = _known(terms, sent.value)
                kept = number >= 0
                yield pa.RecordBatch.from_arrays([pa.array(number[kept]), pa.array(lengths[kept].astype(np.int64))], names=["term", "n"])

    found = np.zeros(len(vocabulary), np.int64)
    for row in index.select("terms", "lengths").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        found[row["term"]] = row["n"]
    return found


# --- looking up ---------------------------------------------------------------------------------------


@dataclass
class Plan:
    """Windows in the order of their rarest terms; ``order[w, k]``: offset of the k-th rarest term."""

    terms: np.ndarray
    size: np.ndarray
    order: np.ndarray
    window_of: np.ndarray
    first_of_term: np.ndarray
    items: list[list[str]]
    vocabulary: dict[bytes, int]


def plan(p: Phrases, counts: np.ndarray, window: int) -> Plan:
    n = len(p.size)
    terms = np.full((n, window), -1, np.int64)
    rare = np.full((n, window), np.iinfo(np.int64).max, np.int64)
    within = np.arange(len(p.terms)) - np.repeat(p.first, p.size)
    row = np.repeat(np.arange(n), p.size)
    terms[row, within] = p.terms
    rare[row, within] = counts[p.terms]
    order = np.argsort(rare, axis=1, kind="stable")
    rarest = terms[np.arange(n), order[:, 0]] if n else np.zeros(0, np.int64)
    window_of = np.argsort(rarest, kind="stable")
    first = np.searchsorted(rarest[window_of], np.arange(len(p.vocabulary) + 1))
    return Plan(terms, p.size, order, window_of, first, p.items, p.vocabulary)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. counts[i] - 1 for each i."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def match(plan: Plan, n_words: np.ndarray, terms: np.ndarray, lengths: np.ndarray, positions: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Exact matches (start, window) and proximity matches (start, window) in a segment.

    ``positions``: the lists of ``terms``, ascending, one after another, each sorted.
    """
    ends = np.cumsum(n_words)
    # All lists as one sorted one: a term's list is a stretch of it, sought by halving.
    posts = (np.repeat(terms, lengths) << 32) | positions

    def stands(term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (term << 32) | place
        at = np.minimum(np.searchsorted(posts, key), len(posts) - 1)
        return posts[at] == key

    per_term = plan.first_of_term[terms + 1] - plan.first_of_term[terms]
    exact, near = ([], []), ([], [])
    times, first = np.repeat(per_term, lengths), np.repeat(plan.first_of_term[terms], lengths)
    used = np.flatnonzero(times)
    seeds, times, first = positions[used], times[used], first[used]
    total = np.cumsum(times)
    cut = 0
    while cut < len(seeds):
        to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + CANDIDATES)))
        t = times[cut:to]
        window = plan.window_of[np.repeat(first[cut:to], t) + _spread(t)]
        seed = np.repeat(seeds[cut:to], t)
        start = seed - plan.order[window, 0]
        doc = np.searchsorted(ends, seed, side="right")
        ok = (start >= (ends - n_words)[doc]) & (start + plan.size[window] <= ends[doc])
        start, window, doc = start[ok], window[ok], doc[ok]
        cut = to
        left = np.arange(len(start))
        for k in range(1, plan.terms.shape[1]):
            offset = plan.order[window[left], k]
            over = k >= plan.size[window[left]]
            there = over | stands(plan.terms[window[left], np.where(over, 0, offset)], start[left] + offset)
            left = left[there]
        exact[0].append(start[left])
        exact[1].append(window[left])
        if slop and len(start):
            other = np.ones(len(start), bool)
            other[left] = False
            other &= plan.size[window] >= 3
            s, w, d = start[other], window[other], doc[other]
            for k in (1, 2):
                offset = plan.order[w, k]
                found = np.zeros(len(s), bool)
                for shift in range(-slop, slop + 1):
                    place = s + offset + shift
                    inside = (place >= (ends - n_words)[d]) & (place < ends[d])
                    found |= inside & stands(plan.terms[w, offset], np.maximum(place, 0))
                s, w, d = s[found], w[found], d[found]
            near[0].append(s)
            near[1].append(w)
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return join(exact[0]), join(exact[1]), join(near[0]), join(near[1])


RESULT_DDL = "segment string, place int, doc_id long, text_hash long, n_words long, n_hit long, n_near long, hit_runs array<int>, items array<string>"


def _seeker(plan_of: Callable[[], Plan], slop: int, keep_runs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of RESULT_DDL from rows of the index. ``hit_runs``: start and end of each run of hit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_of()
        for batch in batches:
            for row in batch.to_pylist():
                n_words = np.array(row["n_words"], np.int64)
                number, lengths, steps = _known(row["terms"], plan.vocabulary), *unpacked([row["lengths"], row["steps"]], np.int32)
                # A list's positions are the sums of its steps.
                sums, borders = np.cumsum(steps, dtype=np.int64), np.cumsum(lengths, dtype=np.int64)
                before = np.concatenate([[0], sums])[borders - lengths] if len(lengths) else borders
                places = sums - np.repeat(before, lengths)
                kept = np.flatnonzero(number >= 0)
                kept = kept[np.argsort(number[kept])]
                at = np.repeat((borders - lengths)[kept], lengths[kept]) + _spread(lengths[kept])
                start, window, near_at, near_window = match(plan, n_words, number[kept], lengths[kept], places[at], slop)
                first = np.cumsum(n_words) - n_words
                mark = np.zeros(int(n_words.sum()) + 1, np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + plan.size[window], -1)
                hit = np.cumsum(mark)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[first + n_words] - total[first]
                owner = lambda at, first=first, n_words=n_words: np.searchsorted(first + n_words, at, side="right")
                n_near = np.bincount(np.unique(np.stack([owner(near_at), near_window]), axis=1)[0], minlength=len(first)) if len(near_at) else np.zeros(len(first), np.int64)
                items: dict[int, set[str]] = {}
                if len(start):
                    for d, w in np.unique(np.stack([owner(start), window]), axis=1).T.tolist():
                        items.setdefault(d, set()).update(plan.items[w])
                runs: list = [None] * len(first)
                for d in np.flatnonzero(n_hit).tolist() if keep_runs else ():
                    own = np.concatenate([[False], hit[first[d] : first[d] + n_words[d]], [False]])
                    runs[d] = np.flatnonzero(own[1:] != own[:-1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * len(first), pa.string()),
                        pa.array(np.arange(len(first), dtype=np.int32)),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["text_hash"], pa.int64()),
                        pa.array(n_words),
                        pa.array(n_hit),
                        pa.array(n_near.astype(np.int64)),
                        pa.array(runs, pa.list_(pa.int32())),
                        pa.array([sorted(items.get(d, ())) for d in range(len(first))], pa.list_(pa.string())),
                    ],
                    names=["segment", "place", "doc_id", "text_hash", "n_words", "n_hit", "n_near", "hit_runs", "items"],
                )

    return run


def _merged(rows: DataFrame) -> DataFrame:
    """The blocks' rows as one row per document. No two blocks have a window in common."""
    runs = F.expr("flatten(collect_list(transform(sequence(0, size(hit_runs) div 2 - 1), i -> struct(hit_runs[2 * i] as a, hit_runs[2 * i + 1] as b))))")
    rows = rows.withColumn("hit_runs", F.when(F.size("hit_runs") > 0, F.col("hit_runs")))
    one = rows.groupBy("segment", "place").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "text_hash", "n_words")], F.sum("n_near").alias("n_near"), runs.alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    covered = "aggregate(array_sort(r), struct(0L as n, 0 as upto), (s, x) -> struct(s.n + greatest(x.b - greatest(x.a, s.upto), 0) as n, greatest(x.b, s.upto) as upto), s -> s.n)"
    return one.select("doc_id", "text_hash", "n_words", F.expr(covered).alias("n_hit"), "n_near", "items")


def look_up(index: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2, item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document of the index: ``doc_id, text_hash, n_words, n_hit, n_near, items``.

    ``items``: sorted ids, as strings, of the items with a window in the document. ``n_near``: distinct windows with a
    proximity match.
    """
    sc = index.sparkSession.sparkContext
    own = stored(windows_of(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), window), "windows")
    words = own.agg(F.sum(F.size(F.split("words", " ")) + F.size("names"))).first()[0] or 0
    blocks = 1 + words // block_words
    rows = None
    for b in range(blocks):
        mine = own.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b) if blocks > 1 else own
        p = phrases([tuple(r) for r in mine.orderBy("words").collect()])
        sent = sc.broadcast(plan(p, frequencies(index, p.vocabulary), window))
        part = index.mapInArrow(_seeker(lambda sent=sent: sent.value, slop, blocks > 1), RESULT_DDL)
        rows = part if rows is None else rows.unionByName(part)
    return _merged(rows) if blocks > 1 else rows.drop("segment", "place", "hit_runs")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 2, id_col: str = "doc_id", text_col: str = "text", **of_items: object) -> DataFrame:
    """:func:`look_up` of a benchmark in the index of ``docs``."""
    return look_up(build_index(docs, id_col, text_col), benchmark, window, slop, **of_items)


def items_digest(items: list[str]) -> str:
    """Plain form of the digest that queries derive in Spark."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
