"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are words (A-Z lowered, between white space) and a text's end. A context is what stands before a symbol: nothing, the word
before, or the two words before; a text's start stands in front of its first word. A context becomes a state of the tree if training
holds it ``LEAST`` times or more and the distribution after it diverges from that after its longest proper suffix: the count-weighted
Kullback-Leibler divergence, the sum of ``n(c, s) * ln(P(s | c) / P(s | suffix))`` over what follows it, reaches ``DIVERGENCE`` nats.
The root is always a state, and so is a text's start.

A symbol is scored by the longest suffix of what precedes it that is a state, whose distribution is smoothed towards that of its own
longest suffix that is a state: ``(n(c, s) + l(c) * P(s | suffix)) / (n(c) + l(c))``, with ``l(c) = SCALE * n(c) ** POWER`` because
contexts that occur more have more symbols still unseen. The root is ``(n(s) + V * spelt(s)) / (N + V)``, where spelt is a distribution
over all strings: each byte given the one before, with a mark of its own (no byte) at both ends.

All that is learnt grows with the corpus, so nothing of the tree is collected or broadcast but the table of byte pairs, which has at most
257 * 257 entries. Training and scoring share two exchanges between segments and buckets:

1. Documents are cut into segments of bounded size, each a row with its numbered words.
2. Every segment deals its distinct words and word pairs, hashed, to buckets; a bucket sums their training counts over all segments
   and gives each segment the sums in the order that it asked.
3. Every segment deals its contexts, and the triples whose context occurs ``LEAST`` times and whose last pair occurs. A bucket, which
   holds all of a context, sums triples and divergence, decides on the state, and answers with states and counts.
4. Every segment scores its documents. Copies of a gram in a segment travel once, so a frequent word or passage is a row per segment.

Words are known by 64-bit hashes, pairs and contexts by the 32 bits after those of their bucket, whose size is bounded, and what follows a
context by 24 bits.

Defined results: null and empty texts are the end alone; documents without id are trained on as id '' would be (their remainder is taken
from the empty string); repeated rows each count and get a row; any byte may stand in a word; extra columns are ignored. Without any
training document all counts are 0, every token's base is log10(0.5 / 0.5) and words are scored by their spelling alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import packed, stored, unpacked

#: Occurrences that a state needs, and the divergence in nats.
LEAST, DIVERGENCE = 2, 8.0
#: The weight of a state's suffix.
SCALE, POWER = 3.0, 0.75
#: Tokens of a segment after which it is closed; a longer document is a segment of its own.
SEGMENT_TOKENS = 2_000_000
#: Buckets, at least, as a power of two; tokens of the corpus for each bucket, about.
BUCKET_BITS, BUCKET_TOKENS = 7, 2_000_000
SEED = 42
#: The bits that tell apart what follows a context.
GRAM = np.uint64((1 << 24) - 1)
#: The mark at both ends of a word's spelling.
MARK = 256

# --- segments -----------------------------------------------------------------------------------------

SEGMENTS = "segment string, doc_ids array<long>, held_out array<boolean>, sizes array<int>, tokens binary, words binary, counts binary, n_train long, n_tokens long"


def _held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _segmenter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    part, number = context.partitionId() if context else 0, 0

    def close(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(pieces).combine_chunks()
        texts = pc.ascii_lower(t.column("text").combine_chunks())
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat = lists.flatten()
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        kept = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
        flat, owner = flat.filter(pa.array(kept)), owner[kept]
        coded = flat.dictionary_encode()
        tokens = coded.indices.to_numpy().astype(np.int32)
        words = coded.dictionary.cast(pa.large_binary()).cast(pa.binary())
        out = t.column("held_out").combine_chunks().to_numpy(zero_copy_only=False)
        counts = np.bincount(tokens[~out[owner]], minlength=len(words)).astype(np.int32)
        sizes = np.bincount(owner, minlength=len(lists)).astype(np.int32)
        spaced = zstandard.ZstdCompressor(level=1).compress(b" ".join(words.to_pylist()))
        cells = [f"{part}-{number}", t.column("doc_id").to_pylist(), out, sizes, packed(tokens), spaced, packed(counts), int(counts.sum()), len(tokens)]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 3, pa.int64(), pa.int64()]
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=names)

    # About five characters a token; sizes only steer where a segment is cut.
    pieces, held = [], 0
    for batch in batches:
        step, size = 0, np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        for i in range(batch.num_rows):
            own = int(size[i] - (size[step - 1] if step else 0))
            if held + own >= 5 * SEGMENT_TOKENS or i == batch.num_rows - 1:
                pieces.append(batch.slice(step, i + 1 - step))
                held, step = held + own, i + 1
                if held >= 5 * SEGMENT_TOKENS:
                    yield close(pieces)
                    pieces, held, number = [], 0, number + 1
    if pieces:
        yield close(pieces)


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored segments. ``tokens``: numbers of ``words``; ``sizes``: words of each document; ``counts``: of words in training."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _held_out(F.col(id_col)).alias("held_out"), F.coalesce(text_col, F.lit("")).alias("text"))
    return stored(rows.mapInArrow(_segmenter, SEGMENTS), "segments")


def words_of(cell: bytes) -> list[bytes]:
    """The words of a segment's cell; no word holds a space."""
    return zstandard.ZstdDecompressor().decompress(cell).split(b" ") if len(cell) > 0 and zstandard.frame_content_size(cell) else []


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes, in their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Segment:
    """A segment's positions: its documents' words and ends, one after another.

    ``symbol``, ``before``: numbers of words (V local ones), V the end, V + 1 the start; ``pair``, ``context``: places in ``pairs``, the
    sorted hashes of the symbol with the one before it, and of the two before it (-1 next to the start).
    """

    def __init__(self, held: pa.Table) -> None:
        cell = lambda name: held.column(name)[0]
        self.name, self.ids, self.out = cell("segment").as_py(), cell("doc_ids").values, cell("held_out").values.to_numpy(zero_copy_only=False)
        self.words = words_of(cell("words").as_py())
        self.sizes = cell("sizes").values.to_numpy().astype(np.int64) + 1
        total, n = int(self.sizes.sum()), len(self.words)
        self.ends = np.cumsum(self.sizes)
        first = self.ends - self.sizes
        self.symbol = np.full(total, n, np.int32)
        inner = np.ones(total, bool)
        inner[self.ends - 1] = False
        self.symbol[inner] = unpacked([cell("tokens").as_py()], np.int32)[0]
        self.before = np.empty_like(self.symbol)
        self.before[1:] = self.symbol[:-1]
        self.before[first] = n + 1
        self.train = np.repeat(~self.out, self.sizes)
        self.hashes = np.array([*map(xxhash.xxh64_intdigest, self.words, [SEED] * n), 1, 2], np.uint64)
        self.order = np.argsort(self.hashes[:n], kind="stable")
        self.pairs, self.pair = np.unique(_mix(self.hashes[self.before], self.hashes[self.symbol]), return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        self.context = np.empty_like(self.pair)
        self.context[1:] = self.pair[:-1]
        self.context[first] = -1

    def triples(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, at, triples, triple): places in ``pairs`` of contexts that may be states by ``counts`` of pairs; positions of triples of
        these whose last pair occurs; each distinct triple, sorted by its context's hash, and the triple of each of these positions."""
        may = self.context >= 0
        may[may] = counts[self.context[may]] >= LEAST
        contexts = np.unique(self.context[may])
        at = np.flatnonzero(may & (counts[self.pair] > 0))
        above = self.pairs[self.context[at]]
        key = (above & ~GRAM) | (_mix(above, self.hashes[self.symbol[at]]) >> np.uint64(40))
        triples, triple = np.unique(key, return_inverse=True)
        return contexts, at, triples, triple


# --- exchanges ----------------------------------------------------------------------------------------

#: What a segment asks of a bucket and what it is told. In the first exchange ``keys`` and ``counts`` are of words (level 1) or pairs (2); in
#: the second ``keys`` are contexts: of one word with ``gains``, parts of their divergence; of two with their ``counts``, the counts of their last
#: word, and the number of their triples, which follow with their counts and those of their last pair. Cells are packed numbers.
ASKED = "level int, bucket int, segment string, keys binary, counts binary, gains binary, lasts binary, inner binary, grams binary, times binary, ends binary"
TOLD = "level int, bucket int, segment string, a binary, b binary, fresh long"
ASKED_NAMES, TOLD_NAMES = ([c.split()[0] for c in ddl.split(", ")] for ddl in (ASKED, TOLD))
ASKED_KINDS = [pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 8]
TOLD_SCHEMA = pa.schema(list(zip(TOLD_NAMES, [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64()], strict=True)))


def packed_sums(sums: np.ndarray) -> bytes:
    """Whole numbers of up to 64 bits, each in as many bytes as the largest needs; that number of bytes comes first."""
    size = max(1, -(-int(sums.max(initial=0)).bit_length() // 8))
    planes = sums.astype("<u8").view(np.uint8).reshape(len(sums), 8).T[:size]
    return zstandard.ZstdCompressor(level=1).compress(bytes([size]) + planes.tobytes())


def unpacked_sums(cells: list[bytes]) -> list[np.ndarray]:
    """The numbers of each cell of :func:`packed_sums`."""
    out, open_ = [], zstandard.ZstdDecompressor().decompress
    for held in map(open_, cells):
        wide = np.zeros(((len(held) - 1) // held[0], 8), np.uint8)
        wide[:, : held[0]] = np.frombuffer(held, np.uint8, offset=1).reshape(held[0], -1).T
        out.append(wide.view("<u8").ravel())
    return out


#: Columns of ASKED that hold counts, which have no bound.
SUMS = {"counts", "lasts", "ends"}


def _dealt(level: int, name: str, bits: int, hashes: np.ndarray, counts: np.ndarray | None = None, gains: np.ndarray | None = None, lasts: np.ndarray | None = None, inner: np.ndarray | None = None, grams: tuple = ()) -> list[tuple]:
    """Rows of ASKED, one for each bucket: sorted ``hashes`` with columns beside; ``inner``: how many of the ``grams`` each has, in order."""
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    keys = hashes if level == 1 and counts is not None else ((hashes >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    there, starts = np.unique(bucket, return_index=True)
    cuts = [*starts.tolist(), len(hashes)]
    below = np.concatenate([[0], np.cumsum(inner, dtype=np.int64)])[cuts].tolist() if inner is not None else []
    rows = []
    for k, b in enumerate(there.tolist()):
        own, more = slice(cuts[k], cuts[k + 1]), slice(below[k], below[k + 1]) if grams else None
        columns = [(c, own) for c in (keys, counts, gains, lasts, inner)] + [(g, more) for g in grams or [None] * 3]
        cells = [None if c is None else (packed_sums if n in SUMS else packed)(c[at]) for n, (c, at) in zip(ASKED_NAMES[3:], columns, strict=True)]
        rows.append((level, b, name, *cells))
    return rows


def _batch(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(ASKED_KINDS), ASKED_KINDS, strict=True)], names=ASKED_NAMES)


def _counter(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words and pairs of each segment with their counts in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Segment(held := pa.Table.from_batches([batch.slice(i, 1)]))
                counts = unpacked([held.column("counts")[0].as_py()], np.int32)[0].astype(np.uint32)
                pairs = np.bincount(own.pair[own.train], minlength=len(own.pairs)).astype(np.uint32)
                rows = _dealt(1, own.name, bits, own.hashes[own.order], counts[own.order]) + _dealt(2, own.name, bits, own.pairs, pairs)
                yield from _batch(rows).to_batches()

    return run


def _joined(group: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All rows' numbers one after another, and how many each row has."""
    cells = group.column(name).to_pylist()
    parts = unpacked_sums(cells) if name in SUMS else unpacked(cells, kind)
    return np.concatenate(parts), np.array([len(p) for p in parts])


def _told(group: pa.Table, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None = None, fresh: int = 0) -> pa.Table:
    """Rows of TOLD: each asking segment's part of ``a`` and ``b``, which are numbers, sums if of 64 bits, and how many are whose."""
    parts = lambda x: [None] * group.num_rows if x is None else [(packed_sums if p.dtype == np.uint64 else packed)(p) for p in np.split(x[0], np.cumsum(x[1])[:-1])]
    columns = [group.column(k).to_pylist() for k in ("level", "bucket", "segment")]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, parts(a), parts(b), [fresh] + [0] * (group.num_rows - 1)], TOLD_SCHEMA, strict=True)], schema=TOLD_SCHEMA)


def _summer(group: pa.Table) -> pa.Table:
    """Counts of a bucket's words or pairs, summed over segments. ``fresh``: the distinct ones that training has."""
    keys, sizes = _joined(group, "keys", np.uint64 if group.column("level")[0].as_py() == 1 else np.uint32)
    distinct, place = np.unique(keys, return_inverse=True)
    sums = np.bincount(place, _joined(group, "counts", np.uint64)[0], len(distinct))
    return _told(group, (sums[place].astype(np.uint64), sizes), fresh=int((sums > 0).sum()))


def _decider(group: pa.Table) -> pa.Table:
    """Which of a bucket's contexts are states (``a``), and the counts of its triples (``b``), over all segments."""
    keys, sizes = _joined(group, "keys", np.uint32)
    distinct, place = np.unique(keys, return_inverse=True)
    if group.column("level")[0].as_py() == 1:
        gain = np.bincount(place, _joined(group, "gains", np.float32)[0].astype(float), len(distinct))
        return _told(group, ((gain >= DIVERGENCE)[place].astype(np.uint8), sizes))
    n, last = np.zeros(len(distinct)), np.zeros(len(distinct))
    n[place], last[place] = _joined(group, "counts", np.uint64)[0], _joined(group, "lasts", np.uint64)[0]
    of = np.repeat(place, _joined(group, "inner", np.uint32)[0])
    grams, inner = _joined(group, "grams", np.uint32)
    triples, triple = np.unique((of.astype(np.uint64) << np.uint64(24)) | grams, return_inverse=True)
    sums, ends = np.bincount(triple, _joined(group, "times", np.uint32)[0], len(triples)), np.ones(len(triples))
    ends[triple] = _joined(group, "ends", np.uint64)[0]
    known = np.flatnonzero(sums > 0)
    above = (triples[known] >> np.uint64(24)).astype(np.int64)
    ratio = np.log(sums[known] / n[above]) - np.log(ends[known] / last[above])
    gain = np.bincount(above, sums[known] * ratio, len(distinct))
    return _told(group, ((gain >= DIVERGENCE)[place].astype(np.uint8), sizes), (sums[triple].astype(np.uint64), inner))


class Known:
    """What a segment was told: counts of its symbols, also as contexts, and of its pairs."""

    def __init__(self, own: Segment, told: pa.Table, n_docs: int) -> None:
        parts = {k: sorted(zip(*(told.filter(pc.equal(told.column("level"), k)).column(c).to_pylist() for c in ("bucket", "a", "b")), strict=True)) for k in (1, 2, 11, 12)}
        whole = lambda k, c, kind: np.concatenate((unpacked_sums([p[c] for p in parts[k]]) if kind is np.uint64 else unpacked([p[c] for p in parts[k]], kind)) or [np.zeros(0, kind)])
        self.words = np.empty(len(own.words) + 2)
        self.words[own.order] = whole(1, 1, np.uint64)
        self.words[-2:] = n_docs  # ends, and starts as contexts
        self.pairs = whole(2, 1, np.uint64)
        self.states, self.states2, self.times = (whole(k, c, kind) for k, c, kind in ((11, 1, np.uint8), (12, 1, np.uint8), (12, 2, np.uint64)))


def _gainer(bits: int, n_docs: int, n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows of ASKED of the second exchange from a segment and the counts it was told."""

    def run(held: pa.Table, told: pa.Table) -> pa.Table:
        if not held.num_rows:
            return _batch([])
        own = Segment(held)
        known = Known(own, told, n_docs)
        train, v = own.train, len(own.words)
        prior = np.zeros(len(own.symbol))
        seen = known.pairs[own.pair] > 0
        prior[seen] = np.log(known.pairs[own.pair[seen]] / known.words[own.before[seen]])
        # Contexts of one word: all of the divergence is known here but its sum.
        gain = np.bincount(own.before[train], prior[train] - np.log(known.words[own.symbol[train]] / n), v + 2)[:v]
        rows = _dealt(1, own.name, bits, own.hashes[own.order], gains=gain[own.order].astype(np.float32))
        # Contexts of two: what their triples add to the divergence is known where these are summed.
        contexts, at, triples, triple = own.triples(known.pairs)
        place = np.zeros(len(own.pairs), np.int64)
        place[contexts] = np.arange(len(contexts))
        one = np.zeros(len(triples), np.int64)
        one[triple] = at
        times = np.bincount(triple[train[at]], minlength=len(triples)).astype(np.uint32)
        of = place[own.context[one]]
        order = np.argsort(of, kind="stable")
        grams = ((triples & GRAM).astype(np.uint32)[order], times[order], known.pairs[own.pair[one]][order])
        counts = known.pairs[contexts]
        at = np.flatnonzero(own.context >= 0)
        last = np.zeros(len(own.pairs), np.int32)
        last[own.context[at]] = own.before[at]
        lasts = known.words[last[contexts]].astype(np.uint64)
        rows += _dealt(2, own.name, bits, own.pairs[contexts], counts, None, lasts, np.bincount(of, minlength=len(contexts)).astype(np.uint32), grams)
        return _batch(rows)

    return run


# --- spelling -----------------------------------------------------------------------------------------


def _byte_pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(byte before * 257 + byte) along all words with their marks, and where each word's begin."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    last = np.cumsum(sizes) - 1
    now = np.full(int(sizes.sum()), MARK, np.int64)
    inner = np.ones(len(now), bool)
    inner[last] = False
    now[inner] = np.frombuffer(b"".join(words), np.uint8)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[:1] = MARK
    return before * (MARK + 1) + now, last + 1 - sizes


def _speller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, counts in zip(batch.column(0).to_pylist(), unpacked(batch.column(1).to_pylist(), np.int32), strict=True):
            pair, first = _byte_pairs(words_of(words))
            sums = np.bincount(pair, np.repeat(counts.astype(float), np.diff([*first, len(pair)])), (MARK + 1) ** 2)
            kept = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(sums[kept].astype(np.int64))], names=["pair", "n"])


def spelling(held: DataFrame, n_docs: int) -> np.ndarray:
    """log10 P(byte | byte before), flat; the end of a text is the word without bytes."""
    rows = held.select("words", "counts").mapInArrow(_speller, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    n = np.full((MARK + 1) ** 2, 0.5)
    for r in rows:  # at most 257 * 257
        n[r["pair"]] += r["n"]
    n[-1] += n_docs
    n = n.reshape(MARK + 1, -1)
    return np.log10(n / n.sum(axis=1, keepdims=True)).ravel()


def spelt(table: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log10 probability of each word among all strings."""
    pair, first = _byte_pairs(words)
    return np.add.reduceat(table[pair], first)


# --- scoring ------------------------------------------------------------------------------------------

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def smoothed(times: np.ndarray, n: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """P(s | c) from n(c, s), n(c) and the suffix's probability."""
    weight = SCALE * n**POWER
    return (times + weight * suffix) / (n + weight)


def _scorer(table_of: Callable[[], np.ndarray], n_docs: int, n: int, v: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    whole, weight = n + 0.5 * (v + 1), max(v, 1)

    def run(held: pa.Table, told: pa.Table) -> pa.Table:
        if not held.num_rows:
            return SCORES_ARROW.empty_table()
        own = Segment(held)
        known = Known(own, told, n_docs)
        base = np.log10((known.words + 0.5) / whole)
        # A word's smallest probability is a float's smallest, however long the word.
        root = np.log10(np.maximum(known.words[:-1] / (n + weight), 0) + 10 ** np.maximum(spelt(table_of(), [*own.words, b""]) + np.log10(weight / (n + weight)), -300))
        p = 10 ** root[own.symbol]
        states = np.zeros(len(own.words) + 2, bool)
        states[own.order] = known.states
        states &= known.words >= LEAST
        states[-1] = n_docs > 0
        at = np.flatnonzero(states[own.before])
        p[at] = smoothed(known.pairs[own.pair[at]].astype(float), known.words[own.before[at]], p[at])
        contexts, where, triples, triple = own.triples(known.pairs)
        deep, times = np.zeros(len(own.pairs) + 1, bool), np.zeros(len(own.symbol))
        deep[contexts] = known.states2
        # Triples came back in the order of their contexts.
        one = np.zeros(len(triples), np.int64)
        one[triple] = where
        place = np.zeros(len(own.pairs), np.int64)
        place[contexts] = np.arange(len(contexts))
        counts = np.empty(len(triples))
        counts[np.argsort(place[own.context[one]], kind="stable")] = known.times
        times[where] = counts[triple]
        at = np.flatnonzero(deep[own.context])
        p[at] = smoothed(times[at], known.pairs[own.context[at]].astype(float), p[at])
        sums = lambda x: np.add.reduceat(x, own.ends - own.sizes)
        columns = [own.ids, own.out, own.sizes, sums((known.words > 0)[own.symbol].astype(np.int64)), sums(base[own.symbol]), sums(np.log10(p))]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=SCORES_ARROW)

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    held = segments(docs, id_col, text_col)
    outs = F.expr("aggregate(held_out, 0L, (n, x) -> n + if(x, 0, 1))")
    row = held.agg(F.sum("n_train").alias("n"), F.sum("n_tokens").alias("tokens"), F.sum(outs).alias("docs")).first()
    n_docs = row["docs"] or 0
    n = (row["n"] or 0) + n_docs
    bits = max(BUCKET_BITS, ((row["tokens"] or 0) // BUCKET_TOKENS).bit_length())
    sent = docs.sparkSession.sparkContext.broadcast(spelling(held, n_docs))

    lean = held.select("segment", "doc_ids", "held_out", "sizes", "tokens", "words")
    counted = held.mapInArrow(_counter(bits), ASKED).groupBy("level", "bucket").applyInArrow(_summer, TOLD)
    counted = stored(counted.select("segment", "level", "bucket", "a", "b", "fresh"), "counted")
    v = (counted.where("level = 1").agg(F.sum("fresh")).first()[0] or 0) + (n_docs > 0)
    asked = lean.groupBy("segment").cogroup(counted.groupBy("segment")).applyInArrow(_gainer(bits, n_docs, n), ASKED)
    decided = asked.groupBy("level", "bucket").applyInArrow(_decider, TOLD).withColumn("level", F.col("level") + 10)
    # Both cogroups are of one plan, so that the segments move once for both.
    told = counted.unionByName(decided.select(*counted.columns))
    found = lean.groupBy("segment").cogroup(told.groupBy("segment")).applyInArrow(_scorer(lambda: sent.value, n_docs, n, v), SCORES)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
