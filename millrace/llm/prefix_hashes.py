"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for every length, the hash of the text's start of that length: the sum of its code points times powers of a base,
modulo a prime. The hash of any span is a difference of two entries, brought to place 0 by a power of the base's inverse, so that

* equality of any two spans, of one text or of two, costs a few operations (:func:`spans_equal`);
* the longest common extension of two places is found by binary search over its length (:func:`common_extension`);
* the array of a text that is pieced together follows from those of its pieces (:func:`pieced`), without reading characters again.

Two bases make two numbers of 31 bits; equality of spans means that both agree.

A fingerprint holds the length, the whole text's hash, and for each of the ``WIDTHS`` a sketch of all spans of that many code points: spans fall
into ``BINS`` bins by their mixed hash, and each bin keeps 16 bits of its smallest. Of two fingerprints the share of bins that agree estimates the
Jaccard similarity of the spans; :func:`likeness` is the share of spans in common that follows from it (half for two texts
of the same length that have half their spans in common). Long texts are compared by long spans, which different texts of a language seldom share.

:func:`fingerprints` pairs every text with the next one in the order of ids. Rows are dealt by range of ids to blocks, sorted there and streamed; a block's
last row finds its successor as a copy of the next block's first row. Texts move once, compressed, and no task holds more than two.

Defined results: a null text is empty; all empty texts have one fingerprint, unlike any other; a text shorter than a width is one span; rows without id come last,
those that share an id go by a hash of their texts; the only row of a table is its own next; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The modulus, and the bases of the two hashes.
PRIME, BASES = (1 << 31) - 1, (1_002_583_661, 786_433_019)
#: Code points of the spans of a fingerprint's sketches; the longer ones compare texts of ``LONG`` code points or more.
WIDTHS, LONG, BINS = (8, 32), 128, 64
#: Rows of a block, and the most blocks there are.
BLOCK_ROWS, BLOCKS = 1_000, 1 << 16
#: Ids that are looked at for a block's border.
PER_BORDER = 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones((2, 1), np.uint64), np.ones((2, 1), np.uint64)]
_STEP = [np.array([[b] for b in BASES], np.uint64), np.array([[pow(b, -1, PRIME)] for b in BASES], np.uint64)]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers, at least, of both bases, or of their inverses; a process keeps and doubles them."""
    while _powers[inverse].shape[1] < n:
        own = _powers[inverse]
        _powers[inverse] = np.concatenate([own, own * (own[:, -1:] * _STEP[inverse] % PRIME) % PRIME], axis=1)
    return _powers[inverse]


def prefixes(text: str) -> np.ndarray:
    """Both prefix arrays, from length 0 to the whole."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    out = np.zeros((2, len(codes) + 1), np.uint64)
    np.cumsum(codes * powers(len(codes))[:, : len(codes)] % PRIME, axis=1, out=out[:, 1:])
    out %= PRIME
    return out


def pieced(a: np.ndarray, m: int, b: np.ndarray, n: int) -> np.ndarray:
    """The prefix arrays of the first ``m`` code points of one text followed by the first ``n`` of another."""
    return np.concatenate([a[:, : m + 1], (a[:, m : m + 1] + b[:, 1 : n + 1] * powers(m + 1)[:, m : m + 1]) % PRIME], axis=1)


def span_hash(of: np.ndarray, start: int, length: int) -> tuple[int, int]:
    """The hash of a span, the same wherever it stands."""
    span = (of[:, start + length] + np.uint64(PRIME) - of[:, start]) * powers(start + 1, True)[:, start] % PRIME
    return int(span[0]), int(span[1])


def spans_equal(a: np.ndarray, i: int, b: np.ndarray, j: int, length: int) -> bool:
    return span_hash(a, i, length) == span_hash(b, j, length)


def common_extension(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """How many code points from place ``i`` of one text and ``j`` of the other agree, by binary search."""
    low, high = 0, min(a.shape[1] - 1 - i, b.shape[1] - 1 - j)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if spans_equal(a, i, b, j, middle) else (low, middle - 1)
    return low


@dataclass
class Print:
    """A fingerprint's parts; a sketch's empty bins are 0."""

    size: int
    whole: tuple[int, int]
    sketches: list[np.ndarray]

    def __str__(self) -> str:
        return "-".join([f"{self.size:x}", f"{self.whole[0]:08x}{self.whole[1]:08x}", *[s.astype(">u2").tobytes().hex() for s in self.sketches]])


def from_text(fingerprint: str) -> Print:
    size, whole, *sketches = fingerprint.split("-")
    return Print(int(size, 16), (int(whole[:8], 16), int(whole[8:], 16)), [np.frombuffer(bytes.fromhex(s), ">u2").astype(np.uint16) for s in sketches])


def sketch(of: np.ndarray, width: int) -> np.ndarray:
    """Of each bin, 16 bits of its smallest mixed span hash."""
    n = of.shape[1] - 1
    width = min(width, n)
    if not n:
        return np.zeros(BINS, np.uint16)
    spans = (of[0, width:] + np.uint64(PRIME) - of[0, : n - width + 1]) * powers(n - width + 1, True)[0, : n - width + 1] % PRIME
    mixed = spans * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    bins = (mixed >> np.uint64(58)).astype(np.int64)
    np.minimum.at(least, bins, mixed)
    kept = (least >> np.uint64(16)).astype(np.uint16) | np.uint16(1)
    return np.where(np.bincount(bins, minlength=BINS) > 0, kept, np.uint16(0))


def fingerprint(of: np.ndarray) -> Print:
    n = of.shape[1] - 1
    return Print(n, span_hash(of, 0, n), [sketch(of, w) for w in WIDTHS])


def likeness(a: Print, b: Print) -> float:
    """The estimated share of spans in common, 0 to 1."""
    if (a.size, a.whole) == (b.size, b.whole):
        return 1.0
    x, y = (p.sketches[min(a.size, b.size) >= LONG] for p in (a, b))
    used = int(((x > 0) | (y > 0)).sum())
    same = int(((x == y) & (x > 0)).sum()) / used if used else 0.0
    return 2 * same / (1 + same)


# --- every text and the next ---------------------------------------------------------------------------

PAIR_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


def compare(doc_id: int | None, text: str, own: tuple[np.ndarray, Print], after: str, other: tuple[np.ndarray, Print]) -> tuple:
    """A row of :data:`PAIR_DDL` for a text and the next one, each with its prefix arrays and fingerprint.

    The edited text is the text with its last half, rounded down, replaced by as many code points from the next one's start.
    """
    kept, taken = len(text) - len(text) // 2, min(len(text) // 2, len(after))
    arrays = pieced(own[0], kept, other[0], taken)
    edited = fingerprint(arrays)
    digest = hashlib.sha256((text[:kept] + after[:taken]).encode()).hexdigest()
    return doc_id, len(text), digest, str(own[1]), str(edited), likeness(own[1], edited), likeness(own[1], other[1]), common_extension(own[0], 0, arrays, 0), common_extension(own[0], 0, other[0], 0)


def _borders(docs: DataFrame) -> tuple[np.ndarray, int | None]:
    """Ids that begin a block, descending, without the first block's, and the highest of all. Reads ids alone; what comes to the driver is bounded by ``BLOCKS``."""
    ids = docs.where("doc_id is not null")
    n, top = ids.agg(F.count("*"), F.max("doc_id")).first()
    blocks = min(BLOCKS, n // BLOCK_ROWS)
    if blocks < 2:
        return np.zeros(0, np.int64), top
    every = max(1, n // (blocks * PER_BORDER))
    some = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(every)) == 0).select("doc_id").distinct()
    held = np.sort(some.toArrow().column(0).to_numpy())[::-1]
    borders = held[PER_BORDER::PER_BORDER]
    return borders[borders < top], top


def _dealer(borders: np.ndarray, top: int | None):
    """Rows with their block; copies of a block's first rows for the block before, those of the first block for the last."""
    ascending = borders[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            none = np.array(batch.column(0).is_null())
            ids = np.where(none, 0, ids).astype(np.int64)
            # Block b holds the ids at most borders[b - 1] and above borders[b].
            block = np.where(none, len(borders), len(borders) - np.searchsorted(ascending, ids, side="left"))
            begins = (~none & np.isin(ids, borders)).nonzero()[0]
            begins_all = (~none & (ids == top)).nonzero()[0] if len(borders) else begins[:0]
            at = np.concatenate([np.arange(len(ids)), begins, begins_all])
            to = np.concatenate([block, block[begins] - 1, np.full(len(begins_all), len(borders))])
            extra = np.concatenate([np.zeros(len(ids), bool), np.ones(len(begins) + len(begins_all), bool)])
            texts = [pack((x.as_py() or "").encode()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.astype(np.int32)), pa.array(extra), *[batch.column(i).take(pa.array(at)) for i in (0, 1)], pa.array([texts[i] for i in at], pa.binary())], names=["block", "extra", "doc_id", "text_hash", "packed"]
            )

    return run


def _pairer(alone: bool):
    """Rows of PAIR_DDL from sorted blocks; ``alone``: the one block's last row is followed by its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last = first = None
        for batch in batches:
            rows = []
            for block, extra, doc_id, cell in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2)], batch.column(4), strict=True):
                if extra and last is None:  # another row of the id that has been met
                    continue
                text = unpack(cell.as_py()).decode()
                arrays = prefixes(text)
                now = block, doc_id, text, (arrays, fingerprint(arrays))
                if last is not None:
                    rows.append(compare(last[1], last[2], last[3], text, now[3]))
                last = None if extra else now
                first = now if alone and first is None else first
            yield _table(rows)
        if last is not None:
            yield _table([compare(last[1], last[2], last[3], first[2], first[3])])

    return run


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*[c.split() for c in PAIR_DDL.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(types)], names=list(names))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of :data:`PAIR_DDL` for every row: its fingerprint, its edited text's, and their likeness, in descending order of ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    borders, top = _borders(rows)
    dealt = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_dealer(borders, top), "block int, extra boolean, doc_id long, text_hash long, packed binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(len(borders) // 8, 1 << 14)) if len(borders) else 1
    order = ["block", "extra", F.col("doc_id").desc_nulls_last(), "text_hash"]
    held = dealt.repartition(parts, "block").sortWithinPartitions(*order)
    return held.mapInArrow(_pairer(not len(borders)), PAIR_DDL)
