"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Tokenising is a map over documents: ids by a given byte-level BPE vocabulary, one end id, pieces of
``capacity`` tokens where a document is longer (its first piece takes the remainder).

Packing: pieces that fill a sequence are one. The others are dealt evenly by hash into partitions of about
``PARTITION`` pieces; each partition is packed best-fit decreasing, and a lower bound from dual feasible
functions certifies its number of sequences. Partitions whose number is above their bound have a gap: the
loosest sequences of all of them are opened, their pieces are dealt anew into fewer, mixed partitions, and
these are packed again; the new packing is kept where it needs fewer sequences. This repeats until no two
partitions have a gap or a round gains nothing. :func:`certificates` gives every partition's sequences, bound and
gap, :func:`utilisation` those of the whole.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; extra columns are
ignored; a document of exactly ``capacity`` tokens isn't cut.
"""

from __future__ import annotations

import importlib
import os
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

CAPACITY = 2048
#: Pieces that are packed together, and so the bound of a task's group.
PARTITION = 20_000
#: Bits of a sequence's number below its turn's, and of a bin in its partition, which has no more bins than pieces.
TURN_BITS, BIN_BITS = 32, 20
#: Text units whose ids a worker remembers; a bound of its memory.
REMEMBERED = 500_000
#: Characters of text that are encoded together.
TOGETHER = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECES_IDS = PIECES + ", ids array<int>"

# --- tokens -------------------------------------------------------------------------------------------


def tokenizers_path(name: str) -> str:
    """Where the public vocabulary files are."""
    return importlib.import_module("public_tokenizers").path(name)


#: White space beside the space itself: what ASCII has of it, and the rest.
PLAIN_SPACE = [chr(c) for c in (*range(9, 14), *range(28, 32))]
OTHER_SPACE = [chr(c) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def spaced_simply(text: str) -> bool:
    """Whether every space stands between two characters that aren't white space."""
    if text[0] == " " or text[-1] == " " or "  " in text or any(c in text for c in OTHER_SPACE):
        return False
    return not any(c in text and (f"{c} " in text or f" {c}" in text) for c in PLAIN_SPACE)


class Encoder:
    """Ids of a byte-level BPE vocabulary.

    Its pre-tokens never reach across a single space between two characters that aren't white space, so a
    text whose spaces are all of that kind is the concatenation of its units, each with the space before it.
    Units repeat very often; their ids are remembered. Other texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are as many as cores
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True  # their strings in a text are ordinary text
        # Places in the text, which a plain call also finds, take as long as the ids themselves.
        self._each = lambda texts: [np.array(e.ids, np.uint32) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
        vocabulary = whole.get_vocab()
        # A byte-level token is written with a character for each of its bytes.
        self._sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self._sizes[i] = len(token)
        self._known: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> None:
        """Encodes units, each after a space, in one call, and cuts the ids where a unit's bytes end."""
        ids = self._each([" " + " ".join(units)])[0]
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        to = (np.searchsorted(np.cumsum(self._sizes[ids]), ends) + 1) * 4
        data = ids.tobytes()
        at = 0
        for unit, end in zip(units, to.tolist(), strict=True):
            self._known[unit] = data[at:end]
            at = end

    def _joined(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of simply spaced texts: their distinct units are looked up once, and the ids gathered by array."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        places, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy()
        # A text's first unit has no space before it; it is encoded by itself.
        heads = self._each([t.partition(" ")[0] for t in texts])
        spaced = np.ones(len(places), bool)
        spaced[bounds[:-1]] = False
        used = np.bincount(places[spaced], minlength=len(coded.dictionary)) > 0
        units = coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        fresh = [u for u in units if u not in self._known]
        if fresh:
            self._learn(fresh)
        cells = list(map(self._known.__getitem__, units))
        sizes, pool = np.zeros(len(used), np.int64), np.frombuffer(b"".join(cells), np.uint32)
        sizes[used] = np.fromiter(map(len, cells), np.int64, len(cells)) // 4
        starts = np.cumsum(sizes) - sizes
        own = np.where(spaced, sizes[places], 0)
        upto = np.cumsum(own)
        ids = pool[np.repeat(starts[places] - (upto - own), own) + np.arange(int(own.sum()))]
        ends = upto[bounds[1:] - 1]
        return [np.concatenate([head, part]) for head, part in zip(heads, np.split(ids, ends[:-1]), strict=True)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, uint32; a list should hold a few MB at most."""
        simple = [bool(t) and spaced_simply(t) for t in texts]
        if len(self._known) > REMEMBERED:
            self._known.clear()
        joined = iter(self._joined([t for t, own in zip(texts, simple, strict=True) if own]) if any(simple) else ())
        whole = iter(self._each([t for t, own in zip(texts, simple, strict=True) if not own]))
        return [next(joined if own else whole) for own in simple]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of ``n`` ids."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def _encoded(own: Encoder, texts: pa.Array) -> Iterator[np.ndarray]:
    """Ids of each text of a batch, a few MB of text at a time."""
    held, size = [], 0
    for value in texts:
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield from own.ids(held)
            held, size = [], 0
    yield from own.ids(held)


def _tokeniser(tokenizer: str, capacity: int, end: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizers_path(tokenizer))
        tail = np.array([end], np.uint32)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, ids in zip(batch.column(0).to_pylist(), _encoded(own, batch.column(1)), strict=True):
                ids = np.concatenate([ids, tail])
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    for column, x in zip(rows, (doc_id, k, start, length, zlib.crc32(part.astype("<u4").tobytes()), part.astype(np.int32)), strict=False):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names=names)

    return run


def pieces(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of every document. ``tokenizer``: the file of a byte-level vocabulary."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    return rows.mapInArrow(_tokeniser(tokenizer, capacity, end, with_ids), PIECES_IDS if with_ids else PIECES)


# --- packing ------------------------------------------------------------------------------------------


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, and the room left in each bin.

    ``open_at[r]``: bins with r tokens of room. Bit r of ``rooms`` is set if there are any, so the tightest
    fit is the lowest set bit from the item's length on.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        above = rooms >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room -= n
        left[b] = room
        if room:
            open_at[room].append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(left, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """The best of three families of dual feasible functions: identity, threshold and rounding.

    Each maps lengths so that whatever fits one bin has a mapped sum of at most the mapped capacity; the
    mapped total, divided by that and rounded up, is a lower bound of the number of bins.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, times, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    best = -(-int((counts * sizes).sum()) // capacity)
    many, mass = np.cumsum(counts), np.cumsum(counts * sizes)
    for e in range(0, capacity // 2 + 1):
        # Over capacity - e: a bin each. Under e: nothing. Between: as they are.
        high = int(many[-1] - many[capacity - e])
        mid = int(mass[capacity - e] - (mass[e - 1] if e else 0))
        best = max(best, high + -(-mid // capacity))
    for k in range(2, 21):
        # x (k + 1) / capacity, if whole, stays x k; else it is rounded down.
        scaled = sizes * (k + 1)
        mapped = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * mapped).sum()) // (capacity * k)))
    return best


ROWS = "row long, length long"
PACKED = ROWS + ", part long, bin long, offset long, room long, gap long"


def _packer(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        return group.assign(bin=bins, offset=offsets, room=left[bins], gap=len(left) - lower_bound(lengths, capacity))

    return run


def _deal(rows: DataFrame, n: int, capacity: int, turn: int) -> DataFrame:
    """Packs ``rows`` in even partitions of about PARTITION, by their stored numbers, which no two rows share."""
    parts = max(1, -(-n // PARTITION))
    key = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)) + F.lit(turn << TURN_BITS)
    return rows.select("row", "length", key.alias("part")).groupBy("part").applyInPandas(_packer(capacity), PACKED)


def best_fit(table: DataFrame, capacity: int = CAPACITY, opened: float = 0.1) -> DataFrame:
    """``table`` (of :func:`pieces`) with ``sequence_id``, ``offset``, gapless from 0 in each sequence, and ``part``.

    ``opened``: share of a gapped partition's sequences, the loosest, that a round packs anew. ``part``: the partition
    that a sequence was packed in, null for pieces that fill one.
    """
    table = stored(table.withColumn("row", F.monotonically_increasing_id()), "pieces")
    rest = table.where(F.col("length") < capacity)
    packed = stored(_deal(rest, rest.count(), capacity, 0), "packed")
    done, turn = [], 0
    while packed.where("gap > 0").select("part").distinct().limit(2).count() > 1:
        turn += 1
        # A partition's number names its turn and place; with a bin's below it, it has room for 2,047 turns.
        bins = packed.where("gap > 0").groupBy("part", "bin").agg(F.first("room").alias("room"), F.count("*").alias("n"))
        share = bins.groupBy("part").agg(F.expr(f"percentile_approx(room, {1 - opened}, 1000)").alias("least"))
        loose = stored(bins.join(share, "part").where("room >= least and room > 0").select("part", "bin", "n"), "loose")
        before = loose.agg(F.count("*").alias("bins"), F.sum("n").alias("n")).first()
        if not before["bins"]:
            break
        taken = packed.join(loose.select("part", "bin"), ["part", "bin"], "left_semi")
        again = stored(_deal(taken, before["n"], capacity, turn), "again")
        if again.select("part", "bin").distinct().count() >= before["bins"]:
            break
        done.append(packed.join(loose.select("part", "bin"), ["part", "bin"], "left_anti"))
        packed = again
    placed = packed
    for part in done:
        placed = placed.unionByName(part)
    sequence = F.col("part") * F.lit(1 << BIN_BITS) + F.col("bin")
    placed = placed.select(F.col("row").alias("at"), sequence.alias("sequence_id"), "offset", "part")
    columns = [c for c in table.columns if c != "row"]
    whole = table.where(F.col("length") == capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("long").alias("part"))
    return whole.unionByName(rest.join(placed, F.col("row") == F.col("at")).select(*columns, "sequence_id", "offset", "part"))


def certificates(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``part, sequences, bound, gap`` of every partition of :func:`best_fit`, of what it holds in the end."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n, bound = group["sequence_id"].nunique(), lower_bound(group["length"].to_numpy(np.int64), capacity)
        return pd.DataFrame([(group["part"].iloc[0], n, bound, n - bound)], columns=["part", "sequences", "bound", "gap"])

    return packed.where("part is not null").select("part", "sequence_id", "length").groupBy("part").applyInPandas(run, "part long, sequences long, bound long, gap long")


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, the certified bound of all pieces, the gap, and the share of room in use."""
    sizes = packed.groupBy("length").count().collect()  # at most ``capacity`` rows
    lengths, n = np.array([r["length"] for r in sizes], np.int64), np.array([r["count"] for r in sizes], np.int64)
    tokens, least = int((lengths * n).sum()), lower_bound(lengths, capacity, n)
    row = packed.agg(F.countDistinct("sequence_id").alias("sequences"))
    return row.select("sequences", F.lit(tokens).alias("tokens"), F.lit(least).alias("bound"), (F.col("sequences") - least).alias("gap"), (F.lit(tokens) / (F.col("sequences") * capacity)).alias("used"))


def plain_fit(lengths: list[int], capacity: int) -> int:
    """Best-fit decreasing in its plainest form, to test against: the number of bins."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        i = bisect_left(rooms, n)
        rooms.insert(bisect_left(rooms, r := (rooms.pop(i) if i < len(rooms) else capacity) - n), r)
    return len(rooms)
