"""SimHash near-duplicates by multi-index hashing.

Each text has a 64-bit fingerprint over its word shingles. The fingerprint is cut into ``m`` segments;
two fingerprints that differ in ``radius`` bits at most differ in ``radius // m`` bits at most in some
segment. So every distinct fingerprint is filed once per segment under that segment's exact value, looks
up the small Hamming ball around each of its own segment values, and whole distances are verified in the
join. Copies share a fingerprint and count once in all of this. Linked fingerprints form components.

Defined results: a null text has no words; a text without words has fingerprint zero; a text of fewer
words than a shingle has one shingle, the whole sequence; repeated rows each get a row; a row without
id takes the component of its fingerprint but makes no links; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import blank_words, components, stored

SEED = 42
#: Hashes that are counted together; bounds the memory of a task whatever the batch holds.
FLUSH = 400_000


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every ``width``-word shingle, repeats included."""
    words = blank_words(text)
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes stand one after another; ``sizes``: hashes of each."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    # Runs of 255 hashes at most, so that eight byte-wide counters fit one 64-bit sum.
    runs = -(-n // 255)
    first_run = np.cumsum(runs) - runs
    within = np.arange(runs.sum()) - np.repeat(first_run, runs)
    starts = np.repeat(np.cumsum(n) - n, runs) + within * 255
    counts = np.empty((len(starts), 8, 8), np.int64)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101), starts)
        counts[:, :, bit] = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(counts.reshape(-1, 64), first_run, axis=0)
    bits = 2 * total > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_batches(width: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, hashes, sizes, held = [], [], [], 0
            for value in batch.column(1):
                h = shingle_hashes(value.as_py(), width)
                hashes.append(np.array(h, np.uint64))
                sizes.append(len(h))
                held += len(h)
                if held >= FLUSH:
                    prints.append(majority(np.concatenate(hashes), np.array(sizes)))
                    hashes, sizes, held = [], [], 0
            if sizes:
                prints.append(majority(np.concatenate(hashes), np.array(sizes)))
            fp = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema.field(0).type), pa.array(fp.view(np.int64))], schema=schema)

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp``: the 64 bits as a signed long."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    arrow = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(_fingerprint_batches(width, arrow), schema)


def segment_masks(segments: int, radius: int) -> list[tuple[int, int, list[int]]]:
    """(shift, bits, masks of the Hamming ball) of each segment."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    return [
        (lo, hi - lo, [sum(1 << i for i in c) for k in range(radius // segments + 1) for c in combinations(range(hi - lo), k)])
        for lo, hi in zip(cuts, cuts[1:], strict=False)
    ]


def links(classes: DataFrame, radius: int = 4, segments: int = 3) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of nodes whose fingerprints differ in ``radius`` bits at most.

    ``classes (node, fp)``: one row per distinct fingerprint.
    """
    filed, sought = [], []
    for i, (lo, bits, masks) in enumerate(segment_masks(segments, radius)):
        value = F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit((1 << bits) - 1))
        tag = F.lit(i << 48)
        filed.append(value.bitwiseOR(tag))
        sought += [value.bitwiseXOR(F.lit(m)).bitwiseOR(tag) for m in masks]
    table = classes.select(F.col("node").alias("b"), F.col("fp").alias("fp_b"), F.explode(F.array(*filed)).alias("key"))
    probes = classes.select(F.col("node").alias("a"), F.col("fp").alias("fp_a"), F.explode(F.array(*sought)).alias("key"))
    near = (probes["key"] == table["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= radius)
    return probes.join(table, near).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, segments: int = 3
) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; component_id: the smallest id reachable over links."""
    prints = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "classes")
    tops = components(links(classes.where("node is not null"), radius, segments))
    tops = classes.join(tops, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(tops, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp") -> Column:
    """The 16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
