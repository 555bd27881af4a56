"""Groups of near copies: SimHash by multi-index hashing first, then all pairs of exact shingle similarity that are left.

Every distinct text has a SimHash fingerprint over its five-word shingles; :mod:`millrace.llm.simhash` finds all fingerprints
within ``RADIUS`` bits and their components. Each text is compared with its component's first one, and counts as its near copy
if the shingle sets have the similarity. A ball of a few bits can't hold all pairs of that similarity; the rest is found exactly:

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Put all
shingles in one order, rarest first. Texts of that similarity share a shingle among the first ``m // 5 + 1`` of
the m shingles of each, so a text is filed under those alone, and no pair is missed whatever was edited. A shingle
that stands in one text only brings nobody together and isn't filed: most texts are filed under nothing. Where the
first shared shingle stands in both texts bounds what they can share, which drops further pairs, none of them near.

How often a shingle occurs is counted in buckets of shingles, as arrays; what comes back are those of two texts or
more. Large groups would make a square of pairs. So first each text only meets two leaders of each shingle it is
filed under, a number of pairs that is linear in the texts: one at random, and the text with the fewest shingles of
its own, which stands nearest to the middle of its group. Verified links of both kinds collapse large groups. Then all pairs are
sought, but only between texts that aren't in one group yet. Copies of a text are one node throughout.

A node of all this is a distinct sequence of words, named by its hash; what ids its rows have doesn't matter. A row is known by its
``rid``, a hash of its id and text, so that rows that share an id, or have none, keep apart.

Defined results: texts of equal words (A-Z lowered, white space apart) are copies; a text of fewer words than a
shingle is one shingle; texts without words are copies of each other; rows without id are grouped like others and stay only if no row
of their group has one; of rows that share an id each is grouped by its own text; of rows equal in id and text one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blank_words, components, stored
from millrace.llm.simhash import FLUSH, SEED, links, majority, shingle_hashes

WIDTH = 5
#: Bits by which fingerprints of linked texts differ at most.
RADIUS = 4
#: Bits of a shingle's hash that are its key. Keys that clash by chance are one shingle everywhere.
KEY_BITS = 40
#: Buckets of shingles, at least, as powers of two; the bits of a key beside its bucket fit 32. Shingles of a bucket, about.
BUCKET_BITS, BUCKET_SHINGLES = 8, 2_000_000
#: Shingles that are dealt together; bounds the memory of a task.
DEALT = 500_000


def _keys(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def shingle_keys(text: str | None) -> np.ndarray:
    """The distinct keys of a text's shingles, in order."""
    return _keys(np.array(shingle_hashes(text, WIDTH), np.uint64))


def _copy(text: str | None) -> int:
    return xxhash.xxh64_intdigest(b" ".join(blank_words(text)), SEED)


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        copies, sizes, prints, held = [], [], [], []
        for i, value in enumerate(batch.column(2)):
            text = value.as_py()
            copies.append(_copy(text))
            held.append(np.array(shingle_hashes(text, WIDTH), np.uint64))
            sizes.append(len(_keys(held[-1])))
            if i == batch.num_rows - 1 or sum(map(len, held)) >= FLUSH:
                prints.append(majority(np.concatenate(held), np.array([len(h) for h in held])))
                held = []
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        fp = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(copies), pa.array(sizes, pa.int32()), signed(fp)], names=["doc_id", "rid", "node", "m", "fp"])


def rid(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's name: a hash of its id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rid, node, m, fp)``: of every row its name, a hash of the words, the number of shingles, and the SimHash fingerprint."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), rid(id_col, text_col).alias("rid"), text_col)
    return rows.mapInArrow(_signer, "doc_id long, rid long, node long, m int, fp long")


def ball_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of a text and the first of its fingerprint's component, a pair at most for each text."""
    classes = stored(nodes.groupBy("fp").agg(F.min("node").alias("node")), "classes")
    tops = components(links(classes, RADIUS)).select(F.col("node").alias("of"), "component")
    first = classes.withColumnRenamed("node", "of").join(tops, "of", "left").select("fp", F.coalesce("component", "of").alias("first"))
    return nodes.join(first, "fp").where("node <> first").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b"))


def _own_texts(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, text)`` of the nodes, each from the row that stands for it; another row's name may clash with that one's."""
    return texts.join(nodes.select("node", "rid").hint("shuffle_hash"), "rid").select("node", "text")


def _dealer(bits: int):
    """Deals the shingles of (node, text) rows to 2**bits buckets, as arrays of nodes and of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            held, size, first = [], 0, 0
            for i, text in enumerate(texts):
                own = np.uint64(_copy(text)).astype(np.int64) == ids[i]
                held.append(shingle_keys(text) if own else np.zeros(0, np.int64))
                size += len(held[-1])
                if size >= DEALT or i == len(texts) - 1:
                    keys, node = np.concatenate(held), np.repeat(ids[first : i + 1], [len(h) for h in held])
                    bucket = keys & ((1 << bits) - 1)
                    order = np.argsort(bucket, kind="stable")
                    keys, node = (keys[order] >> bits).astype(np.uint32), node[order]
                    there, starts = np.unique(bucket[order], return_index=True)
                    ends = [*starts[1:], len(keys)]
                    rows = [[x[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] if len(keys) else [] for x in (node, keys)]
                    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.binary())], names=["bucket", "nodes", "keys"])
                    held, size, first = [], 0, i + 1

    return run


SHARED = pa.schema([("node", pa.int64()), ("key", pa.int64()), ("df", pa.int32())])


def _sharer(bits: int):
    """The shingles of a bucket that stand in two texts or more, with the number of texts."""

    def run(group: pa.Table) -> pa.Table:
        nodes = np.frombuffer(b"".join(group.column("nodes").to_pylist()), np.int64)
        keys = np.frombuffer(b"".join(group.column("keys").to_pylist()), np.uint32)
        _, place, df = np.unique(keys, return_inverse=True, return_counts=True)
        df = df[place]
        kept = df > 1
        whole = (keys[kept].astype(np.int64) << bits) | (group.column("bucket")[0].as_py() if group.num_rows else 0)
        return pa.Table.from_arrays([pa.array(nodes[kept]), pa.array(whole), pa.array(df[kept].astype(np.int32))], schema=SHARED)

    return run


def postings(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``(node, m, own, pos, key)``: each text under the shared ones of its ``m // 5 + 1`` rarest shingles.

    ``own``: its shingles that no other text has, which come first; ``pos``: the shingle's place in the text's order.
    """
    total = nodes.agg(F.sum("m")).first()[0] or 0
    bits = max(BUCKET_BITS, (total // BUCKET_SHINGLES).bit_length())
    dealt = _own_texts(texts, nodes).mapInArrow(_dealer(bits), "bucket int, nodes binary, keys binary")
    shared = dealt.groupBy("bucket").applyInArrow(_sharer(bits), "node long, key long, df int")
    lists = shared.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("df", "key"))).alias("shared"))
    rows = lists.join(nodes.select("node", "m"), "node").withColumn("own", F.col("m") - F.size("shared"))
    first = F.floor(F.col("m") / 5).cast("int") + 1 - F.col("own")
    rows = rows.where(first > 0).select("node", "m", "own", F.posexplode(F.slice("shared", 1, first)).alias("at", "s"))
    return rows.select("node", "m", "own", (F.col("own") + F.col("at")).alias("pos"), F.col("s.key").alias("key"))


def _may() -> Column:
    """Whether rows a and b can be near if this is the first shingle that they share: 9 * common >= 4 * (m_a + m_b)."""
    common = F.least(F.col("m_a") - F.col("pos_a"), F.col("m_b") - F.col("pos_b"))
    return 9 * common >= 4 * (F.col("m_a") + F.col("m_b"))


def _sided(side: str, *more: str) -> list[Column]:
    """The node and where it is filed, named for a side of a join."""
    return [F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("m", "pos", *more)]]


def leader_pairs(posted: DataFrame) -> DataFrame:
    """Pairs of a text and the leaders of the shingles it is filed under."""
    row = F.struct("node", "m", "pos")
    middle = F.struct(F.col("own") / F.col("m"), F.xxhash64("node"))
    leaders = posted.groupBy("key").agg(F.min_by(row, middle).alias("l1"), F.min_by(row, F.xxhash64("node", "key")).alias("l2"), F.count("*").alias("n"))
    leaders = leaders.where("n > 1").select(F.col("key").alias("k"), F.explode(F.array_distinct(F.array("l1", "l2"))).alias("l")).select("k", "l.*").select("k", *_sided("b"))
    near = (F.col("key") == F.col("k")) & (F.col("a") != F.col("b")) & _may()
    return posted.select("key", *_sided("a")).join(leaders, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def outer_pairs(posted: DataFrame, grouped: DataFrame) -> DataFrame:
    """All pairs that a shingle brings together and whose ``grp`` differs."""
    rows = posted.join(grouped.select("node", "grp"), "node")
    mixed = rows.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("key")
    rows = stored(rows.join(mixed, "key"), "mixed")
    near = (F.col("key") == F.col("k")) & (F.col("a") < F.col("b")) & (F.col("grp_a") != F.col("grp_b")) & _may()
    return rows.select("key", *_sided("a", "grp")).join(rows.select(F.col("key").alias("k"), *_sided("b", "grp")), near).select("a", "b").distinct()


def _shingler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of (node, text) rows; a row whose words aren't the node's is left out."""
    for batch in batches:
        own = [_copy(v.as_py()) for v in batch.column(1)]
        batch = batch.filter(pa.array(np.array(own, np.uint64).view(np.int64) == batch.column(0).to_numpy()))
        sets = [shingle_keys(v.as_py()) for v in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have the similarity. Only texts that stand in a pair are read into sets."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rid"), "node")
    sets = stored(_own_texts(texts, ids).mapInArrow(_shingler, "node long, s array<long>"), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("s_b")), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.select("a", "b", (F.size("s_a") + F.size("s_b")).alias("n"), common.alias("c")).where("9 * c >= 4 * n").select("a", "b")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, rid, group_id, first)`` of every row; group_id: the smallest id of its group, null if none has one; first: the name of
    the row that stands for the group, one with the smallest id."""
    texts = docs.select(rid(id_col, text_col).alias("rid"), F.col(text_col).alias("text"))
    signed = stored(signatures(docs, id_col, text_col), "signatures")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    nodes = stored(signed.groupBy("node").agg(F.min_by("rid", order).alias("rid"), F.min("doc_id").alias("doc_id"), F.first("m").alias("m"), F.first("fp").alias("fp")), "nodes")
    posted = stored(postings(nodes, texts), "postings")
    inner = stored(verified(leader_pairs(posted).union(ball_pairs(nodes)).distinct(), nodes, texts), "inner")
    tops = components(inner)
    grouped = stored(nodes.join(tops, "node", "left").select("node", "doc_id", "rid", F.coalesce("component", "node").alias("grp")), "grouped")
    outer = verified(outer_pairs(posted, grouped), nodes, texts)
    of = lambda name: grouped.select(F.col("node").alias(name), F.col("grp").alias(f"grp_{name}"))
    between = outer.join(of("a"), "a").join(of("b"), "b").select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b")).distinct()
    tops = components(between).select(F.col("node").alias("grp"), "component")
    final = stored(grouped.join(tops, "grp", "left").select("node", "doc_id", "rid", F.coalesce("component", "grp").alias("grp")), "final")
    firsts = final.groupBy("grp").agg(F.min("doc_id").alias("group_id"), F.min_by("rid", order).alias("first"))
    return signed.select("doc_id", "rid", "node").join(final.select("node", "grp").join(firsts, "grp").drop("grp"), "node").drop("node")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that another row of their group stands for."""
    found = stored(groups(docs, id_col, text_col), "groups")
    gone = found.where("rid <> first").select(F.col("rid").alias("millrace_rid"), F.col("doc_id").alias("millrace_id")).distinct()
    name = rid(id_col, text_col)
    same = (name == F.col("millrace_rid")) & F.col(id_col).cast("long").eqNullSafe(F.col("millrace_id"))
    left = docs.join(gone.hint("shuffle_hash"), same, "left_anti")
    again = found.where("rid = first").groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rid").alias("millrace_rid"))
    again = stored(again, "again")
    if again.isEmpty():
        return left
    # Rows equal in id and text: one of each stays, whatever their other columns hold.
    named = left.withColumn("millrace_name", name)
    own = named["millrace_name"] == again["millrace_rid"]
    one = named.join(again.hint("shuffle_hash"), own, "left_semi").groupBy("millrace_name").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("millrace_row")).select("millrace_row.*")
    return named.join(again.hint("shuffle_hash"), own, "left_anti").drop("millrace_name").unionByName(one)
