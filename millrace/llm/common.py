"""What several operators of this package share: scratch tables, byte-level words, graph components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps the bytes A-Z to a-z and leaves all others.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Like LOWER, but every ASCII byte that is no letter or digit becomes a space. Bytes of
#: non-ASCII code points stay, so UTF-8 words come out as ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` finds them.
LOWER_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

#: ASCII white space: the space and 09 to 0D.
WS = r"[\x20\x09-\x0D]"


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case; none for null."""
    return text.encode().translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII code points, A-Z in lower case; none for null."""
    return text.encode().translate(LOWER_ALNUM).split() if text else []


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body names it.

    A column that stands inside a lambda is computed anew for every element; a lambda's own variable isn't.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, both: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The running sum of an array, or what another associative ``both`` makes of all elements up to each.

    A fold that appends copies what it has for every element. This adds to each what stands 1, 2, 4, ... places
    before it, so n elements take n log n steps.
    """

    def of(v: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)))).cast("int")), lambda k: F.call_function("shiftleft", F.lit(1), k))
        return F.aggregate(steps, v, lambda done, by: F.transform(done, lambda x, i: F.when(i < by, x).otherwise(both(F.get(done, i - by), x))))

    return let(values, of)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers compressed, the bytes of one weight side by side."""
    planes = numbers.view(np.uint8).reshape(len(numbers), -1).T.tobytes() if len(numbers) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(cells: list[bytes | None], kind: type) -> list[np.ndarray]:
    """The numbers of each cell of :func:`packed`."""
    size, open_ = np.dtype(kind).itemsize, zstandard.ZstdDecompressor().decompress
    bytes_of = [np.frombuffer(open_(c), np.uint8) if c else np.zeros(0, np.uint8) for c in cells]
    return [np.ascontiguousarray(b.reshape(size, -1).T).view(kind).ravel() for b in bytes_of]


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder that ``spark.checkpoint.dir`` names.

    Only where that is unset in a local session, as in tests, a temporary folder of this machine stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/millrace/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again.

    This cuts the lineage: lost executors cost no earlier stage, as the files are outside of them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links (a, b)`` as ``(node, component)``, component: the smallest node.

    Alternates large-star and small-star steps, each a minimum by key and an equi-join, until nothing
    changes, which takes about as many rounds as a component's diameter has bits. Every round's links are a stored
    table. Nodes without a link have no row.
    """

    def neighbours(e: DataFrame, both: bool) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        return down.union(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else down

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        return row["n"], row["h"]

    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = state(edges)
    while before[0]:
        n = neighbours(edges, True)
        low = n.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = n.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        n = neighbours(large, False)
        low = n.groupBy("u").agg(F.min("v").alias("m"))
        small = n.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        edges = stored(small, "links")
        now = state(edges)
        if now == before:
            break
        before = now
    tops = edges.groupBy("a").agg(F.min("b").alias("b"))
    return tops.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        tops.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
