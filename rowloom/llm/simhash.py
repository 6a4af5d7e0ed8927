"""SimHash near-deduplication by segment popcounts.

A fingerprint's 64 bits are cut into 32 segments of two, and each segment gives its number of set bits: a point with 32
coordinates, packed into one integer. Two fingerprints with k differing bits are at most k apart under the Manhattan
distance of their points, so points more than two apart are never linked. The range join on the grid of points goes by
midpoints: two points are within two of each other exactly if some grid point is within one of both, so each fingerprint
is put at its own point and at those one step away (49 rows on average), and an equi-join on the point gives the
candidates, which are then verified on all bits.

* Equal fingerprints are one node from the start, so groups of copies cost nothing here.
* Cells with many fingerprints (families of near copies) aren't paired off: each is verified against the least of its
  cell, and only those that no chain of links reaches are compared with the rest (graph.bucket_links).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.graph import bucket_links, components, join_one

from .common import map_texts, written

WORDS, SEED, DISTANCE = 3, 42, 2
SEGMENTS = 32
#: Fingerprints that one task puts on the grid at most, on average.
NODES_PER_TASK = 50_000


def fingerprint(text: str, n: int = WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text: bit set if in over half of the shingles' hashes; no words: 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    counts, total = np.zeros(64, np.int64), 0
    block: list[bytes] = []
    digest = xxhash.xxh64_digest

    def add() -> int:
        bits = np.unpackbits(np.frombuffer(b"".join(block), np.uint8).reshape(-1, 8), axis=1)
        counts[:] += bits.sum(axis=0, dtype=np.int64)
        return len(bits)

    for s in shingles:
        block.append(digest(s, seed))
        if len(block) == 65_536:
            total += add()
            block.clear()
    total += add() if block else 0
    return int.from_bytes(np.packbits(2 * counts > total).tobytes())


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and fp (the fingerprint's 64 bits as a signed integer) of every row; null counts as empty."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return map_texts(docs, list(keep), "text", [("fp", pa.int64(), "long")], lambda texts: [[signed(fingerprint(t)) for t in texts]])


def point(fp: F.Column) -> F.Column:
    """The popcounts of the 2-bit segments, two bits each."""
    odd, next_ = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(next_).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_).bitwiseAND(odd), 1))


def around(p: F.Column) -> F.Column:
    """p and the points one step away from it: a coordinate goes between 0 and 1 by its low bit, between 1 and 2 by both."""
    coordinate = lambda i: F.shiftrightunsigned(p, 2 * i).bitwiseAND(F.lit(3))
    low = [F.when(coordinate(i) <= 1, p.bitwiseXOR(F.lit(_signed(1 << 2 * i)))) for i in range(SEGMENTS)]
    both = [F.when(coordinate(i) >= 1, p.bitwiseXOR(F.lit(_signed(3 << 2 * i)))) for i in range(SEGMENTS)]
    return F.filter(F.array(p, *low, *both), lambda x: x.isNotNull())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) links of different fingerprints of nodes (fp, distinct) within two bits, that connect what all such pairs do.

    Fingerprints meet in the cells of the grid; bucket_links() compares each with a few of its cell, and with all others
    that no chain of links reaches yet.
    """
    n = nodes.count()
    tasks = max(n // NODES_PER_TASK, min(n // 1_000, nodes.sparkSession.sparkContext.defaultParallelism)) + 1
    dealt = nodes.repartition(tasks, "fp")  # each task makes 49 times its rows
    cells = dealt.select("fp", point(F.col("fp")).alias("p")).select(F.col("fp").alias("id"), F.explode(around(F.col("p"))).alias("bucket"))
    shared = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    close = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= DISTANCE
    # cells are 49 times what Spark takes them for, and neither side may be sent whole through the driver
    met = written(cells.hint("merge").join(shared, "bucket").select("id", "bucket"))
    return bucket_links(met, lambda pairs: pairs.where(close).select(F.col("x").alias("a"), F.col("y").alias("b")), rounds=1)


def near_groups(docs: DataFrame) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id
    that links reach, its own included.

    Null and empty texts have fingerprint zero and are linked like any other; a text of fewer words than a shingle has
    is one shingle. Repeated rows and equal texts share a fingerprint and so a component. Extra columns are ignored; an
    empty table gives an empty result. Texts of any length: shingles are hashed in blocks.
    """
    prints = written(fingerprints(docs.select("doc_id", "text")))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes.select("fp")))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = join_one(written(rooted.select("fp", "root")), firsts, ["root"]).select("fp", "component_id")
    return join_one(prints, named, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
