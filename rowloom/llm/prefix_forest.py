"""Approximate nearest neighbours by a forest of hash prefixes.

Every vector gets a long hash string in each of several trees: the sides of random hyperplanes that it lies on, so that
vectors at a small angle share long prefixes. A tree is the array of its strings in sorted order, kept as a range
partitioned, sorted table; the rows under a prefix are one stretch of it.

* Descent: in each tree the query's string stands among those with the longest common prefixes. How many rows share each
  of its prefixes is read off the array there, and off a bounded table of counts for short prefixes.
* Synchronous ascent: all trees go up together, one symbol at a time, until together they hold as many candidates as
  asked; within the last step tree after tree. Where they would hold as many as there are vectors, one tree's root, which
  has each of them once, takes their place.
* Scoring: rows under the prefixes are scored where they lie, in blocks of the sorted arrays, by their exact cosine; each
  block sends on a query's best few.

How many candidates are asked for is fitted: for a bounded sample of the queries the true neighbours are found by one
pass over all vectors, and the least number that finds RECALL of them by their prefixes is taken. All vectors are indexed.
Equal vectors are one entry with its least ids, k + 1 at most: more can't be among anyone's k nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.operators.graph import join_one

from .common import written

TREES, BITS, SEED = 16, 60, 1301
#: Prefixes up to so many bits are counted in one table: TREES << COUNTED numbers for each length of vectors.
COUNTED = 12
#: Rows of a block at least, and blocks at most; queries that are scored against a block at once.
BLOCK_ROWS, MOST_BLOCKS, QUERIES_AT_ONCE = 4_096, 500_000, 4_096
#: Queries by which the number of candidates is fitted, and the share of their neighbours to be found.
SAMPLE, RECALL = 256, 0.94


def planes(dim: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """trees * bits directions, orthogonal within each dim of a tree, as float64 rows."""
    rng, out = np.random.default_rng([seed, dim]), []
    for _ in range(trees):
        own = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-bits // dim))]
        out.append(np.concatenate(own)[:bits])
    return np.concatenate(out)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of lists of one length as float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square leaves the range of doubles; exact."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine of each row with the query, pair by pair, so that it doesn't depend on what else is scored."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def hash_strings(v: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """(rows, trees) integers of so many bits, the first bit the highest."""
    side = (scaled(v) @ planes(v.shape[1], trees, bits).T > 0).reshape(len(v), trees, bits)
    return side.astype(np.int64) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def by_length(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of vectors of one length, in matrices."""
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column(column))
        for size in pa.compute.unique(sizes).to_pylist():
            part = batch.filter(pa.compute.equal(sizes, size))
            yield part, matrix(part.column(column))


def valid(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id (an integer) and v of the rows that take part; of rows repeated under one id the least vector."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    own = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where("id IS NOT NULL AND size(v) > 0")
    return own.where(F.forall("v", fine) & F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))


def sorted_trees(hashed: DataFrame, rows: int) -> DataFrame:
    """tree, hash, point, asked, block: each tree's strings in sorted order, blocks of neighbours numbered."""
    spark = hashed.sparkSession
    shift = max(BLOCK_ROWS, -(-rows * TREES // MOST_BLOCKS)).bit_length() - 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * TREES // 4_000_000)
    each = hashed.select("point", "asked", "dim", F.posexplode("hashes").alias("t", "hash"))
    each = each.select((F.col("dim") * TREES + F.col("t")).cast("long").alias("tree"), "hash", "point", "asked")
    ordered = each.repartitionByRange(parts, "tree", "hash", "point").sortWithinPartitions("tree", "hash", "point")
    return written(ordered.withColumn("block", F.shiftright(F.monotonically_increasing_id(), shift)))


def short_prefixes(forest: DataFrame) -> dict[int, np.ndarray]:
    """For every tree the number of strings below each prefix of COUNTED bits, cumulated; bounded by COUNTED."""
    counts = forest.groupBy("tree", F.shiftright("hash", BITS - COUNTED).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    out: dict[int, np.ndarray] = {}
    for tree, part in counts.groupby("tree"):
        own = np.zeros((1 << COUNTED) + 1, np.int64)
        own[part["prefix"].to_numpy() + 1] = part["n"].to_numpy()
        out[int(tree)] = np.cumsum(own)
    return out


def depth_counts(forest: DataFrame, below: dict[int, np.ndarray]) -> DataFrame:
    """point, tree, counts of every query: rows that share its prefix of 0, 1, ... BITS bits, read off the sorted array
    around it; an array's slice may end within a long stretch, so longer prefixes count what the slice holds."""
    shared = forest.sparkSession.sparkContext.broadcast(below)

    def run(batches):
        for batch in batches:
            tree, hash_, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "hash", "asked"))
            edges = np.flatnonzero((np.diff(tree) != 0) | (np.diff(hash_) < 0)) + 1  # where another tree or file begins
            for a, b in zip([0, *edges], [*edges, len(tree)], strict=True):
                at = np.flatnonzero(asked[a:b])
                if not len(at):
                    continue
                own, h, table = hash_[a:b], hash_[a:b][at], shared.value[int(tree[a])]
                counts = np.empty((len(at), BITS + 1), np.int64)
                for d in range(BITS + 1):
                    low = h >> (BITS - d)
                    if d <= COUNTED:
                        counts[:, d] = table[(low + 1) << (COUNTED - d)] - table[low << (COUNTED - d)]
                    else:
                        counts[:, d] = np.searchsorted(own, (low + 1) << (BITS - d)) - np.searchsorted(own, low << (BITS - d))
                lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * (BITS + 1), pa.array(counts.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("point").slice(a, b - a).take(pa.array(at)), pa.array(np.full(len(at), tree[a])), lists], names=["point", "tree", "counts"])

    return forest.select("tree", "hash", "point", "asked").mapInArrow(run, "point long, tree long, counts array<long>")


def depths(counts: np.ndarray, wanted: int, rows: int) -> np.ndarray:
    """Depth in each tree (first axis) for counts (trees, depths), by ascending together; all zeros: the root of one."""
    total = counts.sum(axis=0)
    depth = int(np.flatnonzero(total >= min(wanted, total[0]))[-1])
    out = np.full(len(counts), depth, np.int64)
    if depth < BITS:  # within the last step, tree after tree
        gained = total[depth + 1] + np.cumsum(counts[:, depth] - counts[:, depth + 1])
        out[int(np.searchsorted(gained, min(wanted, gained[-1]))) + 1 :] = depth + 1
    visits = counts[np.arange(len(counts)), out].sum()
    return out if visits < rows else np.zeros_like(out)


def fitted(points: DataFrame, hashed: DataFrame, counts: DataFrame, rows: int, k: int) -> int:
    """The least number of candidates by which RECALL of the true neighbours of SAMPLE queries are found."""
    spark = points.sparkSession
    sample = points.where("asked").orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("point", "v").toPandas()
    if sample.empty:
        return 1
    groups = {d: (own["point"].to_numpy(), scaled(np.stack(own["v"].map(np.asarray)).astype(np.float64))) for d, own in sample.groupby(sample["v"].map(len))}
    shared = spark.sparkContext.broadcast(groups)

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part, v in by_length(batches, "v"):
            if v.shape[1] not in shared.value:
                continue
            ids, q = shared.value[v.shape[1]]
            v, own = scaled(v), part.column("point").to_numpy()
            s = q @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T / np.linalg.norm(q, axis=1, keepdims=True)
            for i, p in enumerate(ids):
                s[i, own == p] = -2
                score, who = best.get(p, (np.zeros(0), np.zeros(0, np.int64)))
                score, who = np.append(score, s[i]), np.append(who, own)
                top = np.argsort(-score, kind="stable")[:k]
                best[p] = score[top], who[top]
        rows = [(int(p), int(w), float(s)) for p, (score, who) in best.items() for s, w in zip(score, who, strict=True) if s > -2]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["point", "other", "score"])

    near = points.select("point", "v").mapInArrow(run, "point long, other long, score double").withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy(F.desc("score"), "other"))).where(F.col("n") <= k)
    strings = hashed.select(F.col("point").alias("other"), F.col("hashes").alias("theirs"))
    pairs = near.join(strings, "other").join(hashed.select("point", "hashes"), "point").select("point", "hashes", "theirs").toPandas()
    seen = counts.join(F.broadcast(spark.createDataFrame(sample[["point"]])), "point").orderBy("point", "tree").toPandas()
    if pairs.empty:
        return 1
    held = {p: np.stack(own["counts"].map(np.asarray)) for p, own in seen.groupby("point")}
    apart = np.stack(pairs["hashes"].map(np.asarray)) ^ np.stack(pairs["theirs"].map(np.asarray))
    common = BITS - np.where(apart > 0, np.frexp(apart.astype(np.float64))[1], 0)  # bits of the common prefix, for each tree
    found = lambda m: np.mean([(c >= deep[p]).any() for p, c in zip(pairs["point"], common, strict=True)]) if (deep := {p: depths(c, m, rows) for p, c in held.items()}) else 1.0
    low, high = 0, rows * TREES
    while high - low > max(1, low // 50):
        middle = (low + high) // 2
        low, high = (low, middle) if found(middle) >= RECALL else (middle, high)
    return high


def ascend(counts: DataFrame, wanted: int, rows: int) -> DataFrame:
    """point and depths (one for each tree) of every query."""

    def run(batches):
        for batch in batches:
            out = [depths(np.array(c), wanted, rows).tolist() for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("point"), pa.array(out, pa.list_(pa.int64()))], names=["point", "depths"])

    by_point = counts.groupBy("point").agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "counts"))), lambda x: x["counts"]).alias("counts"))
    return by_point.mapInArrow(run, "point long, depths array<long>")


def visits(queries: DataFrame, forest: DataFrame) -> DataFrame:
    """block, low, high (strings from low to below high), point, v for every block that a query (point, v, dim, hashes, depths)
    has candidates in. Blocks are at most about MOST_BLOCKS, and their bounds are what is broadcast."""
    bounds = forest.groupBy("tree", "block").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).orderBy("tree", "low", "high", "block").toPandas()
    shared = forest.sparkSession.sparkContext.broadcast({int(t): tuple(own[c].to_numpy() for c in ("low", "high", "block")) for t, own in bounds.groupby("tree")})

    def run(batches):
        for batch in batches:
            hashes, deep, dims = batch.column("hashes").to_pylist(), batch.column("depths").to_pylist(), batch.column("dim").to_pylist()
            take, out = [], []
            for i, (own, to, dim) in enumerate(zip(hashes, deep, dims, strict=True)):
                for t in range(1 if not any(to) else TREES):
                    tree = dim * TREES + t
                    low, high, block = shared.value[tree]
                    a = own[t] >> (BITS - to[t]) << (BITS - to[t])
                    b = a + (1 << (BITS - to[t]))
                    for j in range(int(np.searchsorted(high, a)), int(np.searchsorted(low, b))):
                        take.append(i)
                        out.append((tree, int(block[j]), a, b))
            columns = [pa.array([r[c] for r in out], pa.int64()) for c in range(4)]
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, batch.column("point").take(index), batch.column("v").take(index)], names=["tree", "block", "low", "high", "point", "v"])

    vector = queries.schema["v"].dataType.simpleString()
    return queries.mapInArrow(run, f"tree long, block long, low long, high long, point long, v {vector}")


def scored(forest: DataFrame, points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """point, other, score: of every visit (visits) the k best of the block's rows under the prefix."""
    loads = asked.groupBy("tree", "block").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).alias("parts"))
    rows = forest.select("tree", "block", "hash", "point").join(loads, ["tree", "block"]).join(points.select("point", "v"), "point")
    rows = rows.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
    dealt = asked.join(loads, ["tree", "block"]).withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts"))).drop("parts")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if not right.num_rows:
            return pa.table(dict(zip(("point", "other", "score"), none, strict=True)))
        order = np.argsort(left.column("hash").to_numpy(), kind="stable")
        left = left.take(pa.array(order))
        strings, own = left.column("hash").to_numpy(), left.column("point").to_numpy()
        v = scaled(matrix(left.column("v").combine_chunks()))
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        low, high, who = (right.column(c).to_numpy() for c in ("low", "high", "point"))
        q = scaled(matrix(right.column("v").combine_chunks()))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stretches, which = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
        for s, (a, b) in enumerate(zip(*np.searchsorted(strings, stretches), strict=True)):
            if a == b:
                continue
            members = np.flatnonzero(which.ravel() == s)
            about = (q[members] / np.linalg.norm(q[members], axis=1, keepdims=True)) @ unit[a:b].T
            for i, near in zip(members, about, strict=True):
                # all that may be among the best for what the sum's order leaves open, then exactly
                limit = np.partition(near, len(near) - k)[len(near) - k] - 1e-9 if len(near) > k else -2
                at = a + np.flatnonzero(near >= limit)
                exact = cosines(v[at], q[i])
                top = np.lexsort((own[at], -exact))[:k]
                out.append((np.full(len(top), who[i]), own[at][top], exact[top]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else none
        return pa.table(dict(zip(("point", "other", "score"), columns, strict=True)))

    pairs = rows.groupBy("tree", "block", "part").cogroup(dealt.groupBy("tree", "block", "part")).applyInArrow(work, "point long, other long, score double")
    return pairs


def nearest(vectors: DataFrame, asked: Callable[[Column], Column], k: int = 5, key: str = "vec_id", vector: str = "embedding", report: dict | None = None) -> DataFrame:
    """query_id, rank (from 1), the key and score of the k nearest found of every row whose key asked
    takes; nearness is the cosine in double precision, ties go to the smaller key.

    Candidates are all rows but the query's own, all of them where there are fewer than k; vectors of another length are
    none. Rows whose key or vector is null, or whose vector is empty, zero or holds null or non-finite components, take no
    part. Of rows repeated under one key the least vector counts. Extra columns are ignored; an empty table gives an empty
    result. report, where given, takes the number of vectors and of candidates that are asked for.
    """
    own = written(valid(vectors, key, vector).withColumn("spread", F.xxhash64("v")))
    copies = Window.partitionBy("spread", "v").orderBy("id")
    firsts = own.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    groups = firsts.groupBy("spread", "v").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids"))
    groups = written(groups)
    queries = written(own.where(asked(F.col("id"))).select(F.col("id").alias("query_id"), "spread", "v"))
    which = written(join_one(queries, groups.select("spread", "v", "point"), ["spread", "v"]).select("query_id", "point"))
    points = written(groups.select("point", "v").join(which.select("point").distinct().withColumn("asked", F.lit(True)), "point", "left").withColumn("asked", F.col("asked").isNotNull()))
    rows = points.count()

    def run(batches):
        for part, v in by_length(batches, "v"):
            strings = hash_strings(v)
            lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * TREES, pa.array(strings.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("point"), part.column("asked"), pa.array(np.full(len(v), v.shape[1], np.int32)), lists], names=["point", "asked", "dim", "hashes"])

    hashed = written(points.mapInArrow(run, "point long, asked boolean, dim int, hashes array<long>"))
    forest = sorted_trees(hashed, rows)
    counts = written(depth_counts(forest, short_prefixes(forest)))
    wanted = fitted(points, hashed, counts, rows, k)
    if report is not None:
        report |= {"vectors": rows, "candidates": wanted}
    deep = ascend(counts, wanted, rows)
    asking = hashed.where("asked").drop("asked").join(deep, "point").join(points.select("point", "v"), "point")
    pairs = scored(forest, points, written(visits(asking, forest)), k + 1).groupBy("point", "other").agg(F.max("score").alias("score"))
    top = pairs.withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy(F.desc("score"), "other"))).where(F.col("n") <= k + 1)
    named = join_one(written(top.select("point", F.col("other").alias("o"), "score")), groups.select(F.col("point").alias("o"), "ids"), ["o"])
    each = named.select("point", "score", F.explode("ids").alias("id"))
    best = each.groupBy("point").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id", "score"))).alias("best"))
    found = join_one(which, best, ["point"]).withColumn("best", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k))
    return found.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias(key), "b.score")
