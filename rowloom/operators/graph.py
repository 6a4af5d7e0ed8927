"""Connected components in tables, and the tables that operators write on their way."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine, as in tests, the warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df from Parquet files in the folder that driver and executors share, so that later plans reread it by column and know
    its size; lost executors cost nothing that was written. The files stay there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a task takes in join_one() at least; beyond that and a thousandth of all rows a key is dealt out.
KEY_ROWS = 2_000


def join_one(rows: DataFrame, one: DataFrame, key: list[str], least: int = KEY_ROWS) -> DataFrame:
    """rows joined to one, which has a single row for each key. Keys that many rows share don't end in one task.

    rows has to be cheap to reread (written). Keys of more than least rows and more than a thousandth of all, so a
    thousand at most, are counted and broadcast as hashes; their rows are dealt to as many parts as they need, and their
    one row is repeated for each part. A plain join does the rest.
    """
    total = rows.count()
    most = max(least, total // 1_000)
    if total <= most:
        return rows.join(one, key)
    hashed = F.xxhash64(*key).alias("_hash")
    heavy = written(rows.select(hashed).groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("_hash", F.ceil(F.col("n") / most).cast("long").alias("_parts")))
    if heavy.isEmpty():
        return rows.join(one, key)
    dealt = rows.select("*", hashed).join(F.broadcast(heavy), "_hash", "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))))
    repeated = one.select("*", hashed).join(F.broadcast(heavy), "_hash", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.drop("_hash", "_parts").join(repeated.drop("_hash", "_parts"), [*key, "_part"]).drop("_part")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Large: neighbours above a node go to its least neighbour; small: those below, and the node itself."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = join_one(near.where("v > u"), least, ["u"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        out = join_one(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), least, ["u"]).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b: bigint): root is the least node that it reaches, itself included.
    Alternating large-star and small-star steps (Kiveris et al., 2014).

    Each round is two joins and two aggregations of edges by node, written to files; the driver sees only a
    count and a checksum, by which it knows that nothing moves any more. A hub is reduced by each task before its
    shuffle, and the edges of a large one are dealt to several tasks (join_one). No edges give no rows.
    """
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = mark(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = written(_star(written(_star(edges, True)), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: Rows of a bucket that meet in one task at most, on the salted side.
SALT_ROWS = 500


def bucket_links(entries: DataFrame, close: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """(a, b) links between ids that share a bucket and are close, enough to connect what all such links connect.

    entries: written rows (id: bigint, bucket), each once. close: of pairs (x, y) those that are close, as links (a, b).
    First each id of a bucket is compared with the bucket's least alone; after that only buckets whose ids aren't known to
    be connected are of interest. There the ids outside the largest part (_spread) get a centre of their own, for some
    rounds; then each is compared with all ids of other parts in its bucket. So a family of close ids costs a few
    comparisons a row, not one for each pair, and no link between components is lost.
    """
    centres = entries.groupBy("bucket").agg(F.min("id").alias("y"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    links = written(close(join_one(entries, centres, ["bucket"]).select(F.col("id").alias("x"), "y").where("x <> y").distinct()))
    for k in range(rounds + 1):
        mixed = _mixed(entries, links)
        outside = mixed.where("part <> most")
        if outside.isEmpty():
            break
        if k < rounds:
            centre = F.min_by(F.struct(F.col("id").alias("y"), F.col("part").alias("_p")), "id").alias("_c")
            centres = outside.groupBy("bucket").agg(centre).select("bucket", "_c.*")
            pairs = join_one(mixed, centres, ["bucket"]).where("part <> _p").select(F.col("id").alias("x"), "y").distinct()
        else:
            pairs = _across(mixed, outside)
        links = written(links.unionByName(close(pairs)))
    return links


#: Steps by which the least id of a component spreads along links before buckets are judged.
HOPS = 3


def _spread(ids: DataFrame, links: DataFrame, hops: int = HOPS) -> DataFrame:
    """id and part of ids (id): the least id within so many links. Ids of one part are connected for certain; connected ones
    may still be of several parts, which costs comparisons later on and loses nothing."""
    near = written(links.selectExpr("a AS u", "b AS v").unionByName(links.selectExpr("b AS u", "a AS v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    for _ in range(hops - 1):
        own = written(least)
        around = join_one(near, own, ["v"]).select(F.col("u").alias("v"), "m").unionByName(own)
        least = around.groupBy("v").agg(F.min("m").alias("m"))
    found = written(least).withColumnRenamed("v", "id")
    return ids.join(found, "id", "left").select("id", F.coalesce("m", "id").alias("part"))


def _mixed(entries: DataFrame, links: DataFrame) -> DataFrame:
    """entries of the buckets that hold ids of several parts (_spread), with the part and the bucket's largest one (most).
    A bucket of one part has nothing left to find."""
    named = written(join_one(entries, _spread(entries.select("id").distinct(), links), ["id"]))
    per = named.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    most = per.groupBy("bucket").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("bucket", "most")
    return written(join_one(named, most, ["bucket"]))


def _across(mixed: DataFrame, outside: DataFrame) -> DataFrame:
    """(x, y) of ids of different parts that share a bucket, x outside of the bucket's largest part. Buckets are
    dealt to several tasks by salting one side and repeating the other."""
    salts = outside.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("m"))
    x = join_one(outside, salts, ["bucket"]).select("bucket", F.col("id").alias("x"), F.col("part").alias("px"), F.col("most").alias("top"), F.pmod(F.xxhash64("id"), F.col("m")).cast("int").alias("salt"))
    y = join_one(mixed, salts, ["bucket"]).select("bucket", F.col("id").alias("y"), F.col("part").alias("py"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("salt"))
    differ = (F.col("px") != F.col("py")) & ((F.col("py") == F.col("top")) | (F.col("x") < F.col("y")))
    return x.join(y, ["bucket", "salt"]).where(differ).select("x", "y").distinct()
