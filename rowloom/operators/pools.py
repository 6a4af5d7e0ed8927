"""Labelled pools: counts, splits that keep groups together, and samples with exact sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.scores import dealbreaker

FOLDS, SELECT_FOLDS, CALIBRATE_FOLDS = 20, 5, 3


def dealbreaker_counts(rows: DataFrame) -> DataFrame:
    """Rows by pool and category of the labeller's text."""
    return rows.groupBy("pool", dealbreaker(F.col("dealbreaker"))["category"].alias("category")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(items: DataFrame, question: str = "question", option: str = "option") -> DataFrame:
    """A10"""
    return items.groupBy(question, option).agg(F.count(F.lit(1)).alias("n"))


def input_health(condensed: DataFrame) -> DataFrame:
    """Of condensed postings those without headings, without requirements, and unknown headings."""
    return condensed.agg(
        F.count(F.lit(1)).alias("postings"), F.count_if(F.col("headings") == 0).alias("no_headings"), F.count_if("empty_requirements").alias("empty_requirements"), F.sum("unknown_headings").alias("unknown_headings")
    )


def split_rows(rows: DataFrame, seed: int = 1) -> DataFrame:
    """Rows (id, pool, label, group) with split. The old pool trains, and groups that span both pools; each other group
    goes whole to one of twenty folds, balanced over its usual label: a quarter selects, 15 per cent calibrate.

    Folds are dealt by the rank of a group's seeded hash within its label, counted per stretch of hashes, so that one
    label with most groups is spread over tasks.
    """
    facts = rows.groupBy("group").agg(F.max((F.col("pool") == "old").cast("int")).alias("_old"))
    usual = rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("_n")).groupBy("group").agg(F.max_by("label", F.struct("_n", "label")).alias("_label"))
    groups = facts.join(usual, "group").withColumn("_h", F.xxhash64("group", F.lit(seed))).withColumn("_cut", F.shiftrightunsigned(F.col("_h"), 54))
    open_ = groups.where("_old = 0")
    sizes = open_.groupBy("_label", "_cut").agg(F.count(F.lit(1)).alias("_k"))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_k").over(Window.partitionBy("_label").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_label", "_cut", "_ahead")
    rank = F.row_number().over(Window.partitionBy("_label", "_cut").orderBy("_h", "group")) - 1 + F.col("_ahead")
    folds = open_.join(ahead, ["_label", "_cut"]).select("group", (rank % FOLDS).alias("_fold"))
    split = F.when(F.col("_fold") < SELECT_FOLDS, "select").when(F.col("_fold") < SELECT_FOLDS + CALIBRATE_FOLDS, "calibrate").otherwise("train")
    return rows.join(folds, "group", "left").withColumn("split", F.coalesce(split, F.lit("train"))).drop("_fold")


def cap_per_label(rows: DataFrame, label: str = "label", slack: int = 50, key: str = "id", seed: int = 1) -> DataFrame:
    """At most the smallest label's count and slack of each label, those of the smallest seeded hashes.

    Exact without ranking whole labels in one task: a histogram of 4096 hash ranges a label gives the range in which the
    limit falls, and only that range is ranked.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = rows.withColumn("_h", h).withColumn("_cut", F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), 52))
    cells = rows.groupBy(label, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    limit = cells.groupBy(label).agg(F.sum("_n").alias("_t")).agg((F.min("_t") + slack).alias("_limit"))
    w = Window.partitionBy(label).orderBy("_cut")
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(F.broadcast(limit))
    near = rows.join(cells.where("_before < _limit"), [label, "_cut"])
    whole = F.col("_before") + F.col("_n") <= F.col("_limit")
    edge = near.where(~whole).withColumn("_r", F.row_number().over(Window.partitionBy(label, "_cut").orderBy("_h", key))).where("_before + _r <= _limit").drop("_r")
    return near.where(whole).unionByName(edge).drop("_h", "_cut", "_n", "_before", "_limit")


def fingerprint(rows: DataFrame, key: str = "id") -> DataFrame:
    """A fingerprint of the set of ids that doesn't depend on their order: sums of two hashes, and the count."""
    part = lambda s: F.sum(F.xxhash64(F.col(key), F.lit(s)).cast("decimal(20,0)"))
    return rows.select(key).distinct().agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), part(1).cast("string"), part(2).cast("string")), 256).alias("fingerprint"))


def without_ids(rows: DataFrame, undo: DataFrame, key: str = "id") -> DataFrame:
    """Rows without those whose key is in undo."""
    return rows.join(undo.select(key), key, "left_anti")


def valid_rows(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass all checks, and the others with their first error."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = df.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")
