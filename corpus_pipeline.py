"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from rowloom.llm.common import table, without_copies
from rowloom.llm.queries import RANKS
from rowloom.operators.graph import shared_folder

#: Documents are judged already when mixing begins; what is left of the toxic domain is weighed down further.
MIX = {"clean": 0.93, "low": 0.06, "toxic": 0.01}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject; texts pass through the scoring tasks and aren't joined.

    Null and empty texts score like a text without words; rows repeated under one doc_id are judged each by its text; an
    empty table gives an empty one, and empty labels a score of one half, by which all go. Columns may have any names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    scored = toxicity.score(spark, rows, table(spark, sf_dir, "labels"), keep=("row",))
    return scored.where("predicted = 0").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest doc_id.

    Null counts as empty text, and one of the empty texts stays; of rows repeated under one doc_id, null among them, one
    stays of those with equal texts; columns may have any names; an empty table gives an empty one.
    """
    return without_copies(docs, lambda own: exact_dedup.exact_groups(own).where("not kept").select("doc_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; odd rows as in drop_copies."""
    return without_copies(docs, lambda own: simhash.near_groups(own).where("doc_id <> component_id").select("doc_id"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for, columns unchanged; a null text is an empty one, repeated rows are
    drawn alike, an empty table gives an empty one, and weights out of reach give the nearest ones and a warning."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), MIX)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs but for text, then token_ids, n_tokens and the digests of ids and of the bytes decoded from them.

    Null counts as empty and has no ids; repeated rows are encoded each; a column with the name of a result gives way to
    it; an empty table gives an empty one.
    """
    rest = tuple(c for c in docs.columns if c not in ("text", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    coded = byte_bpe.encode(spark, docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep=rest, decoded=True)
    return byte_bpe.digests(coded.withColumn("token_ids", F.col("ids")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("byte_bpe", encode_texts),
]

#: Compression, iterated graph steps and tokens aren't SQL: the pipeline is tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each stage's rows go to the folder that driver and executors share, and stay there."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
