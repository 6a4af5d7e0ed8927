"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.graph import written  # noqa: F401

#: The white space of the contracts: space and U+0009 to U+000D, as a character class of Java's and DuckDB's patterns.
SPACE = r"[\x20\x09-\x0D]"
#: The same characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Ids up to this number are sent to every executor (16 MB at 8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> F.Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", limit: int = BROADCAST_IDS) -> DataFrame:
    """docs without the rows whose key is in ids: ids are counted, broadcast up to limit, and shuffled beyond it."""
    ids = written(ids.select(key).distinct())
    small = ids.count() <= limit
    return docs.join(F.broadcast(ids) if small else ids, key, "left_anti").select(docs.columns)


def without_copies(docs: DataFrame, copies: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows that copies() names, by their doc_id, among rows (doc_id, text) of unique doc_id.

    Where ids repeat or are null, rows are numbered and written first, and what copies() sees as doc_id is a struct that
    orders as doc_id does, nulls last, then by number: so one row of each group stays then as well.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 OR doc_id IS NULL").isEmpty():
        return without_ids(docs, copies(docs.select("doc_id", "text")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("n"))
    own = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", key.alias("doc_id")))
    gone = copies(own.select("doc_id", "text")).select("doc_id.n")
    return without_ids(own.select("row", "doc_id.n"), gone, "n").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def map_texts(df: DataFrame, keep: list[str], text: str, fields: list[tuple[str, pa.DataType, str]], work: Callable[[list[str]], list[list]], setup: Callable[[], None] | None = None, slice_bytes: int = 4 << 20) -> DataFrame:
    """keep and, for every text (null: empty), the fields that work returns, a list for each field.

    Arrow batches are cut into slices of about slice_bytes of text, so that a worker holds few texts at a time however
    long they are. fields are (name, Arrow type, Spark type). The kept columns travel in one struct, so they may have any
    names; one with the name of a field gives way to it.
    """
    names = [n for n, _, _ in fields]
    kept = [c for c in dict.fromkeys(keep) if c not in names]
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("kept"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([own.schema["kept"], *T._parse_datatype_string(", ".join(f"`{n}` {s}" for n, _, s in fields)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 50, 50)  # lists of strings and numbers have no cycles to find
        if setup:
            setup()
        for batch in batches:
            for part in slices(batch, 1, slice_bytes):
                out = work([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, type=t) for v, (_, t, _) in zip(out, fields, strict=True)]], names=["kept", *names])

    return own.mapInArrow(run, schema).select(*[F.col(f"kept.`{c}`").alias(c) for c in kept], *[F.col(f"`{n}`") for n in names])


def slices(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of at least one row and about so many bytes of column at."""
    start = size = 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)
