"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

Every text is cut where its own characters say so, so that equal texts have equal chunks wherever they stand. Chunks
are deduplicated once, by content, into verified identifiers; a document becomes the ordered list of its identifiers
(its recipe), and recipes, a few per cent of the text, are what is compared and joined from there on.

* Identifier: the 64-bit hash of the chunk, where the corpus holds one content for that hash; this is verified over all
  chunks by grouping hash and content. Where several contents share a hash, the identifier carries the content as well.
  Equal recipes therefore mean equal texts, whatever the hash function does.
* Hot groups: a content that a third of the rows share is reduced by each task before the shuffle, to one row a task;
  the rows of a large group are dealt to several tasks when they are joined to its one row (graph.join_one).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.graph import join_one

from .common import SPACE, text_of, written

#: Rows of one group that a task takes at least when rows are joined to their group.
GROUP_ROWS = 64
#: A chunk ends before a byte where it and those before it are each in the class of their place. Classes are drawn by
#: a hash of place and byte (SEED, and SHARE of all bytes), so that texts of any script have chunks of a few
#: dozen to a few hundred bytes.
SEED, PLACES, SHARE = 3881, 5, 0.5


def byte_classes(seed: int = SEED, places: int = PLACES, share: float = SHARE) -> list[list[int]]:
    """The bytes of each place. No byte is in all of them, so a run of one byte has no end of a chunk in it."""
    out = [[b for b in range(256) if hashlib.md5(f"{seed}:{k}:{b}".encode()).digest()[0] < 256 * share] for k in range(places)]
    return [*out[:-1], [b for b in out[-1] if not all(b in c for c in out[:-1])]]


def anchor_pattern(classes: list[list[int]]) -> str:
    own = ["[" + "".join(f"\\x{b:02x}" for b in c) + "]" for c in classes]
    return f"(?<={''.join(own[:-1])})(?={own[-1]})"


ANCHOR = anchor_pattern(byte_classes())


def normalised(text: F.Column) -> F.Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def as_bytes(text: F.Column) -> F.Column:
    """The UTF-8 bytes of a text as characters U+0000 to U+00FF."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def chunks(text: F.Column, anchor: str = ANCHOR) -> F.Column:
    """The chunks of a normalised text as_bytes(), in order; joined they are the text."""
    return F.split(as_bytes(text), anchor)


def collided(docs: DataFrame, id_hash=F.xxhash64, anchor: str = ANCHOR) -> DataFrame:
    """Hashes (key) under which the corpus has more than one chunk content; empty but for hash collisions."""
    each = docs.select(F.explode(F.array_distinct(chunks(normalised(text_of()), anchor))).alias("chunk"))
    contents = each.select(id_hash("chunk").alias("key"), "chunk").groupBy("key", "chunk").agg(F.lit(1).alias("one"))
    return contents.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")


def recipes(docs: DataFrame, collisions: DataFrame | None, id_hash=F.xxhash64, anchor: str = ANCHOR) -> DataFrame:
    """doc_id, recipe (identifiers in order) and text_sha256 of every row.

    collisions: the hashes that need the content in the identifier, None if there are none.
    """
    pieces = docs.select("doc_id", normalised(text_of()).alias("_t")).select("doc_id", F.sha2("_t", 256).alias("text_sha256"), chunks(F.col("_t"), anchor).alias("_c"))
    if collisions is None:
        return pieces.select("doc_id", "text_sha256", F.transform("_c", lambda c: F.struct(id_hash(c).alias("key"), F.lit("").alias("content"))).alias("recipe"))
    pieces = pieces.withColumn("_row", F.monotonically_increasing_id())
    each = pieces.select("_row", "doc_id", "text_sha256", F.posexplode("_c").alias("_pos", "_chunk")).withColumn("key", id_hash("_chunk"))
    found = each.join(collisions.withColumn("_hit", F.lit(True)), "key", "left")
    part = F.struct("_pos", "key", F.when(F.col("_hit"), F.col("_chunk")).otherwise("").alias("content"))
    return found.groupBy("_row", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(part)).alias("_p")).select(
        "doc_id", "text_sha256", F.transform("_p", lambda p: F.struct(p["key"].alias("key"), p["content"].alias("content"))).alias("recipe")
    )


def exact_groups(docs: DataFrame, id_hash=F.xxhash64, anchor: str = ANCHOR) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after normalised(); null counts as empty, and all empty texts are one group. The row
    with the smallest doc_id stays. Rows repeated under one doc_id count in group_size and share the verdict, as nothing
    tells them apart; a null doc_id stays only in a group without any other. Extra columns of docs are ignored; an empty
    table gives an empty result. Texts of any length: the unit that moves is a chunk.
    """
    docs = docs.select("doc_id", "text")
    clashes = written(collided(docs, id_hash, anchor))
    each = written(recipes(docs, None if clashes.isEmpty() else clashes, id_hash, anchor))
    # a recipe is compared as a whole; its two hashes only spread the rows
    each = each.withColumn("spread", F.xxhash64("recipe"))
    groups = each.groupBy("spread", "recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return join_one(each, groups, ["spread", "recipe"], GROUP_ROWS).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
