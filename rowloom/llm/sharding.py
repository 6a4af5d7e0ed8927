"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Each shard orders the slots of a prime-sized table by its own permutation (offset and skip from its name); the shards
take turns, each claiming its best free slot, until the table is full. A document hashes to a slot, and the slot names
its shard: constant time, even shares, and few moves when a shard is added or removed (Eisenbud et al., 2016).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; a prime, at least a hundred times the number of shards for shares within about one per cent.
SLOTS = 65_537
#: Shards of the registered query.
SHARDS = 64


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The table: for each slot, the index of its shard. Its size is slots, whatever the data."""
    if not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("shards must be distinct, at least one and at most as many as slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime, so that every skip visits every slot")

    def number(salt: str, name: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8])

    at = [number("offset", s) % slots for s in shards]
    skip = [number("skip", s) % (slots - 1) + 1 for s in shards]
    out, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while out[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            out[at[i]] = i
            free -= 1
            if not free:
                return out


def lookup(spark: SparkSession, filled: list[int]) -> DataFrame:
    """The table as rows (slot, shard), made from one literal."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, filled))), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: F.Column, slots: int = SLOTS) -> F.Column:
    """The slot of a key: 60 bits of the MD5 of its text, which any engine can compute; null counts as empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with columns slot and shard (index into shards), in place of any columns of these names.

    No shuffle: the table is broadcast, 8 bytes a slot. Rows of one key share a shard, repeated rows included; a null key
    goes where the empty text goes. Extra columns stay; an empty table gives an empty result.
    """
    rest = [c for c in df.columns if c not in ("slot", "shard")]
    own = df.select(*[F.col(f"`{c}`") for c in rest], slot_of(F.col(key), slots).alias("slot"))
    return own.join(F.broadcast(lookup(df.sparkSession, fill(shards, slots))), "slot", "left").select(*[F.col(f"`{c}`") for c in rest], "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str, shards: list[str], files_per_shard: int = 4) -> None:
    """df as one folder a shard under path. A shard's rows are dealt to several tasks, by hash of the key."""
    placed = place(df, key, shards)
    deal = F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", deal).write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: list[str] | None = None) -> DataFrame:
    """doc_id, slot and shard name of every document."""
    shards = shards or names()
    return place(docs.select("doc_id"), "doc_id", shards).select("doc_id", "slot", F.format_string("shard-%05d", "shard").alias("shard"))


def sql(n: int = SHARDS, slots: int = SLOTS) -> str:
    table = ",".join(map(str, fill(names(n), slots)))
    return f"""
WITH t AS (SELECT string_split('{table}', ',') AS a),
d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {slots} AS s FROM documents)
SELECT doc_id, CAST(s AS INTEGER) AS slot, 'shard-' || lpad(a[s + 1], 5, '0') AS shard FROM d, t
"""
