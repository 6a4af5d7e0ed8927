"""The cache of listings over a stream. Each key holds its listing until the listing is too old, by event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.text import parse_time


def leaves_at(posted_at: Column, hours: int) -> Column:
    """The first moment (timestamp) at which a listing of that date is older than hours; null for an undated one, which
    ages from when it was first seen. A date without a time counts to the end of its day, as in text.is_fresh."""
    when, text = parse_time(posted_at), F.trim(posted_at)
    dated = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[A-Za-z]+ +[0-9]{1,2}, [0-9]{4}$")
    age = F.make_dt_interval(hours=F.lit(hours))
    return F.when(dated, F.date_trunc("day", when) + F.make_dt_interval(days=F.lit(1)) + age).otherwise(when + age + F.expr("INTERVAL 1 MILLISECOND"))


def listing_cache(stream: DataFrame, hours: int = 72, late: str = "1 hour") -> DataFrame:
    """Listings (key, at: timestamp, posted_at, and what else they have) to what happens to the cache: event (kept or left),
    at, first_seen, and the listing's columns.

    A fresh listing whose key holds none is kept; while it is held, later rows of its key change nothing. It leaves when the
    watermark, or a later row of its key, reaches the time at which it is too old: hours after posted_at, or after it
    was first seen where posted_at can't be read. Then the key's next fresh row is kept. Listings too old on arrival and
    null keys are no cache's. State: one listing a key, cleared with its timer, so keys that fall silent leave nothing.
    Needs Spark's RocksDB state store.

    The cache of any moment are the listings kept and not yet left; after each batch it equals listings.merge_listings() of
    the cache before it and the batch, at the time of the batch.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    own = [c for c in stream.columns if c not in ("key", "at")]
    listing = F.struct(*[F.col(f"`{c}`") for c in own])
    shape = stream.select(listing.alias("listing")).schema["listing"].dataType
    age = hours * 3_600_000
    out = "key string, event string, at timestamp, first_seen timestamp, listing string"

    class Cache(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.held = handle.getValueState("held", "first long, leaves long, listing string")

        def handleInputRows(self, key, rows, timerValues):
            before = tuple(self.held.get()) if self.held.exists() else None
            frame = pd.concat([f[["ms", "leaves", "listing"]] for f in rows]).sort_values(["ms", "listing"], kind="stable")
            held, events = before, []
            for at, leaves, text in zip(frame["ms"], frame["leaves"], frame["listing"], strict=True):
                if held and held[1] <= at:
                    events.append(("left", held[1], held[0], held[2]))
                    held = None
                leaves = at + age + 1 if pd.isna(leaves) else leaves
                if not held and leaves > at:
                    held = (int(at), int(leaves), text)
                    events.append(("kept", at, at, text))
            if held != before:
                if before:
                    self.handle.deleteTimer(before[1])
                if held:
                    self.held.update(held)
                    self.handle.registerTimer(held[1])
                else:
                    self.held.clear()
            if events:
                yield self.frame(key[0], events)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.held.exists():
                first, leaves, text = self.held.get()
                self.held.clear()
                yield self.frame(key[0], [("left", leaves, first, text)])

        def frame(self, key, events):
            kinds, at, first, texts = zip(*events, strict=True)
            return pd.DataFrame({"key": [key] * len(events), "event": kinds, "at": pd.to_datetime(at, unit="ms"), "first_seen": pd.to_datetime(first, unit="ms"), "listing": texts})

        def close(self):
            pass

    rows = stream.where("key IS NOT NULL").select(
        "key", "at", F.unix_millis("at").alias("ms"), F.unix_millis(leaves_at(F.col("posted_at"), hours)).cast("double").alias("leaves"), F.to_json(listing).alias("listing")
    )
    rows = rows.withWatermark("at", late)
    events = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Cache(), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return events.withColumn("listing", F.from_json("listing", shape)).select("key", "event", "at", "first_seen", *[F.col(f"listing.`{c}`").alias(c) for c in own])


def cached(events: DataFrame) -> DataFrame:
    """The listings of what listing_cache() gave so far (a table) that are kept and haven't left: of each key the last event,
    where that is one of keeping. A key that leaves and is kept again at once has both events at one time; kept is later."""
    rest = [c for c in events.columns if c not in ("key", "event")]
    last = events.groupBy("key").agg(F.max_by(F.struct("event", *rest), F.struct("first_seen", F.col("event") == "left")).alias("r"))
    return last.where("r.event = 'kept'").select("key", *[F.col(f"r.`{c}`").alias(c) for c in rest if c != "at"])
