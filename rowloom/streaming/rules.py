"""The same rules over streams. State is keyed, bounded by watermarks, timers or time to live, and sinks are
idempotent. suppress_repeats() and the clocks need spark.sql.streaming.stateStore.providerClass set to Spark's RocksDB store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from rowloom.operators.outcomes import append_verdicts, filter_unseen, verdicts_to_applications
from rowloom.operators.tracker import CLOSED, GHOST_DAYS, follow_up_for


def landed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Files as they land."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def once_per_id(stream: DataFrame, outcomes: DataFrame, ts: str = "ingested_at", late: str = "72 hours") -> DataFrame:
    """Each id once within the watermark, without those that have a terminal outcome. Rows are judged fresh by
    their own rule; the watermark on the time of ingestion only bounds the state."""
    return filter_unseen(stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["id"]), outcomes)


def weekly_replies(stream: DataFrame, ts: str = "at", late: str = "14 days") -> DataFrame:
    """Applications and replies by tumbling weeks that start on Mondays."""
    week = F.window(ts, "7 days", startTime="4 days")
    return stream.withWatermark(ts, late).groupBy(week).agg(F.count(F.lit(1)).alias("n"), F.count_if("replied").alias("replied"))


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """What is there now, in micro-batches, each handed to an idempotent function with its id."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Partitions of the table of verdicts, by a hash of the message.
BUCKETS = 256


def append_new_verdicts(table: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Appends verdicts whose message the table doesn't have; a replayed batch appends nothing.

    The table is partitioned by a hash of the message (bucket), and a batch reads the ids of its own buckets only, and adds
    one file to each. compact_verdicts() joins what many batches left. The folder may not exist before the first batch.
    """

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("bucket", F.pmod(F.xxhash64("message_id"), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r.bucket for r in own.select("bucket").distinct().collect())  # buckets at most
        if touched:
            stored = spark.read.schema(own.schema).option("ignoreMissingFiles", "true")
            have = stored.parquet(table) if _exists(spark, table) else spark.createDataFrame([], own.schema)
            new = append_verdicts(have.where(F.col("bucket").isin(touched)), own)
            new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(table)
        own.unpersist()

    return each


def compact_verdicts(spark: SparkSession, table: str, into: str) -> None:
    """The table once more in another folder, one file a bucket, for readers and writers to change over to."""
    spark.read.parquet(table).repartition("bucket").write.partitionBy("bucket").parquet(into)


def _exists(spark: SparkSession, folder: str) -> bool:
    try:
        return bool(spark.read.format("binaryFile").load(folder).inputFiles())
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def create_applications(folder: str, outcomes: DataFrame, today_day: int, applications: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Applications from verdicts, in a folder of the batch's own, so that a replay writes the same files again.

    Jobs with an application, given or of an earlier batch, get no other one; earlier batches are one scan of the folder.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = spark.createDataFrame([], "job_id string") if applications is None else applications.select("job_id")
        if number:
            done = done.unionByName(spark.read.schema("job_id string, batch long").parquet(folder).where(F.col("batch") < number).select("job_id"))
        verdicts_to_applications(batch, outcomes, done, today_day).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return each


def suppress_repeats(stream: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """Scored rows (key, id, at: seconds) with repeat: whether the key was told in the last days; a row that is no repeat
    tells it anew. Rows of one key and batch are taken by time.

    State: the time at which the key was last told, cleared by an event-time timer when it can't make a repeat any more;
    late is how far behind rows may come.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Told(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("told", "at long")

        def handleInputRows(self, key, rows, timerValues):
            before = self.state.get()[0] if self.state.exists() else None
            told, out = before, []
            frame = pd.concat([f[["id", "at"]] for f in rows]).sort_values(["at", "id"])
            for i, at in zip(frame["id"], frame["at"], strict=True):
                repeat = told is not None and at - told < days * 86_400
                out.append((key[0], i, int(at), bool(repeat)))
                told = told if repeat else int(at)
            if told != before:
                if before is not None:
                    self.handle.deleteTimer((before + days * 86_400) * 1000)
                self.state.update((told,))
                self.handle.registerTimer((told + days * 86_400) * 1000)
            yield pd.DataFrame(out, columns=["key", "id", "at", "repeat"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.state.clear()
            return iter(())

        def close(self):
            pass

    rows = stream.select("key", "id", "at", F.timestamp_seconds("at").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Told(), outputStructType="key string, id string, at long, repeat boolean", outputMode="Append", timeMode="EventTime")


def deadlines(stream: DataFrame, late: str = "1 hour", restart: bool = False) -> DataFrame:
    """Rows (id, at, due, tag: timestamps and a text) of a stream, one for each clock that ran out: the watermark passed its
    due time and no row with a null due, which ends the clock of its id, came in between.

    A clock starts with the first row that has a due time and keeps that start: a later row changes its length (due - at)
    and its tag only. With restart, each row starts it anew. State: one row an id that waits, cleared with its timer, so
    silent ids come out and leave nothing behind. Rows of one id and batch are folded by time; rows before the watermark
    are too late and don't count.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Clock(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("clock", "first long, due long, tag string")

        def handleInputRows(self, key, rows, timerValues):
            old = tuple(self.state.get()) if self.state.exists() else None
            first, ended, last = (old[0] if old else None), None, None
            waiting = []  # starts after the last end; only the least of them counts, and ends drop the earlier ones
            for frame in rows:
                at, due = frame["at"].astype("datetime64[ms]").astype("int64"), frame["due"]
                stops = at[due.isna()]
                if len(stops):
                    ended = max(int(stops.max()), ended if ended is not None else int(stops.max()))
                open_ = due.notna() & (at > (ended if ended is not None else at.min() - 1))
                waiting = [x for x in waiting if ended is None or x > ended] + sorted(set(at[open_].tolist()))
                if open_.any():
                    k = at[open_].idxmax()
                    mine = (int(at[k]), int(due[k].timestamp() * 1000), frame["tag"][k])
                    last = mine if last is None or mine[0] >= last[0] else last
            if ended is not None and (first is None or first <= ended):
                first = None
            if last is not None and ended is not None and last[0] <= ended:
                last = None
            new = old if first is not None else None
            if last is not None:
                start = min([*waiting, *([first] if first is not None else [])])
                new = (last[0], last[1], last[2]) if restart else (start, start + last[1] - last[0], last[2])
            if new != old:
                if old:
                    self.handle.deleteTimer(old[1])
                if new:
                    self.state.update(new)
                    self.handle.registerTimer(new[1])
                else:
                    self.state.clear()
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.state.exists():
                first, due, tag = self.state.get()
                self.state.clear()
                yield pd.DataFrame({"id": [key[0]], "at": pd.to_datetime([first], unit="ms"), "due": pd.to_datetime([due], unit="ms"), "tag": [tag]})

        def close(self):
            pass

    rows = stream.select("id", "at", "due", "tag").withWatermark("at", late)
    return rows.groupBy("id").transformWithStateInPandas(statefulProcessor=Clock(), outputStructType="id string, at timestamp, due timestamp, tag string", outputMode="Append", timeMode="EventTime")


def gone_clock(stream: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """T4: answers (id, at: timestamp, empty) to ids that are gone: empty for hours since the first, nothing else between."""
    due = F.when(F.col("empty"), F.col("at") + F.expr(f"INTERVAL {hours} HOURS"))
    out = deadlines(stream.select("id", "at", due.alias("due"), F.lit("gone").alias("tag")), late)
    return out.select("id", F.col("at").alias("first_at"), F.col("tag").alias("status"))


def retry_windows(stream: DataFrame, hours: int = 24, unread: int = 6, late: str = "1 hour") -> DataFrame:
    """T5: attempts (id, at: timestamp, status) to the final rows of ids whose retries ran out: error_terminal hours after the
    first failure of the scorer, filtered after unread hours for a posting without a description. Other statuses end it."""
    wait = F.when(F.col("status") == "error_scorer", F.expr(f"INTERVAL {hours} HOURS")).when(F.col("status") == "error_unavailable", F.expr(f"INTERVAL {unread} HOURS"))
    final = F.when(F.col("status") == "error_scorer", "error_terminal").otherwise("filtered")
    out = deadlines(stream.select("id", "at", (F.col("at") + wait).alias("due"), final.alias("tag")), late)
    return out.select("id", F.col("at").alias("first_run_at"), F.col("due").alias("run_at"), F.col("tag").alias("status"))


def application_timers(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events (id of the application, at: timestamp, kind, value) to reminders: follow up when the last stage's time for
    an answer is over, or a set follow-up is due, and "ghost?" for applications still at the start with nothing heard.

    Each event starts the clocks of its application anew; closed stages, offers and follow-ups done end the one they are for.
    """
    c = F.col
    days = lambda n: F.make_dt_interval(days=n)
    stage = c("kind") == "stage"
    set_on = F.when(c("kind") == "follow_up_set", F.timestamp_seconds(c("value").try_cast("long") * 86_400))
    follow = F.coalesce(set_on, F.when(stage, c("at") + days(follow_up_for(c("value"), F.lit(0)).cast("int"))))
    quiet = F.when(~stage | (c("value") == "applied"), c("at") + days(F.lit(GHOST_DAYS)))
    due = F.explode(F.array(F.struct(F.lit("follow up").alias("tag"), follow.alias("due")), F.struct(F.lit("ghost?").alias("tag"), quiet.alias("due"))))
    # a clock of its own for each kind of reminder
    rows = stream.select(c("id").cast("string").alias("id"), "at", due.alias("r")).select(F.concat_ws(":", "r.tag", "id").alias("id"), "at", "r.due", "r.tag")
    out = deadlines(rows, late, restart=True)
    return out.select(F.substring_index("id", ":", -1).alias("id"), c("at").alias("last_at"), "due", c("tag").alias("reason"))


def application_stages(stream: DataFrame) -> DataFrame:
    """The stage of each application by its last stage event, as a running aggregate over a bounded set of applications."""
    return stream.where("kind = 'stage'").groupBy("application_id").agg(F.max_by("value", "id").alias("stage"))


def application_states(stream: DataFrame, keep_days: int = 90, late: str = "1 day") -> DataFrame:
    """Events (id, application_id, kind, value, at: timestamp) to the state of each application that they change:
    application_id, stage, stage_at, follow_up_day, as tracker.current_state() has it, for update mode.

    The last stage event and the last follow-up event by id count, whatever order they come in. State: those two. A closed
    application's state goes keep_days after its last event, by an event-time timer; a new event starts it again.
    """
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Application(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("application", "stage_id long, stage string, stage_at long, follow_id long, follow string, timer long")

        def handleInputRows(self, key, rows, timerValues):
            old = tuple(self.state.get()) if self.state.exists() else (-1, None, None, -1, None, None)
            stage_id, stage, stage_at, follow_id, follow, timer = old
            last = 0
            for f in rows:
                ms = f["at"].astype("datetime64[ms]").astype("int64")
                last = max(last, int(ms.max()))
                moves, follows = f[f["kind"] == "stage"], f[f["kind"].isin(["follow_up_set", "follow_up_done"])]
                if len(moves) and int(moves["id"].max()) > stage_id:
                    k = moves["id"].idxmax()
                    stage_id, stage, stage_at = int(moves["id"][k]), moves["value"][k], int(ms[k])
                if len(follows) and int(follows["id"].max()) > follow_id:
                    k = follows["id"].idxmax()
                    follow_id, follow = int(follows["id"][k]), follows["value"][k] if follows["kind"][k] == "follow_up_set" else None
            due = last + keep_days * 86_400_000 if stage in CLOSED else None
            if timer is not None and timer != due:
                self.handle.deleteTimer(timer)
            if due is not None and timer != due:
                self.handle.registerTimer(due)
            self.state.update((stage_id, stage, stage_at, follow_id, follow, due))
            if (stage_id, follow_id) != (old[0], old[3]):
                yield pd.DataFrame({"application_id": [key[0]], "stage": [stage or "applied"], "stage_at": pd.to_datetime([stage_at], unit="ms"), "follow_up_day": pd.array([None if follow is None else int(follow)], "Int64")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.state.clear()
            return iter(())

        def close(self):
            pass

    rows = stream.select("id", "application_id", "kind", "value", "at").withWatermark("at", late)
    out = "application_id long, stage string, stage_at timestamp, follow_up_day long"
    return rows.groupBy("application_id").transformWithStateInPandas(statefulProcessor=Application(), outputStructType=out, outputMode="Update", timeMode="EventTime")
