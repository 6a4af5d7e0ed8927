"""The digest of due items, at most once a day, each with what fell due since the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.tracker import current_state, digest_row, due_items

#: Failed attempts after which a day is given up.
MOST_FAILURES = 2
STATE = "day long, attempt long, result string, subject string, n_new long, n_today long, n_overdue long, n_calls long"


def digest_log(spark: SparkSession, folder: str) -> DataFrame:
    """All attempts so far (STATE): each in a folder of its day and attempt, so that writing one again writes the same."""
    return spark.read.schema(STATE).option("basePath", folder).parquet(folder)


def last_day(log: DataFrame) -> tuple[int | None, int, str]:
    """The last day with an attempt, how many of it failed, and the result of its last attempt ("" without any)."""
    row = log.groupBy("day").agg(F.count_if(F.col("result") == "failed").alias("failures"), F.max_by("result", "attempt").alias("result")).orderBy(F.desc("day")).limit(1).first()
    return (row.day, row.failures, row.result) if row else (None, 0, "")


def digest_since(day: int | None, failures: int) -> int | None:
    """Items that fell due after this day are new: the last digest's day, or the day before where that one was never sent."""
    return day - 1 if day is not None and failures else day


def send_daily(log: DataFrame, folder: str, applications: DataFrame, events: DataFrame, today: int, send: Callable[[str, DataFrame], bool]) -> str:
    """Sends the digest of today unless its day is done, and writes the attempt: sent, empty (nothing fell due) or failed.

    New is what fell due since the last day that was done, so a day on which nothing ran is part of the next digest. A day
    whose sending failed is tried again until MOST_FAILURES, and its items stay new. The attempt is written after sending;
    a run that dies in between sends again. send gets the subject and the items. Gives what it did, "" for a day done.
    """
    day, failures, result = last_day(log)
    if day is not None and (today < day or (today == day and (result != "failed" or failures >= MOST_FAILURES))):
        return ""
    items = due_items(current_state(applications, events, today), events, today, digest_since(day, failures))
    digest = digest_row(items).select("subject", "n_new", "n_today", "n_overdue", "n_calls")
    found = digest.first()
    attempt = failures + 1 if today == day else 1
    done = "empty" if found is None else "sent" if send(found.subject, items) else "failed"
    row = (today, attempt, done, *(found or (None, 0, 0, 0, 0)))
    attempted = log.sparkSession.createDataFrame([row], STATE)
    attempted.drop("day", "attempt").coalesce(1).write.mode("overwrite").parquet(f"{folder}/day={today}/attempt={attempt}")
    return done


def days_ended(stream: DataFrame, ts: str = "at", late: str = "1 hour") -> DataFrame:
    """day (number since 1970) of each day that a stream has rows of, once the watermark has passed its end. The state is one
    count a day that is open."""
    day = F.window(ts, "1 day")
    ended = stream.withWatermark(ts, late).groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    return ended.select(F.unix_date(F.to_date("window.start")).cast("long").alias("day"), "n")


def digest_each_day(folder: str, applications: Callable[[], DataFrame], events: Callable[[], DataFrame], send: Callable[[str, DataFrame], bool]) -> Callable[[DataFrame, int], None]:
    """A sink for days_ended(): when days have ended, one digest as of the day after the last of them. A replayed batch finds
    the day done and sends nothing; several days in one batch, or days without rows, are one digest."""

    def each(batch: DataFrame, _: int) -> None:
        last = batch.agg(F.max("day").alias("day")).first().day
        if last is not None:
            spark = batch.sparkSession
            try:
                log = digest_log(spark, folder)
            except AnalysisException as missing:  # the folder comes with the first attempt
                if missing.getCondition() != "PATH_NOT_FOUND":
                    raise
                log = spark.createDataFrame([], STATE)
            send_daily(log, folder, applications(), events(), last + 1, send)

    return each
