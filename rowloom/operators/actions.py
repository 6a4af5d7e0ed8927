"""A log of user actions folded into verdicts, hidden jobs, events and new applications. Each result is a pure
function of the log, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tracker import CLOSED, FOLLOW_UP_DAYS, follow_up_for


def standing(actions: DataFrame) -> DataFrame:
    """actions (id, kind, target, value, at_day) once for each id, without undone ones and without the undos. An undo names
    the action in target; undoing an undo isn't possible."""
    once = actions.dropDuplicates(["id"])
    undone = once.where("kind = 'undo'").select(F.col("target").alias("id")).distinct()
    return once.where("kind <> 'undo'").join(undone.withColumn("id", F.col("id").cast(actions.schema["id"].dataType)), "id", "left_anti")


def verdicts(actions: DataFrame) -> DataFrame:
    """Verdict rows of the actions applied and bad."""
    own = standing(actions).where(F.col("kind").isin("applied", "bad"))
    return own.select(F.col("target").alias("job_id"), F.col("kind").alias("verdict"), (F.col("at_day") * 86400).alias("received_at"), F.concat(F.lit("action:"), F.col("id").cast("string")).alias("message_id"))


def hidden(actions: DataFrame) -> DataFrame:
    """Jobs that are hidden after the last of hide and unhide, with the day."""
    last = standing(actions).where(F.col("kind").isin("hide", "unhide")).groupBy(F.col("target").alias("job_id")).agg(F.max_by(F.struct("kind", "at_day"), F.struct("at_day", "id")).alias("r"))
    return last.where("r.kind = 'hide'").select("job_id", F.col("r.at_day").alias("hidden_at"))


def events(actions: DataFrame) -> DataFrame:
    """Event rows of stage moves and follow-ups; a move sets the follow-up of its stage, or ends it for closed stages and
    offers. id orders a move before the follow-up that it sets."""
    own = standing(actions)
    moves = own.where("kind = 'stage'")
    stage = moves.select((F.col("id") * 2).alias("id"), F.col("target").alias("application_id"), F.lit("stage").alias("kind"), F.col("value"), "at_day")
    due = follow_up_for(F.col("value"), F.col("at_day"))
    ends = F.col("value").isin(*CLOSED, "offer")
    after = moves.where(F.col("value").isin(*FOLLOW_UP_DAYS) | ends).select(
        (F.col("id") * 2 + 1).alias("id"), F.col("target").alias("application_id"), F.when(ends, "follow_up_done").otherwise("follow_up_set").alias("kind"), F.when(ends, "").otherwise(due.cast("string")).alias("value"), "at_day"
    )
    asked = own.where("kind = 'follow_up'").select((F.col("id") * 2).alias("id"), F.col("target").alias("application_id"), F.when(F.col("value") == "", "follow_up_done").otherwise("follow_up_set").alias("kind"), F.col("value"), "at_day")
    return stage.unionByName(after).unionByName(asked)


def new_applications(actions: DataFrame, outcomes: DataFrame, applications: DataFrame) -> DataFrame:
    """Applications that the action applied creates: one a job, with the posting's fields, unless the job has an open one."""
    first = standing(actions).where("kind = 'applied'").groupBy(F.col("target").alias("job_id")).agg(F.min("at_day").alias("applied_day"))
    open_ = applications.where(F.col("stage").isin("applied", "screen", "interview", "offer")).select("job_id")
    return first.join(open_, "job_id", "left_anti").join(outcomes.select(F.col("id").alias("job_id"), "title", "company", "url"), "job_id")


def save_letters(letters: DataFrame, batch: DataFrame) -> DataFrame:
    """Q7: the last written text of each job."""
    both = letters.unionByName(batch)
    return both.groupBy("job_id").agg(F.max_by("text", F.struct("written_at", "text")).alias("text"), F.max("written_at").alias("written_at"))
