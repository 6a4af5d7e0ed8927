"""Applications and their events: stages, attention, digests and reply numbers. Days are numbers of days since 1970."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.scores import fit_band, fit_fields, fit_of, iso_week, scaled

from .evaluate import percentiles

#: Stages in order, and those that are closed or a reply.
STAGES = ["applied", "screen", "interview", "offer", "accepted", "rejected", "withdrawn", "ghosted"]
CLOSED = ["accepted", "rejected", "withdrawn", "ghosted"]
REPLIES = ["screen", "interview", "offer", "accepted"]
CALLS = ["screen", "interview"]
#: Defaults: days until a follow-up for each stage, days of silence, days that count as soon, days of calls listed.
FOLLOW_UP_DAYS = {"applied": 7, "screen": 5, "interview": 5}
GHOST_DAYS, SOON_DAYS, CALL_DAYS, FEW = 21, 3, 7, 5


def event_facts(events: DataFrame, today: int) -> DataFrame:
    """One row an application (id) of what its events say; one shuffle, map-side combined.

    The stage is that of the last stage event by id, not by date (W2); follow_up_day is the value of the last follow-up
    event by id if that one sets it. reply_day is the first reply (A4), last_day the latest event (W7); call is the
    earliest screen or interview of the next days that was entered ahead of its date (W8).
    """
    stage = F.col("kind") == "stage"
    follow = F.col("kind").isin("follow_up_set", "follow_up_done")
    call = stage & F.col("value").isin(CALLS) & (F.col("at_day") > F.col("made_day")) & F.col("at_day").between(today, today + SOON_DAYS)
    last = F.max_by(F.struct("kind", "value"), F.when(follow, F.col("id")))
    return events.groupBy(F.col("application_id").alias("id")).agg(
        F.max_by(F.when(stage, F.struct("value", "at_day")), F.when(stage, F.col("id"))).alias("_stage"),
        last.alias("_follow"),
        F.count_if(follow).alias("n_follow"),
        F.min(F.when(stage & F.col("value").isin(REPLIES), F.col("at_day"))).alias("reply_day"),
        F.max("at_day").alias("last_day"),
        F.min(F.when(call, F.struct("at_day", "value"))).alias("call"),
    )


def current_state(applications: DataFrame, events: DataFrame, today: int) -> DataFrame:
    """Applications (id, applied_day) with stage, stage_day, follow_up_day, reply_day, last_day and call."""
    facts = event_facts(events, today)
    out = applications.join(facts, "id", "left")
    set_day = F.when(F.col("_follow.kind") == "follow_up_set", F.col("_follow.value").cast("long"))
    return (
        out.withColumn("stage", F.coalesce("_stage.value", F.lit("applied")))
        .withColumn("stage_day", F.coalesce("_stage.at_day", "applied_day"))
        .withColumn("follow_up_day", set_day)
        .withColumn("last_day", F.coalesce("last_day", "applied_day"))
        .withColumn("n_follow", F.coalesce("n_follow", F.lit(0)))
        .drop("_stage", "_follow")
    )


def follow_up_due(today: int, days: int | None = FOLLOW_UP_DAYS["applied"], ghost: int = GHOST_DAYS) -> Column:
    """The day of the follow-up: the one set, else one derived for applications still at the start, if not long past."""
    derived = F.when((F.col("stage") == "applied") & (F.col("n_follow") == 0) & (today - F.col("applied_day") - (days or 0) <= ghost), F.col("applied_day") + (days or 0)) if days else F.lit(None).cast("long")
    return F.coalesce("follow_up_day", derived)


def attention(state: DataFrame, today: int, ghost: int = GHOST_DAYS) -> DataFrame:
    """State with priority, reason and due of applications that need the user; null for those that can wait."""
    due = follow_up_due(today, ghost=ghost)
    closed, call = F.col("stage").isin(CLOSED), F.col("call").isNotNull()
    quiet = (F.col("stage") == "applied") & (today - F.col("last_day") >= ghost)
    ladder = lambda a, b, c, d: F.when(closed, None).when(F.col("stage") == "offer", a).when(call, b).when(due <= today, c).when(quiet, d)
    none = F.lit(None).cast("long")
    return (
        state.withColumn("priority", ladder(F.lit(0), F.lit(1), F.lit(2), F.lit(3)))
        .withColumn("reason", ladder(F.lit("offer"), F.col("call.value"), F.lit("follow up"), F.lit("ghost?")))
        .withColumn("due", ladder(none, F.col("call.at_day"), due, none))
    )


def needs_sort(state: DataFrame, today: int) -> DataFrame:
    """State with its group (needs, waiting, closed), age_days, and the sort keys of the group as k1, k2, k3."""
    rows = attention(state, today).withColumn("age_days", F.greatest(F.lit(0), today - F.col("last_day")))
    group = F.when(F.col("stage").isin(CLOSED), "closed").when(F.col("priority").isNotNull(), "needs").otherwise("waiting")
    rows = rows.withColumn("group", group)
    needs, waiting = F.col("group") == "needs", F.col("group") == "waiting"
    return rows.withColumns({
        "k1": F.when(needs, F.col("priority").cast("long")).when(waiting, -F.col("age_days")).otherwise(-F.col("stage_day")),
        "k2": F.when(needs, F.coalesce("due", F.lit(0))).when(waiting, F.col("id")).otherwise(-F.col("id")),
        "k3": F.when(needs, -F.col("age_days")).otherwise(F.lit(0)),
    })


def due_items(state: DataFrame, events: DataFrame, today: int, since: int | None = None, ghost: int = GHOST_DAYS) -> DataFrame:
    """Items (id, company, bucket, reason, sort_day, new) of a digest: follow-ups today and overdue, calls today and
    in the next days; new are those that fell due after since (by default only today's)."""
    open_ = state.where(~F.col("stage").isin(*CLOSED, "offer")).withColumn("_due", follow_up_due(today, ghost=ghost))
    follow = open_.where(F.col("_due") <= today).select("id", "company", F.when(F.col("_due") == today, "today").otherwise("overdue").alias("bucket"), F.lit("follow up").alias("reason"), F.col("_due").alias("sort_day"))
    ahead = events.where((F.col("kind") == "stage") & F.col("value").isin(CALLS) & (F.col("at_day") > F.col("made_day")) & F.col("at_day").between(today, today + CALL_DAYS))
    calls = ahead.select(F.col("application_id").alias("id"), F.col("value").alias("reason"), F.col("at_day").alias("sort_day")).join(open_.select("id", "company"), "id")
    calls = calls.select("id", "company", F.when(F.col("sort_day") == today, "today").otherwise("this_week").alias("bucket"), "reason", "sort_day")
    after = today - 1 if since is None else since
    return follow.unionByName(calls).withColumn("new", (F.col("bucket") != "this_week") & (F.col("sort_day") > after))


def due_counts(state: DataFrame, today: int, ghost: int = GHOST_DAYS) -> DataFrame:
    """How many applications are quiet."""
    due = follow_up_due(today, ghost=ghost)
    return state.agg(F.count_if((F.col("stage") == "applied") & ~F.coalesce(due <= today, F.lit(False)) & (today - F.col("last_day") >= ghost)).alias("quiet"))


def digest_row(items: DataFrame) -> DataFrame:
    """One row of subject and counts, none when nothing is new.

    The subject names the companies of today's items, else those of the new ones and since when, each once and in the
    order of its items. It is the text of one mail, so it holds every company that is named in it.
    """
    order = F.struct("sort_day", F.lower("company").alias("name"), "id")
    name = F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce("company", F.lit("")), r"\s+", " ")), F.lit("")), F.lit("—"))
    kinds = {"today": F.col("bucket") == "today", "new": F.col("new")}
    per = items.groupBy().agg(
        F.count_if("new").alias("n_new"), F.count_if(kinds["today"]).alias("n_today"), F.count_if(F.col("bucket") == "overdue").alias("n_overdue"),
        F.count_if(F.col("bucket") == "this_week").alias("n_calls"), F.min(F.when(F.col("new"), F.col("sort_day"))).alias("since"),
    )
    first = items.groupBy(name.alias("name")).agg(*[F.min(F.when(which, order)).alias(k) for k, which in kinds.items()])
    listed = first.groupBy().agg(*[F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(k).isNotNull(), F.struct(k, "name")))), lambda x: x["name"]), ", ").alias(k) for k in kinds])
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("since").cast("int")), "EEE MMM d")
    subject = F.concat(
        F.when(F.col("n_today") > 0, F.concat(F.lit("Due today: "), "today")).otherwise(F.concat(F.lit("Due since "), day, F.lit(": "), "new")),
        F.when(F.col("n_overdue") > 0, F.format_string(" · %d overdue", "n_overdue")).otherwise(""),
        F.when(F.col("n_calls") > 0, F.format_string(" · %d call%s this week", "n_calls", F.when(F.col("n_calls") == 1, "").otherwise("s"))).otherwise(""),
    )
    return per.where("n_new > 0").join(listed).select(subject.alias("subject"), "n_new", "n_today", "n_overdue", "n_calls")


#: The parts of a digest's text with their headings, in order.
DIGEST_PARTS = [("today", "Due today"), ("overdue", "Overdue"), ("this_week", "Calls this week")]


def one_line(text: Column, empty: str = "—") -> Column:
    """White space as single blanks, none at the ends; a sign for nothing."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit("")), F.lit(empty))


def digest_entry(today: int) -> Column:
    """The lines of one item (company, title, stage, reason, bucket, sort_day, fit, url, people, notes) in a digest's text."""
    late = today - F.col("sort_day")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("sort_day").cast("int"))
    ahead = F.when(F.col("sort_day") == today + 1, "tomorrow").otherwise(F.date_format(day, "EEE MMM d"))
    when = F.when(F.col("bucket") == "today", "today").when(F.col("bucket") == "overdue", F.format_string("%d day%s late", late, F.when(late == 1, "").otherwise("s"))).otherwise(ahead)
    some = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    return F.concat(
        F.format_string("- %s: %s (%s), %s %s", one_line(F.col("company")), one_line(F.col("title")), "stage", "reason", when),
        F.coalesce(F.concat(F.lit(", fit "), some("fit")), F.lit("")),
        F.coalesce(F.concat(F.lit("\n  "), some("url")), F.lit("")),
        F.coalesce(F.concat(F.lit("\n  People: "), some("people")), F.lit("")),
        F.coalesce(F.concat(F.lit("\n  Notes: "), F.replace(some("notes"), F.lit("\n"), F.lit("\n         "))), F.lit("")),
    )


def digest_text(items: DataFrame, details: DataFrame, quiet: DataFrame, today: int, ghost: int = GHOST_DAYS) -> DataFrame:
    """One row, the plain text of a digest; none when nothing is new.

    items as due_items() gives them, details (id, title, stage, url, people, notes, fit) of the applications, quiet as
    due_counts() gives it. Each item is a few lines, by part, day, company and id; at the end how many applications are
    quiet. It is the text of one mail, so all of the day's items meet in it.
    """
    lines = items.join(details, "id").withColumn("_text", digest_entry(today))
    order = F.struct("sort_day", F.lower(F.coalesce("company", F.lit(""))).alias("name"), "id", F.col("_text").alias("text"))
    part = lambda name: F.transform(F.sort_array(F.collect_list(F.when(F.col("bucket") == name, order))), lambda x: x["text"])
    sums = lines.agg(F.count_if("new").alias("_new"), *[part(name).alias(name) for name, _ in DIGEST_PARTS])
    shown = [F.when(F.size(name) > 0, F.concat(F.lit(f"{head}\n"), F.array_join(name, "\n"))) for name, head in DIGEST_PARTS]
    silent = F.when(F.col("quiet") > 0, F.format_string("Also %d application%s quiet for %d+ days.", "quiet", F.when(F.col("quiet") == 1, "").otherwise("s"), F.lit(ghost)))
    return sums.where("_new > 0").join(quiet).select(F.concat_ws("\n\n", *shown, silent).alias("text"))  # one row each


def applications_enriched(applications: DataFrame, outcomes: DataFrame, bounds: DataFrame) -> DataFrame:
    """Applications with the posting's model, label and text flag, and the scaled fit of calibrated models."""
    jobs = outcomes.select(F.col("id").alias("job_id"), "source_model", "score_label", "match_score", F.lit(True).alias("known"))
    rows = applications.join(jobs, "job_id", "left").join(bounds.select(F.col("source_model"), "low", "high"), "source_model", "left")
    fit = fit_of(F.col("match_score"), F.col("score_label"), F.col("source_model"))
    return rows.withColumn("fit_scaled", scaled(fit, F.col("low"), F.col("high"))).withColumn("known", F.coalesce("known", F.lit(False)))


def applications_full(applications: DataFrame, outcomes: DataFrame, events: DataFrame, letters: DataFrame, bounds: DataFrame) -> DataFrame:
    """Applications (id, job_id, fit_score) with what is known of them: their events in order (at_day, id, kind, value),
    the letter of their job with when it was written, whether the posting has a description, and how the fit reads (fit,
    fit_raw, fit_scaled), by the posting's label where it is known.

    outcomes has a description; letters are (job_id, text, written_at), bounds (source_model, low, high). An application
    without events has an empty list.
    """
    described = F.length(F.trim(F.coalesce("description", F.lit("")))) > 0
    jobs = outcomes.select(F.col("id").alias("job_id"), "source_model", "score_label", described.alias("has_description"), F.lit(True).alias("_known"))
    jobs = jobs.join(bounds.select("source_model", "low", "high"), "source_model", "left")
    told = letters.select("job_id", F.col("text").alias("cover_letter"), F.col("written_at").alias("cover_letter_at"))
    nested = events.groupBy(F.col("application_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("at_day", F.col("id").alias("event_id"), "kind", "value"))).alias("events"))
    rows = applications.join(jobs, "job_id", "left").join(told, "job_id", "left").join(nested, "id", "left")
    fields = fit_fields(F.col("fit_score"), F.col("score_label"), F.col("source_model"), F.col("low"), F.col("high"))
    known = F.col("_known").isNotNull() & F.col("fit_score").isNotNull()
    plain = F.when(F.col("fit_score").isNotNull(), F.format_string("%s/10", "fit_score"))
    return rows.select(
        *applications.columns,
        F.coalesce("events", F.array().cast(nested.schema["events"].dataType)).alias("events"),
        "cover_letter",
        "cover_letter_at",
        F.coalesce("has_description", F.lit(False)).alias("has_description"),
        F.when(known, fields["text"]).otherwise(plain).alias("fit"),
        F.when(known, fields["raw"]).otherwise(F.col("fit_score")).alias("fit_raw"),
        F.when(known, fields["scaled"]).alias("fit_scaled"),
    )


def reply_numbers(state: DataFrame, fit: str = "fit_score") -> DataFrame:
    """A2, A3: split, label, n, replied, rate and few: overall, by board, resume, fit band and week of application. One
    pass: rows are aggregated once by all four labels, and the splits add those counts up."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("applied_day").cast("int"))
    rows = state.select(
        F.coalesce(F.nullif("board", F.lit("")), F.lit("other")).alias("board"), F.nullif("resume_id", F.lit("")).alias("resume"), fit_band(F.col(fit)).alias("fit"), iso_week(day).alias("week"), F.col("reply_day").isNotNull().cast("int").alias("_r")
    )
    base = rows.groupBy("board", "resume", "fit", "week").agg(F.count(F.lit(1)).alias("_n"), F.sum("_r").alias("_r"))
    names = ["board", "resume", "fit", "week"]
    each = base.select(F.explode(F.array(F.struct(F.lit("overall").alias("split"), F.lit("all").alias("label")), *[F.struct(F.lit(f"by_{c}").alias("split"), F.col(c).alias("label")) for c in names])).alias("s"), "_n", "_r")
    sums = each.where("s.label IS NOT NULL").groupBy("s.split", "s.label").agg(F.sum("_n").alias("n"), F.sum("_r").alias("replied"))
    return sums.withColumn("rate", F.col("replied") / F.col("n")).withColumn("few", F.col("n") < FEW)


def median_days_to_reply(state: DataFrame) -> DataFrame:
    """A3: one row, the median null without replies."""
    days = F.greatest(F.lit(0), F.col("reply_day") - F.col("applied_day"))
    found = percentiles(state.where("reply_day IS NOT NULL"), [], days, [0.5])
    return found.agg(F.max(F.col("q")[0]).alias("median_days"), F.coalesce(F.max("n"), F.lit(0)).alias("replies"))


def stage_counts(state: DataFrame) -> DataFrame:
    """All stages, those without applications too."""
    spark = state.sparkSession
    stages = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage"))
    return stages.join(state.groupBy("stage").agg(F.count(F.lit(1)).alias("_n")), "stage", "left").select("stage", F.coalesce("_n", F.lit(0)).alias("n"))


def valid_event(at: Column, kind: Column, value: Column, today: int) -> Column:
    """F16: null for a valid event (dates in days), else what is wrong."""
    stage, ahead = kind == "stage", value.isin(CALLS)
    day = F.when(kind == "follow_up_set", value.try_cast("long"))
    return (
        F.when(~kind.isin("stage", "follow_up_set", "follow_up_done"), "unknown kind")
        .when(stage & ~value.isin(STAGES), "unknown stage")
        .when((at < 10_957) | (at > F.when(stage & ahead, F.lit(today + 365)).otherwise(F.lit(today + 1))), "date out of range")
        .when((kind == "follow_up_set") & F.coalesce(~day.between(today - 365, today + 730), F.lit(True)), "follow-up out of range")
    )


def follow_up_for(stage: Column, at: Column) -> Column:
    """The day of the follow-up that a move to a stage sets, null for stages without one."""
    out = F
    for name, days in FOLLOW_UP_DAYS.items():
        out = out.when(stage == name, at + days)
    return out
