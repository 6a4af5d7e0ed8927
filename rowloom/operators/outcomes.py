"""Outcomes and verdicts: what is new, what is tried again, what repeats, and what users said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.text import same_job_key
from rowloom.functions.urls import url_key
from rowloom.plans.views import TERMINAL

from .graph import join_one, written

HOUR, DAY = 3600, 86400
#: Statuses that are tried again for a day.
TRIED_AGAIN = ["error_429_retry", "error_unavailable", "error_scorer"]


def latest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row with the greatest order columns; map-side combined, one shuffle, no sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def dedupe_first(df: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Of each key the row that came first."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*[order, *[c for c in rest if c != order]])).alias("_r")).select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in df.columns])


def filter_unseen(postings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Postings without a terminal outcome."""
    return postings.join(outcomes.where(F.col("status").isin(TERMINAL)).select("id"), "id", "left_anti")


def retry_candidates(listed: DataFrame, outcomes: DataFrame, now: int, hours: int = 24) -> DataFrame:
    """Outcomes to try again: failed in a way that passes, first saved in the last hours, not among the listed ids."""
    due = outcomes.where(F.col("status").isin(TRIED_AGAIN) & (F.col("first_run_at") >= now - hours * HOUR))
    return due.join(listed.select("id"), "id", "left_anti")


def suppress_repeats(scored: DataFrame, outcomes: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Scored (id, title, company, decision, delivered, slot) with status: a job notified in the last days, or
    delivered earlier in this run, is a duplicate; an alert that nobody got frees the job for its next copy.

    What a job's copies have to know is one row a job: whether it was told before, and its first slot that is delivered.
    The copies of one job are dealt to several tasks where they are many (join_one).
    """
    key = same_job_key(F.col("title"), F.col("company"))
    told = outcomes.where((F.col("status") == "notified") & (F.col("run_at") >= now - days * DAY)).select(key.alias("_k")).distinct().withColumn("_told", F.lit(True))
    rows = written(scored.withColumn("_k", F.coalesce(key, F.lit(""))))
    alert = (F.col("decision") == "notify") & F.col("delivered")
    jobs = rows.groupBy("_k").agg(F.min(F.when(alert, F.col("slot"))).alias("_first")).join(told, "_k", "left")
    known = join_one(rows, written(jobs), ["_k"])
    status = (
        F.when(F.col("decision") == "log", "logged")
        .when(F.col("decision") == "skip", "skipped")
        .when(F.coalesce("_told", F.lit(False)) | F.coalesce(F.col("_first") < F.col("slot"), F.lit(False)), "duplicate")
        .when(F.col("delivered"), "notified")
        .otherwise("error_notify")
    )
    return known.withColumn("status", status).select(*scored.columns, "status")


def latest_verdicts(verdicts: DataFrame, outcomes: DataFrame, since: int | None = None) -> DataFrame:
    """The latest verdict of each job with the job's title and company; since applies to the latest only."""
    latest = latest_per_key(verdicts, "job_id", "received_at", "id")
    if since is not None:
        latest = latest.where(F.col("received_at") > since)
    named = outcomes.select(F.col("id").alias("job_id"), "title", "company")
    return latest.join(named, "job_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "company")})


def review_queue(outcomes: DataFrame, applications: DataFrame, hidden: DataFrame, verdicts: DataFrame, now: int, days: int, most: int = 200) -> DataFrame:
    """Jobs notified in the last days that wait for the user, newest first."""
    done = latest_per_key(verdicts, "job_id", "received_at", "id").where(F.col("verdict").isin("bad", "applied")).select(F.col("job_id").alias("id"))
    out = outcomes.where((F.col("status") == "notified") & (F.col("run_at") >= now - days * DAY))
    for gone in (applications.select(F.col("job_id").alias("id")), hidden.select(F.col("job_id").alias("id")), done):
        out = out.join(gone, "id", "left_anti")
    return out.orderBy(F.desc("run_at"), F.desc("id")).limit(most)


def dismissed(outcomes: DataFrame, applications: DataFrame, hidden: DataFrame, verdicts: DataFrame, most: int = 500) -> DataFrame:
    """Jobs that the user turned down, by verdict or by hiding, without an application; kind and at of the later."""
    bad = latest_per_key(verdicts, "job_id", "received_at", "id").where("verdict = 'bad'").select(F.col("job_id").alias("id"), F.col("received_at").alias("_bad"))
    hid = hidden.groupBy(F.col("job_id").alias("id")).agg(F.max("hidden_at").alias("_hid"))
    rows = outcomes.join(bad, "id", "left").join(hid, "id", "left").where("_bad IS NOT NULL OR _hid IS NOT NULL")
    rows = rows.join(applications.select(F.col("job_id").alias("id")), "id", "left_anti")
    at = F.greatest("_bad", "_hid")
    kind = F.when(F.col("_hid").isNull() | (F.col("_bad") >= F.col("_hid")), "bad").otherwise("hidden")
    return rows.withColumn("at", at).withColumn("kind", kind).drop("_bad", "_hid").orderBy(F.desc("at"), F.desc("id")).limit(most)


def verdicts_to_applications(verdicts: DataFrame, outcomes: DataFrame, applications: DataFrame, today_day: int) -> DataFrame:
    """Applications to create: the latest verdict is applied, the posting is known, none exists, and the date is valid."""
    applied = latest_per_key(verdicts, "job_id", "received_at", "id").where("verdict = 'applied'").withColumn("applied_day", F.floor(F.col("received_at") / DAY).cast("long"))
    applied = applied.where(F.col("applied_day").between(10_957, today_day + 1))
    rows = applied.join(outcomes.select(F.col("id").alias("job_id"), "title", "company", "url"), "job_id")
    return rows.join(applications.select("job_id"), "job_id", "left_anti").select("job_id", "title", "company", "url", "applied_day")


def match_links(links: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Links (url) with the id of the job of that link, else of one with the same key; the smallest id where several."""
    exact = outcomes.groupBy("url").agg(F.min("id").alias("_exact"))
    alike = outcomes.groupBy(url_key(F.col("url")).alias("_k")).agg(F.min("id").alias("_alike"))
    rows = links.join(exact, "url", "left").withColumn("_k", url_key(F.col("url"))).join(alike, "_k", "left")
    return rows.withColumn("job_id", F.coalesce("_exact", "_alike")).drop("_k", "_exact", "_alike")


def open_duplicates(candidates: DataFrame, applications: DataFrame) -> DataFrame:
    """Candidates (url, title, company) with the latest open application for the same link, or without a link the same job."""
    open_ = applications.where(F.col("stage").isin("applied", "screen", "interview", "offer"))
    by_url = open_.where("url <> ''").groupBy(url_key(F.col("url")).alias("_u")).agg(F.max("id").alias("_by_url"))
    by_job = open_.groupBy(same_job_key(F.col("title"), F.col("company")).alias("_j")).agg(F.max("id").alias("_by_job"))
    rows = candidates.withColumn("_u", url_key(F.col("url"))).withColumn("_j", same_job_key(F.col("title"), F.col("company")))
    rows = rows.join(by_url, "_u", "left").join(by_job, "_j", "left")
    return rows.withColumn("open_id", F.when(F.col("url") != "", F.col("_by_url")).otherwise(F.col("_by_job"))).drop("_u", "_j", "_by_url", "_by_job")


def last_notified(outcomes: DataFrame) -> DataFrame:
    """W5"""
    return outcomes.where("status = 'notified'").orderBy(F.desc("run_at"), F.desc("id")).limit(1)


def numbered(df: DataFrame, key: str, order: str, name: str, width: int = 100_000) -> DataFrame:
    """df with the number of each row of its key by order, an integer column unique within the key.

    A key is numbered in stretches of width values of order, and the stretches are added up, so a key that holds a
    third of all rows is spread over many tasks.
    """
    cut = df.withColumn("_cut", F.floor(F.col(order) / width))
    sizes = cut.groupBy(key, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(key, "_cut").orderBy(order))
    return cut.withColumn("_own", own).join(ahead.select(key, "_cut", "_ahead"), [key, "_cut"]).withColumn(name, F.col("_ahead") + F.col("_own")).select(*df.columns, name)


def take_turns(postings: DataFrame) -> DataFrame:
    """Postings (id, title, company, source, ord) with their place (turn, seen), by which the run takes them: sources
    take turns in the order of their first posting (seen), each in its own order; copies of one job keep the order they
    came in, within the places that they hold.

    Places are numbered through (turn times the number of sources), so that the copies of a job are numbered twice, by
    place and by arrival, each in stretches (numbered): a job with a third of all rows is spread over tasks.
    """
    turns = numbered(postings, "source", "ord", "_turn").withColumn("_k", same_job_key(F.col("title"), F.col("company")))
    first = Window.orderBy("_seen")
    seen = written(postings.groupBy("source").agg(F.min("ord").alias("_seen")).withColumn("_s", F.row_number().over(first)))  # one row a source
    placed = written(turns.join(F.broadcast(seen), "source").withColumn("_place", F.col("_turn") * seen.count() + F.col("_s")))
    held = numbered(placed, "_k", "_place", "_held")
    came = numbered(written(held), "_k", "ord", "_came")
    both = written(came)
    own = both.select("_k", F.col("_held").alias("_came"), F.col("_turn").alias("turn"), F.col("_seen").alias("seen"))
    return both.join(own, ["_k", "_came"]).select(*postings.columns, "turn", "seen")


def upsert_outcomes(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The table with the batch written over it; first_run_at stays that of the first save."""
    both = table.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c not in ("id", "first_run_at")]
    merged = both.groupBy("id").agg(F.min_by("first_run_at", F.struct("_new", "run_at")).alias("first_run_at"), F.max_by(F.struct(*rest), F.struct("_new", "run_at")).alias("_r"))
    return merged.select(*[F.col(c) if c in ("id", "first_run_at") else F.col(f"_r.{c}").alias(c) for c in table.columns])


def remember(table: DataFrame, ids: DataFrame, status: str, now: int) -> DataFrame:
    """Rows to append for ids (id) that the table doesn't have; rows that exist are never touched."""
    new = ids.select("id").distinct().join(table.select("id"), "id", "left_anti").withColumn("status", F.lit(status)).withColumn("run_at", F.lit(now)).withColumn("first_run_at", F.lit(now))
    return new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns])


def append_verdicts(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of batch that are really new, one for each message."""
    return dedupe_first(batch, "message_id", "id").join(table.select("message_id"), "message_id", "left_anti").select(batch.columns)


def run_summary(outcomes: DataFrame, group: str = "source") -> DataFrame:
    """A1: counts of a run for each source, and of filtered rows by filter as text."""
    has = lambda s: F.count_if(F.col("status") == s)
    names = F.when(F.col("status") == "filtered", F.regexp_extract("filter_reason", "^([^:]*):", 1))
    counts = outcomes.groupBy(group).agg(
        F.count(F.lit(1)).alias("found"),
        has("notified").alias("notified"),
        has("logged").alias("logged"),
        has("skipped").alias("skipped"),
        has("duplicate").alias("duplicates"),
        F.count_if(F.col("status").isin("error_429_retry", "error_unavailable", "error_notify")).alias("retry"),
        F.count_if(F.col("status").isin("error", "error_scorer", "error_terminal")).alias("errors"),
    )
    filtered = outcomes.where("status = 'filtered'").groupBy(group, names.alias("filter")).agg(F.count(F.lit(1)).alias("n"))
    texts = filtered.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(F.concat("filter", F.lit("="), F.col("n").cast("string")))), ",").alias("filtered"))
    return counts.join(texts, group, "left").withColumn("filtered", F.coalesce("filtered", F.lit("")))


def status_counts(outcomes: DataFrame) -> DataFrame:
    """A7"""
    return outcomes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def gone_after_empty(empties: DataFrame, now: int, hours: int = 24) -> DataFrame:
    """Ids whose answers have been empty for hours since the first, of empties (id, at)."""
    return empties.groupBy("id").agg(F.min("at").alias("first_at")).withColumn("status", F.when(F.col("first_at") <= now - hours * HOUR, "gone").otherwise("pending"))


def assign_status(df: DataFrame, now: int) -> DataFrame:
    """Q3: status and reason of scored rows by the ladder, from columns filter_reason, blocked_host, needs_description, refused,
    from_listing, first_run_at, error, decision, duplicate and delivered."""
    c = F.col
    age = lambda hours: c("first_run_at").isNotNull() & (c("first_run_at") <= now - hours * HOUR)
    short = c("needs_description")
    ladder: list[tuple[Column, str, Column]] = [
        (c("filter_reason").isNotNull(), "filtered", c("filter_reason")),
        (c("blocked_host").isNotNull() & short, "filtered", F.concat(F.lit("no description: "), c("blocked_host"), F.lit(" does not allow automated reading"))),
        (c("refused") & short, "error_unavailable", F.lit("")),
        (c("from_listing") & short & age(6), "filtered", F.lit("no description: the page gave no text after several tries")),
        (c("from_listing") & short, "error_unavailable", F.lit("")),
        ((c("error") == "error_scorer") & age(24), "error_terminal", F.lit("")),
        (c("error").isNotNull(), "", F.lit("")),
        ((c("decision") == "notify") & c("duplicate"), "duplicate", F.lit("")),
        ((c("decision") == "notify") & ~c("delivered"), "error_notify", F.lit("")),
    ]
    status, reason = F, F
    for when, name, why in ladder:
        status = status.when(when, F.lit(name) if name else c("error"))
        reason = reason.when(when, why)
    decided = F.when(c("decision") == "notify", "notified").when(c("decision") == "log", "logged").otherwise("skipped")
    return df.withColumn("status", status.otherwise(decided)).withColumn("reason", reason.otherwise(""))


def score_chain(answers: list[Column], kinds: list[Column]) -> dict[str, Column]:
    """Q1: result of the first scorer with an answer; without any, the status: rate limits, then outages, then failures."""
    limited, away = (F.coalesce(*[F.when(k == kind, F.lit(True)) for k in kinds], F.lit(False)) for kind in ("rate_limited", "unavailable"))
    result = F.coalesce(*answers)
    return {"result": result, "status": F.when(result.isNotNull(), "").when(limited, "error_429_retry").when(away, "error_unavailable").otherwise("error_scorer")}


def first_saved(ids: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Q4: ids (id) with first_saved_at, the earliest time that an outcome has for the id, null for one never saved."""
    first = outcomes.groupBy("id").agg(F.min("first_run_at").alias("first_saved_at"))
    return ids.join(first, "id", "left")


def feedback_counts(saved: DataFrame, ignored: DataFrame) -> DataFrame:
    """(kind, value, n): messages saved by verdict, and ignored ones by reason."""
    per = lambda df, kind, c: df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return per(saved, "saved", "verdict").unionByName(per(ignored, "ignored", "reason"))


def alerts_outbox(alerts: DataFrame) -> DataFrame:
    """Q5: one row (id, body) for each alert, the plain text that is sent; delivery comes back as a table of its own.

    alerts: id, title, company, location, url, score_label, resume_id, reasoning, matched and gaps (arrays), source, posted_at.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    listed = lambda c: F.coalesce(F.nullif(F.array_join(F.col(c), ", "), F.lit("")), F.lit("none"))
    lines = [
        F.concat(text("title"), F.lit(" at "), text("company")), F.concat(F.lit("Location: "), text("location")), F.concat(F.lit("Link: "), text("url")), F.lit(""),
        F.concat(F.lit("Score: "), text("score_label")), F.concat(F.lit("Resume: "), text("resume_id")), F.concat(F.lit("Why: "), text("reasoning")),
        F.concat(F.lit("Matched skills: "), listed("matched")), F.concat(F.lit("Gaps: "), listed("gaps")),
        F.concat(F.lit("Source: "), text("source"), F.lit(" | Posted: "), F.coalesce(F.nullif(F.col("posted_at"), F.lit("")), F.lit("unknown"))),
    ]
    return alerts.select("id", F.concat_ws("\n", *lines).alias("body"))
