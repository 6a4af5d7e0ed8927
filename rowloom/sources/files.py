"""Labelled pools, imported applications, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.text import csv_cell
from rowloom.operators.graph import written
from rowloom.operators.outcomes import latest_per_key
from rowloom.operators.pools import valid_rows

POOL = "job_id string, title string, company string, description string, label string, location string, match_score double, stack_role string, dealbreaker string, dealbreaker_known boolean, _bad string"
LABELS = ["notify", "log", "skip"]
STAGES = ["applied", "screen", "interview", "offer", "accepted", "rejected", "withdrawn", "ghosted"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of every line of text files, in parallel: lines are counted for each block of a file, and
    the blocks before it are added."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    raw = written(raw)
    blocks = raw.groupBy("file", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    ahead = Window.partitionBy("file").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file", "_b", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"))
    return raw.join(before, ["file", "_b"]).select("file", (F.col("_o") + F.col("_i") - F.col("_first") + 1).alias("line"), "value")


def read_pool(spark: SparkSession, path: str, pool: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid rows and errors (file, line, job_id, error) of JSON lines; with strict the first error is raised, with its
    file and line. Empty lines don't count as rows."""
    parsed = F.from_json("value", T._parse_datatype_string(POOL), {"columnNameOfCorruptRecord": "_bad"})
    raw = numbered_lines(spark, path).where("trim(value) <> ''").select("file", "line", parsed.alias("r")).select("file", "line", "r.*")
    need = {f"{c} is missing": F.coalesce(c, F.lit("")) != "" for c in ("job_id", "title", "company", "description")}
    checks = {"unreadable": F.col("_bad").isNull()} | need | {"unknown label": F.col("label").isin(LABELS), "score is not a whole number from 1 to 10": (F.col("match_score") == F.floor("match_score")) & F.col("match_score").between(1, 10)}
    good, bad = valid_rows(raw, checks)
    if strict and (first := bad.select("file", "line", "job_id", "error").orderBy("file", "line").first()):
        raise ValueError(f"{first['file']}, line {first['line']}: {first['job_id']}: {first['error']}")
    good = good.withColumn("pool", F.lit(pool)).withColumn("location", F.coalesce("location", F.lit(""))).withColumn("dealbreaker_known", F.coalesce("dealbreaker_known", F.lit(True)))
    return good.drop("_bad", "file", "line"), bad


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns, as withColumns(), each computed once a row: a filter on them isn't moved below, where it would hold
    each of their texts again for every mention, in a method too long for the compiler."""
    made = df.select("*", F.inline(F.array(F.struct(*[v.alias(f"_new_{c}") for c, v in columns.items()]))))
    return made.drop(*columns).withColumnsRenamed({f"_new_{c}": c for c in columns})


def import_applications(raw: DataFrame, applications: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV (strings; any case and blanks in headers; a column line) to new applications with stage, and rejects.

    A row is a duplicate of another row, or of an application, of the same company, title and date.
    """
    named = raw.toDF(*[c.replace("﻿", "").strip().lower().replace(" ", "_") for c in raw.columns])
    texts = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in named.columns else F.lit("") for c in ("company", "title", "url", "applied_at", "stage")}
    named = once(named, texts).where("concat(company, title, url, applied_at) <> ''")
    named = once(named, {"day": F.expr("try_to_timestamp(applied_at, 'yyyy-MM-dd')").cast("date"), "stage": F.coalesce(F.nullif(F.lower("stage"), F.lit("")), F.lit("applied"))})
    good, bad = valid_rows(named, {"company or title is missing": (F.col("company") != "") & (F.col("title") != ""), "unreadable date": F.col("day").isNotNull(), "date out of range": F.col("day").between("2000-01-01", today), "unknown stage": F.col("stage").isin(STAGES)})
    keys = lambda df: df.withColumn("_c", F.lower("company")).withColumn("_t", F.lower("title"))
    fields = ("company", "title", "url", "stage", "line")
    new = keys(good).select("_c", "_t", "day", "line", F.struct(*fields).alias("r"), F.lit(False).alias("_have"))
    have = keys(applications).select("_c", "_t", F.col("applied_at").cast("date").alias("day"), F.lit(True).alias("_have"))
    # one grouping instead of a join: each row of many would meet every application of its company and title
    groups = new.unionByName(have, allowMissingColumns=True).groupBy("_c", "_t", "day").agg(F.min_by("r", "line").alias("r"), F.max("_have").alias("_have"))
    return groups.where("NOT _have").select("r.*", F.col("day").alias("applied_at")), bad


def export_verdicts(verdicts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The latest verdict of each job, for write.csv(header=True)."""
    latest = latest_per_key(verdicts, "job_id", "received_at", "id")
    decision = F.when(F.col("verdict").isin("applied", "good"), "notify").when(F.col("verdict") == "maybe", "log").otherwise("skip")
    return latest.join(outcomes.select(F.col("id").alias("job_id"), F.col("title").alias("job_title"), "company"), "job_id", "left").select("job_id", F.coalesce("job_title", F.lit("")).alias("job_title"), F.coalesce("company", F.lit("")).alias("company"), decision.alias("decision"), "verdict", "received_at")


def export_applications(applications: DataFrame) -> DataFrame:
    """All columns as text that no spreadsheet reads as a formula."""
    return applications.select(*[csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in applications.columns])


def mail_to_verdicts(headers: DataFrame, outcomes: DataFrame, own: str, server: str) -> tuple[DataFrame, DataFrame]:
    """Headers (message_id, sender, subject, date, received_at, authentication: array) to verdict rows and the
    counts of ignored rows by reason."""
    from rowloom.functions.text import parse_mail_date, parse_verdict_subject

    ours = F.get(F.filter("authentication", lambda h: F.lower(F.trim(F.substring_index(h, ";", 1))).startswith(server.lower())), F.lit(0))
    domain = F.lower(F.regexp_extract("sender", r"@([^>\s]+)", 1))
    passed = F.exists(F.regexp_extract_all(F.lower(ours), F.lit(r"(?:dkim|spf)=pass[^;]*?(?:header\.(?:d|i)|smtp\.mailfrom)=(?:[^@;\s]*@)?([^;\s]+)"), F.lit(1)), lambda d: (d == domain) | domain.endswith(F.concat(F.lit("."), d)))
    parsed = parse_verdict_subject(F.col("subject"))
    rows = headers.withColumn("_p", parsed).withColumn("job_id", F.col("_p.job_id")).withColumn("_known", F.lit(None).cast("boolean"))
    known = outcomes.select(F.col("id").alias("job_id"), F.lit(True).alias("_is"))
    rows = rows.join(known, "job_id", "left")
    reason = F.when(~F.lower("sender").contains(own.lower()), "foreign sender").when(ours.isNotNull() & ~passed, "not authenticated").when(F.col("_p").isNull(), "bad subject").when(F.col("_is").isNull(), "unknown job")
    rows = rows.withColumn("reason", reason)
    key = F.coalesce(F.nullif("message_id", F.lit("")), F.concat(F.lit("sha1:"), F.sha1(F.concat_ws("\n", "sender", "subject", "date"))))
    good = rows.where("reason IS NULL").select("job_id", F.col("_p.verdict").alias("verdict"), parse_mail_date(F.col("date"), F.col("received_at")).alias("received_at"), key.alias("message_id"))
    return good, rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
