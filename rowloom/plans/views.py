"""Views over the given tables that stand in for postings, outcomes, verdicts, applications and model answers.

Each view is one SQL text that Spark and DuckDB both run, so that a query and its SQL twin read the same rows. Instants
are seconds since 1970.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: The instant that queries take as now, and its day.
NOW, TODAY = 1_767_225_600, "2026-01-01"
#: Statuses of outcomes, terminal ones first.
TERMINAL = ["notified", "logged", "skipped", "filtered", "error_terminal", "stale", "gone", "duplicate"]
RETRYABLE = ["error_429_retry", "error_unavailable", "error_scorer", "error_notify", "error", "pending"]
STATUSES = TERMINAL + RETRYABLE

_STATUS = "CASE doc_id % 14 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATUSES)) + " END"

VIEWS: dict[str, tuple[list[str], str]] = {
    "v_postings": (
        ["documents", "nation"],
        f"""SELECT concat(d.source, '_', d.doc_id) AS id, regexp_extract(d.text, '^([^ ]+( [^ ]+){{0,5}})', 1) AS title, d.source AS company,
          n.n_name AS location, concat('https://boards.greenhouse.io/', d.source, '/jobs/', d.doc_id) AS url, d.text AS description,
          concat('', {NOW} - 3600 * (d.doc_id % 200)) AS posted_at, d.source AS source, d.doc_id AS ord
        FROM documents d JOIN nation n ON n.n_nationkey = d.doc_id % 25""",
    ),
    "v_outcomes": (
        ["documents"],
        f"""SELECT concat(source, '_', doc_id) AS id, regexp_extract(text, '^([^ ]+( [^ ]+){{0,1}})', 1) AS title, source AS company, source AS source,
          concat('https://boards.greenhouse.io/', source, '/jobs/', doc_id) AS url, {_STATUS} AS status,
          CAST(1 + (doc_id * 37 % 91) / 10.0 AS DOUBLE) AS match_score, concat('local-', doc_id % 3) AS source_model,
          CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('fit ', 1 + doc_id % 9, '.5/10') END AS score_label,
          CASE WHEN doc_id % 14 = 3 THEN CASE WHEN doc_id % 3 = 0 THEN 'location: abroad' ELSE 'keywords: excluded' END ELSE '' END AS filter_reason,
          {NOW} - 3600 * (doc_id % 1000) AS run_at, {NOW} - 3600 * (doc_id % 1000) - 60 * (doc_id % 97) AS first_run_at, doc_id AS ord
        FROM documents""",
    ),
    "v_verdicts": (
        ["events"],
        """SELECT event_id AS id, concat('src', user_id % 20, '_', user_id) AS job_id,
          CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'click' THEN 'good' WHEN 'view' THEN 'maybe' ELSE 'bad' END AS verdict,
          CAST(floor(epoch_s / 3600) * 3600 AS BIGINT) AS received_at, concat('m', event_id % 1000003) AS message_id
        FROM v_events WHERE event_type <> 'signup'""",
    ),
    "v_app_events": (
        ["events"],
        """SELECT event_id AS id, user_id AS application_id, CASE WHEN event_id % 7 = 0 THEN 'follow_up_set' WHEN event_id % 11 = 0 THEN 'follow_up_done' ELSE 'stage' END AS kind,
          CASE WHEN event_id % 7 = 0 THEN concat('', CAST(floor(epoch_s / 86400) AS BIGINT) + event_id % 12) WHEN event_id % 11 = 0 THEN ''
            ELSE CASE event_type WHEN 'signup' THEN 'applied' WHEN 'view' THEN 'screen' WHEN 'click' THEN 'interview' WHEN 'purchase' THEN 'offer' ELSE 'rejected' END END AS value,
          CAST(floor(epoch_s / 86400) AS BIGINT) + event_id % 3 AS at_day, CAST(floor(epoch_s / 86400) AS BIGINT) AS made_day
        FROM v_events""",
    ),
    "v_applications": (
        ["customer"],
        """SELECT c_custkey AS id, concat('src', c_custkey % 20, '_', c_custkey) AS job_id, concat('src', c_custkey % 20) AS company, concat('Role ', c_nationkey) AS title,
          concat('https://boards.greenhouse.io/src', c_custkey % 20, '/jobs/', c_custkey) AS url, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('board', c_custkey % 5) END AS board,
          CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('resume', c_custkey % 3) END AS resume_id, CAST(1 + (c_custkey * 31 % 91) / 10.0 AS DOUBLE) AS fit_score,
          19700 + c_custkey % 40 AS applied_day
        FROM customer""",
    ),
    "v_labelled": (
        ["labels", "documents"],
        """SELECT l.doc_id AS id, l.quality AS y, l.toxic = 0 AS gated, CAST(1 + (d.n_chars % 37) / 4.0 AS DOUBLE) AS s,
          CASE WHEN l.quality = 1 AND d.n_chars % 3 = 0 THEN 'notify' WHEN d.n_chars % 3 = 1 THEN 'log' ELSE 'skip' END AS label
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    ),
}
#: Instants of events differ in name between the engines.
EVENTS = {"spark": "SELECT *, unix_micros(CAST(ts AS TIMESTAMP)) / 1000000 AS epoch_s FROM events", "duckdb": "SELECT *, epoch(ts) AS epoch_s FROM events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    tables, text = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if "v_events" in text:
        frames["v_events"] = spark.sql(EVENTS["spark"].replace("events", "{events}"), events=frames.pop("events"))
    text = text.replace("{", "{{").replace("}", "}}")  # names in braces are frames
    for t in frames:
        for word in ("FROM ", "JOIN "):
            text = text.replace(f"{word}{t} ", f"{word}{{{t}}} ").replace(f"{word}{t}\n", f"{word}{{{t}}}\n")
        if text.endswith(f"FROM {t}"):
            text = f"{text[: -len(t)]}{{{t}}}"
    return spark.sql(text, **frames)


def with_views(names: list[str], select: str) -> str:
    """SQL for DuckDB: select over views."""
    texts = [VIEWS[n][1] for n in names]
    parts = [f"v_events AS ({EVENTS['duckdb']})"] * any("v_events" in t for t in texts) + [f"{n} AS ({t})" for n, t in zip(names, texts, strict=True)]
    select = select.strip()
    again = "RECURSIVE " if select.startswith("WITH RECURSIVE ") else ""
    select = select.replace("WITH RECURSIVE ", "WITH ", 1)
    return f"WITH {again}{', '.join(parts)}" + (f", {select[4:]}" if select[:5].upper() == "WITH " else f" {select}")
