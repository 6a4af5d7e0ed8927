"""Registered queries of single rules: scores and decisions, the ladder of statuses, user actions, mails, imports, replies.

Each query's rows are one SELECT over a view that Spark and DuckDB both run; the rule is applied to them by the library's
functions here, and written out once more in its twin's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom import plugins
from rowloom.functions import scores, text
from rowloom.operators import actions, evaluate, outcomes, tracker
from rowloom.sources import files, pages

from .queries import _ITEMS, _STATE, _VIEWS, NOW, TODAY, _state, due_items, has, read, register, w
from .views import TERMINAL


def rows(spark: SparkSession, d: str, name: str, select: str) -> DataFrame:
    """A SELECT over one view or table of the folder."""
    return spark.sql(select.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {v}"), v=read(spark, d, name))


def twin(select: str, rule: str) -> str:
    """The SELECT as i, then the rule over it."""
    return f"WITH i AS ({select}){',' if rule.startswith('+') else ''} {rule.lstrip('+')}"


# --- scores and decisions -------------------------------------------------------------------------------------------

_SCORES = """SELECT id, CASE WHEN ord % 9 = 0 THEN NULL WHEN ord % 5 = 0 THEN floor(match_score) ELSE match_score END AS score,
  CASE WHEN ord % 18 = 0 THEN NULL ELSE match_score / 10 END AS p, CASE WHEN ord % 7 = 0 THEN 'strong' ELSE score_label END AS label,
  source_model AS model, CAST(CASE WHEN ord % 3 = 0 THEN NULL ELSE 1 END AS DOUBLE) AS low, CAST(CASE WHEN ord % 3 = 0 THEN NULL ELSE 10 END AS DOUBLE) AS high FROM v_outcomes"""
_FIT = "CASE WHEN starts_with(model, 'local') AND label = '' AND score = floor(score) THEN NULL ELSE score END"
_UP = "least(10.0, greatest(0.0, ({0} - low) / (high - low) * 10))"
_SHOW = "printf('fit %.1f/10 (raw %.2f)', " + _UP + ", floor({0} * 100 + 1e-9) / 100)"


@register(
    twin(
        _SCORES,
        rf"""SELECT id, CASE WHEN label <> '' AND low IS NOT NULL AND score IS NOT NULL AND regexp_matches(label, '^fit [0-9]+(\.[0-9]+)?/10$') THEN {_SHOW.format("score")}
          WHEN label <> '' THEN label WHEN score IS NULL AND p IS NULL THEN 'n/a' WHEN score IS NULL THEN printf('fit %.0f%%', p * 100)
          WHEN low IS NOT NULL AND fit IS NOT NULL THEN {_SHOW.format("fit")}
          WHEN score = floor(score) THEN concat(CAST(score AS BIGINT), '/10') ELSE concat(score, '/10') END AS shown,
          CASE WHEN label = '' AND score IS NULL THEN NULL WHEN label = '' THEN concat(score, '/10') ELSE label END AS told, floor(fit * 100 + 1e-9) / 100 AS raw,
          CASE WHEN low IS NOT NULL AND (label = '' OR regexp_matches(label, '^fit [0-9]+(\.[0-9]+)?/10$')) THEN round({_UP.format("fit")}, 6) END AS up
        FROM (SELECT *, {_FIT} AS fit FROM i)""",
    ),
    ["v_outcomes"],
)
def shown_scores(spark: SparkSession, d: str) -> DataFrame:
    """X2, X3, X4"""
    c = F.col
    args = (c("label"), c("model"), c("low"), c("high"))
    fields = scores.fit_fields(c("score"), *args)
    out = rows(spark, d, "v_outcomes", _SCORES).select("id", scores.score_label(c("score"), c("p"), *args).alias("shown"), fields.alias("f"), "label", "score")
    told = F.when((c("label") == "") & c("score").isNull(), None).otherwise(c("f.text"))
    return out.select("id", "shown", told.alias("told"), c("f.raw").alias("raw"), F.round("f.scaled", 6).alias("up"))


_DECIDED = "SELECT id, gated, s, s / 10 AS p, id % 11 AS k FROM v_labelled"


@register(
    twin(
        _DECIDED,
        """+ t AS (SELECT *, list_transform(range(0, 11), lambda j: exp(-power(j - k, 2) / 2)) AS w FROM i)
        SELECT id, CASE WHEN gated AND s >= 7 THEN 'notify' WHEN gated AND s >= 4 THEN 'log' ELSE 'skip' END AS decision,
          CASE WHEN p >= 0.8 THEN 8 WHEN p >= 0.3 THEN 6 ELSE 3 END AS score, round(w[k + 1] / list_sum(w), 9) AS at, round(w[1] / list_sum(w), 9) AS first FROM t""",
    ),
    ["v_labelled"],
)
def decisions(spark: SparkSession, d: str) -> DataFrame:
    """X9, X10, X11, X14"""
    target = scores.smoothed_target(F.col("k"), 11, 1.0)
    return rows(spark, d, "v_labelled", _DECIDED).select(
        "id",
        scores.decide_gated(F.col("gated"), F.col("s"), 7, 4).alias("decision"),
        scores.decision_score(scores.decide_alert(F.col("p"), 0.8, 0.3)).alias("score"),
        F.round(F.get(target, F.col("k").cast("int")), 9).alias("at"),
        F.round(F.get(target, F.lit(0)), 9).alias("first"),
    )


_ROLES = """SELECT id, CASE ord % 5 WHEN 0 THEN concat(' ', upper(source)) WHEN 1 THEN ' Backend ' WHEN 2 THEN 'DATA' WHEN 3 THEN title ELSE 'ai' END AS role, run_at FROM v_outcomes"""


@register(
    twin(
        _ROLES,
        f"""SELECT id, CASE WHEN lower(trim(role)) IN ({", ".join(f"'{r}'" for r in scores.STACK_ROLES)}) THEN lower(trim(role)) ELSE 'other' END AS role,
          run_at % 86400 // 60 >= 22 * 60 + 30 OR run_at % 86400 // 60 < 7 * 60 AS night, run_at % 86400 // 60 BETWEEN 12 * 60 AND 13 * 60 - 1 AS noon FROM i""",
    ),
    ["v_outcomes"],
)
def roles_and_hours(spark: SparkSession, d: str) -> DataFrame:
    """X13, X16"""
    at = F.timestamp_seconds("run_at")
    quiet = {"night": scores.is_quiet(at, "UTC", "22:30", "07:00"), "noon": scores.is_quiet(at, "UTC", "12:00", "13:00")}
    return rows(spark, d, "v_outcomes", _ROLES).select("id", scores.role_target(F.col("role")).alias("role"), *[v.alias(k) for k, v in quiet.items()])


# --- the chain of scorers and the ladder of statuses ------------------------------------------------------------------

_CHAIN = """SELECT id, CASE WHEN ord % 3 = 0 THEN match_score END AS first, CASE WHEN ord % 5 = 0 THEN match_score / 2 END AS second,
  CASE ord % 7 WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'failed' END AS kind_1,
  CASE ord % 4 WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'failed' END AS kind_2 FROM v_outcomes"""


@register(
    twin(
        _CHAIN,
        """SELECT id, coalesce(first, second) AS result, CASE WHEN first IS NOT NULL OR second IS NOT NULL THEN '' WHEN 'rate_limited' IN (coalesce(kind_1, ''), coalesce(kind_2, '')) THEN 'error_429_retry'
          WHEN 'unavailable' IN (coalesce(kind_1, ''), coalesce(kind_2, '')) THEN 'error_unavailable' ELSE 'error_scorer' END AS status FROM i""",
    ),
    ["v_outcomes"],
)
def chained_scores(spark: SparkSession, d: str) -> DataFrame:
    """Q1"""
    c = F.col
    made = outcomes.score_chain([c("first"), c("second")], [c("kind_1"), c("kind_2")])
    return rows(spark, d, "v_outcomes", _CHAIN).select("id", *[v.alias(k) for k, v in made.items()])


_LADDER = f"""SELECT id, CASE WHEN ord % 10 = 0 THEN 'keywords: excluded' END AS filter_reason, CASE WHEN ord % 6 = 0 THEN concat(source, '.example') END AS blocked_host,
  ord % 4 = 1 AS needs_description, ord % 8 = 1 AS refused, ord % 12 < 6 AS from_listing, CASE WHEN ord % 13 = 0 THEN NULL ELSE {NOW} - 3600 * (ord % 60) END AS first_run_at,
  CASE ord % 11 WHEN 0 THEN 'error_scorer' WHEN 1 THEN 'error_429_retry' END AS error, CASE ord % 3 WHEN 0 THEN 'notify' WHEN 1 THEN 'log' ELSE 'skip' END AS decision,
  ord % 9 = 0 AS duplicate, ord % 7 > 0 AS delivered FROM v_outcomes"""


@register(
    twin(
        _LADDER,
        f"""SELECT id, CASE WHEN filter_reason IS NOT NULL OR blocked_host IS NOT NULL AND needs_description THEN 'filtered' WHEN NOT needs_description OR NOT (refused OR from_listing) THEN
            CASE WHEN error = 'error_scorer' AND first_run_at <= {NOW - 86400} THEN 'error_terminal' WHEN error IS NOT NULL THEN error WHEN decision = 'log' THEN 'logged' WHEN decision = 'skip' THEN 'skipped'
              WHEN duplicate THEN 'duplicate' WHEN delivered THEN 'notified' ELSE 'error_notify' END
          WHEN refused OR first_run_at IS NULL OR first_run_at > {NOW - 6 * 3600} THEN 'error_unavailable' ELSE 'filtered' END AS status,
          CASE WHEN filter_reason IS NOT NULL THEN filter_reason WHEN blocked_host IS NOT NULL AND needs_description THEN concat('no description: ', blocked_host, ' does not allow automated reading')
            WHEN needs_description AND NOT refused AND from_listing AND first_run_at <= {NOW - 6 * 3600} THEN 'no description: the page gave no text after several tries' ELSE '' END AS reason FROM i""",
    ),
    ["v_outcomes"],
)
def assigned_statuses(spark: SparkSession, d: str) -> DataFrame:
    """Q3"""
    return outcomes.assign_status(rows(spark, d, "v_outcomes", _LADDER), NOW).select("id", "status", "reason")


_SAVED = "SELECT concat(source, '_', doc_id % 701) AS id, doc_id AS ord, lang AS status FROM documents"


@register(twin(_SAVED, "SELECT id, min(ord) AS ord, arg_min(status, ord) AS status FROM i GROUP BY id"))
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """W3"""
    return outcomes.dedupe_first(rows(spark, d, "documents", _SAVED))


_IDS = "SELECT concat(source, '_', doc_id * 3) AS id FROM documents"


@register(
    f"WITH i AS ({_IDS}) SELECT DISTINCT i.id, 'stale' AS status, {NOW} AS first_run_at FROM i LEFT JOIN v_outcomes o ON o.id = i.id WHERE o.id IS NULL",
    ["v_outcomes"],
)
def remembered(spark: SparkSession, d: str) -> DataFrame:
    """S21"""
    found = outcomes.remember(read(spark, d, "v_outcomes"), rows(spark, d, "documents", _IDS), "stale", NOW)
    return found.select("id", "status", F.col("first_run_at").cast("int").alias("first_run_at"))


# --- user actions -----------------------------------------------------------------------------------------------------

#: Actions of users, a tenth of them undone later.
_ACTIONS = """SELECT event_id AS id, CASE WHEN event_id % 10 = 9 THEN 'undo' WHEN event_type = 'purchase' THEN 'applied' WHEN event_type = 'click' THEN 'stage' WHEN event_type = 'view' THEN 'hide'
    WHEN event_type = 'signup' THEN 'unhide' WHEN event_id % 2 = 0 THEN 'follow_up' ELSE 'bad' END AS kind,
  CASE WHEN event_id % 10 = 9 THEN concat('', event_id - 4) ELSE concat('src', user_id % 20, '_', user_id) END AS target,
  CASE WHEN event_type = 'click' THEN CASE event_id % 5 WHEN 0 THEN 'screen' WHEN 1 THEN 'interview' WHEN 2 THEN 'offer' WHEN 3 THEN 'rejected' ELSE 'applied' END
    WHEN event_id % 3 = 0 THEN '' ELSE concat('', 19700 + event_id % 50) END AS value, CAST(floor(epoch_s / 86400) AS BIGINT) AS at_day FROM v_events"""
_STANDING = "s AS (SELECT * FROM i WHERE kind <> 'undo' AND id NOT IN (SELECT CAST(target AS BIGINT) FROM i WHERE kind = 'undo'))"
_EVENTS = "v_events AS (SELECT *, epoch(ts) AS epoch_s FROM events), "


def _actions(spark: SparkSession, d: str) -> DataFrame:
    timed = spark.sql("SELECT *, unix_micros(CAST(ts AS TIMESTAMP)) / 1000000 AS epoch_s FROM {e}", e=read(spark, d, "events"))
    return spark.sql(_ACTIONS.replace("FROM v_events", "FROM {v}"), v=timed)


def _acted(rule: str) -> str:
    return f"WITH {_EVENTS} i AS ({_ACTIONS}), {_STANDING} {rule}"


@register(_acted("SELECT target AS job_id, kind AS verdict, at_day * 86400 AS received_at, concat('action:', id) AS message_id FROM s WHERE kind IN ('applied', 'bad')"))
def action_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Q6"""
    return actions.verdicts(_actions(spark, d))


@register(_acted("SELECT target AS job_id, arg_max(at_day, (at_day, id)) AS hidden_at FROM s WHERE kind IN ('hide', 'unhide') GROUP BY target HAVING arg_max(kind, (at_day, id)) = 'hide'"))
def action_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Q6"""
    return actions.hidden(_actions(spark, d))


@register(
    _acted(
        """SELECT 2 * id AS id, target AS application_id, 'stage' AS kind, value, at_day FROM s WHERE kind = 'stage' UNION ALL
        SELECT 2 * id + 1, target, CASE WHEN value IN ('applied', 'screen', 'interview') THEN 'follow_up_set' ELSE 'follow_up_done' END,
          CASE value WHEN 'applied' THEN concat('', at_day + 7) WHEN 'screen' THEN concat('', at_day + 5) WHEN 'interview' THEN concat('', at_day + 5) ELSE '' END, at_day FROM s WHERE kind = 'stage' UNION ALL
        SELECT 2 * id, target, CASE value WHEN '' THEN 'follow_up_done' ELSE 'follow_up_set' END, value, at_day FROM s WHERE kind = 'follow_up'"""
    )
)
def action_events(spark: SparkSession, d: str) -> DataFrame:
    """Q6, X15"""
    return actions.events(_actions(spark, d))


@register(
    f"WITH {_EVENTS} i AS ({_ACTIONS}), {_STANDING}, "
    """f AS (SELECT target AS job_id, min(at_day) AS applied_day FROM s WHERE kind = 'applied' GROUP BY target),
    a AS (SELECT job_id, CASE id % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'offer' WHEN 2 THEN 'rejected' ELSE 'ghosted' END AS stage FROM v_applications)
    SELECT f.job_id, applied_day, title, company, url FROM f JOIN v_outcomes o ON o.id = f.job_id WHERE f.job_id NOT IN (SELECT job_id FROM a WHERE stage IN ('applied', 'offer'))""",
    ["v_applications", "v_outcomes"],
)
def action_applications(spark: SparkSession, d: str) -> DataFrame:
    """Q6"""
    stage = F.element_at(F.array(*map(F.lit, ["applied", "offer", "rejected", "ghosted"])), (F.col("id") % 4 + 1).cast("int"))
    have = read(spark, d, "v_applications").select("job_id", stage.alias("stage"))
    return actions.new_applications(_actions(spark, d), read(spark, d, "v_outcomes"), have).select("job_id", "applied_day", "title", "company", "url")


_LETTERS = "SELECT concat('src', user_id % 20, '_', user_id) AS job_id, concat('Dear ', event_type, ' ', event_id % 13) AS text, event_id % 97 AS written_at, event_id % 2 AS half FROM events"


@register(twin(_LETTERS, "SELECT job_id, arg_max(text, (written_at, text)) AS text, max(written_at) AS written_at FROM i GROUP BY job_id"))
def saved_letters(spark: SparkSession, d: str) -> DataFrame:
    """Q7: one half of the letters stored before, the other written now"""
    made = rows(spark, d, "events", _LETTERS)
    parts = [made.where(F.col("half") == k).drop("half") for k in (0, 1)]
    return actions.save_letters(*parts)


_VALID = """SELECT id, CASE WHEN id % 17 = 0 THEN 'note' ELSE kind END AS kind, CASE WHEN id % 19 = 0 THEN 'hired' WHEN id % 23 = 0 THEN '99999' ELSE value END AS value,
  at_day + CASE id % 13 WHEN 0 THEN 400 WHEN 1 THEN 30 ELSE 0 END AS at_day FROM v_app_events"""


@register(
    twin(
        _VALID,
        f"""SELECT id, CASE WHEN kind NOT IN ('stage', 'follow_up_set', 'follow_up_done') THEN 'unknown kind'
          WHEN kind = 'stage' AND value NOT IN ({", ".join(f"'{s}'" for s in tracker.STAGES)}) THEN 'unknown stage'
          WHEN at_day < 10957 OR at_day > {TODAY} + CASE WHEN kind = 'stage' AND value IN ('screen', 'interview') THEN 365 ELSE 1 END THEN 'date out of range'
          WHEN kind = 'follow_up_set' AND NOT coalesce(TRY_CAST(value AS BIGINT) BETWEEN {TODAY - 365} AND {TODAY + 730}, false) THEN 'follow-up out of range' END AS error FROM i""",
    ),
    ["v_app_events"],
)
def valid_events(spark: SparkSession, d: str) -> DataFrame:
    """F16"""
    c = F.col
    return rows(spark, d, "v_app_events", _VALID).select("id", tracker.valid_event(c("at_day"), c("kind"), c("value"), TODAY).alias("error"))


# --- mails, imports, replies --------------------------------------------------------------------------------------------

_MAILS = f"""SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE message_id END AS message_id, CASE WHEN id % 7 = 0 THEN 'Eve <eve@other.example>' ELSE 'Me <me@home.example>' END AS sender,
  CASE id % 6 WHEN 0 THEN concat('Re: JH:', verdict, ':', job_id) WHEN 1 THEN concat('  fw : aw: jh:', upper(verdict), ': ', job_id) WHEN 2 THEN concat('news of ', job_id)
    WHEN 3 THEN concat('JH:', verdict, ':', job_id, '  ') ELSE concat('jh:', verdict, ':', job_id) END AS subject,
  CASE id % 4 WHEN 0 THEN concat('Thu, ', 1 + id % 28, ' Jan 2026 10:', 10 + id % 50, ':00 +0100') WHEN 1 THEN concat(1 + id % 28, ' Feb 2026 23:59:59 +0000 (UTC)') ELSE 'yesterday' END AS date, received_at,
  CASE id % 8 WHEN 0 THEN 'mx.home.example; dkim=pass header.d=home.example' WHEN 1 THEN 'mx.home.example; dkim=fail header.d=home.example; spf=pass smtp.mailfrom=me@home.example'
    WHEN 2 THEN 'mx.home.example; dkim=pass header.d=ome.example' WHEN 3 THEN 'other.example; dkim=fail' ELSE '' END AS auth FROM v_verdicts"""
#: The parts of a mail that the rule reads, each taken out once.
_READ = r"""+ p AS (SELECT *, regexp_extract(subject, '(?i)^\s*(?:(?:re|fwd?|aw)\s*:\s*)*jh:(applied|good|maybe|bad):(\S.*?)\s*$', ['v', 'j']) AS s FROM i),
  r AS (SELECT p.*, lower(s.v) AS verdict, s.j AS job_id, o.id IS NOT NULL AS known,
    CASE WHEN NOT contains(lower(sender), 'me@home.example') THEN 'foreign sender' WHEN starts_with(auth, 'mx.home.example') AND NOT (contains(auth, 'dkim=pass header.d=home.example') OR contains(auth, 'spf=pass smtp.mailfrom=me@home.example')) THEN 'not authenticated'
      WHEN s.v = '' THEN 'bad subject' WHEN o.id IS NULL THEN 'unknown job' END AS reason FROM p LEFT JOIN v_outcomes o ON o.id = p.s.j)"""


def _mail(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    made = rows(spark, d, "v_verdicts", _MAILS).withColumn("received_at", F.timestamp_seconds("received_at")).withColumn("authentication", F.when(F.col("auth") == "", F.array().cast("array<string>")).otherwise(F.array("auth")))
    return files.mail_to_verdicts(made, read(spark, d, "v_outcomes"), "me@home.example", "mx.home.example")


@register(
    twin(
        _MAILS,
        _READ
        + r""" SELECT job_id, verdict, CASE id % 4 WHEN 0 THEN epoch(strptime(regexp_extract(date, ', (.*) \+0100', 1), '%d %b %Y %H:%M:%S')) - 3600 WHEN 1 THEN epoch(strptime(regexp_extract(date, '^(.*) \+0000', 1), '%d %b %Y %H:%M:%S'))
          ELSE received_at END::BIGINT AS received_at, CASE message_id WHEN '' THEN concat('sha1:', sha1(concat_ws(chr(10), sender, subject, date))) ELSE message_id END AS message_id FROM r WHERE reason IS NULL""",
    ),
    ["v_verdicts", "v_outcomes"],
)
def mail_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """S23, C23, C25, F15"""
    return _mail(spark, d)[0].withColumn("received_at", F.unix_seconds("received_at"))


@register(twin(_MAILS, _READ + " SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason"), ["v_verdicts", "v_outcomes"])
def ignored_mails(spark: SparkSession, d: str) -> DataFrame:
    """S23"""
    return _mail(spark, d)[1]


_IMPORTED = """SELECT id AS line, CASE WHEN id % 11 = 0 THEN ' ' ELSE concat(' ', upper(company)) END AS company, concat(title, CASE WHEN id % 3 = 0 THEN ' ' ELSE '' END) AS title, url,
  CASE id % 9 WHEN 0 THEN 'last week' WHEN 1 THEN '2031-01-01' ELSE concat('2025-0', 1 + id % 3, '-1', id % 4) END AS applied_at,
  CASE id % 7 WHEN 0 THEN 'Screen' WHEN 1 THEN 'hired' WHEN 2 THEN '' ELSE 'applied' END AS stage FROM v_applications"""
_GOOD = """+ c AS (SELECT line, trim(company) AS company, trim(title) AS title, url, TRY_CAST(applied_at AS DATE) AS day, CASE trim(stage) WHEN '' THEN 'applied' ELSE lower(trim(stage)) END AS stage FROM i),
  e AS (SELECT *, CASE WHEN company = '' OR title = '' THEN 'company or title is missing' WHEN day IS NULL THEN 'unreadable date' WHEN day NOT BETWEEN DATE '2000-01-01' AND DATE '2026-01-01' THEN 'date out of range'
    WHEN stage NOT IN ('applied', 'screen', 'interview', 'offer', 'accepted', 'rejected', 'withdrawn', 'ghosted') THEN 'unknown stage' END AS error FROM c)"""


def _imported(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = rows(spark, d, "v_applications", _IMPORTED).withColumnsRenamed({"company": " Company", "applied_at": "Applied at", "stage": "STAGE "})
    have = read(spark, d, "v_applications").where("id % 5 = 0").select("company", "title", F.lit("2025-01-11").alias("applied_at"))
    return files.import_applications(raw, have, "2026-01-01")


@register(
    twin(
        _IMPORTED,
        _GOOD
        + """, o AS (SELECT *, row_number() OVER (PARTITION BY lower(company), lower(title), day ORDER BY line) AS k FROM e WHERE error IS NULL)
        SELECT company, title, url, stage, line, CAST(day AS VARCHAR) AS applied_at FROM o WHERE k = 1 AND NOT EXISTS (
          SELECT 1 FROM v_applications a WHERE a.id % 5 = 0 AND lower(a.company) = lower(o.company) AND lower(a.title) = lower(o.title) AND o.day = DATE '2025-01-11')""",
    ),
    ["v_applications"],
)
def imported_applications(spark: SparkSession, d: str) -> DataFrame:
    """S17"""
    return _imported(spark, d)[0].withColumn("applied_at", F.col("applied_at").cast("string"))


@register(twin(_IMPORTED, _GOOD + " SELECT line, error FROM e WHERE error IS NOT NULL"), ["v_applications"])
def rejected_imports(spark: SparkSession, d: str) -> DataFrame:
    """S17"""
    return _imported(spark, d)[1].select("line", "error")


_REPLIES = """SELECT id, CASE ord % 8 WHEN 0 THEN concat('<think>{"score": 1}</think>', '{"score": ', 1 + ord % 12, ', "reasoning": "fits ', source, '"}') WHEN 1 THEN 'no answer' WHEN 2 THEN '{"score": "high"}'
    WHEN 3 THEN concat('Here: {"score": "', 1 + ord % 10, '", "matched_skills": ["sql", "', source, '"], "keyword_gaps": [], "role_type": "data"} Bye') WHEN 4 THEN '{"score": 7'
    WHEN 5 THEN concat('{"score": ', 1 + ord % 10, ', "matched_skills": "sql", "role_type": null}') ELSE concat('{"reasoning": "', source, '", "score": ', 1 + ord % 10, '}') END AS reply FROM v_outcomes"""


@register(
    twin(
        _REPLIES,
        r"""+ b AS (SELECT id, TRY_CAST(nullif(regexp_extract(regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g'), '(?s)\{.*\}'), '') AS JSON) AS j FROM i),
        s AS (SELECT id, j, j->>'$.score' AS score FROM b)
        SELECT id, CASE WHEN regexp_matches(score, '^([1-9]|10)$') THEN CAST(score AS INT) END AS score, j->>'$.reasoning' AS reasoning,
          coalesce(array_to_string(CASE WHEN json_type(j->'$.matched_skills') = 'ARRAY' THEN CAST(j->'$.matched_skills' AS VARCHAR[]) END, ','), '') AS matched, j->>'$.role_type' AS role,
          CASE WHEN j IS NULL THEN 'no JSON object' WHEN NOT coalesce(regexp_matches(score, '^([1-9]|10)$'), false) THEN 'score is not a whole number from 1 to 10' END AS error FROM s""",
    ),
    ["v_outcomes"],
)
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """C20"""
    p = rows(spark, d, "v_outcomes", _REPLIES).select("id", text.parse_reply(F.col("reply")).alias("p"))
    return p.select("id", "p.score", "p.reasoning", F.array_join("p.matched_skills", ",").alias("matched"), F.col("p.role_type").alias("role"), "p.error")


_PROMPT = "SELECT id, title, company, concat('<posting> `', substr(description, 1, 400), '` ', chr(9), ' </posting>', chr(10), source) AS body, location AS profile FROM v_postings"


@register(
    twin(
        _PROMPT,
        r"""+ f AS (SELECT *, list_transform([title, company, body], lambda x: trim(regexp_replace(translate(x, '<>`', ''), '\s+', ' ', 'g'))) AS x FROM i)
        SELECT id, x[3] AS fenced, concat('Candidate profile:', chr(10), profile, chr(10, chr(10), '<posting>', chr(10), 'Title: ', x[1][:200], chr(10), 'Company: ', x[2][:200], chr(10), x[3][:300], chr(10), '</posting>') AS prompt FROM f""".replace("chr(10, chr(10)", "chr(10), chr(10)"),
    ),
    ["v_postings"],
)
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """C19"""
    c = F.col
    made = text.build_prompt(c("title"), c("company"), c("body"), c("profile"), 300)
    return rows(spark, d, "v_postings", _PROMPT).select("id", text.fence_text(c("body"), 100_000).alias("fenced"), made.alias("prompt"))


_REPORT = """SELECT source, count_if(status = 'notified') AS alerts, count(*) % 2 = 0 AS met, avg(match_score) / 10 AS precision, CAST(0.55 AS DOUBLE) AS base_rate, max(match_score) - min(match_score) AS spread,
  CAST(8.95 AS DOUBLE) AS least_spread, avg(match_score) / 10 AS accuracy, CAST(0.5 AS DOUBLE) AS majority FROM v_outcomes GROUP BY source"""


@register(
    twin(
        _REPORT,
        """SELECT source, concat_ws('; ', CASE WHEN alerts = 0 THEN 'nothing passes the gates' END, CASE WHEN NOT met THEN 'no cut-off catches enough' END, CASE WHEN precision <= base_rate THEN 'alerts are no better than chance' END,
          CASE WHEN spread < least_spread THEN 'scores are close together' END, CASE WHEN accuracy - majority < 0.05 THEN 'answers are no better than the usual one' END) AS warnings FROM i""".replace("count_if(", "count_if ("),
    ).replace("count_if(status = 'notified')", "sum(CASE WHEN status = 'notified' THEN 1 ELSE 0 END)"),
    ["v_outcomes"],
)
def warned_reports(spark: SparkSession, d: str) -> DataFrame:
    """A report for each source"""
    return evaluate.report_warnings(rows(spark, d, "v_outcomes", _REPORT)).select("source", "warnings")


# --- SQL functions ------------------------------------------------------------------------------------------------------


@register(
    rf"""WITH s AS (SELECT id, list_filter(regexp_split_to_array(replace(regexp_replace(description, '([.!?])\s+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)), lambda x: trim(x) <> '') AS x FROM v_postings)
    SELECT id, len(x) AS sentences, x[1] AS first, x[-1] AS last FROM s WHERE len(x) > 0""",
    ["v_postings"],
)
def split_sentences(spark: SparkSession, d: str) -> DataFrame:
    """K5: a table function of the session, joined to each posting"""
    plugins.register_functions(spark)
    found = spark.sql("SELECT p.id, s.n, s.sentence FROM {p} p, LATERAL sentences_of(p.description) s", p=read(spark, d, "v_postings"))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("sentences"), F.min_by("sentence", "n").alias("first"), F.max_by("sentence", "n").alias("last"))


@register(
    f"""SELECT id, floor(match_score * 33 * 100 + 1e-9) / 100 AS raw, CASE WHEN match_score >= 7 THEN 'notify' WHEN match_score >= 5 THEN 'log' ELSE 'skip' END AS decision,
      CASE WHEN status IN ({", ".join(f"'{s}'" for s in TERMINAL)}) THEN 'done' ELSE 'open' END AS state, CASE WHEN match_score < 5 THEN '<5' WHEN match_score < 7 THEN '5–7' ELSE '≥7' END AS band,
      round(least(10.0, greatest(0.0, (match_score - 2) / 6 * 10)), 6) AS up FROM v_outcomes""",
    ["v_outcomes"],
)
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """K6: the rules as SQL functions"""
    plugins.register_functions(spark)
    return spark.sql(
        "SELECT id, floor2(match_score * 33) AS raw, decide(match_score, 7, 5) AS decision, outcome_state(status) AS state, fit_band(match_score) AS band, round(scaled(match_score, 2, 8), 6) AS up FROM {o}",
        o=read(spark, d, "v_outcomes"),
    )


@register(
    """WITH e AS (SELECT s AS score, count(*) AS n, count(*) FILTER (y = 1) AS good FROM v_labelled GROUP BY s)
    SELECT score, sum(n) OVER w AS n_at, round(sum(good) OVER w / sum(n) OVER w, 9) AS precision, round(sum(good) OVER w / (SELECT sum(good) FROM e), 9) AS recall FROM e WINDOW w AS (ORDER BY score DESC)""",
    ["v_labelled"],
)
def precision_steps(spark: SparkSession, d: str) -> DataFrame:
    """K6: a table function over labelled scores"""
    plugins.register_functions(spark)
    read(spark, d, "v_labelled").select(F.col("s").alias("score"), F.col("y").cast("int").alias("good")).createOrReplaceTempView("labelled_scores")
    return plugins.precision_steps(spark.table("labelled_scores"))


# --- digests and applications -------------------------------------------------------------------------------------------

_DETAILS = "SELECT id, title, job_id, url, CASE WHEN id % 3 = 0 THEN 'Ann Lee' ELSE '' END AS people, CASE WHEN id % 4 = 0 THEN concat('call', chr(10), 'again') ELSE '' END AS notes, CASE WHEN id % 5 = 0 THEN '' ELSE concat(id % 9, '/10') END AS fit FROM v_applications"


@register(
    f"""WITH {_STATE}, {_ITEMS}, n AS (SELECT *, bucket <> 'this_week' AND sort_day > {TODAY - 3} AS new FROM i), d AS ({_DETAILS}),
    t AS (SELECT n.*, '- ' || n.company || ': ' || d.title || ' (' || s.stage || '), ' || reason || ' ' || CASE bucket WHEN 'today' THEN 'today' WHEN 'overdue' THEN concat({TODAY} - sort_day, CASE WHEN {TODAY} - sort_day = 1 THEN ' day late' ELSE ' days late' END)
        ELSE CASE WHEN sort_day = {TODAY + 1} THEN 'tomorrow' ELSE strftime(DATE '1970-01-01' + CAST(sort_day AS INTEGER), '%a %b %-d') END END
      || CASE d.fit WHEN '' THEN '' ELSE ', fit ' || d.fit END || CASE d.url WHEN '' THEN '' ELSE chr(10) || '  ' || d.url END || CASE d.people WHEN '' THEN '' ELSE chr(10) || '  People: ' || d.people END
      || CASE d.notes WHEN '' THEN '' ELSE chr(10) || '  Notes: ' || replace(d.notes, chr(10), chr(10) || '         ') END AS e FROM n JOIN d ON d.id = n.id JOIN s ON s.id = n.id),
    q AS (SELECT count(*) FILTER (stage = 'applied' AND NOT coalesce(due_day <= {TODAY}, false) AND {TODAY} - last_day >= 21) AS quiet FROM s),
    p AS (SELECT [(SELECT 'Due today' || chr(10) || string_agg(e, chr(10) ORDER BY sort_day, lower(company), id, e) FROM t WHERE bucket = 'today'),
      (SELECT 'Overdue' || chr(10) || string_agg(e, chr(10) ORDER BY sort_day, lower(company), id, e) FROM t WHERE bucket = 'overdue'),
      (SELECT 'Calls this week' || chr(10) || string_agg(e, chr(10) ORDER BY sort_day, lower(company), id, e) FROM t WHERE bucket = 'this_week'),
      (SELECT CASE WHEN quiet > 0 THEN concat('Also ', quiet, CASE WHEN quiet = 1 THEN ' application' ELSE ' applications' END, ' quiet for 21+ days.') END FROM q)] AS x)
    SELECT array_to_string(list_filter(x, lambda y: y IS NOT NULL), chr(10) || chr(10)) AS text FROM p WHERE (SELECT count(*) FROM t WHERE new) > 0""",
    _VIEWS,
)
def digest_texts(spark: SparkSession, d: str) -> DataFrame:
    """W10"""
    state = _state(spark, d)
    details = rows(spark, d, "v_applications", _DETAILS).drop("job_id").join(state.select("id", "stage"), "id")
    return tracker.digest_text(due_items(spark, d), details, tracker.due_counts(state, TODAY), TODAY)


_FULL = "SELECT *, CASE WHEN ord % 3 = 0 THEN ' ' ELSE title END AS description FROM v_outcomes"
_WRITTEN = "SELECT concat('src', user_id % 20, '_', user_id) AS job_id, max(concat('Dear ', event_type)) AS text, max(event_id) AS written_at FROM events GROUP BY user_id"


@register(
    rf"""WITH o AS ({_FULL}), l AS ({_WRITTEN}), b AS (SELECT source_model, min(match_score) AS low, max(match_score) AS high FROM v_outcomes WHERE source_model <> 'local-2' GROUP BY source_model),
    e AS (SELECT application_id AS id, count(*) AS n, string_agg(concat(at_day, ':', id, ':', kind, ':', value), ';' ORDER BY at_day, id) AS events FROM v_app_events GROUP BY application_id),
    j AS (SELECT a.id, a.fit_score, o.id IS NOT NULL AS known, o.score_label AS label, low, high, trim(coalesce(o.description, '')) <> '' AS has_description, l.text AS cover_letter, l.written_at AS cover_letter_at, coalesce(e.n, 0) AS n_events, coalesce(e.events, '') AS events,
      CASE WHEN starts_with(o.source_model, 'local') AND o.score_label = '' AND a.fit_score = floor(a.fit_score) THEN NULL ELSE a.fit_score END AS fit
      FROM v_applications a LEFT JOIN o ON o.id = a.job_id LEFT JOIN b ON b.source_model = o.source_model LEFT JOIN l ON l.job_id = a.job_id LEFT JOIN e ON e.id = a.id)
    SELECT id, n_events, events, cover_letter, cover_letter_at, has_description, CASE WHEN known AND label <> '' THEN label ELSE concat(fit_score, '/10') END AS fit,
      CASE WHEN known THEN floor(fit * 100 + 1e-9) / 100 ELSE fit_score END AS fit_raw,
      round(CASE WHEN known AND low IS NOT NULL THEN least(10.0, greatest(0.0, (fit - low) / (high - low) * 10)) END, 6) AS fit_scaled FROM j""",
    ["v_applications", "v_app_events", "v_outcomes"],
)
def application_rows(spark: SparkSession, d: str) -> DataFrame:
    """J10, F18"""
    known = read(spark, d, "v_outcomes").where("source_model <> 'local-2'")
    bounds = known.groupBy("source_model").agg(F.min("match_score").alias("low"), F.max("match_score").alias("high"))
    letters = rows(spark, d, "events", _WRITTEN)
    full = tracker.applications_full(read(spark, d, "v_applications"), rows(spark, d, "v_outcomes", _FULL), read(spark, d, "v_app_events"), letters, bounds)
    shown = F.transform("events", lambda x: F.concat_ws(":", x["at_day"].cast("string"), x["event_id"].cast("string"), x["kind"], x["value"]))
    return full.select(
        "id", F.size("events").cast("long").alias("n_events"), F.array_join(shown, ";").alias("events"), "cover_letter", "cover_letter_at", "has_description", "fit", "fit_raw", F.round("fit_scaled", 6).alias("fit_scaled")
    )


# --- posts and names ------------------------------------------------------------------------------------------------------

_POSTS = f"""SELECT id, ord, concat(CASE ord % 5 WHEN 0 THEN '[Hiring] Backend ' WHEN 1 THEN 'How to ' WHEN 2 THEN 'Software engineer ' WHEN 3 THEN 'Cron jobs: ' ELSE '' END, title) AS title,
  concat('https://dev.to/', source, '/', CASE WHEN ord % 29 = 0 THEN '' ELSE concat('post-', ord) END) AS link,
  concat('<p>', CASE ord % 7 WHEN 0 THEN 'We are hiring.' WHEN 1 THEN 'Apply now, developers!' WHEN 2 THEN 'Apply for the position.' WHEN 3 THEN 'A tutorial for an engineer.' ELSE 'Nothing.' END, '</p><p>', source, ' &amp; <b>co</b></p>') AS body,
  CASE ord % 3 WHEN 0 THEN 'Career' WHEN 1 THEN ' jobs ' ELSE 'webdev' END AS category,
  CASE ord % 11 WHEN 0 THEN 'soon' ELSE concat('Thu, ', 1 + ord % 28, ' Dec 2025 10:00:00 +0200') END AS posted FROM v_postings"""
_TEXT = "regexp_extract(body, '^<p>([^<]*)', 1) || chr(10) || regexp_extract(body, '</p><p>([^ ]*) ', 1) || ' & co'"


def _any_of(words: str, terms: list[str]) -> str:
    return "(" + " OR ".join(has(words, t) for t in terms) + ")"


_OPENING = f"""+ t AS (SELECT *, {_TEXT} AS text FROM i), k AS (SELECT *, {w("title")} AS head, {w("title || ' ' || text")} AS words FROM t),
  o AS (SELECT *, NOT {_any_of("head", pages.ARTICLE_WORDS)} AND {_any_of("words", pages.ROLE_WORDS)} AND (starts_with(lower(title), '[hiring]') OR {_any_of("words", pages.OPENING_SIGNALS)}
    OR lower(trim(category)) IN ('jobs', 'job', 'hiring', 'career') AND {_any_of("words", ["apply", "position"])}) AS opening FROM k)"""


def _posts(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d, "v_postings", _POSTS)


@register(twin(_POSTS, _OPENING + " SELECT id, opening FROM o"), ["v_postings"])
def likely_openings(spark: SparkSession, d: str) -> DataFrame:
    """F12"""
    c = F.col
    return _posts(spark, d).select("id", pages.is_likely_opening(c("title"), text.html_to_text(c("body")), F.array("category")).alias("opening"))


@register(
    twin(
        _POSTS,
        _OPENING
        + f""", p AS (SELECT *, CASE WHEN posted <> 'soon' THEN strptime(substr(posted, 6, length(posted) - 11), '%d %b %Y %H:%M:%S') - INTERVAL 2 HOUR END AS day FROM o WHERE opening)
        SELECT concat('devto_', CASE WHEN ord % 29 = 0 THEN '' ELSE concat('post-', ord) END) AS id, title, link AS url, text AS description, coalesce(strftime(day, '%Y-%m-%dT%H:%M:%S+00:00'), '') AS posted_at
        FROM p WHERE ord % 29 > 0 AND (day IS NULL OR epoch(day) >= {NOW - 14 * 86400})""",
    ),
    ["v_postings"],
)
def feed_postings(spark: SparkSession, d: str) -> DataFrame:
    """S11"""
    items = _posts(spark, d).where("ord % 29 > 0").select("title", "link", F.col("body").alias("description"), F.col("posted").alias("pubDate"), F.array("category").alias("category"))
    return pages.from_devto(items, F.timestamp_seconds(F.lit(NOW - 14 * 86400))).select("id", "title", "url", "description", "posted_at")


_NAMED = """SELECT id, concat(CASE ord % 6 WHEN 0 THEN concat('Ann Lee', chr(10)) WHEN 1 THEN concat('  Mary-Jane O', chr(39), 'Neil Li', chr(10)) WHEN 2 THEN concat('Ann lee', chr(10)) ELSE '' END, title,
  CASE ord % 5 WHEN 0 THEN ' by Ann Lee, ' WHEN 1 THEN ' ann_lee@x.example ' WHEN 2 THEN ' Joann Lee ' WHEN 3 THEN ' Ann Leeds ' ELSE ' ANN . LEE' END, source) AS text FROM v_postings"""


@register(
    twin(
        _NAMED,
        r"""SELECT id, regexp_replace(text, '(^|[^a-zA-Z])[aA][nN][nN][ ._-]+[lL][eE][eE]($|[^a-zA-Z])', '\1the candidate\2', 'g') AS hidden,
          nullif(regexp_extract(trim(regexp_extract(text, '^\s*([^\n]+)', 1)), '^((?:\p{Lu}[\p{L}.''-]*)(?: \p{Lu}[\p{L}.''-]*){1,3})$', 1), '') AS name FROM i""",
    ),
    ["v_postings"],
)
def hidden_names(spark: SparkSession, d: str) -> DataFrame:
    """C18"""
    t = F.col("text")
    return rows(spark, d, "v_postings", _NAMED).select("id", text.anonymize(t, ["Ann Lee"]).alias("hidden"), text.header_name(t).alias("name"))
