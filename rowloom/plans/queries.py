"""Registered queries: each operator over the views, with its twin in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import scores, text, urls
from rowloom.operators import evaluate, filters, listings, outcomes, similar, tracker, years
from rowloom.operators.filters import LEVELS, apply_filters, keyword_reason, seniority_reason, title_levels

from .views import NOW, TERMINAL, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY_NOW = NOW // 86400
#: Days of events end before this one, which queries take as today.
TODAY = 19_740


def register(sql: str | None = None, views: list[str] | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            # count_if gives a wider type than count there
            SQL[f.__name__] = (with_views(views, sql) if views else sql).replace("count_if(", "count(*) FILTER (WHERE ")
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return view(spark, d, name) if name.startswith("v_") else spark.read.parquet(f"{d}/{name}.parquet")


# --- texts of SQL twins ---------------------------------------------------------------------------------------------


def w(c: str) -> str:
    """word_text() in DuckDB."""
    return f"(' ' || array_to_string(list_filter(list_transform(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9+#.]+', ' ', 'g'), ' '), lambda x: trim(x, '.')), lambda x: x <> ''), ' ') || ' ')"


def has(words: str, term: str) -> str:
    return f"contains({words}, '{text.word_text_py(term)}')"


def ukey(c: str) -> str:
    return rf"(lower(regexp_extract({c}, '^([a-z]+)://', 1)) || '://' || lower(regexp_extract({c}, '^[a-z]+://([^/?#]*)', 1)) || rtrim(regexp_extract({c}, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'))"


def jkey(t: str, c: str) -> str:
    return f"(trim({w(t)}) || chr(10) || trim({w(c)}))"


TERMS = ", ".join(f"'{s}'" for s in TERMINAL)
LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY received_at DESC, id DESC) AS rn FROM v_verdicts) WHERE rn = 1)"

# --- cleaning and links ---------------------------------------------------------------------------------------------


@register(f"SELECT id, {w('title')} AS words, {jkey('title', 'company')} AS job_key FROM v_postings", ["v_postings"])
def word_keys(spark: SparkSession, d: str) -> DataFrame:
    """C1, C12"""
    return read(spark, d, "v_postings").select("id", text.word_text(F.col("title")).alias("words"), text.same_job_key(F.col("title"), F.col("company")).alias("job_key"))


@register("SELECT id, trim(regexp_replace(translate(lower(title), '-/', '  '), '\\s+', ' ', 'g')) || chr(10) || trim(regexp_replace(translate(lower(company), '-/', '  '), '\\s+', ' ', 'g')) AS group_key FROM v_postings", ["v_postings"])
def group_keys(spark: SparkSession, d: str) -> DataFrame:
    """C13"""
    return read(spark, d, "v_postings").select("id", text.group_key(F.col("title"), F.col("company")).alias("group_key"))


@register(f"SELECT id, strftime(make_timestamp(CAST(posted_at AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS posted, CAST(posted_at AS BIGINT) >= {NOW - 72 * 3600} AS fresh FROM v_postings", ["v_postings"])
def posted_and_fresh(spark: SparkSession, d: str) -> DataFrame:
    """C4, C5, F2"""
    cutoff = F.timestamp_seconds(F.lit(NOW - 72 * 3600))
    return read(spark, d, "v_postings").select("id", text.posted_iso(F.col("posted_at")).alias("posted"), text.is_fresh(F.col("posted_at"), cutoff).alias("fresh"))


@register(
    rf"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1)
      || CASE WHEN array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: NOT starts_with(lower(x), 'utm_')), '&') <> ''
         THEN '?' || array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: NOT starts_with(lower(x), 'utm_')), '&') ELSE '' END
      || regexp_extract(url, '(#.*)$', 1) AS clean, {ukey("url")} AS url_key,
      lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') || '?' || regexp_extract(url, '\?([^#]*)', 1) AS same,
      CASE WHEN regexp_matches(url, '^https?://') THEN url ELSE '' END AS safe FROM pages"""
)
def url_forms(spark: SparkSession, d: str) -> DataFrame:
    """C8 to C11"""
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", urls.without_tracking(u).alias("clean"), urls.url_key(u).alias("url_key"), urls.same_url(u).alias("same"), urls.safe_url(u).alias("safe"))


_LINKS = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('https://boards.greenhouse.io/Co', page_id % 11, '/jobs/', page_id % 97, '?gh_src=x') WHEN 1 THEN concat('https://jobs.lever.co/co', page_id % 11, '/', page_id % 89) WHEN 2 THEN concat('https://wd1.myworkdaysite.com/recruiting/ten', page_id % 7, '/site/job/', page_id % 83, '/apply') WHEN 3 THEN concat('https://myjobs.adp.com/x?cid=c', page_id % 5, '&jobId=', page_id) ELSE url END AS link FROM {pages}"


def _links(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_LINKS, pages=read(spark, d, "pages"))


_PARSED = rf"""l AS ({_LINKS.replace("{pages}", "pages")}),
g AS (SELECT page_id, link, regexp_extract(link, '^https?://(?:boards|job-boards)\.greenhouse\.io/([^/?]+)/jobs/(\d+)', ['s', 'j']) AS gh, regexp_extract(link, '^https?://jobs\.lever\.co/([^/?]+)/([^/?]+)', ['s', 'j']) AS lv,
  regexp_extract(link, '^https?://[a-z0-9]+\.myworkdaysite\.com/recruiting/([^/?]+)/[^/?]+/job/([^/?]+)', ['s', 'j']) AS wd, regexp_extract(link, '^https?://myjobs\.adp\.com/.*[?&]cid=([^&]+)&jobId=([^&]+)', ['s', 'j']) AS ad FROM l),
p AS (SELECT page_id, link, CASE WHEN gh.s <> '' THEN 'greenhouse' WHEN lv.s <> '' THEN 'lever' WHEN wd.s <> '' THEN 'workday' WHEN ad.s <> '' THEN 'adp' END AS ats,
  nullif(coalesce(nullif(gh.s, ''), nullif(lv.s, ''), nullif(wd.s, ''), ad.s), '') AS slug, nullif(coalesce(nullif(gh.j, ''), nullif(lv.j, ''), nullif(wd.j, ''), ad.j), '') AS job_id FROM g)"""


@register(f"WITH {_PARSED} SELECT page_id, coalesce(ats, '') AS ats, slug, job_id FROM p")
def parsed_links(spark: SparkSession, d: str) -> DataFrame:
    """C14, C15"""
    return _links(spark, d).select("page_id", urls.ats_of(F.col("link")).alias("ats"), urls.parse_link(F.col("link")).alias("p")).select("page_id", "ats", "p.slug", "p.job_id")


@register(f"WITH {_PARSED} SELECT ats, lower(slug) AS slug, job_id, min(link) AS url FROM p WHERE ats IS NOT NULL GROUP BY ALL")
def unique_links(spark: SparkSession, d: str) -> DataFrame:
    """J18, U1"""
    return listings.unique_links(_links(spark, d).select("link"))


@register(rf"""WITH l AS ({_LINKS.replace("{pages}", "pages")}), t AS (SELECT html || ' <a href="' || replace(link, '&', '&amp;') || '">job</a> or ' || link || '.' AS html FROM pages JOIN l USING (page_id)),
f AS (SELECT DISTINCT rtrim(replace(unnest(regexp_extract_all(html, '(https?://[^\s"''<>()\]]+)', 1)), '&amp;', '&'), '.,;:!') AS link FROM t)
SELECT link FROM f WHERE regexp_matches(lower(regexp_extract(link, '^https?://([^/?#]*)', 1)), '(^|\.)(greenhouse\.io|lever\.co|ashbyhq\.com|adp\.com|myworkdayjobs\.com|myworkdaysite\.com|dover\.io|dover\.com|gem\.com|teamtailor\.com|bamboohr\.com|workable\.com)$')""")
def extracted_links(spark: SparkSession, d: str) -> DataFrame:
    """Pages that also name a posting, once in markup and once in prose"""
    named = F.concat(F.col("html"), F.lit(' <a href="'), F.replace(F.col("link"), F.lit("&"), F.lit("&amp;")), F.lit('">job</a> or '), F.col("link"), F.lit("."))
    found = read(spark, d, "pages").join(_links(spark, d), "page_id").select(F.explode(urls.links_in(named)).alias("link"))
    return found.where(urls.ats_of(F.col("link")) != "").distinct()


# --- filters --------------------------------------------------------------------------------------------------------

EXCLUDED = {"companies": ["src3", "src11"], "title": ["the", "der"], "phrases": ["of the", "que de"], "roles": {"a": (["thing", "ertion", "and"], 2)}}


def _keyword_sql() -> str:
    x = w("title || ' ' || description")
    whens = [f"WHEN {has('c', k)} THEN 'excluded company: {k}'" for k in EXCLUDED["companies"]] + [f"WHEN {has('t', k)} THEN 'excluded title word: {k}'" for k in EXCLUDED["title"]] + [f"WHEN {has('x', k)} THEN 'excluded phrase: {k}'" for k in EXCLUDED["phrases"]]
    terms, least = EXCLUDED["roles"]["a"]
    hits = "list_filter([" + ", ".join(f"CASE WHEN {has('x', k)} THEN '{k}' END" for k in terms) + "], lambda y: y IS NOT NULL)"
    return f"k AS (SELECT id, source, ord, posted_at, CASE {' '.join(whens)} WHEN len({hits}) >= {least} THEN 'excluded role ''a'': ' || array_to_string({hits}, ', ') END AS reason FROM (SELECT *, {w('title')} AS t, {w('company')} AS c, {x} AS x FROM v_postings))"


@register(f"WITH {_keyword_sql()} SELECT id, reason FROM k", ["v_postings"])
def keyword_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """F1, F8"""
    return read(spark, d, "v_postings").select("id", keyword_reason(F.col("title"), F.col("company"), F.col("description"), EXCLUDED).alias("reason"))


_TITLES = "CASE ord % 6 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' WHEN 2 THEN 'Staff/Principal ' WHEN 3 THEN 'Summer Intern, ' WHEN 4 THEN 'Entry-Level ' ELSE '' END"


def _levels_sql() -> str:
    cases = ", ".join("CASE WHEN " + " OR ".join(has("words", t) for t in terms) + f" THEN '{level}' END" for level, terms in LEVELS.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@register(
    f"WITH t AS (SELECT id, {_TITLES} || title AS title, {w(f'{_TITLES} || title')} AS words FROM v_postings), f AS (SELECT id, title, {_levels_sql()} AS found FROM t) SELECT id, array_to_string(found, '/') AS levels, CASE WHEN len(found) > 0 AND NOT list_has_any(found, ['entry', 'mid']) THEN 'title level ' || array_to_string(found, '/') || ' not in entry, mid: ' || title END AS reason FROM f",
    ["v_postings"],
)
def seniority_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """F6"""
    title = F.concat(F.expr(_TITLES), F.col("title"))
    return read(spark, d, "v_postings").select("id", F.array_join(title_levels(title), "/").alias("levels"), seniority_reason(title, ["entry", "mid"]).alias("reason"))


@register(
    f"WITH {_keyword_sql()} SELECT id, CASE WHEN reason IS NOT NULL THEN 'keywords: ' || reason WHEN CAST(posted_at AS BIGINT) < {NOW - 72 * 3600} THEN 'age: old' END AS filter_reason FROM k",
    ["v_postings"],
)
def applied_filters(spark: SparkSession, d: str) -> DataFrame:
    """filters in order, the first reason wins."""
    p = read(spark, d, "v_postings")
    fresh = text.is_fresh(F.col("posted_at"), F.timestamp_seconds(F.lit(NOW - 72 * 3600)))
    return p.select("id", apply_filters({"keywords": keyword_reason(F.col("title"), F.col("company"), F.col("description"), EXCLUDED), "age": F.when(~fresh, "old")}).alias("filter_reason"))


@register(
    "WITH p AS (SELECT *, CASE WHEN length(title) % 5 = 0 THEN true WHEN length(title) % 5 = 1 THEN false END AS snippet, CASE WHEN source < 'src3' THEN concat('https://', source, '.indeed.com/x') ELSE url END AS link FROM v_postings)"
    " SELECT id, coalesce(snippet, false) OR length(trim(description)) < 200 AS needs, CASE WHEN regexp_matches(link, '^https?://([^/]+\\.)?indeed\\.com(/|$)') THEN 'indeed.com' END AS blocked FROM p",
    ["v_postings"],
)
def needs_description(spark: SparkSession, d: str) -> DataFrame:
    """F14"""
    n = F.length("title") % 5
    link = F.when(F.col("source") < "src3", F.concat(F.lit("https://"), "source", F.lit(".indeed.com/x"))).otherwise(F.col("url"))
    return read(spark, d, "v_postings").select("id", filters.needs_description(F.col("description"), F.when(n == 0, True).when(n == 1, False)).alias("needs"), filters.unreadable_host(link).alias("blocked"))


_YEARS = "SELECT id, title, company, concat(description, '\nRequires ', 1 + length(title) % 12, '+ years of software experience. At least ', 1 + ord % 9, ' years of work with it, or ', 1 + ord % 4, ' years of work with a degree.') AS text FROM {v}"


@register(
    f"WITH t AS ({_YEARS.replace('{v}', 'v_postings')}), n AS (SELECT id, list_transform(regexp_extract_all(text, '([0-9]+)[+]? years of', 1), lambda x: CAST(x AS INT)) AS n FROM t), y AS (SELECT id, greatest(n[1], least(n[2], n[3])) AS years FROM n)"
    " SELECT id, years, CASE WHEN years > 6 THEN 'requires ' || years || '+ years (max 6)' END AS reason FROM y",
    ["v_postings"],
)
def required_years(spark: SparkSession, d: str) -> DataFrame:
    """a requirement and two alternatives after every text; the highest counts, of alternatives the lowest."""
    p = spark.sql(_YEARS, v=read(spark, d, "v_postings"))
    return p.select("id", years.required_years(F.col("text"), F.col("company")).alias("years"), years.years_reason(F.col("title"), F.col("text"), F.col("company"), 6).alias("reason"))


_ASKED = "SELECT concat('src', user_id % 20, '_', user_id) AS id, CASE event_type WHEN 'view' THEN 'software_role' WHEN 'click' THEN 'students_only' WHEN 'purchase' THEN 'requires_clearance' WHEN 'error' THEN 'requires_citizenship' ELSE 'other' END AS question, CASE WHEN value < 400 THEN round(value - floor(value), 2) END AS p FROM {e}"


@register(
    f"WITH a AS ({_ASKED.replace('{e}', 'events')}), m AS (SELECT id, max(p) FILTER (question = 'software_role') AS r, max(p) FILTER (question = 'students_only') AS s, max(p) FILTER (question = 'requires_citizenship') AS c, max(p) FILTER (question = 'requires_clearance') AS k FROM a GROUP BY id)"
    " SELECT v.id, CASE WHEN r < 0.5 THEN printf('not a software engineering role (model: %.2f)', r) WHEN s >= 0.5 THEN printf('only for current students (model: %.2f)', s) WHEN k >= 0.5 THEN printf('requires a security clearance (model: %.2f)', k) WHEN c >= 0.5 THEN printf('requires citizenship (model: %.2f)', c) END AS reason FROM v_postings v LEFT JOIN m ON m.id = v.id",
    ["v_postings"],
)
def model_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """F11"""
    answers = spark.sql(_ASKED, e=read(spark, d, "events"))
    return filters.model_check_verdict(read(spark, d, "v_postings").select("id"), answers, True, ["clearance", "citizenship"])


@register(
    "SELECT id, title, company, strftime(make_timestamp(CAST(posted_at AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS posted_at, md5(description) AS description FROM (SELECT id, coalesce(title, '') AS title, CASE WHEN company = 'src1' THEN '' ELSE company END AS company, posted_at, coalesce(description, '') AS description FROM v_postings)",
    ["v_postings"],
)
def cleaned_postings(spark: SparkSession, d: str) -> DataFrame:
    """With the company of one source missing"""
    p = read(spark, d, "v_postings").withColumn("company", F.when(F.col("company") != "src1", F.col("company")))
    return text.clean_posting(p).select("id", "title", "company", "posted_at", F.md5("description").alias("description"))


@register("SELECT id, md5('Candidate profile:\nknows ' || source || '\n\nJob title: ' || title || '\nCompany: ' || company || '\n\nJob description:\n' || left(description, 8000)) AS state FROM v_postings".replace("\n", "' || chr(10) || '"), ["v_postings"])
def model_states(spark: SparkSession, d: str) -> DataFrame:
    """C21"""
    return read(spark, d, "v_postings").select("id", F.md5(text.model_state(F.concat(F.lit("knows "), "source"), F.col("title"), F.col("company"), F.col("description"))).alias("state"))


# --- outcomes -------------------------------------------------------------------------------------------------------


@register(f"SELECT id, title FROM v_postings WHERE id NOT IN (SELECT id FROM v_outcomes WHERE status IN ({TERMS}))", ["v_postings", "v_outcomes"])
def unseen_postings(spark: SparkSession, d: str) -> DataFrame:
    """J1"""
    return outcomes.filter_unseen(read(spark, d, "v_postings"), read(spark, d, "v_outcomes")).select("id", "title")


@register(
    f"WITH {_keyword_sql()}, u AS (SELECT k.*, CAST(posted_at AS BIGINT) >= {NOW - 72 * 3600} AS fresh FROM k WHERE id NOT IN (SELECT id FROM v_outcomes WHERE status IN ({TERMS}))) SELECT source, count(*) AS found, count_if(fresh) AS fresh, count_if(reason IS NOT NULL) AS filtered, count_if(fresh AND reason IS NULL) AS kept FROM u GROUP BY source",
    ["v_postings", "v_outcomes"],
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: new postings of a run, judged by age and words, counted by source."""
    new = outcomes.filter_unseen(read(spark, d, "v_postings"), read(spark, d, "v_outcomes"))
    fresh = text.is_fresh(F.col("posted_at"), F.timestamp_seconds(F.lit(NOW - 72 * 3600)))
    judged = new.select("source", fresh.alias("_f"), keyword_reason(F.col("title"), F.col("company"), F.col("description"), EXCLUDED).alias("_r"))
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("found"), F.count_if("_f").alias("fresh"), F.count_if(F.col("_r").isNotNull()).alias("filtered"), F.count_if(F.col("_f") & F.col("_r").isNull()).alias("kept"))


@register(
    "SELECT source, count(*) AS found, count_if(status = 'notified') AS notified, count_if(status = 'logged') AS logged, count_if(status = 'skipped') AS skipped, count_if(status = 'duplicate') AS duplicates, count_if(status IN ('error_429_retry', 'error_unavailable', 'error_notify')) AS retry, count_if(status IN ('error', 'error_scorer', 'error_terminal')) AS errors, coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT regexp_extract(filter_reason, '^([^:]*):', 1) || '=' || count(*) AS f FROM v_outcomes i WHERE i.source = o.source AND status = 'filtered' GROUP BY regexp_extract(filter_reason, '^([^:]*):', 1))), '') AS filtered FROM v_outcomes o GROUP BY source",
    ["v_outcomes"],
)
def outcome_summary(spark: SparkSession, d: str) -> DataFrame:
    """A1"""
    return outcomes.run_summary(read(spark, d, "v_outcomes"))


@register("SELECT status, count(*) AS n FROM v_outcomes GROUP BY status", ["v_outcomes"])
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """A7"""
    return outcomes.status_counts(read(spark, d, "v_outcomes"))


@register(f"SELECT id, status, first_run_at FROM v_outcomes WHERE status IN ('error_429_retry', 'error_unavailable', 'error_scorer') AND first_run_at >= {NOW - 86400 * 20} AND id NOT IN (SELECT id FROM v_postings WHERE source < 'src2')", ["v_postings", "v_outcomes"])
def retries(spark: SparkSession, d: str) -> DataFrame:
    """J2, with a window of twenty days"""
    return outcomes.retry_candidates(read(spark, d, "v_postings").where("source < 'src2'"), read(spark, d, "v_outcomes"), NOW, 480).select("id", "status", "first_run_at")


_SCORED = "SELECT id, regexp_extract(description, '^([^ ]+( [^ ]+)?)', 1) AS title, company, CASE ord % 4 WHEN 0 THEN 'log' WHEN 1 THEN 'skip' ELSE 'notify' END AS decision, ord % 7 <> 0 AS delivered, ord AS slot FROM {v}"


@register(
    f"""WITH s AS (SELECT *, {jkey("title", "company")} AS k FROM ({_SCORED.replace("{v}", "v_postings")})),
t AS (SELECT DISTINCT {jkey("title", "company")} AS k FROM v_outcomes WHERE status = 'notified' AND run_at >= {NOW - 30 * 86400}),
b AS (SELECT s.*, t.k IS NOT NULL AS told, max(CASE WHEN decision = 'notify' AND t.k IS NULL AND delivered THEN 1 END) OVER (PARTITION BY s.k ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s LEFT JOIN t ON s.k = t.k)
SELECT id, CASE WHEN decision = 'log' THEN 'logged' WHEN decision = 'skip' THEN 'skipped' WHEN told OR before = 1 THEN 'duplicate' WHEN delivered THEN 'notified' ELSE 'error_notify' END AS status FROM b""",
    ["v_postings", "v_outcomes"],
)
def repeats(spark: SparkSession, d: str) -> DataFrame:
    """J3"""
    scored = spark.sql(_SCORED, v=read(spark, d, "v_postings"))
    return outcomes.suppress_repeats(scored, read(spark, d, "v_outcomes"), NOW).select("id", "status")


@register(f"WITH {LATEST} SELECT l.job_id, l.id, l.verdict, l.received_at, coalesce(o.title, '') AS title, coalesce(o.company, '') AS company FROM latest l LEFT JOIN v_outcomes o ON o.id = l.job_id", ["v_verdicts", "v_outcomes"])
def latest_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """W1, J4"""
    return outcomes.latest_verdicts(read(spark, d, "v_verdicts"), read(spark, d, "v_outcomes")).select("job_id", "id", "verdict", "received_at", "title", "company")


_HIDDEN = "SELECT id AS job_id, run_at + 50 AS hidden_at FROM {o} WHERE source = 'src7'"


@register(
    f"WITH {LATEST}, h AS ({_HIDDEN.replace('{o}', 'v_outcomes')}) SELECT id, title, run_at FROM v_outcomes o WHERE status = 'notified' AND run_at >= {NOW - 40 * 86400} AND NOT EXISTS (SELECT 1 FROM v_applications a WHERE a.job_id = o.id AND a.board = 'board1') AND NOT EXISTS (SELECT 1 FROM h WHERE h.job_id = o.id) AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.job_id = o.id AND verdict IN ('bad', 'applied')) ORDER BY run_at DESC, id DESC LIMIT 200",
    ["v_verdicts", "v_outcomes", "v_applications"],
)
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """J5"""
    o = read(spark, d, "v_outcomes")
    return outcomes.review_queue(o, read(spark, d, "v_applications").where("board = 'board1'"), spark.sql(_HIDDEN, o=o), read(spark, d, "v_verdicts"), NOW, 40).select("id", "title", "run_at")


@register(
    f"""WITH {LATEST}, h AS (SELECT job_id, max(hidden_at) AS hid FROM ({_HIDDEN.replace("{o}", "v_outcomes")}) GROUP BY job_id)
SELECT o.id, greatest(coalesce(l.received_at, 0), coalesce(h.hid, 0)) AS at, CASE WHEN h.hid IS NULL OR l.received_at >= h.hid THEN 'bad' ELSE 'hidden' END AS kind
FROM v_outcomes o LEFT JOIN latest l ON l.job_id = o.id AND l.verdict = 'bad' LEFT JOIN h ON h.job_id = o.id
WHERE (l.job_id IS NOT NULL OR h.job_id IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM v_applications a WHERE a.job_id = o.id AND a.board = 'board1') ORDER BY 2 DESC, o.id DESC LIMIT 500""",
    ["v_verdicts", "v_outcomes", "v_applications"],
)
def dismissed_jobs(spark: SparkSession, d: str) -> DataFrame:
    """J6"""
    o = read(spark, d, "v_outcomes")
    return outcomes.dismissed(o, read(spark, d, "v_applications").where("board = 'board1'"), spark.sql(_HIDDEN, o=o), read(spark, d, "v_verdicts")).select("id", "at", "kind")


@register(
    f"WITH {LATEST} SELECT l.job_id, o.title, o.company, o.url, l.received_at // 86400 AS applied_day FROM latest l JOIN v_outcomes o ON o.id = l.job_id WHERE verdict = 'applied' AND received_at // 86400 BETWEEN 10957 AND {DAY_NOW + 1} AND NOT EXISTS (SELECT 1 FROM v_applications a WHERE a.job_id = l.job_id AND a.board < 'board2')",
    ["v_verdicts", "v_outcomes", "v_applications"],
)
def applications_from_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """J7"""
    return outcomes.verdicts_to_applications(read(spark, d, "v_verdicts"), read(spark, d, "v_outcomes"), read(spark, d, "v_applications").where("board < 'board2'"), DAY_NOW)


@register("SELECT a.id, a.job_id, o.first_saved_at FROM v_applications a LEFT JOIN (SELECT id, min(first_run_at) AS first_saved_at FROM v_outcomes GROUP BY id) o ON o.id = a.job_id", ["v_applications", "v_outcomes"])
def first_saved(spark: SparkSession, d: str) -> DataFrame:
    """Q4"""
    ids = read(spark, d, "v_applications").select(F.col("id").alias("application"), F.col("job_id").alias("id"))
    return outcomes.first_saved(ids, read(spark, d, "v_outcomes")).select(F.col("application").alias("id"), F.col("id").alias("job_id"), "first_saved_at")


@register("SELECT 'saved' AS kind, verdict AS value, count(*) AS n FROM v_verdicts GROUP BY ALL UNION ALL SELECT 'ignored', event_type, count(*) FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL", ["v_verdicts"])
def feedback_counts(spark: SparkSession, d: str) -> DataFrame:
    """A12"""
    ignored = read(spark, d, "events").where("event_type IN ('signup', 'error')").select(F.col("event_type").alias("reason"))
    return outcomes.feedback_counts(read(spark, d, "v_verdicts"), ignored)


_ALERTS = "SELECT id, title, company, source AS location, url, score_label, concat('resume', ord % 3) AS resume_id, filter_reason AS reasoning, source, CASE WHEN ord % 5 = 0 THEN '' ELSE concat('', run_at) END AS posted_at, ord FROM {o} WHERE status = 'notified'"


@register(
    f"WITH a AS ({_ALERTS.replace('{o}', 'v_outcomes')}) SELECT id, concat_ws(chr(10), title || ' at ' || company, 'Location: ' || location, 'Link: ' || url, '', 'Score: ' || score_label, 'Resume: ' || resume_id, 'Why: ' || reasoning, 'Matched skills: ' || CASE WHEN source < 'src2' THEN 'sql, ' || source ELSE 'none' END, 'Gaps: go', 'Source: ' || source || ' | Posted: ' || CASE WHEN posted_at = '' THEN 'unknown' ELSE posted_at END) AS body FROM a",
    ["v_outcomes"],
)
def alerts_outbox(spark: SparkSession, d: str) -> DataFrame:
    """Q5"""
    a = spark.sql(_ALERTS, o=read(spark, d, "v_outcomes"))
    own = F.when(F.col("source") < "src2", F.array(F.lit("sql"), F.col("source"))).otherwise(F.array().cast("array<string>"))
    return outcomes.alerts_outbox(a.withColumn("matched", own).withColumn("gaps", F.array(F.lit("go"))))


_CANDIDATES = "SELECT CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN concat(url, '?utm_source=x') ELSE url END AS url, title, company, id AS n FROM {v}"


@register(
    f"""WITH c AS ({_CANDIDATES.replace("{v}", "v_applications")}), e AS (SELECT url, min(id) AS i FROM v_outcomes GROUP BY url), k AS (SELECT {ukey("url")} AS u, min(id) AS i FROM v_outcomes GROUP BY ALL)
SELECT c.n, coalesce(e.i, k.i) AS job_id FROM c LEFT JOIN e ON e.url = c.url LEFT JOIN k ON c.url <> '' AND k.u = {ukey("c.url")}""",
    ["v_applications", "v_outcomes"],
)
def matched_links(spark: SparkSession, d: str) -> DataFrame:
    """J8"""
    return outcomes.match_links(spark.sql(_CANDIDATES, v=read(spark, d, "v_applications")), read(spark, d, "v_outcomes")).select("n", "job_id")


_STATE = f"""e AS (SELECT *, row_number() OVER (PARTITION BY application_id, kind = 'stage' ORDER BY id DESC) AS rn FROM v_app_events),
f AS (SELECT application_id AS id, max(CASE WHEN kind = 'stage' AND rn = 1 THEN value END) AS stage, max(CASE WHEN kind = 'stage' AND rn = 1 THEN at_day END) AS stage_day,
  max(CASE WHEN kind = 'follow_up_set' AND rn = 1 THEN CAST(value AS BIGINT) END) AS follow_up_day, count_if(kind <> 'stage') AS n_follow,
  min(CASE WHEN kind = 'stage' AND value IN ('screen', 'interview', 'offer', 'accepted') THEN at_day END) AS reply_day, max(at_day) AS last_day,
  min(CASE WHEN kind = 'stage' AND value IN ('screen', 'interview') AND at_day > made_day AND at_day BETWEEN {TODAY} AND {TODAY + 3} THEN at_day * 10 + CASE value WHEN 'interview' THEN 0 ELSE 1 END END) AS call
  FROM e GROUP BY application_id),
s AS (SELECT a.id, a.company, a.board, a.resume_id, a.fit_score, a.applied_day, coalesce(f.stage, 'applied') AS stage, coalesce(f.stage_day, a.applied_day) AS stage_day, f.follow_up_day, coalesce(f.n_follow, 0) AS n_follow, f.reply_day, coalesce(f.last_day, a.applied_day) AS last_day, f.call,
  coalesce(f.follow_up_day, CASE WHEN coalesce(f.stage, 'applied') = 'applied' AND coalesce(f.n_follow, 0) = 0 AND {TODAY} - a.applied_day - 7 <= 21 THEN a.applied_day + 7 END) AS due_day
  FROM v_applications a LEFT JOIN f ON f.id = a.id)"""
_VIEWS = ["v_applications", "v_app_events"]


def _state(spark: SparkSession, d: str) -> DataFrame:
    return tracker.current_state(read(spark, d, "v_applications"), read(spark, d, "v_app_events"), TODAY)


@register(f"WITH {_STATE} SELECT id, stage, stage_day, follow_up_day, reply_day, last_day FROM s", _VIEWS)
def current_stages(spark: SparkSession, d: str) -> DataFrame:
    """W2, W7, A4"""
    return _state(spark, d).select("id", "stage", "stage_day", "follow_up_day", "reply_day", "last_day")


_OPEN = "(SELECT a.*, s.stage FROM v_applications a JOIN s ON s.id = a.id WHERE s.stage IN ('applied', 'screen', 'interview', 'offer'))"


@register(
    f"""WITH {_STATE}, c AS ({_CANDIDATES.replace("{v}", "v_applications")}), o AS {_OPEN}, u AS (SELECT {ukey("url")} AS u, max(id) AS i FROM o WHERE url <> '' GROUP BY ALL), j AS (SELECT {jkey("title", "company")} AS j, max(id) AS i FROM o GROUP BY ALL)
SELECT c.n, CASE WHEN c.url <> '' THEN u.i ELSE j.i END AS open_id FROM c LEFT JOIN u ON u.u = {ukey("c.url")} LEFT JOIN j ON j.j = {jkey("c.title", "c.company")}""",
    _VIEWS,
)
def open_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """J9"""
    return outcomes.open_duplicates(spark.sql(_CANDIDATES, v=read(spark, d, "v_applications")), _state(spark, d)).select("n", "open_id")


_ATT = f"""t AS (SELECT *, CASE WHEN stage IN ('accepted', 'rejected', 'withdrawn', 'ghosted') THEN NULL WHEN stage = 'offer' THEN 0 WHEN call IS NOT NULL THEN 1 WHEN due_day <= {TODAY} THEN 2 WHEN stage = 'applied' AND {TODAY} - last_day >= 21 THEN 3 END AS priority,
  greatest(0, {TODAY} - last_day) AS age_days FROM s),
q AS (SELECT *, CASE priority WHEN 0 THEN 'offer' WHEN 1 THEN CASE call % 10 WHEN 0 THEN 'interview' ELSE 'screen' END WHEN 2 THEN 'follow up' WHEN 3 THEN 'ghost?' END AS reason, CASE priority WHEN 1 THEN call // 10 WHEN 2 THEN due_day END AS due FROM t)"""


@register(f"WITH {_STATE}, {_ATT} SELECT id, priority, reason, due FROM q WHERE priority IS NOT NULL", _VIEWS)
def attention(spark: SparkSession, d: str) -> DataFrame:
    """W8"""
    return tracker.attention(_state(spark, d), TODAY).where("priority IS NOT NULL").select("id", "priority", "reason", "due")


@register(
    f"""WITH {_STATE}, {_ATT}, g AS (SELECT *, CASE WHEN stage IN ('accepted', 'rejected', 'withdrawn', 'ghosted') THEN 'closed' WHEN priority IS NOT NULL THEN 'needs' ELSE 'waiting' END AS grp FROM q)
SELECT id, grp AS "group", age_days, CASE grp WHEN 'needs' THEN priority WHEN 'waiting' THEN -age_days ELSE -stage_day END AS k1, CASE grp WHEN 'needs' THEN coalesce(due, 0) WHEN 'waiting' THEN id ELSE -id END AS k2, CASE grp WHEN 'needs' THEN -age_days ELSE 0 END AS k3 FROM g""",
    _VIEWS,
)
def grouped_state(spark: SparkSession, d: str) -> DataFrame:
    """W6"""
    return tracker.needs_sort(_state(spark, d), TODAY).select("id", "group", "age_days", "k1", "k2", "k3")


_ITEMS = f"""o AS (SELECT * FROM s WHERE stage NOT IN ('accepted', 'rejected', 'withdrawn', 'ghosted', 'offer')),
i AS (SELECT id, company, CASE WHEN due_day = {TODAY} THEN 'today' ELSE 'overdue' END AS bucket, 'follow up' AS reason, due_day AS sort_day FROM o WHERE due_day <= {TODAY}
UNION ALL SELECT o.id, company, CASE WHEN at_day = {TODAY} THEN 'today' ELSE 'this_week' END, value, at_day FROM v_app_events e JOIN o ON o.id = e.application_id WHERE kind = 'stage' AND value IN ('screen', 'interview') AND at_day > made_day AND at_day BETWEEN {TODAY} AND {TODAY + 7})"""


@register(f"""WITH {_STATE}, {_ITEMS} SELECT *, bucket <> 'this_week' AND sort_day > {TODAY - 3} AS "new" FROM i""", _VIEWS)
def due_items(spark: SparkSession, d: str) -> DataFrame:
    """W9"""
    return tracker.due_items(_state(spark, d), read(spark, d, "v_app_events"), TODAY, TODAY - 3)


@register(
    f"""WITH {_STATE}, {_ITEMS}, n AS (SELECT *, bucket <> 'this_week' AND sort_day > {TODAY - 3} AS new FROM i), c AS (SELECT company, min(sort_day) FILTER (bucket = 'today') AS t, min(sort_day) FILTER (new) AS w FROM n GROUP BY company),
p AS (SELECT count_if(new) AS n_new, count_if(bucket = 'today') AS n_today, count_if(bucket = 'overdue') AS n_overdue, count_if(bucket = 'this_week') AS n_calls, min(sort_day) FILTER (new) AS since FROM n)
SELECT CASE WHEN n_today > 0 THEN 'Due today: ' || (SELECT string_agg(company, ', ' ORDER BY t, lower(company)) FROM c WHERE t IS NOT NULL)
  ELSE 'Due since ' || strftime(DATE '1970-01-01' + CAST(since AS INTEGER), '%a %b %-d') || ': ' || (SELECT string_agg(company, ', ' ORDER BY w, lower(company)) FROM c WHERE w IS NOT NULL) END
  || CASE WHEN n_overdue > 0 THEN ' · ' || n_overdue || ' overdue' ELSE '' END || CASE WHEN n_calls > 0 THEN ' · ' || n_calls || CASE WHEN n_calls = 1 THEN ' call' ELSE ' calls' END || ' this week' ELSE '' END AS subject,
  n_new, n_today, n_overdue, n_calls FROM p WHERE n_new > 0""",
    _VIEWS,
)
def digest(spark: SparkSession, d: str) -> DataFrame:
    """W10"""
    return tracker.digest_row(due_items(spark, d))


@register(f"WITH {_STATE} SELECT count_if(stage = 'applied' AND NOT coalesce(due_day <= {TODAY}, false) AND {TODAY} - last_day >= 21) AS quiet FROM s", _VIEWS)
def quiet_count(spark: SparkSession, d: str) -> DataFrame:
    """A20"""
    return tracker.due_counts(_state(spark, d), TODAY)


@register(
    f"""WITH {_STATE}, r AS (SELECT coalesce(nullif(board, ''), 'other') AS board, nullif(resume_id, '') AS resume, CASE WHEN fit_score < 5 THEN '<5' WHEN fit_score < 7 THEN '5–7' ELSE '≥7' END AS fit, strftime(DATE '1970-01-01' + CAST(applied_day AS INTEGER), '%G-W%V') AS week, CAST(reply_day IS NOT NULL AS INTEGER) AS r FROM s),
g AS (SELECT 'overall' AS split, 'all' AS label, r FROM r UNION ALL SELECT 'by_board', board, r FROM r UNION ALL SELECT 'by_resume', resume, r FROM r WHERE resume IS NOT NULL UNION ALL SELECT 'by_fit', fit, r FROM r UNION ALL SELECT 'by_week', week, r FROM r)
SELECT split, label, count(*) AS n, CAST(sum(r) AS BIGINT) AS replied, sum(r) / count(*) AS rate, count(*) < 5 AS few FROM g GROUP BY ALL""",
    _VIEWS,
)
def reply_numbers(spark: SparkSession, d: str) -> DataFrame:
    """A2, A5"""
    return tracker.reply_numbers(_state(spark, d))


@register(f"WITH {_STATE} SELECT quantile_cont(greatest(0, reply_day - applied_day), 0.5) AS median_days, count(*) AS replies FROM s WHERE reply_day IS NOT NULL", _VIEWS)
def median_reply(spark: SparkSession, d: str) -> DataFrame:
    """A3"""
    return tracker.median_days_to_reply(_state(spark, d))


@register(f"WITH {_STATE} SELECT stage, coalesce(n, 0) AS n FROM (SELECT unnest(['applied', 'screen', 'interview', 'offer', 'accepted', 'rejected', 'withdrawn', 'ghosted']) AS stage) LEFT JOIN (SELECT stage, count(*) AS n FROM s GROUP BY stage) USING (stage)", _VIEWS)
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """A6"""
    return tracker.stage_counts(_state(spark, d))


_FIT = "CASE WHEN score_label = '' AND match_score = floor(match_score) THEN NULL ELSE match_score END"
_BOUNDS = f"b AS (SELECT source_model, round(quantile_cont({_FIT}, 0.01), 4) AS low, round(quantile_cont({_FIT}, 0.99), 4) AS high, count({_FIT}) AS n FROM v_outcomes GROUP BY source_model HAVING count({_FIT}) >= 30 AND quantile_cont({_FIT}, 0.99) - quantile_cont({_FIT}, 0.01) >= 0.5)"


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    fit = scores.fit_of(F.col("match_score"), F.col("score_label"), F.col("source_model"))
    return evaluate.calibrate_fit(read(spark, d, "v_outcomes"), fit)


@register(f"WITH {_BOUNDS} SELECT * FROM b", ["v_outcomes"])
def fit_bounds(spark: SparkSession, d: str) -> DataFrame:
    """A8, F18"""
    return _bounds(spark, d)


@register(
    f"WITH {_BOUNDS} SELECT a.id, o.source_model, o.id IS NOT NULL AS known, CASE WHEN b.low IS NOT NULL THEN least(10.0, greatest(0.0, (CASE WHEN o.score_label = '' AND o.match_score = floor(o.match_score) THEN NULL ELSE o.match_score END - low) / (high - low) * 10)) END AS fit_scaled FROM v_applications a LEFT JOIN v_outcomes o ON o.id = a.job_id LEFT JOIN b ON b.source_model = o.source_model".replace("THEN least(10.0, greatest(0.0, (CASE", "AND NOT (o.score_label = '' AND o.match_score = floor(o.match_score)) THEN least(10.0, greatest(0.0, (CASE"),
    ["v_applications", "v_outcomes"],
)
def enriched_applications(spark: SparkSession, d: str) -> DataFrame:
    """J10, X5"""
    e = tracker.applications_enriched(read(spark, d, "v_applications"), read(spark, d, "v_outcomes"), _bounds(spark, d))
    fit = scores.fit_of(F.col("match_score"), F.col("score_label"), F.col("source_model"))
    return e.select("id", "source_model", "known", F.when(fit.isNotNull(), F.col("fit_scaled")).alias("fit_scaled"))


@register("SELECT id, run_at FROM v_outcomes WHERE status = 'notified' ORDER BY run_at DESC, id DESC LIMIT 1", ["v_outcomes"])
def last_notified(spark: SparkSession, d: str) -> DataFrame:
    """W5"""
    return outcomes.last_notified(read(spark, d, "v_outcomes")).select("id", "run_at")


_COPIES = "SELECT id, concat('role ', ord % 50) AS title, concat('co ', ord % 3) AS company, source, ord FROM {v}"


@register(
    f"""WITH p AS (SELECT *, {jkey("title", "company")} AS k, row_number() OVER (PARTITION BY source ORDER BY ord) AS t, min(ord) OVER (PARTITION BY source) AS f FROM ({_COPIES.replace("{v}", "v_postings")})),
h AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, f) AS held, row_number() OVER (PARTITION BY k ORDER BY ord) AS came FROM p)
SELECT a.id, b.t AS turn, b.f AS seen FROM h a JOIN h b ON a.k = b.k AND a.came = b.held""",
    ["v_postings"],
)
def turns(spark: SparkSession, d: str) -> DataFrame:
    """W4"""
    return outcomes.take_turns(spark.sql(_COPIES, v=read(spark, d, "v_postings"))).select("id", "turn", "seen")


@register(
    """WITH n AS (SELECT *, 0 AS new FROM v_outcomes WHERE source < 'src6' UNION ALL SELECT * REPLACE (run_at + 100 AS run_at, 'logged' AS status), 1 AS new FROM v_outcomes WHERE source >= 'src3')
SELECT id, arg_min(first_run_at, new) AS first_run_at, arg_max(status, new) AS status, arg_max(run_at, new) AS run_at FROM n GROUP BY id""",
    ["v_outcomes"],
)
def upserted_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """S20"""
    o = read(spark, d, "v_outcomes")
    batch = o.where("source >= 'src3'").withColumn("run_at", F.col("run_at") + 100).withColumn("status", F.lit("logged"))
    return outcomes.upsert_outcomes(o.where("source < 'src6'"), batch).select("id", "first_run_at", "status", "run_at")


@register("SELECT message_id, min(id) AS id FROM v_verdicts WHERE message_id NOT IN (SELECT message_id FROM v_verdicts WHERE verdict = 'applied') GROUP BY message_id", ["v_verdicts"])
def new_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """S22"""
    v = read(spark, d, "v_verdicts")
    return outcomes.append_verdicts(v.where("verdict = 'applied'"), v).select("message_id", "id")


# --- evaluation -----------------------------------------------------------------------------------------------------

_CUTS = "g AS (SELECT s, count(*) AS n, count_if(y = 1) AS good FROM v_labelled WHERE gated GROUP BY s), c AS (SELECT s, n, good, sum(n) OVER (ORDER BY s DESC) AS n_at, sum(good) OVER (ORDER BY s DESC) AS good_at, (SELECT count_if(y = 1) FROM v_labelled) AS all_good FROM g), m AS (SELECT *, good_at / n_at AS p, good_at / greatest(1, all_good) AS r FROM c)"


@register(f"WITH {_CUTS} SELECT s AS t, p AS precision, r AS recall, CAST(n_at AS BIGINT) AS alerts, true AS met FROM m WHERE r >= 0.3 ORDER BY p DESC, s DESC LIMIT 1", ["v_labelled"])
def alert_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """W11"""
    return evaluate.alert_cutoff(read(spark, d, "v_labelled"), 0.3)


@register(
    "WITH b AS (SELECT s, label = 'log' AS y FROM v_labelled WHERE s < 8 AND label IN ('log', 'skip')), g AS (SELECT s, count(*) AS n, count_if(y) AS good FROM b GROUP BY s), c AS (SELECT s, sum(n) OVER (ORDER BY s DESC) AS n_at, sum(good) OVER (ORDER BY s DESC) AS good_at, (SELECT count_if(y) FROM b) AS a FROM g) SELECT s AS save_at FROM c ORDER BY 2 * good_at / greatest(1, n_at + a) DESC, s LIMIT 1",
    ["v_labelled"],
)
def save_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """W12"""
    return evaluate.save_cutoff(read(spark, d, "v_labelled"), 8.0)


@register(
    "WITH t AS (SELECT unnest([5.25, 5.5, 5.75, 6.0, 6.25, 6.5, 6.75]) AS t) SELECT CAST(t AS DOUBLE) AS t, coalesce(count_if(gated AND s >= t AND y = 1) / nullif(count_if(gated AND s >= t), 0), 0) AS precision, count_if(gated AND s >= t AND y = 1) / greatest(1, count_if(y = 1)) AS recall, count_if(gated AND s >= t) AS alerts FROM t, v_labelled GROUP BY t",
    ["v_labelled"],
)
def cutoff_table(spark: SparkSession, d: str) -> DataFrame:
    """W13, A15"""
    return evaluate.cutoff_table(read(spark, d, "v_labelled"), 6.0, 0.25)


@register(f"WITH {_CUTS} SELECT sum(good / (SELECT sum(good) FROM g) * good_at / n_at) AS average_precision FROM c", ["v_labelled"])
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """A18"""
    return evaluate.average_precision(read(spark, d, "v_labelled"))


@register(
    """WITH a AS (SELECT count(*) AS labelled, count_if(s >= 6 AND id % 3 = 0) AS alerts, count_if(s >= 6 AND id % 3 = 0 AND label = 'notify') AS caught, count_if(label = 'notify') AS good FROM v_labelled),
x AS (SELECT *, caught / alerts AS p, 1.96 AS z FROM a)
SELECT alerts, round(100 * alerts / labelled, 1) AS per100, p AS worth, round((p + z * z / (2 * alerts) - z * sqrt(p * (1 - p) / alerts + z * z / (4 * alerts * alerts))) / (1 + z * z / alerts), 3) AS low, round((p + z * z / (2 * alerts) + z * sqrt(p * (1 - p) / alerts + z * z / (4 * alerts * alerts))) / (1 + z * z / alerts), 3) AS high, caught, good, p > 0.2 AND caught >= 2 AS go FROM x""",
    ["v_labelled"],
)
def alert_summary(spark: SparkSession, d: str) -> DataFrame:
    """A19, X12"""
    rows = read(spark, d, "v_labelled").select("label", F.when(F.col("s") >= 6, "notify").alias("decision"), (F.col("id") % 3 == 0).alias("keep"))
    return evaluate.go_no_go(evaluate.alert_summary(rows), 10, 2)


@register("SELECT label, count_if(s >= 6) AS notify, count_if(s >= 4 AND s < 6) AS log, count_if(s < 4) AS skip FROM v_labelled GROUP BY label", ["v_labelled"])
def confusion(spark: SparkSession, d: str) -> DataFrame:
    """A14, X1"""
    rows = read(spark, d, "v_labelled").withColumn("decision", scores.decide(F.col("s"), 6, 4))
    return evaluate.confusion(rows, "label", "decision", ["notify", "log", "skip"])


@register(
    "WITH r AS (SELECT least(floor(s / 10.25 * 15), 14) AS bin, s / 10.25 AS conf, y FROM v_labelled), b AS (SELECT bin, count(*) AS n, avg(conf) AS c, avg(y) AS a FROM r GROUP BY bin) SELECT round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM b",
    ["v_labelled"],
)
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    """A17"""
    rows = read(spark, d, "v_labelled").select((F.col("s") / 10.25).alias("conf"), (F.col("y") == 1).alias("correct"))
    return evaluate.calibration_error(rows).select(F.round("ece", 9).alias("ece"))


@register("WITH r AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM v_labelled) SELECT round(corr(a, b), 9) AS spearman FROM r", ["v_labelled"])
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """The rank correlation"""
    return evaluate.spearman(read(spark, d, "v_labelled").select("s", "y"), "s", "y").select(F.round("spearman", 9).alias("spearman"))


_SOFT = "list_transform({x}, lambda v: exp(v - list_max({x})))"


def _softsql(x: str) -> str:
    e = _SOFT.replace("{x}", x)
    return f"list_transform({e}, lambda v: v / list_sum({e}))"


_LOGITS = f"l AS (SELECT vec_id, {_softsql('CAST(embedding[1:7] AS DOUBLE[])')} AS role, {_softsql('CAST(embedding[8:9] AS DOUBLE[])')} AS deal, {_softsql('CAST(embedding[10:19] AS DOUBLE[])')} AS fit FROM embeddings)"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    a = scores.answers(F.slice(e, 1, 7), F.slice(e, 8, 2), F.slice(e, 10, 10))
    return read(spark, d, "embeddings").select("vec_id", *[c.alias(k) for k, c in a.items()])


@register(
    f"WITH {_LOGITS}, a AS (SELECT vec_id, ['backend', 'frontend', 'fullstack', 'ai', 'data', 'infra', 'other'][list_position(role, list_max(role))] AS role, deal[2] AS deal_p, fit FROM l) SELECT vec_id, role, round(deal_p, 6) AS deal_p, round(1 + list_sum(list_transform(fit, lambda x, i: x * (i - 1))), 6) AS expected, round(fit[7] + fit[8] + fit[9] + fit[10], 6) AS p_good, role IN ('backend', 'fullstack', 'ai', 'data') AND deal_p < 0.5 AS gated FROM a"
)
def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """X6, X7, X8, F17"""
    a = _answers(spark, d)
    return a.select("vec_id", "role", F.round("deal_p", 6).alias("deal_p"), F.round(scores.summarise(F.col("fit_p"), "expected"), 6).alias("expected"), F.round(scores.summarise(F.col("fit_p"), "p_good"), 6).alias("p_good"), scores.gates_pass(F.col("role"), F.col("deal_p")).alias("gated"))


@register(
    f"WITH {_LOGITS}, b AS (SELECT vec_id, fit, list_sum(fit[7:10]) AS hi, list_sum(fit[5:6]) AS mid, list_sum(fit[1:4]) AS lo FROM l) SELECT vec_id, CAST(CASE WHEN hi >= mid AND hi >= lo THEN 6 + list_position(fit[7:10], list_max(fit[7:10])) WHEN mid >= lo THEN 4 + list_position(fit[5:6], list_max(fit[5:6])) ELSE list_position(fit[1:4], list_max(fit[1:4])) END AS INTEGER) AS band_score FROM b"
)
def band_scores(spark: SparkSession, d: str) -> DataFrame:
    """W16"""
    return _answers(spark, d).select("vec_id", scores.band_score(F.col("fit_p"), 7, 5).alias("band_score"))


# --- similarity -----------------------------------------------------------------------------------------------------

# rows of one table with equal shingle sets are a class, named by its smallest ord; shared: shingles that two classes share
_SHINGLES = """w AS (SELECT ord, regexp_extract_all(lower(description), '([a-z0-9+#]+)', 1) AS w FROM v_postings),
h AS (SELECT ord, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]))) AS s FROM w WHERE len(w) >= 30),
c AS (SELECT s, min(ord) AS rep FROM h GROUP BY s), e AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM c),
x AS (SELECT a.rep AS i, b.rep AS j, a.n AS ni, b.n AS nj, count(*) AS shared FROM e a JOIN e b USING (g) WHERE a.rep < b.rep GROUP BY ALL), pairs AS (SELECT i, j FROM x WHERE shared / (ni + nj - shared) >= 0.8)"""
_GROUP_KEY = "(trim(regexp_replace(translate(lower(title), '-/', '  '), '\\s+', ' ', 'g')) || chr(10) || trim(regexp_replace(translate(lower(company), '-/', '  '), '\\s+', ' ', 'g')))"


@register(f"WITH {_SHINGLES} SELECT i, j FROM pairs", ["v_postings"])
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links between classes of equal sets; similar_classes has their members."""
    return similar.similar_pairs(read(spark, d, "v_postings"))


@register(
    f"WITH {_SHINGLES}, l AS (SELECT k, count(*) AS links FROM (SELECT i AS k FROM pairs UNION ALL SELECT j FROM pairs) GROUP BY k) SELECT ord, coalesce(rep, ord) AS class, coalesce(links, 0) AS links FROM v_postings LEFT JOIN h USING (ord) LEFT JOIN c USING (s) LEFT JOIN l ON k = rep",
    ["v_postings"],
)
def similar_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each posting with its class and its number of links"""
    return similar.similar_classes(read(spark, d, "v_postings"))


@register(
    f"""WITH RECURSIVE {_SHINGLES}, k AS (SELECT ord, {_GROUP_KEY} AS k FROM v_postings), m AS (SELECT k, min(ord) AS b FROM k GROUP BY k),
l AS (SELECT ord AS a, b FROM k JOIN m USING (k) UNION SELECT ord, rep FROM h JOIN c USING (s) UNION SELECT i, j FROM pairs), g AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) WHERE a <> b),
r AS (SELECT ord AS a, ord AS b FROM v_postings UNION SELECT r.a, g.b FROM r JOIN g ON g.a = r.b) SELECT a AS ord, min(b) AS "group" FROM r GROUP BY a""",
    ["v_postings"],
)
def job_groups(spark: SparkSession, d: str) -> DataFrame:
    """J15"""
    return similar.job_groups(read(spark, d, "v_postings"))


@register(
    f"""WITH {_SHINGLES}, p AS (SELECT ord, id, {_GROUP_KEY} AS k FROM v_postings), near AS (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs UNION ALL SELECT rep, rep FROM c),
even AS (SELECT DISTINCT rep FROM h JOIN c USING (s) WHERE ord % 2 = 0), lk AS (SELECT DISTINCT h.ord FROM h JOIN c USING (s) JOIN near ON i = rep JOIN even ON even.rep = j)
SELECT id, CASE WHEN id IN (SELECT id FROM p WHERE ord % 2 = 0) THEN 'same_id' WHEN k IN (SELECT k FROM p WHERE ord % 2 = 0) THEN 'same_title_company' WHEN ord IN (SELECT ord FROM lk) THEN 'similar_text' END AS excluded FROM p WHERE ord % 2 = 1""",
    ["v_postings"],
)
def excluded_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Odd postings against even ones"""
    p = read(spark, d, "v_postings")
    return similar.exclude_near_duplicates(p.where("ord % 2 = 1"), p.where("ord % 2 = 0")).select("id", "excluded")
