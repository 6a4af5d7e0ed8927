"""Further registered queries: lexicons, condensed postings, pools, listings, locations and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import scores
from rowloom.functions.text import word_text, word_text_py
from rowloom.operators import condense, employment, evaluate, graph, lexicon, listings, location, pools

from .queries import NOW, QUERIES, _answers, _LOGITS, has, read, register, w

#: Terms that the texts of the given tables have, some of several words, with alternatives.
LEXICON = {"article": ["the", "der", "la"], "of": ["of the", "de la"], "thing": ["thing", "things"], "and": ["and", "und", "et"], "ing": ["ing"]}
_HITS = "h AS (SELECT id, words, list_filter([" + ", ".join("CASE WHEN " + " OR ".join(has("words", t) for t in terms) + f" THEN '{k}' END" for k, terms in LEXICON.items()) + f"], lambda x: x IS NOT NULL) AS hits FROM (SELECT id, {w('description')} AS words FROM v_postings))"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "v_postings").select("id", F.col("description").alias("text"))


@register(f"WITH {_HITS} SELECT id, array_to_string(hits, ',') AS skills FROM h", ["v_postings"])
def skills(spark: SparkSession, d: str) -> DataFrame:
    """J12"""
    found = lexicon.skills_of(_texts(spark, d), LEXICON)
    return found.select("id", F.array_join("skills", ",").alias("skills"))


@register(f"WITH {_HITS} SELECT id, array_to_string(list_filter(hits, lambda x: x IN ('of', 'article')), ',') AS matched, array_to_string(list_filter(hits, lambda x: x NOT IN ('of', 'article')), ',') AS gaps FROM h", ["v_postings"])
def compared_skills(spark: SparkSession, d: str) -> DataFrame:
    """Q2, U3, U4"""
    found = lexicon.compare_skills(lexicon.skills_of(_texts(spark, d), LEXICON), ["article", "of"])
    return found.select("id", F.array_join("matched", ",").alias("matched"), F.array_join("gaps", ",").alias("gaps"))


#: Terms of two and three words, all that the benchmark table has.
_SEQUENCES = f"SELECT DISTINCT unnest(list_concat([x[i] || ' ' || x[i + 1] FOR i IN range(1, len(x))], [x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] FOR i IN range(1, len(x) - 1)])) AS term FROM (SELECT string_split(trim({w('text')}), ' ') AS x FROM benchmark)"


@register(
    f"""WITH t AS ({_SEQUENCES}), p AS (SELECT id, string_split(trim({w('description')}), ' ') AS x FROM v_postings),
    g AS (SELECT DISTINCT id, unnest(list_concat([x[i] || ' ' || x[i + 1] FOR i IN range(1, len(x))], [x[i] || ' ' || x[i + 1] || ' ' || x[i + 2] FOR i IN range(1, len(x) - 1)])) AS term FROM p)
    SELECT id, count(*) AS terms, min(term) AS first, sum(CAST(length(term) AS BIGINT))::BIGINT AS chars FROM g JOIN t USING (term) GROUP BY id""",
    ["v_postings"],
)
def benchmark_terms(spark: SparkSession, d: str) -> DataFrame:
    """A lexicon of some ten thousand terms"""
    words = F.split(F.trim(word_text(F.col("text"))), " ")
    pick = lambda x, n: F.transform(F.slice(F.sequence(F.lit(0), F.size(x)), F.lit(1), F.greatest(F.size(x) - (n - 1), F.lit(0))), lambda i: F.array_join(F.slice(x, i + 1, n), " "))
    made = read(spark, d, "benchmark").select(words.alias("x")).select(F.explode(F.concat(pick(F.col("x"), 2), pick(F.col("x"), 3))).alias("term")).distinct()
    found = lexicon.term_hits(_texts(spark, d), made.select(F.lit(0).alias("ord"), F.col("term").alias("key"), "term"))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.min("key").alias("first"), F.sum(F.length("key").cast("long")).alias("chars"))


@register(f"WITH {_HITS} SELECT id, CAST(list_position(['article', 'of', 'thing', 'and', 'ing'], k) - 1 AS INT) AS ord, k AS key FROM (SELECT id, unnest(hits) AS k FROM h)", ["v_postings"])
def term_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row a text and key"""
    return lexicon.term_hits(_texts(spark, d), lexicon.lexicon_table(spark, LEXICON))


PROFILES = {"english": ["the", "and", "thing"], "german": ["der", "und", "die"], "french": ["la", "et", "que"], "spare": []}


def _profile_sql() -> str:
    n = {k: "(" + (" + ".join(f"CAST({has('words', t)} AS INT)" for t in terms) or "0") + ")" for k, terms in PROFILES.items()}
    best = f"greatest({', '.join(n.values())})"
    top = " + ".join(f"CAST({x} = {best} AS INT)" for x in n.values())
    return f"SELECT id, CASE WHEN {best} = 0 OR {top} > 1 THEN 'spare' " + " ".join(f"WHEN {x} = {best} THEN '{k}'" for k, x in n.items()) + f" END AS profile FROM (SELECT id, {w('description')} AS words FROM v_postings)"


@register(_profile_sql(), ["v_postings"])
def picked_profiles(spark: SparkSession, d: str) -> DataFrame:
    """J11"""
    return lexicon.pick_profile(_texts(spark, d), PROFILES, "spare")




_MADE = """SELECT id, concat(CASE WHEN ord % 3 = 0 THEN concat('About us', chr(10), 'We are old.', chr(10), 'Requirements:', chr(10), '5 years of it', chr(10)) ELSE '' END,
  CASE ord % 5 WHEN 0 THEN concat('**What you’ll do**', chr(10)) WHEN 1 THEN concat('Some Things To Know:', chr(10)) WHEN 2 THEN concat(upper(location), chr(10)) ELSE '' END,
  CASE WHEN ord % 7 = 0 THEN '' ELSE concat('Responsibilities:', chr(10)) END, description,
  CASE ord % 4 WHEN 0 THEN concat(chr(10), 'Benefits', chr(10), 'free food') WHEN 1 THEN concat(chr(10), '# Nice to have', chr(10), title, chr(10), 'Experience with ', source) ELSE '' END) AS text FROM v_postings"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _condensed_sql() -> str:
    """The division of postings over rows of lines: each line's section is that of the last heading before it."""
    phrases = [(p, k) for k, own in condense.KINDS for p in own]
    kind = "CASE " + " ".join(f"WHEN contains(low || ' ', {_quoted(p)}) THEN '{k}'" for p, k in phrases) + " WHEN starts_with(low, 'about ') THEN 'drop' ELSE 'other' END"
    opens = "(starts_with(low, 'about ') OR " + " OR ".join(f"starts_with(low, {_quoted(p)})" for p, _ in phrases) + ")"
    same = ", ".join(_quoted(x) for p, _ in phrases for x in (p, p + "s"))
    tag, boiler, need = (_quoted(x) for x in (condense.TAG, condense.BOILERPLATE, condense.REQUIREMENT))
    letters = r"(?:[^\p{L}]*\p{L}){4}"
    own = lambda name: f"nullif(coalesce(string_agg(trim(line), chr(10) ORDER BY i) FILTER (placed = '{name}'), ''), '') AS {name}"
    return rf"""WITH t AS ({_MADE.replace("{", "").replace("}", "")}),
    n AS (SELECT id, unnest(regexp_split_to_array(text, '\r\n|[\n\r]')) AS line, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r]'), 1) AS i FROM t),
    b AS (SELECT *, trim(regexp_replace(trim(translate(line, chr(8217) || chr(8216), chr(39) || chr(39))), '^[*#]+|[*#]+$', '', 'g')) AS bare FROM n WHERE trim(line) <> ''),
    f AS (SELECT *, rtrim(lower(bare), ':') AS low, len(regexp_split_to_array(bare, '\s+')) AS words,
      ends_with(bare, ':') OR regexp_matches(trim(line), '^(?:#|\*\*)') OR regexp_matches(bare, '{letters}') AND NOT regexp_matches(bare, '[\p{{Ll}}\p{{Lo}}\p{{Lt}}\p{{Lm}}]') AS marked FROM b),
    j AS (SELECT *, bare <> '' AND length(bare) <= 70 AND words <= 8 AND NOT regexp_matches(bare, '[.;,]$') AND NOT regexp_matches(trim(rtrim(bare, ':')), {tag}) AND regexp_matches(bare, '{letters}')
      AND (marked OR words <= 6 AND {opens}) AS head FROM f),
    k AS (SELECT *, CASE WHEN head THEN {kind} END AS kind, CASE WHEN head THEN NOT marked AND NOT (len(regexp_split_to_array(low, '\s+')) <= 2 OR low IN ({same})) ELSE true END AS content FROM j),
    s AS (SELECT *, coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING), 'other') AS section FROM k),
    h AS (SELECT id, count(*) FILTER (head) AS headings, count(*) FILTER (kind = 'other') AS unknown_headings FROM k GROUP BY id),
    z AS (SELECT id, replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(10), chr(1)) AS text FROM t SEMI JOIN (SELECT id FROM h WHERE headings = 0) USING (id)),
    parts AS (SELECT id, line, i, section FROM s JOIN h USING (id) WHERE headings > 0 AND content AND (NOT head AND section <> 'drop' OR head AND section NOT IN ('drop', 'other'))
      UNION ALL SELECT id, unnest(string_split(text, chr(1))), generate_subscripts(string_split(text, chr(1)), 1), 'other' FROM z),
    r AS (SELECT id, line, i, CASE WHEN section IN ('responsibilities', 'other') AND regexp_matches(line, {need}) THEN 'requirements' ELSE section END AS placed FROM parts
      WHERE trim(line) <> '' AND NOT regexp_matches(line, {boiler})),
    c AS (SELECT id, {", ".join(own(x) for x in condense.SECTIONS)} FROM r GROUP BY id)
    SELECT t.id, {", ".join(condense.SECTIONS)}, CAST(coalesce(headings, 0) AS INT) AS headings, CAST(coalesce(unknown_headings, 0) AS INT) AS unknown_headings, requirements IS NULL AS empty_requirements
    FROM t LEFT JOIN h USING (id) LEFT JOIN c USING (id)"""


def _condensed(spark: SparkSession, d: str) -> DataFrame:
    made = spark.sql(_MADE.replace("FROM v_postings", "FROM {v}"), v=read(spark, d, "v_postings"))
    return made.select("id", condense.split_posting(F.col("text")).alias("p")).select("id", "p.*")


@register(_condensed_sql(), ["v_postings"])
def condensed_postings(spark: SparkSession, d: str) -> DataFrame:
    """C17"""
    return _condensed(spark, d)


@register(
    f"""WITH y AS ({_condensed_sql()}) SELECT count(*) AS postings, count(*) FILTER (headings = 0) AS no_headings, count(*) FILTER (empty_requirements) AS empty_requirements, CAST(sum(unknown_headings) AS BIGINT) AS unknown_headings FROM y""",
    ["v_postings"],
)
def input_health(spark: SparkSession, d: str) -> DataFrame:
    """A11"""
    return pools.input_health(_condensed(spark, d))


def _excerpt_sql(split: str, hit: str) -> str:
    """The lines with a word until one would pass 1,500 characters, else the opening."""
    return f"""(SELECT coalesce(nullif(string_agg(x, chr(10) ORDER BY k) FILTER (upto <= 1500), ''), substr(text, 1, 1500)) FROM (
      SELECT x, k, sum(length(x) + 1) OVER (ORDER BY k) - 1 AS upto FROM (SELECT trim(unnest(p)) AS x, generate_subscripts(p, 1) AS k FROM (SELECT {split} AS p)) WHERE {hit}))"""


_TOKENS = r"regexp_split_to_array(lower(x), '[^\p{L}\p{N}]+')"


@register(
    rf"""SELECT id, {_excerpt_sql(r"regexp_split_to_array(text, '\r\n|[\n\r]')", f"list_has_any({_TOKENS}, ['the', 'der', 'que'])")} AS lines,
      {_excerpt_sql(r"string_split(replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1))", f"list_contains({_TOKENS}, 'thing') OR len(list_filter({_TOKENS}, lambda t: starts_with(t, 'onth'))) > 0")} AS sentences
    FROM (SELECT id, coalesce(description, '') AS text FROM v_postings)""",
    ["v_postings"],
)
def posting_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """C22"""
    return _texts(spark, d).select("id", condense.matching_lines(F.col("text"), ["the", "der", "que"]).alias("lines"), condense.matching_lines(F.col("text"), ["thing"], sentences=True, prefixes=["onth"]).alias("sentences"))


_SAID = """SELECT concat('pool', ord % 2) AS pool, concat(title, '; ', CASE ord % 9 WHEN 0 THEN 'Secret clearance' WHEN 1 THEN concat(ord % 12, ' years') WHEN 2 THEN 'Onsite in Germany;' WHEN 3 THEN '' WHEN 4 THEN ' ; '
    WHEN 5 THEN 'US citizen' WHEN 6 THEN concat(ord % 7, '+ of ', source) WHEN 7 THEN 'Senior firmware' ELSE 'relocation' END, CASE WHEN ord % 4 = 0 THEN '; lead; India' ELSE '' END) AS dealbreaker, ord % 5 AS k, title FROM v_postings"""
_KINDS = " ".join(f"WHEN regexp_matches(p, {_q}) THEN '{_name}'" for _name, _, _rule in scores.DEALBREAKER_RULES for _q in ["'" + _rule + "'"])
_SOFT = ", ".join(f"'{_name}'" for _name, _bad, _ in scores.DEALBREAKER_RULES if not _bad)


@register(
    f"""WITH i AS ({_SAID}), s AS (SELECT pool, row_number() OVER () AS r, CASE k WHEN 0 THEN substr(dealbreaker, length(title) + 3) ELSE dealbreaker END AS said FROM i),
    p AS (SELECT r, trim(unnest(string_split(lower(said), ';'))) AS p, generate_subscripts(string_split(said, ';'), 1) AS n FROM s),
    c AS (SELECT r, n, CASE {_KINDS} ELSE 'other' END AS kind FROM p WHERE p <> ''),
    f AS (SELECT r, arg_min(kind, (CASE WHEN kind IN ({_SOFT}) THEN 1 ELSE 0 END, n)) AS kind FROM c GROUP BY r)
    SELECT pool, coalesce(kind, 'none') AS category, count(*) AS n FROM s LEFT JOIN f USING (r) GROUP BY ALL""",
    ["v_postings"],
)
def dealbreaker_counts(spark: SparkSession, d: str) -> DataFrame:
    """A9"""
    made = spark.sql(_SAID.replace("FROM v_postings", "FROM {v}"), v=read(spark, d, "v_postings"))
    said = F.when(F.col("k") == 0, F.expr("substr(dealbreaker, length(title) + 3)")).otherwise(F.col("dealbreaker"))
    return pools.dealbreaker_counts(made.select("pool", said.alias("dealbreaker")))


@register("SELECT CAST(gated AS VARCHAR) AS question, label AS \"option\", count(*) AS n FROM v_labelled GROUP BY ALL", ["v_labelled"])
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    """A10"""
    return pools.class_counts(read(spark, d, "v_labelled").select(F.col("gated").cast("string").alias("question"), F.col("label").alias("option")))


def split_pool(spark: SparkSession, d: str) -> DataFrame:
    """W14"""
    rows = read(spark, d, "v_labelled").select("id", F.when(F.col("id") % 5 == 0, "old").otherwise("new").alias("pool"), "label", (F.col("id") / 3).cast("long").alias("group"))
    return pools.split_rows(rows).select("id", "group", "pool", "split")


def capped_labels(spark: SparkSession, d: str) -> DataFrame:
    """W15"""
    return pools.cap_per_label(read(spark, d, "v_labelled").select("id", "label"), slack=10)


@register(
    f"WITH {_LOGITS}, a AS (SELECT vec_id % 3 = 0 AS y, 1 + list_sum(list_transform(fit, lambda x, i: x * (i - 1))) AS expected, fit[7] + fit[8] + fit[9] + fit[10] AS p_good FROM l), e AS (SELECT expected AS s, count(*) AS n, count(*) FILTER (y) AS g FROM a GROUP BY s), p AS (SELECT p_good AS s, count(*) AS n, count(*) FILTER (y) AS g FROM a GROUP BY s), "
    "x AS (SELECT sum(g / (SELECT sum(g) FROM e) * ga / na) AS ap FROM (SELECT g, sum(g) OVER (ORDER BY s DESC) AS ga, sum(n) OVER (ORDER BY s DESC) AS na FROM e)), z AS (SELECT sum(g / (SELECT sum(g) FROM p) * ga / na) AS ap FROM (SELECT g, sum(g) OVER (ORDER BY s DESC) AS ga, sum(n) OVER (ORDER BY s DESC) AS na FROM p)) SELECT round(x.ap, 6) AS expected, round(z.ap, 6) AS p_good, CASE WHEN z.ap > x.ap THEN 'p_good' ELSE 'expected' END AS chosen FROM x, z"
)
def chosen_summary(spark: SparkSession, d: str) -> DataFrame:
    """W17"""
    a = _answers(spark, d).select((F.col("vec_id") % 3 == 0).cast("int").alias("y"), F.lit(True).alias("gated"), scores.summarise(F.col("fit_p"), "expected").alias("expected"), scores.summarise(F.col("fit_p"), "p_good").alias("p_good"))
    return evaluate.choose_summary(a).select(F.round("expected", 6).alias("expected"), F.round("p_good", 6).alias("p_good"), "chosen")


_ROLE_LIST = "[" + ", ".join(f"'{r}'" for r in scores.STACK_ROLES) + "]"


@register(
    f"""WITH {_LOGITS}, a AS (SELECT {_ROLE_LIST}[list_position(role, list_max(role))] = {_ROLE_LIST}[vec_id % 7 + 1] AS same, vec_id % 7 AS r, deal[2] >= 0.5 AS hit, vec_id % 2 = 1 AS bad, vec_id % 5 > 0 AS known,
      1 + list_sum(list_transform(fit, lambda x, i: x * (i - 1))) AS expected, vec_id % 10 + 1 AS score FROM l),
    k AS (SELECT *, rank() OVER (ORDER BY expected) + (count(*) OVER (PARTITION BY expected) - 1) / 2 AS re, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rs FROM a)
    SELECT count(*) AS n, round(avg(CAST(same AS INT)), 6) AS role_accuracy, round(avg(CASE WHEN known THEN CAST(hit = bad AS INT) END), 6) AS deal_accuracy,
      round(count(*) FILTER (known AND hit AND bad) / greatest(1, count(*) FILTER (known AND hit)), 6) AS deal_precision, round(count(*) FILTER (known AND hit AND bad) / greatest(1, count(*) FILTER (known AND bad)), 6) AS deal_recall,
      round(avg(abs(expected - score)), 6) AS fit_mae, round((SELECT max(c) FROM (SELECT count(*) AS c FROM a GROUP BY r)) / count(*), 6) AS role_majority, round(corr(re, rs), 6) AS spearman FROM k"""
)
def question_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A16"""
    roles = F.element_at(F.array(*map(F.lit, scores.STACK_ROLES)), (F.col("vec_id") % 7 + 1).cast("int"))
    a = _answers(spark, d).withColumn("expected", scores.summarise(F.col("fit_p"), "expected"))
    rows = a.select("role", roles.alias("role_true"), "deal_p", (F.col("vec_id") % 2).alias("deal_true"), (F.col("vec_id") % 5 > 0).alias("deal_known"), "expected", (F.col("vec_id") % 10 + 1).alias("score"))
    found = evaluate.question_metrics(rows)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


_LOSS = "avg(ln(list_sum(list_transform(g, lambda v: exp((v - list_max(g)) / t)))) + (list_max(g) - g[y + 1]) / t)"


@register(
    f"""WITH x AS (SELECT list_transform(CAST(embedding[10:19] AS DOUBLE[]), lambda v: v * 20) AS g, vec_id % 10 AS y FROM embeddings),
    c AS (SELECT arg_min(t, loss) AS t FROM (SELECT t, {_LOSS} AS loss FROM x, (SELECT unnest(range(50, 501)) / 100.0::DOUBLE AS t) GROUP BY t)),
    f AS (SELECT arg_min(t, loss) AS t FROM (SELECT t, {_LOSS} AS loss FROM x, (SELECT t + k / 10000.0::DOUBLE AS t FROM c, (SELECT unnest(range(-100, 101)) AS k)) WHERE t BETWEEN 0.5 AND 5 GROUP BY t))
    SELECT round(t, 4) AS temperature FROM f"""
)
def temperatures(spark: SparkSession, d: str) -> DataFrame:
    """The temperature of the fit question; the twin tries them all"""
    e = F.col("embedding").cast("array<double>")
    rows = graph.written(read(spark, d, "embeddings").select(F.transform(F.slice(e, 10, 10), lambda x: x * 20).alias("logits"), (F.col("vec_id") % 10).cast("int").alias("y")))
    return spark.range(1).select(F.lit(evaluate.fit_temperature(rows)).alias("temperature"))


def question_report(spark: SparkSession, d: str) -> DataFrame:
    """Calibrated on one half of the answers, measured on the other"""
    e, k = F.col("embedding").cast("array<double>"), F.col("vec_id")
    true = F.element_at(F.array(*map(F.lit, scores.STACK_ROLES)), (k % 7 + 1).cast("int"))
    rows = read(spark, d, "embeddings").select(
        k, F.slice(e, 1, 7).alias("role"), F.slice(e, 8, 2).alias("deal"), F.slice(e, 10, 10).alias("fit"), true.alias("role_true"), (k % 2).alias("deal_true"), (k % 5 > 0).alias("deal_known"), (k % 10 + 1).alias("score"),
        (k % 10 >= 6).cast("int").alias("y"), F.when(k % 10 >= 6, "notify").when(k % 10 >= 4, "log").otherwise("skip").alias("label"),
    )
    half = F.pmod(F.xxhash64("vec_id"), F.lit(2))
    return evaluate.evaluate_questions(rows.where(half == 0), rows.where(half == 1))


_LISTED = "SELECT concat('k', ord % 400) AS key, CASE ord % 3 WHEN 0 THEN concat('https://jobs.lever.co/c/', ord % 300, '/') ELSE concat('http://x.org/', ord % 350, '?a=1') END AS url, ord FROM {p}"


@register(
    "WITH l AS (" + _LISTED.replace("{p}", "v_postings") + "), k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1), u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY rtrim(regexp_extract(url, '^[a-z]+://([^?]*)', 1), '/') || regexp_extract(url, '(\\?.*)$', 1) ORDER BY ord) = 1) SELECT key, url, CASE WHEN url LIKE '%lever%' THEN 'lever' END AS handed FROM u",
    ["v_postings"],
)
def routed_listings(spark: SparkSession, d: str) -> DataFrame:
    """J16, A13"""
    rows = spark.sql(_LISTED, p=read(spark, d, "v_postings"))
    return listings.route_listings(rows, ["lever", "gem"]).select("key", "url", "handed")


@register(
    f"""WITH c AS (SELECT concat('k', ord) AS key, title, posted_at, ord % 400 * 3600 + {NOW - 400 * 3600} AS seen, 0 AS r FROM v_postings WHERE source < 'src5'), n AS (SELECT concat('k', ord) AS key, 'new ' || title AS title, CASE WHEN ord % 2 = 0 THEN '' ELSE posted_at END AS posted_at, {NOW} AS seen, 1 AS r FROM v_postings WHERE source >= 'src3'),
b AS (SELECT * FROM (SELECT * FROM c UNION ALL SELECT * FROM n) WHERE CASE WHEN posted_at = '' THEN seen ELSE CAST(posted_at AS BIGINT) END >= {NOW - 72 * 3600})
SELECT key, arg_min(title, r) AS title, min(seen) AS seen FROM b GROUP BY key""",
    ["v_postings"],
)
def merged_listings(spark: SparkSession, d: str) -> DataFrame:
    """J17, T13"""
    p = read(spark, d, "v_postings").withColumn("key", F.concat(F.lit("k"), F.col("ord")))
    cache = p.where("source < 'src5'").select("key", "title", "posted_at", F.timestamp_seconds(F.col("ord") % 400 * 3600 + NOW - 400 * 3600).alias("first_seen"))
    new = p.where("source >= 'src3'").select("key", F.concat(F.lit("new "), "title").alias("title"), F.when(F.col("ord") % 2 == 0, "").otherwise(F.col("posted_at")).alias("posted_at"))
    out = listings.merge_listings(cache, new, F.timestamp_seconds(F.lit(NOW - 72 * 3600)), F.timestamp_seconds(F.lit(NOW)))
    return out.select("key", "title", F.unix_seconds("first_seen").alias("seen"))


ALLOWED = {"DE": {"names": ["germany", "berlin"], "region_codes": ["BE", "BY"]}, "FR": {"names": ["france"], "region_codes": []}}
OTHERS = {"CA": {"names": ["canada", "toronto"], "region_codes": ["ON", "BC"]}, "IN": {"names": ["india"], "region_codes": ["KA"]}}


@register(
    "SELECT id, CASE ord % 6 WHEN 1 THEN 'location outside allowed countries: Toronto, ON' WHEN 2 THEN 'location outside allowed countries: Tokyo, Japan' WHEN 3 THEN 'location not recognised: Lima, Peru' WHEN 5 THEN 'location outside allowed countries: Bengaluru, KA, IN' END AS reason FROM v_postings",
    ["v_postings"],
)
def location_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """F3, F4, F5"""
    p = read(spark, d, "v_postings")
    places = ["Berlin, Germany", "Toronto, ON", "Tokyo, Japan", "Lima, Peru", "Tokyo, Japan; Remote - BY", "Bengaluru, KA, IN"]
    where = F.element_at(F.array(*map(F.lit, places)), (F.col("ord") % 6 + 1).cast("int"))
    return p.select("id", location.location_verdict(where, F.col("title"), F.col("description"), ALLOWED, OTHERS).alias("reason"))


#: Offers of all kinds in the texts of the postings.
_OFFERS = """SELECT id, concat(CASE ord % 6 WHEN 0 THEN 'Contractor ' WHEN 1 THEN 'Temporary ' WHEN 2 THEN 'Smart Contracts ' ELSE '' END, title) AS title,
  concat(description, ' ', CASE ord % 9 WHEN 0 THEN 'A contract role.' WHEN 1 THEN concat('A ', 1 + ord % 24, '-month contract.') WHEN 2 THEN 'Six months  contract' WHEN 3 THEN 'This is contract-to-hire.' WHEN 4 THEN 'Employment type: Temporary'
    WHEN 5 THEN 'C2C or 1099 welcome' WHEN 6 THEN concat('Handles $9,000/hr and pays $', ord % 700, ' - $800 per hour') WHEN 7 THEN concat('USD ', ord % 60, '.50 hourly') ELSE 'We manage contracts.' END) AS text,
  CASE ord % 11 WHEN 0 THEN 'Contract, W2' WHEN 1 THEN 'Full-time' WHEN 2 THEN 'Contract-to-Hire' WHEN 3 THEN 'Remote, contract' END AS listed,
  CASE ord % 10 WHEN 0 THEN concat('$', 20 + ord % 90, ' - $120 hourly') WHEN 1 THEN '90,000 USD a year' WHEN 2 THEN '$2,000 / hour' END AS pay FROM v_postings"""


def _first_of(words: str, terms: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {has(words, t)} THEN '{t}'" for t in terms) + " END"


def _masked(words: str, terms: list[str]) -> str:
    for t in terms:
        words = f"replace({words}, '{word_text_py(t)}', ' ')"
    return words


_WAGES = r"(?:\$\s*\d[\d,]*(?:\.\d+)?|usd\s*\$?\s*\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s*usd)"
_HOURLY = rf"{_WAGES}\s*(?:-\s*\$?\s*\d[\d,]*(?:\.\d+)?\s*(?:usd\s*)?)?\s*(?:/\s*|\s+per\s+)(?:hrs?|hours?)\b|hourly\s+rate\s+of\s+{_WAGES}|{_WAGES}\s+hourly\b"
_LISTED_PAY = r"(?:\$\s*)?\d[\d,]*(?:\.\d+)?(?:\s*-\s*\$?\s*\d[\d,]*(?:\.\d+)?)?(?:\s+hourly\b|\s*(?:/\s*|\s+per\s+)(?:hrs?|hours?)\b)"
_WAGE = r"list_filter(regexp_extract_all({0}, '{1}'), lambda m: TRY_CAST(replace(regexp_extract(m, '\d[\d,]*(?:\.\d+)?'), ',', '') AS DOUBLE) <= 500)[1]"


@register(
    rf"""WITH i AS ({_OFFERS}), k AS (SELECT *, list_transform(string_split(lower(coalesce(listed, '')), ','), lambda p: trim(regexp_replace(replace(p, '-', ' '), '\s+', ' ', 'g'))) AS parts,
      {_masked(_masked(w("title"), employment.TO_HIRE), ["smart contracts", "smart contract"])} AS heads, {_masked(w("title || ' ' || text"), employment.TO_HIRE)} AS words,
      regexp_replace(lower(title || chr(10) || text), '\b(?:contract[\s-]+to[\s-]+hire|cth|temp[\s-]+to[\s-]+perm|temp[\s-]+to[\s-]+hire)\b', ' ', 'g') AS raw FROM i),
    f AS (SELECT *, len(list_filter(parts, lambda p: NOT starts_with(p, 'contract to hire') AND string_split(p, ' ')[1] = 'contract')) > 0 AS is_listed,
      coalesce({_first_of("heads", employment.TITLE_TERMS)}, {_first_of("words", employment.PHRASES)},
        nullif(trim(regexp_extract(raw, '\b(?:\d{{1,2}}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)[\s-]+months?\s+contract\b')), ''),
        nullif(trim(regexp_extract(raw, '\b(?:employment|job|position)\s*type\s*[:\-]\s*(?:contract|temporary|(?:independent\s+)?contractor|1099)\b')), '')) AS found FROM k)
    SELECT id, CASE WHEN is_listed THEN 'contract: listed as ' || listed WHEN found IS NOT NULL THEN 'contract: ' || found END AS contract,
      CASE WHEN {_WAGE.format("lower(coalesce(pay, ''))", _LISTED_PAY)} IS NOT NULL THEN 'hourly pay: listed as ' || pay
        WHEN {_WAGE.format("lower(title || chr(10) || text)", _HOURLY)} IS NOT NULL THEN 'hourly pay: ' || trim({_WAGE.format("lower(title || chr(10) || text)", _HOURLY)}) END AS hourly FROM f""",
    ["v_postings"],
)
def contract_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """F9, F10"""
    made = spark.sql(_OFFERS.replace("FROM v_postings", "FROM {v}"), v=read(spark, d, "v_postings"))
    c = F.col
    return made.select("id", employment.contract_reason(c("title"), c("text"), c("listed")).alias("contract"), employment.hourly_reason(c("title"), c("text"), c("pay")).alias("hourly"))


for f in (split_pool, capped_labels, question_report):
    QUERIES[f.__name__] = f
