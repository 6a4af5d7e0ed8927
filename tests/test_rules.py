"""Golden cases of text rules, sources and files, and invariants of splits and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from rowloom.functions import scores, text, urls
from rowloom.operators import condense, employment, evaluate, graph, location, outcomes, pools, similar, tracker
from rowloom.sources import files, payloads


def values(spark, rows, *columns):
    """The columns, given as functions of a column c, for each of rows."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    got = df.select("i", *[f(F.col("c")).alias(f"v{k}") for k, f in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in got]


def test_words(spark):
    assert values(spark, ["C++/C#, Node.js.", "", None], text.word_text) == [" c++ c# node.js ", "  ", "  "]
    assert values(spark, ["javascript", "Java, SQL"], lambda c: text.has_term(text.word_text(c), "java")) == [False, True]


def test_repair(spark):
    assert values(spark, ["Engineer â\x80\x94 Cloud", "café", "a &amp; b", None], text.repair_text) == ["Engineer — Cloud", "café", "a & b", ""]


def test_times(spark):
    assert values(spark, ["1700000000", "1700000000000", "September 24, 2026", "2026-09-24", "soon", ""], text.posted_iso) == ["2023-11-14T22:13:20+00:00", "2023-11-14T22:13:20+00:00", "2026-09-24", "2026-09-24", "soon", ""]
    cutoff = F.lit("2026-09-24 12:00:00").cast("timestamp")
    assert values(spark, ["2026-09-24", "2026-09-23", "2026-09-24T11:00:00Z", "when?", None], lambda c: text.is_fresh(c, cutoff)) == [True, False, False, True, True]


def test_html(spark):
    assert values(spark, ["<p>a <b>b</b>c</p><ul><li>x<br>y</li></ul>&lt;z&gt;", None], text.html_to_text) == ["a bc\nx\ny\n<z>", ""]


def test_names(spark):
    assert values(spark, ["Ann Lee wrote; ann_lee too; Ann alone"], lambda c: text.anonymize(c, ["Ann Lee"])) == ["the candidate wrote; the candidate too; Ann alone"]
    assert values(spark, ["Ann Lee\nEngineer", "an engineer\nx"], text.header_name) == ["Ann Lee", None]


def test_replies_and_subjects(spark):
    got = values(spark, ['<think>{}</think> {"score": 7, "matched_skills": ["a", 1]}', '{"score": 11}', "none"], text.parse_reply)
    assert (got[0]["score"], got[0]["error"], got[1]["score"]) == (7, None, None) and got[2]["error"]
    assert [r and tuple(r) for r in values(spark, ["Re: Fwd: jh:good:a:b", "jh:what:x"], text.parse_verdict_subject)] == [("good", "a:b"), None]
    got = values(spark, ["Mon, 05 Oct 2026 10:00:00 +0200"], lambda c: text.parse_mail_date(c, F.lit(None).cast("timestamp")).cast("string"))
    assert got == ["2026-10-05 08:00:00"]
    assert values(spark, ["=1+1", "a"], text.csv_cell) == ["'=1+1", "a"]


def test_links(spark):
    cases = {
        "https://boards.greenhouse.io/Acme/jobs/12?x=1": ("greenhouse", "Acme", "12"),
        "https://boards.greenhouse.io/embed/job_app?for=acme&token=5": ("greenhouse", "acme", "5"),
        "https://acme.wd5.myworkdayjobs.com/en/site/job/Place/Title_R1/apply": ("workday", "acme", "Title_R1"),
        "https://acme.wd5.myworkdayjobs.com/careers": None,
        "http://localhost#@a.myworkdayjobs.com/x/job/y": None,
        "https://app.dover.com/apply/acme/1-2": ("dover", "acme", "1-2"),
        "https://myjobs.adp.com/x?cid=c1&jobId=9": ("adp", "c1", "9"),
        "https://example.org/jobs/1": None,
    }
    assert [r and tuple(r)[:3] for r in values(spark, list(cases), urls.parse_link)] == list(cases.values())
    assert values(spark, ["https://x.org/a?utm_source=q&b=1#f", "https://x.org/a?b=1"], urls.without_tracking) == ["https://x.org/a?b=1#f", "https://x.org/a?b=1"]


def test_condense(spark):
    got = values(spark, ["About us\nWe are old.\nRequirements:\n5 years of Java\nWe offer 401(k).\nNice to have\nGo\n", "We do things. 3 years required.", None], condense.split_posting)
    assert (got[0]["requirements"], got[0]["preferred"], got[0]["headings"], got[0]["other"]) == ("5 years of Java", "Go", 3, None)
    assert (got[1]["requirements"], got[1]["other"], got[2]["empty_requirements"]) == ("3 years required.", "We do things.", True)
    assert values(spark, ["a cat\nb\nthe cat"], lambda c: condense.matching_lines(c, ["cat"])) == ["a cat\nthe cat"]


US = {"US": {"names": ["united states", "usa", "new mexico"], "region_codes": ["CA", "NY", "TX", "DE", "TN"]}}
REST = {"CA": {"names": ["canada", "toronto"], "region_codes": ["ON", "NS"]}, "IN": {"names": ["india", "chennai"], "region_codes": ["KA", "TN"]}, "DE": {"names": ["germany", "berlin"], "region_codes": ["BE"]}}


def test_location(spark):
    kept = ["Austin, TX", "New York, NY, San Jose, CA", "Toronto, ON; Austin, TX", "Albuquerque, New Mexico", "CA - San Jose", "San Francisco, CA, USA"]
    gone = ["Toronto, CA", "DE - Berlin", "Chennai, TN", "Bengaluru, KA, IN", "Halifax, NS", "Paris, France", "Cajamarca, Peru", "Remote"]
    blank = F.lit("")
    got = values(spark, [*kept, *gone], lambda c: location.location_verdict(c, F.lit("Engineer"), blank, US, REST))
    assert got[: len(kept)] == [None] * len(kept) and all(got[len(kept) :]), got
    got = values(spark, ["Engineer - Austin, TX", "Engineer"], lambda c: location.location_verdict(blank, c, blank, US, REST))
    assert got[0] is None and got[1].startswith("no location given")
    assert values(spark, ["Austin, TX / Toronto, ON", "a|b"], location.split_places) == [["Austin, TX", "Toronto, ON"], ["a", "b"]]


def test_employment(spark):
    none = F.lit(None).cast("string")
    titles = ["Engineer (Temp)", "Temp Sensor Engineer", "Smart Contract Engineer", "Contract Engineer", "Contract-to-hire Engineer"]
    assert values(spark, titles, lambda c: employment.contract_reason(c, F.lit(""), none)) == ["contract: temp", None, None, "contract: contract", None]
    texts = ["Duration: 6 months", "Duration: 12 months onboarding program", "You will work as a contractor.", "help people work as a contractor", "Paid on 1099", "reporting on 1099 forms"]
    assert values(spark, texts, lambda c: employment.contract_reason(F.lit("Engineer"), c, none)) == ["contract: duration: 6 months", None, "contract: as a contractor", None, "contract: on 1099", None]
    assert values(spark, ["$55/hr", "10,000/hr transactions", "$10,000/hr of spend, USD 40 per hour"], lambda c: employment.hourly_reason(F.lit("Engineer"), c, none)) == ["hourly pay: $55/hr", None, "hourly pay: usd 40 per hour"]


def test_scores(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("v")).first()["v"]
    p = F.array(*[F.lit(float(x)) for x in (0.0, 0.0, 0.0, 0.1, 0.2, 0.1, 0.3, 0.3, 0.0, 0.0)])
    assert one(scores.band_score(p, 7, 5)) == 7 and abs(one(scores.summarise(p, "p_good")) - 0.6) < 1e-12
    assert one(scores.floor2(F.lit(6.07))) == 6.07 and one(scores.floor4(F.lit(0.0003))) == 0.0003
    assert [round(x, 4) for x in one(F.array(*scores.wilson(F.lit(8), F.lit(10))))] == [0.4902, 0.9433]
    assert one(F.array(*scores.wilson(F.lit(0), F.lit(0)))) == [0.0, 0.0]
    assert one(scores.decide(F.lit(8), 7, 5, F.lit(0.2), 0.5)) == "log"
    assert abs(sum(one(scores.smoothed_target(F.lit(3), 10, 1.0))) - 1) < 1e-12
    none = F.lit(None).cast("double")
    assert one(scores.score_label(F.lit(6.5), none, F.lit(""), F.lit("m"), none, none)) == "6.5/10"
    assert one(scores.score_label(none, F.lit(0.72), F.lit(""), F.lit("m"), none, none)) == "fit 72%"


def test_question_report(spark, sf):
    """The report against a plain computation over its rows."""
    import numpy as np

    from rowloom import catalog

    e = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()}
    half = {r["vec_id"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id").where("pmod(xxhash64(vec_id), 2) = 0").collect()}
    r = catalog.queries()["question_report"](spark, sf).first()
    soft = lambda x, t: np.exp((x - x.max()) / t) / np.exp((x - x.max()) / t).sum()
    rows = []
    for k in sorted(half):
        role, deal, fit = soft(e[k][:7], r["t_role"]), soft(e[k][7:9], r["t_deal"]), soft(e[k][9:19], r["t_fit"])
        s = 1 + (fit * np.arange(10)).sum() if r["summary"] == "expected" else fit[6:].sum()
        rows.append((int(role.argmax()) in (0, 2, 3, 4) and deal[1] < 0.5, s, k % 10 >= 6))
    good, gated = sum(y for *_, y in rows), [(s, y) for g, s, y in rows if g]
    assert (r["select_jobs"], r["good_jobs"], r["gated_jobs"]) == (len(rows), good, len(gated))
    assert abs(r["base_rate"] - np.mean([y for _, y in gated])) < 1e-9
    cuts = []
    for t, _ in gated:
        hit = [y for s, y in gated if s >= t]
        cuts.append((sum(hit) / good >= 0.3, sum(hit) / len(hit), t, len(hit)))
    met = max(x for x in cuts if x[0]) if any(x[0] for x in cuts) else min((False, 0, t, 0) for t, y in gated if y)
    assert r["met"] == met[0] and abs(r["alert_at"] - np.floor(round(met[2] * 1e4, 6)) / 1e4) < 1e-9
    assert not met[0] or (abs(r["precision"] - met[1]) < 1e-9 and r["alerts"] == met[3])


def test_cutoff_without_gated_rows(spark):
    df = spark.createDataFrame([(1.0, 1, False), (2.0, 0, False)], "s double, y int, gated boolean")
    assert evaluate.alert_cutoff(df, 0.5).first().asDict() == {"t": 2.0, "precision": 0.0, "recall": 0.0, "alerts": 0, "met": False}
    assert evaluate.average_precision(df).first()[0] == 0.0


def test_temperature(spark):
    rows = [([2.0, 0.0], 0)] * 8 + [([2.0, 0.0], 1)] * 2
    t = evaluate.fit_temperature(graph.written(spark.createDataFrame(rows, "logits array<double>, y int")))
    assert abs(t - 2 / 1.3862943611) < 1e-3  # log(8 / 2)


def test_components_equal_brute_force(spark):
    import random

    random.seed(4)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    alone = {a for a, b in edges if a == b} - {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: find(v) for v in root if v not in alone}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_keeps_groups(spark):
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN 'old' ELSE 'new' END AS pool", "CASE WHEN id % 3 = 0 THEN 'log' ELSE 'skip' END AS label", "id div 4 AS `group`")
    out = pools.split_rows(rows)
    assert out.groupBy("group").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert out.where("pool = 'old' AND split <> 'train'").count() == 0
    shares = {r["split"]: r["n"] for r in out.where("`group` % 25 <> 0").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    assert abs(shares["select"] / total - 0.25) < 0.05 and abs(shares["calibrate"] / total - 0.15) < 0.05


def test_caps_are_exact(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id < 100 THEN 'a' ELSE 'b' END AS label")
    got = {r["label"]: r["n"] for r in pools.cap_per_label(rows, slack=50).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"a": 100, "b": 150}


def test_turns_are_a_permutation(spark):
    rows = spark.range(50).selectExpr("id", "concat('t', id % 7) AS title", "'c' AS company", "concat('s', id % 3) AS source", "id AS ord")
    got = outcomes.take_turns(rows).orderBy("turn", "seen").collect()
    assert sorted(r["id"] for r in got) == list(range(50))
    for key in {r["title"] for r in got}:
        own = [r["ord"] for r in got if r["title"] == key]
        assert own == sorted(own)


def test_numbered_in_stretches(spark):
    got = outcomes.numbered(spark.range(95).selectExpr("id AS ord", "id % 2 AS k"), "k", "ord", "n", width=10).orderBy("k", "ord").collect()
    assert [r["n"] for r in got if r["k"] == 0] == list(range(1, 49))


def test_status_ladder(spark):
    base = dict(filter_reason=None, blocked_host=None, needs_description=False, refused=False, from_listing=False, first_run_at=None, error=None, decision="notify", duplicate=False, delivered=True)
    cases = [({}, "notified"), ({"duplicate": True}, "duplicate"), ({"delivered": False}, "error_notify"), ({"filter_reason": "x: y"}, "filtered"), ({"needs_description": True, "refused": True}, "error_unavailable"), ({"needs_description": True, "from_listing": True, "first_run_at": 0}, "filtered"), ({"error": "error_scorer", "first_run_at": 0}, "error_terminal"), ({"error": "error_429_retry"}, "error_429_retry"), ({"decision": "log"}, "logged")]
    schema = "i int, filter_reason string, blocked_host string, needs_description boolean, refused boolean, from_listing boolean, first_run_at long, error string, decision string, duplicate boolean, delivered boolean"
    df = spark.createDataFrame([(i, *(base | c).values()) for i, (c, _) in enumerate(cases)], schema)
    assert [r["status"] for r in outcomes.assign_status(df, 10**6).orderBy("i").collect()] == [s for _, s in cases]


def test_upsert_is_idempotent(spark):
    table = spark.createDataFrame([("a", "pending", 1, 1), ("b", "logged", 1, 1)], "id string, status string, run_at int, first_run_at int")
    batch = spark.createDataFrame([("a", "notified", 5, 5), ("c", "skipped", 5, 5)], table.schema)
    once = outcomes.upsert_outcomes(table, batch)
    assert sorted(map(tuple, once.collect())) == [("a", "notified", 5, 1), ("b", "logged", 1, 1), ("c", "skipped", 5, 5)]
    assert sorted(map(tuple, outcomes.upsert_outcomes(once, batch).collect())) == sorted(map(tuple, once.collect()))


def test_stage_is_by_event_id(spark):
    apps = spark.createDataFrame([(1, 100)], "id long, applied_day long")
    events = spark.createDataFrame([(1, 1, "stage", "screen", 120, 119), (2, 1, "stage", "applied", 100, 100), (3, 1, "follow_up_set", "130", 121, 121)], "id long, application_id long, kind string, value string, at_day long, made_day long")
    row = tracker.current_state(apps, events, 125).first()
    assert (row["stage"], row["follow_up_day"], row["reply_day"], row["last_day"]) == ("applied", 130, 120, 121)


def test_similar_pairs_count_heavy_shingles(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] * 3 + [" ".join(words[:58] + ["x", "y"]), "short text"]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, description string")
    assert sorted(map(tuple, similar.similar_pairs(df).collect())) == [(0, 3)]
    assert sorted(map(tuple, similar.similar_classes(df).collect())) == [(0, 0, 1), (1, 0, 1), (2, 0, 1), (3, 3, 1), (4, 4, 0)]
    assert sorted(map(tuple, similar.similar_classes(df, links=False).collect())) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)]
    none = df.limit(0)
    assert similar.similar_pairs(none).count() == similar.similar_classes(none).count() == similar.similar_pairs(df, none).count() == 0


def test_similar_pairs_of_hot_groups(spark):
    """130 rows of copies and near copies in which each shingle is in over 100 texts, against brute force."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:59] + [f"x{i // 65}"]) for i in range(130)]  # two sets, 65 rows each
    texts += [" ".join([f"v{i}" for i in range(k, k + 45)]) for k in range(0, 30, 3)] + ["short text"]  # sliding sets
    df = spark.createDataFrame([(i, t, f"id{i}", f"T{i}", f"C{i}") for i, t in enumerate(texts)], "ord long, description string, id string, title string, company string")
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)], strict=False)) if len(t.split()) >= 30 else None for t in texts]
    like = lambda x, y: bool(x and y) and len(x & y) / len(x | y) >= 0.8
    wanted = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if like(sets[i], sets[j])]
    member = lambda rows: {r["ord"]: r["class"] for r in similar.similar_classes(rows, links=False).collect() if sets[r["ord"]]}
    classes, linked = member(df), {tuple(r) for r in similar.similar_pairs(df).collect()}
    linked |= {(j, i) for i, j in linked} | {(k, k) for k in classes.values()}
    assert [(i, j) for i in sorted(classes) for j in sorted(classes) if i < j and (classes[i], classes[j]) in linked] == wanted and len(wanted) > 130 * 129 // 2
    odd, even = df.where("ord % 2 = 1"), df.where("ord % 2 = 0")
    across = [(i, j) for i in range(1, len(texts), 2) for j in range(0, len(texts), 2) if like(sets[i], sets[j])]
    mine, theirs, linked = member(odd), member(even), {tuple(r) for r in similar.similar_pairs(odd, even).collect()}
    assert sorted((i, j) for i in mine for j in theirs if (mine[i], theirs[j]) in linked) == across
    excluded = similar.exclude_near_duplicates(odd, even).where("excluded = 'similar_text'").select("ord").collect()
    assert sorted(r["ord"] for r in excluded) == sorted({i for i, _ in across})
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for i, j in wanted:
            root[i] = root[j] = min(root[i], root[j])
    assert sorted(map(tuple, similar.job_groups(df).collect())) == list(enumerate(root))


def raw(spark, rows, **also):
    names = list(also)
    return spark.createDataFrame([(json.dumps(r), *also.values()) for r in rows], ["raw", *names]) if names else spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string")


def test_sources(spark):
    old = F.lit("2026-01-01").cast("timestamp")
    g = payloads.from_greenhouse(raw(spark, [{"id": 7, "title": "Dev", "location": {"name": "Here"}, "content": "&lt;p&gt;a &amp;amp; b&lt;/p&gt;", "updated_at": "2026-01-02"}], slug="acme")).first()
    assert (g["id"], g["company"], g["location"], g["description"], g["posted_at"]) == ("greenhouse_7", "acme", "Here", "a & b", "2026-01-02")
    v = payloads.from_lever(raw(spark, [{"id": "x", "text": "Dev", "createdAt": 1700000000000, "descriptionPlain": "in", "lists": [{"text": "Need", "content": "<li>a</li><li>b</li>"}], "additionalPlain": " "}], slug="acme")).first()
    assert (v["description"], v["posted_at"]) == ("in\n\nNeed\na\nb", "2023-11-14T22:13:20+00:00")
    a = payloads.from_ashby(raw(spark, [{"id": "q", "title": "T", "locationName": "L", "descriptionPlain": "p"}], slug="s")).first()
    assert (a["url"], a["location"], a["description"]) == ("https://jobs.ashbyhq.com/s/q", "L", "p")
    d = payloads.from_dice(raw(spark, [{"guid": "g", "isRemote": True, "salary": "$4"}])).first()
    assert (d["id"], d["location"], d["extra"], d["description_is_snippet"]) == ("dice_g", "Remote - US", {"guid": "g", "pay": "$4"}, True)
    rows = payloads.from_dover(raw(spark, [{"id": "A", "title": "T", "created": "2026-02-01"}, {"id": "b", "title": "T", "active": False}, {"id": "c"}, {"id": "d", "title": "T", "created": "2025-01-01"}], slug="x y"), old).collect()
    assert [r["disposition"] for r in rows] == ["new", "gone", "empty", "stale"] and rows[0]["url"] == "https://app.dover.com/apply/x%20y/a"
    m = payloads.from_gem(raw(spark, [{"extId": "e", "title": "T", "firstPublishedTsSec": 1800000000, "locations": [{"name": "A"}, {"name": ""}]}], slug="s"), old).first()
    assert (m["company"], m["location"], m["disposition"]) == ("s", "A", "new")
    p = payloads.from_adp(raw(spark, [{"itemID": "i", "requisitionTitle": "T", "customFieldGroup": {"stringFields": [{"nameCode": {"codeValue": "ExternalJobID"}, "stringValue": "9"}]}}], cid="C1"), {"c1": "Acme"}, old).first()
    assert (p["id"], p["company"]) == ("adp_c1_9", "Acme")
    z = payloads.from_amazon(raw(spark, [{"job_path": "/en/jobs/123/x", "city": "A", "country_code": "USA", "description": "d"}])).first()
    assert (z["id"], z["location"], z["url"]) == ("top_amazon_123", "A, USA", "https://www.amazon.jobs/en/jobs/123/x")
    k = payloads.from_getro(raw(spark, [{"results": {"jobs": [{"id": 1, "url": "https://a", "title": "T", "created_at": "1800000000", "locations": ["x", "y"]}, {"id": 2, "url": "ftp://a"}]}}]), old).collect()
    assert [(r["key"], r["location"]) for r in k] == [("getro_1", "x; y")]
    li = payloads.from_linkedin(raw(spark, [{"url": "https://l/view/1234567", "company": "\n Co \nCo", "age": "3 hours ago"}, {"url": "https://l/view/7654321", "age": "2 days ago"}]), 24, old).collect()
    assert [(r["id"], r["company"]) for r in li] == [("linkedin_1234567", "Co")]
    kept, bad = payloads.collect_postings({"one": payloads.from_lever(spark.createDataFrame([("not json", "s")], "raw string, slug string")), "two": payloads.from_lever(raw(spark, [{"id": "x"}], slug="s"))})
    assert kept.count() == 1 and {r["source"]: r["unreadable"] for r in bad.collect()} == {"one": 1, "two": 0}


def test_jsonld(spark):
    ld = '{"@graph": [{"@type": "Thing"}, {"@type": "JobPosting", "title": "Dev", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "X", "addressCountry": "US"}}, "description": "<p>d</p>"}]}'
    pages = spark.createDataFrame([("u", f'<script type="application/ld+json">{ld}</script>'), ("v", "<title>T | S</title><p>x</p>")], "url string, html string")
    a, b = payloads.from_jsonld(pages).orderBy("url").collect()
    assert (a["title"], a["company"], a["location"], a["description"], a["has_job"]) == ("Dev", "Acme", "X, US", "d", True)
    assert (b["title"], b["has_job"]) == ("T", False)


def test_pools_and_imports(spark, tmp_path):
    path = tmp_path / "pool.jsonl"
    good = {"job_id": "1", "title": "t", "company": "c", "description": "d", "label": "log", "match_score": 5}
    path.write_text(json.dumps(good) + "\n" + json.dumps(good | {"label": "what"}) + "\n")
    rows, bad = files.read_pool(spark, str(path), "p", strict=False)
    assert rows.count() == 1 and bad.first()["error"] == "unknown label"
    with pytest.raises(ValueError):
        files.read_pool(spark, str(path), "p")
    raw_rows = spark.createDataFrame([("Acme", "Dev", "2026-01-02", "", 1), ("ACME", "dev", "2026-01-02", "", 2), ("Acme", "Dev", "soon", "", 3), ("Old", "Dev", "2026-01-02", "", 4)], "`Company ` string, Title string, `Applied at` string, Stage string, line int")
    have = spark.createDataFrame([("old", "dev", "2026-01-02")], "company string, title string, applied_at string")
    new, rejects = files.import_applications(raw_rows, have, "2026-06-01")
    assert [(r["company"], r["line"]) for r in new.collect()] == [("Acme", 1)] and rejects.first()["error"] == "unreadable date"


def test_imports_meet_no_copies_of_applications(spark):
    """2,000 applications of one company, title and date, 2,000 rows of the same on another: no join pairs them."""
    raw_rows = spark.range(2000).selectExpr("'Acme' AS company", "'Dev' AS title", "IF(id < 5, '2026-01-02', '2026-01-03') AS applied_at", "'' AS stage", "id AS line")
    have = spark.range(2000).selectExpr("'ACME' AS company", "IF(id = 7, NULL, 'dev') AS title", "'2026-01-02' AS applied_at")
    new, _ = files.import_applications(raw_rows, have, "2026-06-01")
    assert [(r["line"], str(r["applied_at"])) for r in new.collect()] == [(5, "2026-01-03")]
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("gettimestamp(") == 1


def test_imports_take_any_other_headers(spark):
    raw_rows = spark.createDataFrame([("Acme", "Dev", "2026-01-02", 1, "x", "y", 9.5), ("Acme", "Dev", "never", 2, "x", "y", 9.5)], "company string, title string, applied_at string, line int, a string, b string, c double").toDF("company", "title", "applied_at", "line", "notes", "notes", "pay.max")
    new, bad = files.import_applications(raw_rows, spark.createDataFrame([], "company string, title string, applied_at string"), "2026-06-01")
    assert [(r["line"], r["stage"]) for r in new.collect()] == [(1, "applied")] and [(r["line"], r["error"]) for r in bad.select("line", "error").collect()] == [(2, "unreadable date")]


def test_stream_equals_batch(spark, tmp_path):
    from rowloom.streaming import rules

    src, out = str(tmp_path / "in"), str(tmp_path / "table")
    rows = spark.range(40).selectExpr("concat('m', id % 25) AS message_id", "id", "concat('j', id % 4) AS job_id", "'good' AS verdict", "id AS received_at")
    rows.write.parquet(src)
    for name in ("c1", "c2"):  # the second run replays all of it
        rules.run_available(rules.landed(spark, src, rows._jdf.schema().toDDL()), str(tmp_path / name), rules.append_new_verdicts(out)).awaitTermination()
    got = sorted(r["message_id"] for r in spark.read.parquet(out).collect())
    assert got == sorted({f"m{i % 25}" for i in range(40)})
    stream = rules.application_stages(rules.landed(spark, src, rows._jdf.schema().toDDL()).selectExpr("'stage' AS kind", "job_id AS application_id", "message_id AS value", "id"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["application_id"]: r["stage"] for r in spark.table("stages").collect()} == {f"j{k}": f"m{(36 + k) % 25}" for k in range(4)}


def test_plugins(spark):
    from rowloom import plugins

    @plugins.scorer("half")
    def half(df):
        return F.when(F.col("id") % 2 == 0, F.col("id") * 10)

    @plugins.scorer("rest")
    def rest(df):
        return F.when(F.col("id") < 4, F.col("id"))

    got = {r["id"]: (r["result"], r["scorer"]) for r in plugins.run_scorers(spark.range(6), ["half", "rest"]).collect()}
    assert got == {0: (0, "half"), 2: (20, "half"), 4: (40, "half"), 1: (1, "rest"), 3: (3, "rest"), 5: (None, None)}
    plugins.register_functions(spark)
    assert spark.sql("SELECT floor2(6.079), decide(8, 7, 5)").first()[:] == (6.07, "notify")
    assert spark.sql("SELECT count(*) FROM sentences_of('A b. C d.\nE')").first()[0] == 3


def test_import_without_training_data_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['rowloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.llm is None and e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_pages_and_feeds(spark):
    from rowloom.sources import pages

    old = F.lit("2026-01-01").cast("timestamp")
    items = [("We are hiring a backend engineer", "https://d/a-1", "<p>x</p>", "Mon, 05 Oct 2026 10:00:00 +0000", ["x"]), ("How to hire engineers: we are hiring", "https://d/b", "", None, []), ("Developer", "https://d/c", "apply here", None, [" Jobs "]), ("Developer", "https://d/e", "apply here", None, None)]
    df = spark.createDataFrame(items, "title string, link string, description string, pubDate string, category array<string>")
    assert sorted((r["id"], r["posted_at"]) for r in pages.from_devto(df, old).collect()) == [("devto_a-1", "2026-10-05T10:00:00+00:00"), ("devto_c", "")]
    jobs = json.dumps({"initialData": {"n": 1, "jobs": [{"id": 5, "title": "T [x]", "apply_url": "https://a", "posted_at": "2026-02-01", "tags": ["q"]}, {"id": 6, "apply_url": "javascript:"}]}})
    cut = len(jobs) // 2
    page = "".join(f"<script>self.__next_f.push([1,{json.dumps(part)}])</script>" for part in (jobs[:cut], jobs[cut:]))
    found, failed = pages.from_consider(spark.createDataFrame([("h", page), ("bad", "<p>")], "host string, html string"), old)
    assert [(r["key"], r["title"]) for r in found.collect()] == [("consider_5", "T [x]")] and [r["host"] for r in failed.collect()] == ["bad"]
    guest = '<div class="show-more-less-html__markup x"><p>Do it</p></div><h3 class="description__job-criteria-subheader">Level</h3><span> Mid </span>'
    assert pages.from_linkedin_page(spark.createDataFrame([("u", guest)], "url string, html string")).first()["description"] == "Do it\n\nLevel: Mid"
    html_ = [("u", '<nav>n</nav><div class="job-description"><p>Build it</p>experience<script>x</script></div><div id="content">a</div>'), ("v", "<body><header>h</header><p>all of it</p></body>"), ("w", "<div id='content'>Loading</div>")]
    got = {r["url"]: r["description"] for r in pages.best_description(spark.createDataFrame(html_, "url string, html string"), ["experience"], ["loading"]).collect()}
    assert got == {"u": "Build it\nexperience", "v": "all of it", "w": ""}


def test_actions(spark):
    from rowloom.operators import actions as act

    log = [(1, "applied", "j1", "", 100), (2, "bad", "j2", "", 100), (3, "hide", "j3", "", 100), (4, "unhide", "j3", "", 101), (5, "hide", "j4", "", 100), (6, "stage", "7", "screen", 110), (7, "stage", "7", "offer", 120), (8, "undo", "2", "", 121), (9, "follow_up", "7", "130", 121), (1, "applied", "j1", "", 100)]
    df = spark.createDataFrame(log, "id long, kind string, target string, value string, at_day long")
    assert [(r["job_id"], r["verdict"]) for r in act.verdicts(df).collect()] == [("j1", "applied")]
    assert [r["job_id"] for r in act.hidden(df).collect()] == ["j4"]
    assert [(r["id"], r["kind"], r["value"]) for r in act.events(df).orderBy("id").collect()] == [(12, "stage", "screen"), (13, "follow_up_set", "115"), (14, "stage", "offer"), (15, "follow_up_done", ""), (18, "follow_up_set", "130")]
    jobs = spark.createDataFrame([("j1", "t", "c", "u")], "id string, title string, company string, url string")
    apps = spark.createDataFrame([("j1", "rejected")], "job_id string, stage string")
    assert act.new_applications(df, jobs, apps).count() == 1
    assert act.new_applications(df, jobs, apps.withColumn("stage", F.lit("screen"))).count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_bucket_links_connect_what_all_links_connect(spark, rounds):
    """Numbers are close within three; buckets hold them at random, one holds them all."""
    import random

    draw = random.Random(rounds)
    values = draw.sample(range(600), 150)
    entries = {(v, 0) for v in values} | {(v, draw.randrange(1, 9)) for v in values for _ in range(2)}
    df = spark.createDataFrame(sorted(entries), "id long, bucket long")
    asked = []

    def close(pairs):
        asked.append(pairs.count())
        return pairs.where("abs(x - y) <= 3").selectExpr("x AS a", "y AS b")

    links = graph.bucket_links(graph.written(df), close, rounds)
    got = {r.node: r.root for r in graph.components(links).collect()}
    ordered, root = sorted(values), {}
    for k, v in enumerate(ordered):
        root[v] = root[ordered[k - 1]] if k and v - ordered[k - 1] <= 3 else v
    assert {v: got.get(v, v) for v in values} == root
    assert graph.bucket_links(graph.written(df.where("false")), close, rounds).count() == 0


def test_a_family_of_near_copies_takes_few_comparisons(spark):
    """5,000 near copies of one text: a few comparisons a row, components as of all pairs."""
    from pyspark.sql import functions as F

    words = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.when(i == F.col("id") % 97, F.concat(F.lit("x"), F.col("id") % 89)).otherwise(F.concat(F.lit("w"), i)))
    copies = spark.range(5_000).select(F.col("id").alias("ord"), F.array_join(words, " ").alias("description"))
    others = spark.range(30).select((F.col("id") + 9_000).alias("ord"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(F.lit("o"), F.col("id"), F.lit("n"), i)), " ").alias("description"))
    links = graph.written(similar.similar_links(copies.unionByName(others)))
    assert links.count() < 40 * 5_000
    roots = {r.node: r.root for r in graph.components(links).collect()}
    assert set(roots.values()) == {0} and len(roots) == 5_000


def test_percentiles_are_exact(spark):
    df = spark.range(5_000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE concat('m', id % 2) END AS model", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 4 ELSE (id * 7919 % 1009) / 8 END AS v")
    shares = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    got = {r.model: (r.n, r.q) for r in evaluate.percentiles(df, ["model"], F.col("v"), shares).collect()}
    want = df.groupBy("model").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()
    assert got == {r.model: (r.n, r.q) for r in want}
    assert evaluate.percentiles(df.where("false"), ["model"], F.col("v"), shares).count() == 0
    whole = evaluate.percentiles(df, [], F.col("v"), [0.5]).first()
    assert whole.q == [df.agg(F.percentile("v", 0.5)).first()[0]]


def test_terms_by_automaton_and_by_join(spark):
    from rowloom.operators import lexicon

    texts = spark.createDataFrame([(1, "Alpha beta, gamma. ALPHA"), (2, None), (3, ""), (4, "beta beta"), (4, "gamma"), (5, "alphabet c++ c")], "id long, text string")
    terms = lexicon.lexicon_table(spark, {"a": ["alpha", "alpha beta"], "b": ["beta gamma", "beta"], "c": ["c++"], "g": ["gamma"], "none": ["delta", "beta beta beta"]})
    want = {(1, "a"), (1, "b"), (1, "g"), (4, "b"), (4, "g"), (5, "c")}
    for chars in (10**6, 0):
        assert {(r.id, r.key) for r in lexicon.term_hits(texts, terms, most_chars=chars).collect()} == want
        assert lexicon.term_hits(texts, terms.where("false"), most_chars=chars).count() == 0


def test_a_job_with_a_third_of_the_rows(spark):
    """Turns and repeats where one job has most rows, against plain windows."""
    from pyspark.sql import Window

    n = 3_000
    posts = spark.range(n).selectExpr("concat('p', id) AS id", "CASE WHEN id % 3 = 0 THEN 'Dev' ELSE concat('t', id) END AS title", "'Acme' AS company", "concat('s', id * 31 % 4) AS source", "id AS ord")
    got = {r.id: (r.turn, r.seen) for r in outcomes.take_turns(posts).collect()}
    turn = F.row_number().over(Window.partitionBy("source").orderBy("ord"))
    plain = posts.withColumn("turn", turn).join(posts.groupBy("source").agg(F.min("ord").alias("seen")), "source").toPandas()
    for _, own in plain.groupby("title"):
        places = own.sort_values(["turn", "seen"])[["turn", "seen"]].itertuples(index=False, name=None)
        assert [got[i] for i in own.sort_values("ord")["id"]] == list(places)


def test_pool_errors_name_the_line(spark, tmp_path):
    good = lambda i: json.dumps({"job_id": f"j{i}", "title": "t", "company": "c", "description": "d" * (i % 50), "label": "log", "match_score": 5} | ({"description": "x"} if i % 50 == 0 else {}))
    lines = [good(i) for i in range(1, 301)]
    lines[41], lines[249], lines[100] = '{"job_id": "bad"', good(1).replace("log", "later"), "  "
    path = tmp_path / "pool.jsonl"
    path.write_text("\n".join(lines) + "\n")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "2000")  # the file is read in many blocks
    try:
        rows, bad = files.read_pool(spark, str(path), "p", strict=False)
        assert sorted((r["line"], r["error"]) for r in bad.collect()) == [(42, "unreadable"), (250, "unknown label")] and rows.count() == 297
        with pytest.raises(ValueError, match="pool.jsonl, line 42: .*unreadable"):
            files.read_pool(spark, str(path), "p")
    finally:
        spark.conf.set(name, before)


def test_similar_sets_keep_prefixes_alone(spark, monkeypatch):
    """Pairs as by brute force with frequent shingles in every text, and no table on the way that holds whole sets of texts
    without a link."""
    made = []
    keep = similar.written
    monkeypatch.setattr(similar, "written", lambda df: made.append(keep(df)) or made[-1])
    common = [f"c{i}" for i in range(20)]
    texts = [" ".join(common + [f"t{k}n{i}" for i in range(60)]) for k in range(30)] + [" ".join(common + [f"t{k}n{i}" for i in range(58)] + ["x", "y"]) for k in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, description string")
    assert sorted(map(tuple, similar.similar_pairs(df).collect())) == [(0, 30), (1, 31), (2, 32)]
    wide = [t.count() for t in made if "_h" in t.columns]
    assert wide and max(wide) == 6


def test_only_odd_texts_reach_python(spark, monkeypatch):
    """What is handed to the Python function is null for texts without signs of misreading and with simple references alone."""
    monkeypatch.setattr(text, "_repair", lambda c: c)
    cases = ["plain", "a &amp; b &lt;i&gt;", "a & b", "&&amp;lt;", "&copy; a", "cafÃ© &amp;", "a&b", None]
    assert values(spark, cases, text.repair_text) == ["plain", "a & b <i>", "a & b", "&&lt;", "&copy; a", "cafÃ© &amp;", "a&b", ""]
    monkeypatch.setattr(text, "_repair", lambda c: c.isNotNull().cast("string"))
    assert values(spark, cases[:6], text.repair_text) == ["false"] * 4 + ["true"] * 2
    monkeypatch.undo()
    assert values(spark, cases, text.repair_text) == ["plain", "a & b <i>", "a & b", "&&lt;", "© a", "café &", "a&b", ""]
