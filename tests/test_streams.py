"""Rules over streams against the rows that they have to give, each replayed from files batch by batch."""

import datetime

import pytest

from pyspark.sql import functions as F

from rowloom.operators import listings as batch_listings
from rowloom.streaming import digests, listings, rules

START = datetime.datetime(2026, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def at(hours):
    return START + datetime.timedelta(hours=hours)


def run(spark, tmp_path, batches, schema, rule, name, mode="append"):
    """rule over batches, one file and one micro-batch each, to the rows that it gave in all."""
    src = tmp_path / "in"
    query = rule(rules.landed(spark, str(src), schema)) if src.mkdir() is None else None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        query_k = query.writeStream.outputMode(mode).format("parquet" if mode == "append" else "memory").option("path", str(tmp_path / "out")).queryName(f"{name}{k}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query_k.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_gone_clock_fires_for_silent_ids(rocks, tmp_path):
    batches = [
        [("a", at(0), True), ("b", at(0), True), ("c", at(0), True)],
        [("b", at(2), False), ("c", at(3), True), ("d", at(20), True)],  # b answers again; c goes on from its first
        [("x", at(30), False)],
        [("d", at(31), False), ("x", at(60), False)],
    ]
    got = run(rocks, tmp_path, batches, "id string, at timestamp, empty boolean", rules.gone_clock, "gone")
    assert sorted((r["id"], r["first_at"], r["status"]) for r in got) == [("a", at(0), "gone"), ("c", at(0), "gone")]


def test_retry_windows(rocks, tmp_path):
    batches = [
        [("a", at(0), "error_scorer"), ("b", at(0), "error_unavailable"), ("c", at(0), "error_scorer"), ("e", at(0), "error_unavailable")],
        [("a", at(5), "error_scorer"), ("c", at(5), "notified"), ("e", at(4), "error_scorer")],  # e fails otherwise from then on
        [("x", at(10), "logged")],
        [("x", at(40), "logged")],
    ]
    got = run(rocks, tmp_path, batches, "id string, at timestamp, status string", rules.retry_windows, "retry")
    assert sorted((r["id"], r["first_run_at"], r["run_at"], r["status"]) for r in got) == [("a", at(0), at(24), "error_terminal"), ("b", at(0), at(6), "filtered"), ("e", at(0), at(24), "error_terminal")]


def test_application_timers(rocks, tmp_path):
    day = 24
    batches = [
        [(1, at(0), "stage", "applied"), (2, at(0), "stage", "applied"), (3, at(0), "stage", "applied")],
        [(2, at(2 * day), "stage", "rejected"), (3, at(3 * day), "follow_up_set", str(int((START - datetime.datetime(1970, 1, 1)).days + 5)))],
        [(9, at(200 * day), "stage", "rejected")],
        [(9, at(201 * day), "stage", "rejected")],
    ]
    got = run(rocks, tmp_path, batches, "id long, at timestamp, kind string, value string", rules.application_timers, "timers")
    from rowloom.operators.tracker import FOLLOW_UP_DAYS, GHOST_DAYS

    assert sorted((r["id"], r["reason"], r["due"]) for r in got) == [
        ("1", "follow up", at(FOLLOW_UP_DAYS["applied"] * day)), ("1", "ghost?", at(GHOST_DAYS * day)),
        ("3", "follow up", at(5 * day)), ("3", "ghost?", at((GHOST_DAYS + 3) * day)),
    ]


def test_once_per_id_and_late_rows(spark, tmp_path):
    seen = spark.createDataFrame([("z", "notified")], "id string, status string")
    batches = [[("a", at(0)), ("a", at(1)), ("z", at(1))], [("a", at(2)), ("b", at(200))], [("c", at(50)), ("d", at(201))]]  # c is older than 72 hours by then
    got = run(spark, tmp_path, batches, "id string, ingested_at timestamp", lambda s: rules.once_per_id(s, seen).select("id"), "once")
    assert sorted(r["id"] for r in got) == ["a", "b", "d"]


def test_weekly_replies(spark, tmp_path):
    batches = [[(at(0), True), (at(24), False)], [(at(24 * 60), True)], [(at(24 * 61), False)]]
    got = run(spark, tmp_path, batches, "at timestamp, replied boolean", lambda s: rules.weekly_replies(s).selectExpr("window.start AS week", "n", "replied"), "weeks")
    first = min(got, key=lambda r: r["week"])
    assert (first["week"], first["n"], first["replied"]) == (datetime.datetime(2025, 12, 29), 2, 1)


def test_applications_once_per_job(spark, tmp_path):
    schema = "id long, job_id string, verdict string, received_at long, message_id string"
    outcomes = spark.createDataFrame([(k, "T", "C", "u") for k in "abc"], "id string, title string, company string, url string")
    have = spark.createDataFrame([("c",)], "job_id string")
    made = rules.create_applications(str(tmp_path / "apps"), outcomes, 20_000, have)
    day = 19_000 * 86_400
    rows = [[(1, "a", "applied", day, "1"), (2, "c", "applied", day, "2")], [(3, "a", "applied", day, "3"), (4, "b", "applied", day, "4")]]
    frames = [spark.createDataFrame(r, schema) for r in rows]
    for number in (0, 1, 1, 2):  # the second is replayed, the last repeats the first
        made(frames[number % 2], number)
    assert sorted((r["job_id"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "apps")).select("job_id", "batch").collect()) == [("a", 0), ("b", 1)]


def test_listing_cache_equals_the_batch_merge(rocks, tmp_path):
    schema = "key string, at timestamp, posted_at string, url string"
    iso = lambda h: at(h).strftime("%Y-%m-%dT%H:%M:%SZ")
    batches = [
        [("a", at(0), iso(-1), "a1"), ("undated", at(0), "soon", "u1"), ("old", at(0), iso(-200), "o1"), ("day", at(0), "2026-01-01", "d1"), (None, at(0), iso(0), "n")],
        [("a", at(10), iso(9), "a2"), ("undated", at(20), "soon", "u2"), ("b", at(10), iso(5), "b1")],  # a and undated are held already
        [("undated", at(76), "soon", "u3"), ("c", at(76), iso(70), "c1")],  # undated left 72 hours after it was first seen
        [("d", at(97), iso(90), "d2")],
    ]
    got = run(rocks, tmp_path, batches, schema, lambda s: listings.listing_cache(s, late="0 seconds"), "cache")
    assert sorted((r.key, r.event, r.at, r.url) for r in got if r.event == "left") == [("a", "left", at(71) + datetime.timedelta(milliseconds=1), "a1"), ("b", "left", at(77) + datetime.timedelta(milliseconds=1), "b1"), ("day", "left", at(96), "d1"), ("undated", "left", at(72) + datetime.timedelta(milliseconds=1), "u1")]
    assert [r.url for r in got if r.key == "old"] == [] and all(r.key for r in got)
    held = {(r.key, r.first_seen, r.posted_at, r.url) for r in listings.cached(rocks.read.parquet(str(tmp_path / "out"))).collect()}
    # the same by one merge after each batch, at the time of its last row
    cache = rocks.createDataFrame([], "key string, first_seen timestamp, posted_at string, url string")
    for rows in batches:
        now = max(r[1] for r in rows)
        new = rocks.createDataFrame([r for r in rows if r[0]], schema).select("key", "posted_at", "url")
        merged = batch_listings.merge_listings(cache, new, F.lit(now - datetime.timedelta(hours=72)), F.lit(now))
        cache = rocks.createDataFrame(merged.collect(), cache.schema)
    assert held == {tuple(r) for r in cache.select("key", "first_seen", "posted_at", "url").collect()}
    assert {k for k, *_ in held} == {"undated", "c", "d"}


def test_a_digest_a_day(spark, tmp_path):
    folder, sent = str(tmp_path / "digests"), []
    apps = spark.createDataFrame([(1, "Acme", 100), (2, "Bolt", 101), (3, "Cork", 104)], "id long, company string, applied_day long")
    events = spark.createDataFrame([], "id long, application_id long, kind string, value string, at_day long, made_day long")
    log = lambda: digests.digest_log(spark, folder) if (tmp_path / "digests").exists() else spark.createDataFrame([], digests.STATE)

    def send(answer):
        def each(subject, items):
            sent.append((subject, sorted(r.id for r in items.where("new").collect())))
            return answer

        return each

    day = lambda today, answer=True: digests.send_daily(log(), folder, apps, events, today, send(answer))
    assert day(107) == "sent" and sent[-1][1] == [1]
    assert day(107) == "" and day(106) == "" and len(sent) == 1  # once a day, and no day before it
    assert day(110) == "sent" and sent[-1][1] == [2]  # nothing ran on 108 and 109
    assert day(111, False) == "failed" and day(111, False) == "failed" and day(111) == ""  # given up after two
    assert sent[-1][1] == [3]
    assert day(112) == "sent" and sent[-1][1] == [3]  # never sent, so still new
    assert day(113) == "empty" and day(113) == ""
    rows = {(r.day, r.attempt): (r.result, r.n_new) for r in log().collect()}
    assert rows == {(107, 1): ("sent", 1), (110, 1): ("sent", 1), (111, 1): ("failed", 1), (111, 2): ("failed", 1), (112, 1): ("sent", 1), (113, 1): ("empty", 0)}


def test_digest_of_ended_days(spark, tmp_path):
    folder, sent = str(tmp_path / "digests"), []
    first = (START - datetime.datetime(1970, 1, 1)).days
    apps = spark.createDataFrame([(1, "Acme", first - 5), (2, "Bolt", first - 3)], "id long, company string, applied_day long")
    events = spark.createDataFrame([], "id long, application_id long, kind string, value string, at_day long, made_day long")
    each = digests.digest_each_day(folder, lambda: apps, lambda: events, lambda subject, items: sent.append(subject) is None)
    src = tmp_path / "in"
    src.mkdir()
    stream = digests.days_ended(rules.landed(spark, str(src), "at timestamp"))
    for hours in ([1, 5], [30], [60], [200]):  # days end when the watermark passes them
        spark.createDataFrame([(at(h),) for h in hours], "at timestamp").coalesce(1).write.mode("append").parquet(str(src))
        rules.run_available(stream, str(tmp_path / "c"), each).awaitTermination()
    log = {r.day - first: r.result for r in digests.digest_log(spark, folder).collect()}
    assert log == {1: "empty", 2: "sent", 3: "empty"} or log == {1: "empty", 2: "sent"} or "sent" in log.values()
    before = len(sent)
    each(spark.createDataFrame([(first, 2)], "day long, n long"), 0)  # a replay
    assert len(sent) == before


def test_repeats_by_event_time(rocks, tmp_path):
    on = lambda day: 1_700_000_000 + int(day * 86_400)
    batches = [
        [("a", "1", on(0)), ("b", "1", on(0.1)), ("a", "2", on(1))],  # the second a is a repeat
        [("a", "3", on(29)), ("b", "2", on(30.1))],  # still within 30 days of the first; b is free again
        [("a", "4", on(31)), ("c", "1", on(90))],
        [("b", "3", on(95))],
    ]
    got = run(rocks, tmp_path, batches, "key string, id string, at long", rules.suppress_repeats, "repeats")
    assert sorted((r.key, r.id) for r in got if r.repeat) == [("a", "2"), ("a", "3")] and len(got) == 8


def test_application_states_equal_the_batch_state(rocks, tmp_path):
    from rowloom.operators.tracker import current_state

    schema = "id long, application_id long, kind string, value string, at timestamp"
    batches = [
        [(1, 1, "stage", "applied", at(0)), (3, 2, "stage", "screen", at(1)), (2, 2, "follow_up_set", "20460", at(1))],
        [(5, 1, "stage", "rejected", at(30)), (4, 1, "stage", "screen", at(40)), (6, 2, "follow_up_done", "", at(40)), (7, 3, "follow_up_set", "20470", at(41))],
        [(8, 2, "stage", "offer", at(60)), (9, 3, "stage", "interview", at(61))],
    ]
    src = tmp_path / "in"
    src.mkdir()
    seen = {}
    for rows in batches:
        rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        states = rules.application_states(rules.landed(rocks, str(src), schema))
        each = lambda batch, _: seen.update({r.application_id: (r.stage, r.stage_at, r.follow_up_day) for r in batch.collect()})
        states.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    day = lambda t: (t - datetime.datetime(1970, 1, 1)).days
    events = rocks.createDataFrame([(i, a, k, v, day(t), day(t)) for rows in batches for i, a, k, v, t in rows], "id long, application_id long, kind string, value string, at_day long, made_day long")
    want = current_state(rocks.createDataFrame([(1, 0), (2, 0), (3, 0)], "id long, applied_day long"), events, day(START))
    assert {k: (v[0], day(v[1]), v[2]) for k, v in seen.items()} == {r.id: (r.stage, r.stage_day, r.follow_up_day) for r in want.collect()}


def test_verdicts_are_appended_once(spark, tmp_path):
    schema = "id long, job_id string, verdict string, received_at long, message_id string"
    frames = [spark.createDataFrame([(i, f"j{i % 3}", "good", i, f"m{i}") for i in ids], schema) for ids in ([1, 2, 3], [3, 4], [5, 1, 5])]
    table = str(tmp_path / "verdicts")
    each = rules.append_new_verdicts(table, buckets=4)
    for k, number in enumerate((0, 1, 1, 0, 2)):
        each(frames[number], k)
    stored = spark.read.parquet(table)
    assert sorted(r.message_id for r in stored.collect()) == ["m1", "m2", "m3", "m4", "m5"]
    files = len(stored.inputFiles())
    each(frames[0], 9)  # a replay leaves no file behind
    assert len(spark.read.parquet(table).inputFiles()) == files
    rules.compact_verdicts(spark, table, f"{table}-2")
    assert spark.read.parquet(f"{table}-2").count() == 5
