"""Periodic runs against every stretch tried one by one, and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import periodic_runs as pr

LONG = " ".join(["a b c"] * 30_000)


def plain(words, least, periods):
    """All runs by comparing words at every distance."""
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i < n - q:
            k = i
            while k < n - q and words[k] == words[k + q]:
                k += 1
            length = k - i + q
            smaller = any(all(words[j] == words[j + p] for j in range(i, i + length - p)) for p in range(1, q))
            if k > i and length >= max(least, periods * q) and not smaller:
                out.append((i, length, q))
            i = k + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("letters, least", [(2, 6), (2, 24), (3, 3), (1, 4)])
def test_equals_every_stretch_tried(letters, least):
    rng = random.Random(letters * 100 + least)
    docs = [[rng.randrange(letters) for _ in range(rng.randrange(60))] for _ in range(60)]
    for _ in range(60):  # periodic stretches of odd lengths between other words
        root = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
        tail = root * rng.randrange(2, 6)
        docs.append([rng.randrange(letters) for _ in range(rng.randrange(9))] + tail[: rng.randrange(len(tail) + 1)] + [rng.randrange(letters) for _ in range(rng.randrange(9))])
    sizes = [len(d) for d in docs]
    flat, owner = np.array([w for d in docs for w in d]), np.repeat(np.arange(len(docs)), sizes)
    start, length, period = pr.find_runs(flat, owner, least)
    begins = np.cumsum(sizes) - sizes
    for k, d in enumerate(docs):
        own = owner[start] == k
        got = list(zip((start[own] - begins[k]).tolist(), length[own].tolist(), period[own].tolist(), strict=True))
        assert got == plain(d, least, 3), d


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        pr.find_runs(np.zeros(3, int), np.zeros(3, int), periods=2)


def test_odd_rows(spark):
    texts = [None, "", " \n", "w", "x " * 23, "x " * 24, LONG, "a b " * 12 + "end", "a b " * 12 + "end", "é 🎉\x0b" * 12]
    rows = [(i, t, "keep", "r", 7) for i, t in enumerate(texts)] + [(None, "y " * 30, "k", "r", 7), (9, texts[9], "keep", "r", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, runs string, _w int")
    got = {(r.doc_id, r.extra): r for r in pr.periodic_runs(docs, keep=("doc_id", "extra", "runs")).collect()}
    runs = {k: [tuple(x) for x in r.runs] for k, r in got.items()}
    assert all(runs[i, "keep"] == [] for i in range(5))
    assert runs[5, "keep"] == [(0, 24, 1)] and got[5, "keep"].collapsed == "x"
    assert runs[6, "keep"] == [(0, 90_000, 3)] and got[6, "keep"].collapsed == "a b c"
    assert runs[7, "keep"] == [(0, 24, 2)] and got[7, "keep"].collapsed == "a b end"
    assert runs[9, "keep"] == [(0, 24, 2)] and got[9, "keep"].collapsed == "é 🎉"
    assert runs[None, "k"] == [(0, 30, 1)]
    out = pr.digests(pr.periodic_runs(docs))
    assert out.count() == docs.count() and pr.digests(pr.periodic_runs(docs.where("false"))).count() == 0
    none = out.where("doc_id = 0").first()
    assert (none.n_runs, none.start, none.exponent_milli) == (0, None, None) and none.runs_sha256 == hashlib.sha256(b"").hexdigest() == none.collapsed_sha256


def test_planted_tails(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 40 + id % 50), i -> concat('w', i)), ' ')").alias("text"))
    planted = pr.plant(docs).where("crc32(cast(cast(doc_id AS string) AS binary)) % 10 = 0")
    found = pr.periodic_runs(planted)
    assert planted.count() > 15 and pr.plant(docs).count() == 300
    for r in found.collect():
        import zlib

        g, n = zlib.crc32(str(r.doc_id).encode()) // 10, r.n_words
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        want = [(a, n - a, p)] if n - a >= max(24, 3 * p) else []
        assert [tuple(x) for x in r.runs] == want
