"""The forest of hash prefixes against brute force: recall, exact scores, copies, ties, odd rows."""

import numpy as np
import pytest

from rowloom.llm import prefix_forest as pf, queries


def every(c):
    return c % 50 == 0


def brute(ids, v, asked, k):
    """query -> the k nearest (id, cosine), ties to the smaller id."""
    out = {}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in np.flatnonzero(asked):
        score = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def frame(spark, ids, v):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("kind", ["spread", "clusters"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    n, dim = 3_000, 16
    v = rng.standard_normal((n, dim)) if kind == "spread" else rng.standard_normal((60, dim))[rng.integers(60, size=n)] + 0.1 * rng.standard_normal((n, dim))
    ids, report = np.arange(n), {}
    got = found(pf.nearest(frame(spark, ids, v), every, report=report))
    want = brute(ids, v, ids % 50 == 0, 5)
    assert recall(got, want) >= 0.9
    assert all(len(x) == 5 for x in got.values()) and got.keys() == want.keys()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert all(abs(s - unit[q] @ unit[i]) < 1e-12 for q, x in got.items() for i, s in x)
    if kind == "clusters":
        assert report["candidates"] < n / 2  # close neighbours need few candidates


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    assert recall(found(queries.queries()["op13_nearest"](spark, sf)), brute(ids, v, ids % 50 == 0, 5)) >= 0.9


def test_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((400, 8))
    v[100:300] = v[100]  # a vector that half of all rows share, queries among them
    v[350], v[351] = 2 * v[50], v[50] / 4  # other lengths of one direction: the same cosine to the last bit
    ids = np.arange(400)
    got = found(pf.nearest(frame(spark, ids, v), every))
    for q in range(100, 300, 50):
        assert [i for i, _ in got[q]] == [i for i in range(100, 106) if i != q][:5]
    assert [i for i, _ in got[50]][:2] == [350, 351] and [i for i, _ in got[350]][:2] == [50, 351]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [None, 1.0]), (None, [1.0, 0.0]), (50, [1e200, 1e200]), (100, [1.0, 2.0, 3.0]), (1, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, point string, score int")
    got = found(pf.nearest(df, every))
    assert [i for i, _ in got[0]] == [2, 50, 1] and [i for i, _ in got[50]] == [2, 0, 1]
    assert got[50][0][1] == pytest.approx(1.0) and 100 not in got  # no other vector of three components
    assert pf.nearest(df.where("false"), every).count() == 0
    assert pf.nearest(df.where("vec_id = 1"), every).count() == 0


def test_hash_strings_share_prefixes_by_angle():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((200, 12))
    near, far = v + 0.05 * rng.standard_normal(v.shape), rng.standard_normal(v.shape)
    common = lambda a, b: np.mean([pf.BITS - int(x).bit_length() for x in (pf.hash_strings(a) ^ pf.hash_strings(b)).ravel()])
    assert common(v, near) > 10 * max(1, common(v, far)) / 2 and (pf.hash_strings(v) == pf.hash_strings(v * 1e-200)).all()
