"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, at least as long as asked, that no neighbouring word
extends. For every power of two m the dictionary names the stretches of m words (basic factors), each from two names of
the level below, so that equal stretches have equal names. Where a factor occurs again within a window of twice its
length, that is at most m words on, its occurrences form arithmetic progressions, and their difference is a proposed
period. Progressions of the same difference that start at neighbouring words extend each other to one stretch.

* Each period is taken from one level, m/2 < q <= m, which leaves no run twice. In a run of at least three periods a
  factor of m >= q words recurs exactly q words on, as the run's period is its smallest; so each word from the run's
  first on starts such a progression, words before it and after it don't, and the joined stretch is the whole run.
* A difference proposed in this way is the smallest period of its stretch: a smaller one would divide it, and the factor
  would recur earlier.
* A factor that doesn't recur within its document is dropped at once, and so are the longer ones that hold it: most
  texts are done after a few levels. All documents of an Arrow slice are named in the same arrays.

Documents are independent of each other: no shuffle, and a document's work is n log n however its words repeat.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, map_texts, text_of

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_PERIODS = 24, 3
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(words: np.ndarray, document: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in words (numbers), by start and period; document (sorted) bounds the runs.

    periods is three at least, which the proof above needs.
    """
    if periods < 3:
        raise ValueError("runs have three periods at least")
    empty = np.zeros(0, np.int64)
    n = len(words)
    if not n:
        return empty, empty, empty
    most = int(np.bincount(document).max())
    at = np.arange(n, dtype=np.int64)
    pair = document.astype(np.int64) * (int(words.max()) + 1) + words
    found, m = [], 1
    while True:
        # names of the factors of m words at the positions at, for those alone that occur more than once
        _, name, times = np.unique(pair, return_inverse=True, return_counts=True)
        keep = times[name] > 1
        at, name = at[keep], name[keep]
        if not len(at):
            break
        order = np.argsort(name, kind="stable")
        here, there = at[order[:-1]], at[order[1:]]
        gap = np.where(name[order[:-1]] == name[order[1:]], there - here, n)
        near = (gap <= m) & (2 * gap > m)
        if near.any():
            found.append(_joined(here[near], gap[near], m, n, least, periods))
        if periods * (m + 1) > most:
            break
        # factors of 2m words: two of m that stand side by side
        second = np.searchsorted(at, at + m)
        second[second == len(at)] = 0
        both = at[second] == at + m
        pair = name[both].astype(np.int64) * (int(name.max()) + 1) + name[second[both]]
        at, m = at[both], 2 * m
        if not len(at):
            break
    if not found:
        return empty, empty, empty
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _joined(at: np.ndarray, gap: np.ndarray, m: int, n: int, least: int, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of positions at whose factors of m words recur gap words on, where they are long enough."""
    key = np.sort(gap * (2 * n) + at)
    edge = np.flatnonzero(np.diff(key) != 1)
    first, last = key[np.append(0, edge + 1)], key[np.append(edge, len(key) - 1)]
    period, start = first // (2 * n), first % (2 * n)
    length = last - first + m + period
    long = length >= np.maximum(least, periods * period)
    return start[long], length[long], period[long]


def runs_of_texts(texts: list[str], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[list]:
    """For every text its number of words, its runs and the text without the words that repeat a run's first period."""
    words = [t.encode().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    every = [w for doc in words for w in doc]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    if not every:
        return [sizes, [[] for _ in texts], ["" for _ in texts]]
    document = np.repeat(np.arange(len(texts)), sizes)
    start, length, period = find_runs(pd.factorize(np.array(every, object))[0], document, least, periods)
    cover = np.zeros(len(every) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    owner = document[start]
    runs: list[list[dict]] = [[] for _ in texts]
    for d, s, k, p in zip(owner.tolist(), (start - begins[owner]).tolist(), length.tolist(), period.tolist(), strict=True):
        runs[d].append({"start": s, "length": k, "period": p})
    collapsed = []
    for doc, a, b, has in zip(words, begins, ends, runs, strict=True):
        collapsed.append(b" ".join([w for w, k in zip(doc, kept[a:b].tolist(), strict=True) if k] if has else doc).decode())
    return [sizes, runs, collapsed]


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """keep, n_words, runs (array of start, length, period, by start and period) and collapsed (the text without the words
    that a run repeats after its first period, joined by one space) of every row.

    Words are what stands between U+0020 and U+0009 to U+000D. Null counts as empty: no words, no runs, an empty collapsed
    text. Repeated rows are read each; kept columns may have any names, one with the name of a result gives way to it; an
    empty table gives an empty result. Texts are taken in slices of a few MB, a longer one alone, and whole.
    """
    fields = [("n_words", pa.int64(), "long"), ("runs", RUNS, "array<struct<start: long, length: long, period: long>>"), ("collapsed", pa.string(), "string")]
    return map_texts(docs, list(keep), text, fields, lambda texts: runs_of_texts(texts, least, periods))


def plant(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, with a periodic tail in every tenth text by the hash of its doc_id, as the contract of op11
    says; a null doc_id has no hash and keeps its text."""
    own = docs.select("doc_id", "text").withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("_g", F.expr("_h div 10"))
    words = F.when(F.col("_h") % 10 == 0, F.array_remove(F.split(text_of(), f"{SPACE}+"), ""))
    own = own.withColumn("_w", words).withColumn("_n", F.size("_w").cast("long")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    own = own.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    tail = F.expr("transform(sequence(_a, _n - 1), i -> _w[int(_a + (i - _a) % _p)])")
    planted = F.concat_ws(" ", F.slice("_w", F.lit(1), F.col("_a").cast("int")), tail)
    return own.withColumn("text", F.when(F.col("_n") > 0, planted).otherwise(F.col("text"))).select("doc_id", "text")


def digests(found: DataFrame) -> DataFrame:
    """The columns of the contract from runs and collapsed: counts, the run with most periods, and the digests."""
    better = F.expr(
        "aggregate(runs, cast(null AS struct<start: bigint, length: bigint, period: bigint>), (best, r) -> "
        "CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)"
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("best", better).select(
        *[c for c in found.columns if c not in ("runs", "collapsed", "n_words")],
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The same by joins of equal words at every distance: islands of neighbouring pairs, without those of a multiple of a period.
SQL = r"""
WITH d AS (
  SELECT doc_id, list_reduce(list_prepend(4294967295, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '') IF c <> '']),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))) AS crc,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), h AS (SELECT doc_id, w, len(w) AS n, xor(crc, 4294967295) AS h FROM d
), a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h
), p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a
), words AS (
  SELECT doc_id, n, i, CASE WHEN a IS NULL OR i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM p)
), same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q AND s.q % t.q = 0 AND t.start <= s.start AND t.start + t.length >= s.start + s.length)
), best AS (
  SELECT doc_id, start, length, q FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / q DESC, start, q) AS k FROM runs) WHERE k = 1
), texts AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS t FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY w.doc_id
)
SELECT p.doc_id, coalesce(x.n_runs, 0) AS n_runs, b.start, b.length, b.q AS period, 1000 * b.length // b.q AS exponent_milli,
       sha256(coalesce(x.lines, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM p LEFT JOIN texts x USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
