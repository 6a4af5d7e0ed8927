"""Phrase collocations by set-oriented relational mining (SETM).

The relation of occurrences (document, position, group) is persisted for each length, bucketed by document and sorted by
position. A phrase of k + 1 words occurs where two phrases of k words do, the second one word on; so the relation of
length k is merge-joined with itself by document and adjacent position, the pairs are counted, and the relation is
semi-joined with the frequent ones before it is extended again. A border between pieces holds a position of its own, so
that words on either side of it aren't adjacent.

* Shuffles: documents once, to their bucket; after that the joins of occurrences run inside buckets, and what moves are
  counts, combined by each task first. A word pair that a third of all rows hold is one row of each task.
* Frequent groups go to every executor where there are few, counted before; beyond that they are joined by a shuffle that
  deals frequent keys to several tasks (graph.join_one).
* A bucket holds whole documents: about BUCKET_WORDS words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.operators.graph import join_one, shared_folder

from .common import text_of, written

LEAST, MOST_WORDS, TOP, COVERED = 10, 3, 2_000, 50
BUCKET_WORDS, MOST_BUCKETS = 1_000_000, 50_000
#: Groups up to this number are sent to every executor (about 60 bytes each, by one integer).
BROADCAST_GROUPS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BORDERS = ".,;:!?\n\x0b\x0c\r"


def tokens(text) -> F.Column:
    """The words of a text in order, with a line feed for every border between pieces."""
    plain = F.translate(text, UPPER + BORDERS + "\t", LOWER + "\n" * len(BORDERS) + " ")
    return F.array_remove(F.split(F.replace(plain, F.lit("\n"), F.lit(" \n ")), " "), "")


def _exploded(docs: DataFrame) -> DataFrame:
    """lang, doc, at, word of every word; borders count in at."""
    return docs.select("lang", "doc", F.posexplode(tokens(F.col("text"))).alias("at", "word")).where("word <> '\n'")


def _semi(rows: DataFrame, groups: DataFrame, key: list[str], limit: int) -> tuple[DataFrame, bool]:
    """rows of the frequent groups, with the group's columns; and whether they stayed in their task."""
    if groups.count() <= limit:
        return rows.join(F.broadcast(groups), key), True
    return join_one(written(rows), groups, key), False


@contextmanager
def _in_buckets(spark: SparkSession) -> Iterator[None]:
    """While plans are made in here, tables of the same buckets are joined where they are, also by more columns than theirs."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Relations:
    """Occurrence tables of one run: bucketed by document, sorted by position, in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.run, self.names = spark, buckets, uuid.uuid4().hex, []

    def keep(self, rows: DataFrame, in_place: bool) -> DataFrame:
        name = f"occurrences_{len(self.names) + 1}_{self.run}"
        dealt = rows if in_place else rows.repartition(self.buckets, "doc")
        path = f"{shared_folder(self.spark)}/{name}"
        dealt.write.format("parquet").bucketBy(self.buckets, "doc").sortBy("doc", "at").option("path", path).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        """Takes the tables out of the catalogue; their files stay in the shared folder."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE {name}")


def _adjacent(rows: DataFrame, groups: int) -> DataFrame:
    """doc, at, key: a group and the one that starts one word on, as one number (ids are below groups)."""
    second = rows.select("doc", (F.col("at") - 1).alias("at"), F.col("id").alias("tail"))
    return rows.hint("merge").join(second, ["doc", "at"]).select("doc", "at", (F.col("id") * groups + F.col("tail")).alias("key"))


def _numbered(groups: DataFrame) -> tuple[DataFrame, int]:
    """groups with an id counting from 0, and their number. Rows are numbered in each task, the tasks' sizes are added up."""
    own = written(groups.withColumn("_m", F.monotonically_increasing_id()))
    part, ahead, offsets = F.shiftright("_m", 33), 0, []
    for r in own.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect():
        offsets.append((r["_p"], ahead))
        ahead += r.n
    if ahead >= 1 << 31:
        raise ValueError("more than 2^31 frequent groups; pairs of them don't fit one number")
    ahead_of = own.sparkSession.createDataFrame(offsets, "_p long, _o long")
    placed = own.withColumn("_p", part).join(F.broadcast(ahead_of), "_p").withColumn("id", F.col("_o") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    return written(placed.drop("_m", "_p", "_o")), ahead


def frequent_phrases(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, limit: int = BROADCAST_GROUPS) -> tuple[DataFrame, DataFrame]:
    """Of docs (text, lang): (lang, words, phrase, a) of all phrases of up to most_words words that occur least times or
    more in their language, single words included, and (lang, n) of all words."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"), F.monotonically_increasing_id().alias("doc"))
    counts = written(_exploded(own).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("a")))
    totals = written(counts.groupBy("lang").agg(F.sum("a").alias("n")))
    words = sum(r.n for r in totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect())
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // BUCKET_WORDS)))
    groups, size = _numbered(counts.where(F.col("a") >= least).select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a"))
    found = [groups.select("lang", F.lit(1).alias("words"), "phrase", "a")]
    relations = _Relations(spark, buckets)
    rows, placed = _semi(_exploded(own.repartition(buckets, "doc")), groups.select("lang", F.col("phrase").alias("word"), "id"), ["lang", "word"], limit)
    for k in range(2, most_words + 1):
        with _in_buckets(spark):
            pairs = _adjacent(relations.keep(rows.select("doc", "at", "id"), placed), size)
            counted, more = _numbered(pairs.groupBy("key").agg(F.count(F.lit(1)).alias("a")).where(F.col("a") >= least))
            if k < most_words:
                rows, placed = _semi(pairs, counted.select("key", "id"), ["key"], limit)
        ends = counted.select("id", "a", F.expr(f"key div {size}").alias("head"), (F.col("key") % size).alias("tail"))
        heads = join_one(written(ends), groups.select(F.col("id").alias("head"), "lang", "phrase"), ["head"])
        named = join_one(written(heads), groups.select(F.col("id").alias("tail"), "last"), ["tail"])
        groups, size = written(named.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a")), more
        found.append(groups.select("lang", F.lit(k).alias("words"), "phrase", "a"))
    relations.forget()
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    return written(phrases), totals


def _cut(first: int | str, length: int | str) -> F.Column:
    return F.expr(f"array_join(slice(w, {first}, {length}), ' ')")


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, covered: int = COVERED, top: int = TOP, limit: int = BROADCAST_GROUPS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two to most_words words.

    Text: A to Z as a to z; pieces end at [.,;:!?] and U+000A to U+000D, words at space and tab. Counts are by language, a null
    one being und, and take in all occurrences, overlapping ones too; a null text has none. A phrase of a occurrences, least or
    more, is cut after each of its words but the last, into parts of l and r occurrences; its score is the lowest
    floor(1000000 a a / (l r)) of its cuts, of equal ones that of the shortest first part. Phrases inside a longer one that has
    covered per cent of their occurrences or more are left out. The top best of each language are ranked by score, a and
    phrase. Products are decimals of 38 digits, exact up to five thousand million million occurrences.

    Extra columns of docs are ignored, repeated rows count each, equal scores are told apart by a and by the bytes of the
    phrase, an empty table gives an empty result.
    """
    phrases, totals = frequent_phrases(docs, most_words, least, limit)
    counts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    asked = phrases.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = asked.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).select(
        "lang", "phrase", "words", "a", "k", F.struct("lang", _cut(1, "k").alias("part")).alias("first"), F.struct("lang", _cut("k + 1", "words - k").alias("part")).alias("rest")
    )
    left = join_one(written(cuts), counts.select(F.struct("lang", "part").alias("first"), F.col("f").alias("l")), ["first"])
    both = join_one(written(left), counts.select(F.struct("lang", "part").alias("rest"), F.col("f").alias("r")), ["rest"])
    big = lambda c: f"cast({c} AS decimal(19, 0))"
    score = F.expr(f"(1000000 * {big("a")} * {big("a")}) div ({big("l")} * {big("r")})")
    scored = both.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("s"))
    inner = asked.where("words > 2").select("lang", "a", "w", "words", F.explode(F.expr("sequence(2, words - 1)")).alias("size"))
    inner = inner.withColumn("from", F.explode(F.expr("sequence(1, words - size + 1)"))).groupBy("lang", _cut("from", "size").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    best = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    best = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)")).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT *, row_number() OVER () AS doc FROM documents)
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(w[:c], ' ') AS first, array_to_string(w[c + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, c.c, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), longer AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE k = 3
), kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = s.lang AND x.phrase = s.phrase AND 100 * x.a >= 50 * s.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
