"""Quality rules: cross-document line frequency, with DataFrame functions only.

Lines are normalised and hashed; for every host the distinct documents that hold a line are counted; lines above a limit
are taken out, and documents that are left with too little are rejected. Base rules on words come first.

* Texts are read once: a row's figures and the hashes of its lines are written, and all that follows works on those.
* Hot lines and hosts: a task reduces its lines to one row for each (host, line, document) before the shuffle, and that
  shuffle goes by document as well, so that a line which a third of the documents share is spread; only counts meet.
  Where lines are joined to the frequent ones, those of a hot line are dealt to several tasks (graph.join_one).
* The limit is a number of documents by one formula at every size: a floor, or a share of the host's documents if more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.graph import join_one

from .common import BROADCAST_IDS, SPACE, text_of, written

#: A line is boilerplate of a host if more than this many of its distinct documents hold it, and more than one in so many
#: of all its documents: a low floor, which hosts of a few documents reach too, and a share, by which ordinary short lines
#: of a host with many documents stay.
MAX_DOCUMENTS, ONE_IN = 10, 1_000
#: A document is depleted with fewer words left than this, or than this share of its words.
MIN_WORDS_LEFT, MIN_PERCENT_LEFT = 20, 30
#: Lines of one text that a task takes at least when lines are joined to the frequent ones.
LINE_ROWS = 1_000
SYMBOLS = "#*$%&|<>"
#: What a word has.
WORD = r"[^\x20\x09-\x0D]"


def words_of(text: F.Column) -> F.Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def normal_lines(text: F.Column) -> F.Column:
    """The lines of a text in lower case, digits as 0, white space as one space, none at the ends."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(text), "[1-9]", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(whole, "\n"), lambda x: F.trim(x))


def with_repeated_words(df: DataFrame, words: str, into: str) -> DataFrame:
    """df with the number of words that lie in a 3-word window found twice or more among the words.

    Where all hashes of windows differ, no window repeats; else the windows are sorted and compared with their
    neighbours. Each step is a column of its own, so that none is computed twice.
    """
    n = F.size(words)
    from_word = lambda i: F.slice(words, F.lit(i), F.greatest(n - 2, F.lit(0)))
    windows = F.zip_with(from_word(1), F.zip_with(from_word(2), from_word(3), lambda b, c: F.concat(b, F.lit(" "), c)), lambda a, bc: F.concat(a, F.lit(" "), bc))
    df = df.withColumn("_g", windows).withColumn("_h", F.transform("_g", lambda w: F.xxhash64(w)))
    number = F.transform("_g", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    ordered = F.sort_array(F.zip_with("_h", number, lambda h, g: F.struct(h.alias("h"), g["w"].alias("w"), g["i"].alias("i"))))
    df = df.withColumn("_o", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered))
    m = F.size("_o") - 1
    pairs = F.zip_with(F.slice("_o", F.lit(1), m), F.slice("_o", F.lit(2), m), lambda a, b: F.when((a["h"] == b["h"]) & (a["w"] == b["w"]), F.array(a["i"], b["i"])))
    df = df.withColumn("_at", F.when(F.col("_o").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))))
    k = F.greatest(F.size("_at") - 1, F.lit(0))
    steps = F.zip_with(F.slice("_at", F.lit(1), k), F.slice("_at", F.lit(2), k), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x) + 3
    return df.withColumn(into, F.when(F.size("_at") > 0, covered).otherwise(0).cast("long")).drop("_g", "_h", "_o", "_at")


def base_rules(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every row.

    Kept columns may have any names; one with the name of a figure gives way to it.
    """
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    keep = tuple(c for c in dict.fromkeys(keep) if c not in figures)
    t = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0)]).alias("_kept"), text_of().alias("_t"))
    t = t.select("_kept", "_t", words_of(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_l"))
    t = with_repeated_words(t, "_w", "n_repeat_words")
    out = t.select(
        "_kept",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(*[F.col(f"_kept.`{c}`").alias(c) for c in keep], *figures[:-1], failed.alias("base_failed"))


def line_hashes(text: F.Column) -> F.Column:
    """(hash, words) of every normalised line with a word, in order."""
    found = F.filter(normal_lines(text), lambda x: x != "")
    return F.transform(found, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words")))


def measured(docs: DataFrame, host: str = "source", figures: bool = True) -> DataFrame:
    """Written: a number for each row of docs (row), doc_id, host (null: empty), a hash of its text (key), its line_hashes
    (lines), and its base figures if wanted."""
    own = docs.select("doc_id", "text", F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("host"))
    own = own.withColumn("lines", line_hashes(text_of())).withColumn("key", F.xxhash64("text"))
    own = base_rules(own, ("doc_id", "host", "key", "lines")) if figures else own.drop("text")
    return written(own.withColumn("row", F.monotonically_increasing_id()))


def taken_lines(rows: DataFrame, max_documents: int = MAX_DOCUMENTS, one_in: int = ONE_IN) -> DataFrame:
    """row, doc_id, host, key, line and words of the lines of measured() rows that are boilerplate for their host: more than
    max_documents of its distinct documents hold them, and more than one in one_in of its documents. A null doc_id is
    no document, but loses such lines like any other."""
    lines = rows.select("row", "doc_id", "host", "key", F.explode("lines").alias("x")).select("row", "doc_id", "host", "key", "x.line", "x.words")
    many = lines.groupBy("host", "line").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") > max_documents)
    sizes = rows.groupBy("host").agg(F.count("doc_id").alias("documents"))
    frequent = join_one(written(many), sizes, ["host"]).where(F.col("n") * one_in > F.col("documents")).select("host", "line")
    return join_one(lines, written(frequent), ["host", "line"], LINE_ROWS)


def clean_texts(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS, one_in: int = ONE_IN) -> DataFrame:
    """For every row of docs (doc_id, text, host): the base figures of its text, clean_text, the text of its lines that are
    not boilerplate of its host, in their order and as they were, n_words_left, base_failed and kept.

    Only hashes of lines are joined to find what to take out. Documents without such lines pass through where they are; the
    texts of the others are joined to their few. Lines without a word stay. Null texts are empty; a null host is a host of
    its own; rows repeated under one doc_id, null among them, count once for a line's documents and each loses its own
    lines. An empty table gives an empty result.
    """
    rows = measured(docs, host, figures=False)
    gone = written(taken_lines(rows, max_documents, one_in).groupBy("doc_id", "host", "key").agg(F.collect_set("line").alias("_gone")))
    own = docs.select("doc_id", "text", F.coalesce(F.col(f"`{host}`"), F.lit("")).alias("host")).withColumn("key", F.xxhash64("text"))
    # keys of texts are spread evenly, null doc_ids among them; a text that shares its key by chance is only looked at
    keys = written(gone.select("key").distinct())
    few = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    touched = own.join(few, "key", "left_semi").join(gone.withColumnsRenamed({"doc_id": "_id", "host": "_host"}), "key").where(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")))
    pair = F.zip_with(F.split(text_of(), "\n"), normal_lines(text_of()), lambda t, n: F.struct(t.alias("t"), n.alias("n")))
    left = F.filter(pair, lambda x: (x["n"] == "") | ~F.array_contains("_gone", F.xxhash64(x["n"])))
    cleaned = touched.select("doc_id", "text", F.array_join(F.transform(left, lambda x: x["t"]), "\n").alias("clean_text"))
    ids = gone.select("key", F.col("doc_id").alias("_id"), F.col("host").alias("_host"))
    same = (own["key"] == ids["key"]) & own["doc_id"].eqNullSafe(F.col("_id")) & (own["host"] == F.col("_host"))
    rest = own.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, same, "left_anti").select("doc_id", "text", text_of().alias("clean_text"))
    out = base_rules(cleaned.unionByName(rest), ("doc_id", "clean_text")).withColumn("n_words_left", F.size(words_of(F.col("clean_text"))).cast("long"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted(F.col("n_words"), F.col("n_words_left")))


def depleted(words: F.Column, left: F.Column) -> F.Column:
    return (left < MIN_WORDS_LEFT) | (100 * left < MIN_PERCENT_LEFT * words)


def quality_rules(docs: DataFrame, host: str = "source", max_documents: int = MAX_DOCUMENTS, one_in: int = ONE_IN) -> DataFrame:
    """For every row of docs (doc_id, text, host): the base figures, n_boilerplate_words, base_failed and kept.

    Null texts have no words and fail; a null host is a host of its own. Rows repeated under one doc_id, null among them,
    count once for a line's documents, and each has its own figures and verdict. Extra columns are ignored; an empty
    table gives an empty result. Texts of any length: all steps are linear in the words, but for sorting.
    """
    rows = measured(docs, host)
    taken = taken_lines(rows, max_documents, one_in).groupBy("row").agg(F.sum("words").cast("long").alias("n_boilerplate_words"))
    out = rows.drop("host", "key", "lines").join(taken, "row", "left").drop("row").withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0).cast("long")))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted(F.col("n_words"), left))


_FIGURES = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, host, trim(regexp_replace(translate(lower(x), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS x FROM d)),
frequent AS (SELECT host, line FROM lines WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT doc_id) > {MAX_DOCUMENTS}
  AND count(DISTINCT doc_id) * {ONE_IN} > (SELECT count(doc_id) FROM d WHERE d.host = lines.host)),
taken AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM lines JOIN frequent USING (host, line) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(taken.n, 0) AS BIGINT) AS n_boilerplate_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN taken USING (doc_id))
"""
_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
SQL = f"""{_FIGURES}
SELECT *, {_FAILED} AS base_failed, NOT ({_FAILED}) AND n_words - n_boilerplate_words >= {MIN_WORDS_LEFT}
  AND 100 * (n_words - n_boilerplate_words) >= {MIN_PERCENT_LEFT} * n_words AS kept
FROM f
"""
#: clean_texts(): lines of the text that aren't frequent for the host, put together again.
CLEAN_SQL = rf"""{_FIGURES},
numbered AS (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS x, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d),
cleaned AS (SELECT n.doc_id, string_agg(n.x, chr(10) ORDER BY n.i) AS clean_text FROM numbered n LEFT JOIN frequent q
  ON q.host = n.host AND q.line = trim(regexp_replace(translate(lower(n.x), '123456789', '000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) WHERE q.line IS NULL GROUP BY n.doc_id),
g AS (SELECT f.* EXCLUDE (n_boilerplate_words), coalesce(clean_text, '') AS clean_text,
  CAST(len(list_filter(regexp_split_to_array(coalesce(clean_text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_words_left FROM f LEFT JOIN cleaned USING (doc_id))
SELECT *, {_FAILED} AS base_failed, NOT ({_FAILED}) AND n_words_left >= {MIN_WORDS_LEFT} AND 100 * n_words_left >= {MIN_PERCENT_LEFT} * n_words AS kept FROM g
"""
