"""Collocations against SQL on odd rows and hot words, with groups sent to all executors and with groups shuffled."""

import duckdb
import pytest

from rowloom.llm import collocations as co


def rows(df):
    return sorted(tuple(r) for r in df[["lang", "rank", "phrase", "a", "l", "r", "n", "score"]].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def docs(spark):
    hot = "The quick  brown\tfox, jumps. the the the the"
    texts = [(hot, "en")] * 40 + [("alpha beta gamma delta " * 15, "de"), ("Alpha beta gamma! alpha beta", "de"), ("É É é é " * 12, None), ("a b a c " * 20, "und")]
    texts += [(None, "en"), ("", "en"), (" \t ", None), (",,;;..", "en"), ("x" * 3_000, "fr"), (f"{hot} " * 500, "en"), ("one\x0btwo\x0cone two\rone two", "fr")]
    texts += [("new york city " * 3 + "new york state", "en")] * 6
    return spark.createDataFrame([(t, lang, 1, "w") for t, lang in texts], "text string, lang string, id int, phrase string")


@pytest.mark.parametrize("limit", [co.BROADCAST_GROUPS, 0])
def test_equals_sql(docs, limit):
    con = duckdb.connect()
    con.register("documents", docs.select("text", "lang").toPandas())
    want = rows(con.execute(co.SQL).fetchdf())
    assert rows(co.collocations(docs, limit=limit).toPandas()) == want and len(want) > 10


def test_empty_and_longer_phrases(docs):
    assert co.collocations(docs.where("false")).count() == 0
    longer = {r.phrase: r for r in co.collocations(docs, most_words=5).collect()}
    # every shorter phrase of the line is inside the longest one
    assert "quick brown fox" not in longer and longer["the the quick brown fox"].a == 499
    assert longer["alpha beta gamma delta alpha"].a == 14


def test_exact_beyond_64_bits(spark):
    phrases = spark.createDataFrame([(3_000_000_000, 4_000_000_000)], "a long, l long")
    score = phrases.selectExpr("(1000000 * cast(a AS decimal(19, 0)) * cast(a AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(l AS decimal(19, 0))) AS s").first().s
    assert score == 10**6 * 3_000_000_000**2 // 4_000_000_000**2
